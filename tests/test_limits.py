"""No rule changes with the size of what it looks at: data beyond every former limit."""

from math import cos, radians

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trenchline.operators import gates, grouping, network, routes
from trenchline.sources import bore_logs, stores


def catalog_of(spark, lines):
    """lines: {route: [(lat, lon), ...]}."""
    rows = [("p", k, i, a, b) for k, v in lines.items() for i, (a, b) in enumerate(v)]
    vertices = spark.createDataFrame(rows, "project_id string, route_id string, idx int, lat double, lon double")
    meta = spark.createDataFrame([("p", k, i, "Underground Cable", "Plant") for i, k in enumerate(lines)],
                                 "project_id string, route_id string, doc_pos int, route_name string, source_folder string")
    return routes.build_catalog(vertices, meta)


@pytest.mark.parametrize("lat", [0.0, 30.0, 69.0, 85.0])
def test_many_routes_at_one_place(spark, lat):
    lon = 0.002 / cos(radians(lat))
    lines = {f"in{i:02d}": [(lat + 0.001 * (i + 1), -lon), (lat, 0.0)] for i in range(14)} | {"out": [(lat, 0.000002), (lat, lon)]}
    catalog = catalog_of(spark, lines)
    bearings = routes.terminal_bearings(catalog)
    found = {r.route_id: r for r in gates.neighbours(catalog, bearings).collect()}
    assert found["out"].n_up == 14 and len(found["out"].up) == gates.NEIGHBOURS
    assert all(found[f"in{i:02d}"].n_down == 1 and [n.neighbour for n in found[f"in{i:02d}"].down] == ["out"] for i in range(14))
    assert [found[f"in{i:02d}"].down[0].back for i in range(14)] == [i < 10 for i in range(14)]
    everything = {r.route_id: r for r in gates.neighbours(catalog, bearings, keep=None).collect()}
    assert len(everything["out"].up) == 14


def test_a_closed_route_is_not_its_own_neighbour(spark):
    ring = [(30.0, 0.0), (30.001, 0.0), (30.001, 0.001), (30.0, 0.0)]
    catalog = catalog_of(spark, {"ring": ring, "next": [(30.0, 0.0), (29.999, 0.0)]})
    found = {r.route_id: (r.n_up, r.n_down) for r in gates.neighbours(catalog, routes.terminal_bearings(catalog)).collect()}
    assert found == {"ring": (None, 1), "next": (1, None)}


@pytest.mark.parametrize("lat", [0.0, 45.0, 65.0, 69.0, 80.0, -69.0])
def test_snaps_at_every_latitude(spark, lat):
    feet = 1 / 364000.0
    east = feet / cos(radians(lat))
    lines = [("p", f"s{i}", [Row(lat=lat, lon=i * 4000 * east), Row(lat=lat, lon=(i * 4000 + 900) * east)], [0.0, 900.0]) for i in range(5)]
    segments = spark.createDataFrame(lines, "project_id string, segment_id string, coords array<struct<lat:double,lon:double>>, chain array<double>").withColumn("eligible", F.lit(True))
    points = [("p", 8 * i + k, lat + 245 * feet * (-1) ** k, (i * 4000 + 120.0 * k) * east) for i in range(5) for k in range(8)]
    found = network.snap(spark.createDataFrame(points, "project_id string, photo_id long, lat double, lon double"), segments, "photo_id").collect()
    assert {r.photo_id: r.segment_id for r in found} == {8 * i + k: f"s{i}" for i in range(5) for k in range(8)}


def test_identical_rows_stay_as_many(spark):
    rows = [("p", "f", "1", float(s), "", "A", "n") for s in (0, 50, 50, 100)] * 2
    df = spark.createDataFrame(rows, "project_id string, source_file string, print string, station_ft double, date string, crew string, notes string")
    keyed = grouping.with_row_keys(df)
    assert keyed.select("row_key").distinct().count() == 8
    grouped = grouping.group_rows(keyed)
    assert grouped.count() == 8 and grouped.select("row_key").distinct().count() == 8
    # a repeated station starts a new group, so no group holds a station twice
    assert grouped.groupBy("group_id", "station_ft").count().where("count > 1").count() == 0


def test_groups_of_sixty_stations_are_judged_whole(spark):
    """The checks of a long group see its last station."""
    from trenchline.operators.windows import best_window

    chain = [60.0 * i for i in range(101)]
    rel = [50.0 * i for i in range(60)]
    df = spark.createDataFrame([(chain, [30.0 + c / 364000 for c in chain], [0.0] * 101, rel, rel[-1], [], [])],
                               "c array<double>, la array<double>, lo array<double>, rel array<double>, span double, s array<int>, rs array<int>")
    found = df.select(best_window("c", "la", "lo", "rel", "span", "s", "rs").alias("w")).first().w
    assert len(found.p_route_ft) == 60 and found.p_route_ft[-1] - found.p_route_ft[0] == rel[-1]


def test_sheets_with_many_heading_rows(spark):
    cells = [("s", i, "page", "of") for i in range(40)] + [("s", 40 + i, f"{i}+00", f"{i + 1}+00") for i in range(3)]
    rows = spark.createDataFrame(cells, "sheet_id string, row_index int, c0 string, c1 string")
    heads = spark.createDataFrame([], "sheet_id string, col_index int, header string")
    found = bore_logs.station_ranges(rows, heads, ["c0", "c1"]).collect()
    assert [(r.start_station, r.end_station) for r in sorted(found, key=lambda r: r.row_index)] == [("0+00", "1+00"), ("1+00", "2+00"), ("2+00", "3+00")]


def test_forms_with_wide_gaps(spark):
    cells = ["Start Station", *[""] * 9, "1+00", "End Station", *[""] * 12, "4+50"]
    columns = [f"c{i}" for i in range(len(cells))]
    rows = spark.createDataFrame([("s", 1, *cells)], "sheet_id string, row_index int, " + ", ".join(f"{c} string" for c in columns))
    found = bore_logs.form_station_pairs(rows, columns).first()
    assert (found.start_station, found.end_station) == ("1+00", "4+50")


def test_sheet_rows_are_read_once(spark):
    """Forms, columns and tabular rows of all sheets come from one read of the rows, with one row a form."""
    cells = [("form", 1, "From Station", "1+00", "End Station", "2+50"), ("form", 1, "From Station", "1+00", "End Station", "2+50"),
             ("form", 2, "9+00", "9+50", "", ""), ("form", 0, "To Station", "3+00", "Start Station", "4+00"),
             ("named", 1, " 1+00 ", "x", "2+00", "3+00"), ("named", 2, "1+00", "x", "x", "3+00"), ("named", 3, "5+00", None, "6+00", None),
             ("like", 1, "a", "1+00", "b", "2+00"), ("like", 2, "a", "3+00", None, "4+00"), ("like", 3, "a", "b", "3+00", "5+0x"),
             ("none", 1, "1+00", "2+00", "", ""), (None, 1, "1+00", "2+00", "", ""), (None, 2, "1+00", "2+00", "", ""),
             (None, 3, "Begin Station", "7+00", "End Station", "8+00")]
    rows = spark.createDataFrame(cells, "sheet_id string, row_index int, c0 string, c1 string, c2 string, c3 string")
    heads = spark.createDataFrame([("named", 2, "To  Station (ft)"), ("named", 0, "from station"), ("named", 3, "end"), ("like", 0, None)],
                                  "sheet_id string, col_index int, header string")
    ranges = bore_logs.station_ranges(rows, heads, ["c0", "c1", "c2", "c3"])
    found = sorted([tuple(r) for r in ranges.select("sheet_id", "row_index", "start_station", "end_station", "start_ft", "end_ft", "source_mode").collect()], key=str)
    assert found == sorted([
        ("form", None, "1+00", "2+50", 100.0, 250.0, "form"), (None, None, "7+00", "8+00", 700.0, 800.0, "form"),
        ("named", 1, "1+00", "2+00", 100.0, 200.0, "tabular"), ("named", 3, "5+00", "6+00", 500.0, 600.0, "tabular"),
        ("like", 1, "1+00", "2+00", 100.0, 200.0, "tabular"), ("like", 2, "3+00", "4+00", 300.0, 400.0, "tabular")], key=str)
    assert ranges._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_large_uploads_are_refused_with_a_reason(spark):
    files = [("many", f"f{i}", "image/png") for i in range(12)] + [("few", "a", "image/jpeg"), ("few", "b", "text/plain"), ("few", "c", None)]
    df = spark.createDataFrame([("h", u, f, t, "now") for u, f, t in files], "station_hash string, upload_id string, filename string, content_type string, uploaded_at string")
    found = {r.filename: (r.reject_reason, r.photo_id is not None) for r in stores.judge_photos(df).collect()}
    assert len(found) == 15 and all(found[f"f{i}"] == ("Upload up to 10 files at a time.", False) for i in range(12))
    assert found["a"] == found["c"] == (None, True) and found["b"] == ("b is not an image upload.", False)
    assert stores.accept_photos(df).count() == 2


def test_issue_log_keeps_all_unless_told(spark):
    reports = spark.range(500).selectExpr("concat('f', id) as fingerprint", "timestamp_seconds(id) as ts", "id as event_id", "'x' as details")
    assert stores.upsert_issues(reports).count() == 500
    assert {r.last_id for r in stores.upsert_issues(reports, 3).collect()} == {497, 498, 499}


def test_very_long_walks_are_linear(spark):
    from trenchline.operators import walks

    fixes = spark.range(100_000).selectExpr(
        "'s' as session_id", "0.0 as walk_s", "id * 1.0 as t_s", "id as event_id", "30 + id * 1e-5 as lat", "0.0 as lon", "5.0 as accuracy_m", "0 as delay_s")
    kept = walks.accept_fixes(fixes)
    assert kept.count() == 50_000 and kept.agg(F.max("event_id"), F.max("pos")).first()[:] == (99_998, 49_999)
    # a straight line gives way point by point: the last kept one stays until the next is too far from it
    steady = walks.steady_trail(kept.select("session_id", "walk_s", "pos", "lat", "lon")).collect()
    places = sorted(r.pos for r in steady)
    assert places[0] == 0 and places[-1] == 49_999 and len(places) < 50_000


def test_zigzags_go_and_corners_stay(spark):
    from trenchline.operators import walks

    metre = 1 / 111_195
    line = [(0, 0.0), (5, 1.0), (10, 0.0), (15, 0.0), (15, 10.0), (15, 20.0)]
    rows = [("s", 0.0, i, 30 + y * metre, x * metre) for i, (x, y) in enumerate(line)]
    df = spark.createDataFrame(rows, "session_id string, walk_s double, pos int, lat double, lon double")
    found = sorted(walks.steady_trail(df).collect(), key=lambda r: r.pos)
    assert [r.pos for r in found] == [0, 3, 5] or [r.pos for r in found] == [0, 2, 3, 5]
    assert (found[0].lat, found[-1].lat) == (rows[0][3], rows[-1][3])


def test_many_short_walks_in_seconds(spark):
    """100,000 walks of three fixes and one longer than a batch, in one pass; each walk starts anew."""
    import time

    from trenchline.operators import walks

    fixes = spark.range(300_000).selectExpr(
        "concat('s', id div 3) as session_id", "0.0 as walk_s", "(id % 3) * 1.5 as t_s", "id as event_id", "30 + id * 1e-4 as lat", "0.0 as lon", "5.0 as accuracy_m", "0 as delay_s")
    long = spark.range(25_000).selectExpr(
        "'long' as session_id", "0.0 as walk_s", "id * 2.0 as t_s", "id as event_id", "if(id % 5 = 4, 40, 30 + id * 1e-4) as lat", "0.0 as lon", "5.0 as accuracy_m", "0 as delay_s")
    started = time.time()
    kept = walks.accept_fixes(fixes.unionByName(long))
    found = {r[0]: r[1:] for r in kept.groupBy((F.col("session_id") == "long").alias("long")).agg(F.count("*").alias("n"), F.max("pos").alias("pos"), F.sum("pos").alias("sum")).collect()}
    assert found[False] == (200_000, 1, 100_000)
    assert found[True] == (25_000, 24_999, sum(range(25_000)))
    assert time.time() - started < 120


def steady_by_hand(points):
    """Display line of (lat, lon) points, all at once."""
    from trenchline.operators.walks import _metres, _zigzag

    kept = [0]
    for i in range(1, len(points)):
        if i == len(points) - 1 or not _zigzag(points[kept[-1]], points[i], points[i + 1]):
            kept.append(i)
    out = [(i, *points[i]) for i in kept]
    for j in range(1, len(kept) - 1):
        a, b, c = (points[k] for k in kept[j - 1:j + 2])
        y, x = (0.22 * a[k] + 0.56 * b[k] + 0.22 * c[k] for k in (0, 1))
        if _metres(*b, y, x) <= 2.2:
            out[j] = (kept[j], y, x)
    return out


def test_steady_lines_of_random_walks(spark):
    import numpy as np

    from trenchline.operators import walks

    rng, given, want = np.random.default_rng(8), [], {}
    for s, n in enumerate([1, 2, 3, 4, 50, 400, 12_000]):
        metres = np.cumsum(rng.normal(0.4, 1.6, (n, 2)), axis=0)
        points = [(30 + float(y) / 111_195, -96 + float(x) / 96_000) for y, x in metres]
        given += [(f"s{s}", 0.0, i, *p) for i, p in enumerate(points)]
        want[f"s{s}"] = steady_by_hand(points)
    df = spark.createDataFrame(given, "session_id string, walk_s double, pos int, lat double, lon double").repartition(5)
    for name, line in want.items():
        found = sorted(tuple(r) for r in walks.steady_trail(df.where(F.col("session_id") == name)).select("pos", "lat", "lon").collect())
        assert [r[0] for r in found] == [r[0] for r in line]
        assert np.allclose(found, line, atol=1e-12)
    assert len(want["s6"]) < 12_000

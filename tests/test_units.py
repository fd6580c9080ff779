"""Hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.functions import stations as st
from trenchline.operators import coverage, grouping, hulls, routes
from trenchline.sources import bore_logs as src


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_stations(spark):
    raw = [("14+20",), ("1420",), ("7+5",), ("12",), ("",), (" 14 + 20",), ("142+005",)]
    got = values(spark, raw, "s string", st.station_strict(F.col("s")), st.feet_from_station(st.station_strict(F.col("s"))))
    assert got == [("14+20", 1420.0), ("14+20", 1420.0), ("7+05", 705.0), (None, None), (None, None), ("14+20", 1420.0), ("142+05", 14205.0)]


def test_recognised_station(spark):
    assert values(spark, [("l4+2O",)], "s string", st.station_scan(F.col("s"))) == [("14+20",)]


def test_bad_cells_never_fail(spark):
    raw = [("+",), ("++",), ("x+y",), ("99999999999999999999+99999999999999",), (None,)]
    got = values(spark, raw, "s string", st.station_strict(F.col("s")), st.station_template(F.col("s")), st.depth_scan(F.col("s")), st.boc_scan(F.col("s")),
                 st.station_best(F.col("s")), st.number(F.col("s")))
    assert len(got) == 5


def test_events(spark):
    lines = [(1, "Rock Adder - STA 2+12"), (2, "Coupler at 50’ from station 2+72"), (3, "No structures set to station 3+50"),
             (4, "Homeowner complaint about yard"), (5, "Restoration - add sod at 1+57")]
    got = src.parse_event_lines(spark.createDataFrame(lines, "line_number int, line string")).orderBy("line_number")
    assert [tuple(r) for r in got.select("event_type", "severity", "billable", "station_ft", "offset_ft", "offset_from_ft").collect()] == [
        ("rock", "high", True, 212, None, None), ("coupler", "medium", True, 272, 50, 272), ("note", "low", False, 350, None, None),
        ("complaint", "high", False, None, None, None), ("restoration", "medium", False, 157, None, None)]


def log(spark, stations, crew="A"):
    rows = [("p", "f", "1", f"{int(s) // 100}+{int(s) % 100:02d}", float(s), crew, "", "", 4.0, 5.0, i) for i, s in enumerate(stations)]
    return spark.createDataFrame(rows, "project_id string, source_file string, print string, station string, station_ft double, crew string, date string, "
                                       "notes string, depth_ft double, boc_ft double, row_key long")


def test_groups_break_at_adaptive_gap_and_repeats(spark):
    got = grouping.group_rows(log(spark, [0, 50, 100, 400, 450, 900, 900])).orderBy("row_key").select("group_id").collect()
    ids = [r[0] for r in got]
    assert [sorted(set(ids), key=ids.index).index(i) for i in ids] == [0, 0, 0, 1, 1, 2, 3]


def test_many_repeats_of_one_station(spark):
    got = grouping.group_rows(log(spark, [0, 50, 50, 50, 50, 100]))
    sizes = sorted(r["count"] for r in got.groupBy("group_id").count().collect())
    assert sizes == [1, 1, 2, 2]


def test_interval_union(spark):
    def merged(rows):
        df = spark.createDataFrame([("p", "r", float(a), float(b)) for a, b in rows], "project_id string, route_id string, start_ft double, end_ft double")
        return sorted((r.start_ft, r.end_ft) for r in coverage.merge_intervals(df, ["project_id", "route_id"], 5.0).collect())
    assert merged([(0, 10), (12, 20), (40, 50)]) == [(0, 20), (40, 50)]
    assert merged([(0, 10), (12, 20), (40, 50), (5, 60)]) == [(0, 60)]
    assert merged([(1990, 2010), (2014, 4100), (10, 0), (3, 3)]) == [(0, 10), (1990, 4100)]


LINE = [(30.1652 + i * 0.0003, -96.4038 + i * 0.0005 + (i % 2) * 0.0001) for i in range(9)]


def line(spark):
    v = spark.createDataFrame([("p", "r", i, a, b) for i, (a, b) in enumerate(LINE)], "project_id string, route_id string, idx int, lat double, lon double")
    return routes.with_chainage(v)


def test_clip_length_and_round_trip(spark):
    cut = routes.as_polylines(line(spark)).withColumn("c", geo.clip(F.col("coords"), F.col("chain"), F.lit(100.0), F.lit(900.0)))
    row = cut.select(geo.length_ft(F.col("c")), "total_ft").first()
    assert math.isclose(row[0], 800.0, abs_tol=0.1) and row[1] > 900
    assert cut.select(F.size(geo.clip(F.col("coords"), F.col("chain"), F.lit(9.0), F.lit(3.0)))).first()[0] == 0


def test_densify_not_longer(spark):
    raw = line(spark)
    dense = routes.with_chainage(routes.densify(raw))
    assert dense.agg(F.max("chain_ft")).first()[0] <= raw.agg(F.max("chain_ft")).first()[0] + 1e-6


def test_hull_of_square(spark):
    pts = [("p", float(x), float(y)) for x in range(4) for y in range(4)]
    out = hulls.design_outline(spark.createDataFrame(pts, "project_id string, lon double, lat double"), salts=3).orderBy("pos").collect()
    assert {(r.lon, r.lat) for r in out} == {(0, 0), (3, 0), (3, 3), (0, 3)} and len(out) == 5


@pytest.mark.parametrize("text,reason", [("12+34,5,6", None), ("STATION,DEPTH,BOC", "Header row skipped"), ("1,2", "Could not split into 3 values: 1,2"),
                                         ("1234 5.5 7", None), ("xx,5,6", "Invalid station: xx")])
def test_bulk_line(spark, text, reason):
    got = src.parse_bulk_lines(spark.createDataFrame([(1, text)], "line_number int, line string")).first()
    assert got.reject_reason == reason

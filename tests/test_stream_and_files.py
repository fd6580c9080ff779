"""The stream equals its batch twin; sinks and file sources round-trip."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from trenchline.config import Walk
from trenchline.operators import routes, walks
from trenchline.plans.inputs import view
from trenchline.plans.queries_geometry import raw_chain
from trenchline.sources import design, stores
from trenchline.streaming import walk_stream


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_stream_equals_batch(spark):
    """All fixes in one micro-batch; walks of a session end at gaps of a day, in the stream by silence."""
    folder = tempfile.mkdtemp(prefix="spark-")
    cfg = Walk(idle_s=86400.0)
    fixes = view(spark, SF_DIR, "gps_fixes").withColumn("ts", F.col("ts").cast("timestamp"))
    events = fixes.select("session_id", F.lit("fix").alias("kind"), "event_id", "ts", (F.col("ts") + F.make_dt_interval(secs=F.col("delay_s"))).alias("ingest_ts"),
                          "lat", "lon", "accuracy_m", F.lit(None).cast("string").alias("station_text"), F.lit(None).cast("string").alias("note"))
    events.coalesce(1).write.parquet(folder + "/in")
    spark.conf.set(*ROCKS)
    stream = walk_stream.walk_events(spark.readStream.schema(walk_stream.EVENTS).parquet(folder + "/in"), cfg)
    sessions = fixes.select("session_id", "project_id", "route_id").distinct()
    lines = routes.as_polylines(raw_chain(spark, SF_DIR))
    walk_stream.write_walks(walk_stream.snapped_events(stream, sessions, lines), folder + "/out", folder + "/cp").awaitTermination(300)
    out = spark.read.parquet(folder + "/out")
    good = fixes.where(walks.good_fix(F.col("accuracy_m"), F.col("delay_s"))).withColumn("t_s", walks.seconds(F.col("ts")))
    walked = walks.split_walks(good, cfg.idle_s)
    accepted = walks.accept_fixes(walked)
    columns = ["session_id", "event_id", "snap_lat", "snap_lon", "route_ft", "distance_ft"]
    snapped = walks.snapped_trail(accepted, sessions, lines)
    want = sorted(map(tuple, snapped.select(*columns).collect()))
    assert sorted(map(tuple, out.where("kind = 'fix'").select(*columns).collect())) == want and want
    # every walk but those within a day of the newest fix is over
    newest = walked.agg(F.max("t_s")).first()[0]
    over = walks.walk_sessions(walked.join(snapped, "session_id", "left_semi")).where(F.col("ended_s") + cfg.idle_s < newest - cfg.max_age_s).count()
    assert out.where("kind = 'end'").count() >= over > 0


def write_events(spark, folder, rows):
    """One file of (session, kind, event_id, second of the day, lat, lon, station)."""
    import datetime as dt

    day = dt.datetime(2025, 1, 1)
    made = [(s, k, e, day + dt.timedelta(seconds=t), day + dt.timedelta(seconds=t), la, lo, 5.0, st, None) for s, k, e, t, la, lo, st in rows]
    spark.createDataFrame(made, walk_stream.EVENTS).coalesce(1).write.mode("append").parquet(folder + "/in")


def run_walks(spark, folder):
    stream = walk_stream.walk_events(spark.readStream.schema(walk_stream.EVENTS).parquet(folder + "/in"))
    walk_stream.write_walks(stream, folder + "/out", folder + "/cp").awaitTermination(300)
    return sorted(((r.session_id, r.event_id or 0, r.kind, r.entry_count, r.ts.strftime("%H:%M:%S")) for r in spark.read.parquet(folder + "/out").collect()))


def state_sessions(spark, folder, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(folder + "/cp")
    return {r.key.session_id for r in rows.collect()}


def test_silent_session_ends_by_its_timer(spark):
    """Session 1 falls silent: it ends by itself, nothing of its state stays, and a late fix is refused."""
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(*ROCKS)
    write_events(spark, folder, [(1, "start", 1, 0, None, None, None), (1, "fix", 2, 1, 30.0, -96.0, None), (1, "entry", 3, 5, None, None, "0+10"),
                                 (2, "fix", 4, 2, 31.0, -96.0, None)])
    assert run_walks(spark, folder) == [(1, 2, "fix", 0, "00:00:01"), (1, 3, "entry", 1, "00:00:05"), (2, 4, "fix", 0, "00:00:02")]
    assert state_sessions(spark, folder, "last_fix") == state_sessions(spark, folder, "last_seen") == {1, 2}
    # session 2 goes on; 30 minutes later the watermark passes the timer of session 1
    write_events(spark, folder, [(2, "fix", 5, 1700, 31.001, -96.0, None)])
    run_walks(spark, folder)
    write_events(spark, folder, [(2, "fix", 6, 1900, 31.002, -96.0, None)])
    seen = run_walks(spark, folder)
    assert (1, 0, "end", 1, "00:00:05") in seen and not [r for r in seen if r[0] == 2 and r[2] == "end"]
    for name in ("last_fix", "entries", "last_seen"):
        assert state_sessions(spark, folder, name) == {2}
    # a fix of the ended session that is older than the watermark is refused, a new one begins a walk
    write_events(spark, folder, [(1, "fix", 7, 10, 30.5, -96.0, None), (1, "entry", 8, 11, None, None, "0+20")])
    assert run_walks(spark, folder) == seen and state_sessions(spark, folder, "last_seen") == {2}
    write_events(spark, folder, [(1, "fix", 9, 1950, 30.6, -96.0, None)])
    assert (1, 9, "fix", 0, "00:32:30") in run_walks(spark, folder)
    assert state_sessions(spark, folder, "last_seen") == {1, 2}


def test_gap_within_a_batch_ends_a_session(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(*ROCKS)
    write_events(spark, folder, [(1, "fix", 1, 0, 30.0, -96.0, None), (1, "entry", 2, 3, None, None, "a"), (1, "entry", 3, 1804, None, None, "lost"),
                                 (1, "fix", 4, 1805, 30.0, -96.0, None), (1, "end", 5, 1806, None, None, None)])
    assert run_walks(spark, folder) == [(1, 0, "end", 1, "00:00:03"), (1, 1, "fix", 0, "00:00:00"), (1, 2, "entry", 1, "00:00:03"),
                                        (1, 4, "fix", 0, "00:30:05"), (1, 5, "end", 0, "00:30:06")]
    assert state_sessions(spark, folder, "last_seen") == set()


def test_entries_and_lifecycle(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    t = "timestamp'2025-01-01 10:00:{:02d}'"
    rows = [(1, "start", 1, 0, None, None, None), (1, "entry", 2, 1, None, None, "0+10"), (1, "fix", 3, 2, 30.0, -96.0, None), (1, "fix", 4, 3, 30.0001, -96.0, None),
            (1, "fix", 5, 6, 30.0001, -96.0, None), (1, "entry", 6, 7, None, None, "0+50"), (1, "end", 7, 9, None, None, None)]
    values = ", ".join(f"({s}L, '{k}', {e}L, {t.format(x)}, {t.format(x)}, {'cast(null as double)' if la is None else la}, {'cast(null as double)' if lo is None else lo}, 5.0D, "
                       f"{'cast(null as string)' if st is None else repr(st)}, cast(null as string))" for s, k, e, x, la, lo, st in rows)
    names = ", ".join(walk_stream.EVENTS.names)
    spark.sql(f"SELECT cast(lat as double) lat, cast(lon as double) lon, * EXCEPT (lat, lon) FROM VALUES {values} AS v({names})").select(*walk_stream.EVENTS.names).coalesce(1).write.parquet(folder + "/in")
    spark.conf.set(*ROCKS)
    stream = walk_stream.walk_events(spark.readStream.schema(walk_stream.EVENTS).parquet(folder + "/in"))
    walk_stream.write_walks(stream, folder + "/out", folder + "/cp").awaitTermination(300)
    got = sorted((r.event_id, r.kind, r.entry_count) for r in spark.read.parquet(folder + "/out").collect())
    assert got == [(3, "fix", 0), (5, "fix", 0), (6, "entry", 1), (7, "end", 1)]


KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><name>Job</name>
<Folder><name>North</name><Folder><name>Backbone</name><Placemark><name>Run 1</name><MultiGeometry>
<LineString><coordinates>-96.4,30.1,0 -96.4,30.1 -96.41,30.11 bad</coordinates></LineString><LineString><coordinates>-96.4,30.1</coordinates></LineString></MultiGeometry></Placemark>
<Placemark><Point><coordinates>-96.4,30.2,5</coordinates></Point></Placemark></Folder></Folder>
<Placemark><gx:Track><gx:coord>-96.4 30.1 0</gx:coord><gx:coord>-96.5 30.1 0</gx:coord><gx:coord>-96.6 30.1 0</gx:coord></gx:Track></Placemark></Document></kml>"""


def test_design_files(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "a.kml").write_text(KML)
    with zipfile.ZipFile(folder / "b.kmz", "w") as z:
        z.writestr("other.kml", "<kml/>")
        z.writestr("doc.kml", KML)
    (folder / "c.kmz").write_bytes(b"not a zip")
    marks = design.placemarks(design.read_designs(spark, str(folder))).cache()
    assert marks.where("error IS NOT NULL").count() == 1
    found = design.design_features(marks).where(F.endswith("path", F.lit("b.kmz"))).orderBy("feature_pos").collect()
    assert [(r.feature_id, r.name, r.folder_path, r.role, len(r.coords)) for r in found] == [
        ("line_1", "Run 1", "North / Backbone", "backbone", 2), ("point_2", "Unnamed Feature", "North / Backbone", "backbone", 1)]
    main = {r.path[-5:]: (len(r.coords), r.n_candidates) for r in design.main_route(marks).collect()}
    assert main == {"a.kml": (3, 2), "b.kmz": (3, 2)}


def test_map_export_reads_back(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    lines = routes.as_polylines(raw_chain(spark, SF_DIR)).where("project_id = 'p0'").withColumn("n", F.xxhash64("route_id"))
    features = lines.select("project_id", F.lit("line").alias("kind"), F.lit("x").alias("role"), F.col("route_id").alias("name"), F.col("n").alias("feature_pos"), "coords")
    none = features.limit(0)
    runs = none.select("project_id", F.col("feature_pos").alias("run_no"), "name", "coords", F.lit("").alias("description"))
    stations = none.select("project_id", F.col("feature_pos").alias("station_no"), F.col("name").alias("station"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("").alias("description"))
    design.write_export(design.export_lines(features, runs, stations), folder + "/out", files=3)
    text = "".join(p.read_text() for p in sorted(Path(folder, "out", "project_id=p0").glob("part-*.txt")))
    back = design.placemarks(spark.createDataFrame([("x.kml", bytearray(text.encode()))], "path string, content binary"))
    assert back.where("error IS NULL").count() == lines.count()


def test_audit_appends(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    seen = spark.createDataFrame([("a", "d", "A", "job", "1")], "source_file string, date string, crew string, job_name string, print string")
    stores.audit_append(seen, folder + "/audit")
    stores.audit_append(seen, folder + "/audit")
    assert spark.read.parquet(folder + "/audit").count() == 2

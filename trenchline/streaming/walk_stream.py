"""Live phone walks with Structured Streaming.

Input rows: session_id, kind (start, fix, entry, end), ts, ingest_ts, lat, lon, accuracy_m,
station_text, note.  Stale rows go before any state; one small state per session (last kept
fix, entry count, time of the last row) decides the rest and ends with the session, by its end
row or by a timer; snapping is a stream-static join with no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trenchline.config import EARTH_RADIUS_M, Walk
from trenchline.operators.walks import snap_to_line

EVENTS = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("ingest_ts", T.TimestampType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("accuracy_m", T.DoubleType()), T.StructField("station_text", T.StringType()),
    T.StructField("note", T.StringType()),
])
#: What the processor gives; `us` is the time in microseconds, whatever the session time zone.
OUTPUT = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("us", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("station_text", T.StringType()), T.StructField("note", T.StringType()), T.StructField("entry_count", T.IntegerType()),
])
_ORDER = {"start": 0, "fix": 1, "entry": 2, "end": 3}


def metres_apart(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return float(2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a)))


class WalkProcessor(StatefulProcessor):
    """Keeps fixes that moved far and long enough since the last kept one; locates entries at it.

    A session that is silent for more than `idle_s` is over: a row after such a gap begins it
    anew, and where no row comes, its event-time timer ends it once the watermark is past.
    Either way an end row without event_id tells the time of its last row, and nothing of its
    state is left.  Rows behind the watermark are refused, as their session may be over.
    """

    def __init__(self, cfg: Walk = Walk()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_fix", "lat double, lon double, us bigint")
        self.entries = handle.getValueState("entries", "n int")
        self.seen = handle.getValueState("last_seen", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        floor = timerValues.getCurrentWatermarkInMs() * 1000
        batch = pd.concat([part[part["us"] >= floor] for part in rows], ignore_index=True)
        if batch.empty:
            return
        batch = batch.assign(o=batch["kind"].map(_ORDER)).sort_values(["us", "o", "event_id"])
        last = self.last.get() if self.last.exists() else None
        seen = self.seen.get()[0] if self.seen.exists() else None
        count = self.entries.get()[0] if self.entries.exists() else 0
        out = []
        for r in batch.itertuples(index=False):
            if seen is not None and r.us - seen > self.cfg.idle_s * 1e6:
                out.append(self.silent_end(key, seen, count))
                last, count, seen = None, 0, None
            seen = r.us if seen is None else max(seen, r.us)
            if r.kind == "start":
                last, count = None, 0
            elif r.kind == "fix":
                if last is not None and (r.us - last[2] < self.cfg.min_interval_s * 1e6 or metres_apart(last[0], last[1], r.lat, r.lon) < self.cfg.min_move_m):
                    continue
                last = (r.lat, r.lon, r.us)
                out.append((key[0], "fix", r.event_id, r.us, r.lat, r.lon, None, None, count))
            elif r.kind == "entry" and last is not None:
                count += 1
                out.append((key[0], "entry", r.event_id, r.us, last[0], last[1], r.station_text, r.note, count))
            elif r.kind == "end":
                out.append((key[0], "end", r.event_id, r.us, None, None, None, None, count))
                last, count, seen = None, 0, None
        self.forget()
        if seen is not None:
            if last is not None:
                self.last.update(last)
            self.entries.update((count,))
            self.seen.update((int(seen),))
            self.handle.registerTimer(int(seen // 1000 + self.cfg.idle_s * 1000) + 1)
        yield pd.DataFrame(out, columns=OUTPUT.names).astype({"event_id": "Int64"})

    def silent_end(self, key, seen: int, count: int) -> tuple:
        return (key[0], "end", None, seen, None, None, None, None, count)

    def forget(self) -> None:
        for state in (self.last, self.entries, self.seen):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = self.silent_end(key, self.seen.get()[0], self.entries.get()[0])
        for state in (self.last, self.entries, self.seen):
            state.clear()
        yield pd.DataFrame([end], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def fresh(events: DataFrame, cfg: Walk = Walk()) -> DataFrame:
    """Fixes that are sharp and at most 8 s old when they arrive; other rows pass."""
    age = F.abs(F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("ingest_ts"))) / 1e6
    sharp = (F.col("accuracy_m") > 0) & (F.col("accuracy_m") <= cfg.max_accuracy_m) & ~F.isnan("accuracy_m")
    return events.where((F.col("kind") != "fix") | F.coalesce(sharp & (age <= cfg.max_age_s), F.lit(False)))


def walk_events(events: DataFrame, cfg: Walk = Walk()) -> DataFrame:
    """Kept fixes, located entries and session ends, asked for or by silence, of an event stream.

    The watermark trails the newest event by the age beyond which a fix is stale anyway.
    """
    timed = fresh(events.withWatermark("ts", f"{int(cfg.max_age_s)} seconds"), cfg).withColumn("us", F.unix_micros("ts"))
    kept = timed.groupBy("session_id").transformWithStateInPandas(WalkProcessor(cfg), OUTPUT, "Append", "EventTime")
    return kept.select("session_id", "kind", "event_id", F.timestamp_micros("us").alias("ts"), *OUTPUT.names[4:])


def snapped_events(kept: DataFrame, sessions: DataFrame, polylines: DataFrame) -> DataFrame:
    """Stream-static join with the route of each session, nearest place found in the row."""
    routes = sessions.join(polylines.where(F.size("coords") >= 2).select("project_id", "route_id", "coords", "chain"), ["project_id", "route_id"])
    on = kept.join(routes, "session_id").withColumn("s", F.when(F.col("lat").isNotNull(), snap_to_line(F.col("coords"), F.col("chain"), F.col("lat"), F.col("lon"))))
    return on.withColumns({"snap_lat": F.col("s.lat"), "snap_lon": F.col("s.lon"), "route_ft": F.col("s.route_ft"), "distance_ft": F.col("s.distance_ft")}).drop("coords", "chain", "s")


def write_walks(kept: DataFrame, path: str, checkpoint: str):
    """Append sink; entries and trails land as parquet by kind."""
    return (kept.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("kind").trigger(availableNow=True).start())

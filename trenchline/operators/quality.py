"""Order-aware cleaning and checks of log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import DEVIATION_WORDS, Deviation, PointQa
from trenchline.functions import stations as st
from trenchline.functions.text import flag_label, has, qa_colour
from trenchline.operators.sequences import split_blocks, with_last_mark, with_neighbours


def relative_progress(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `at_ft`: feet past the first station of the key.

    The first station is an aggregate joined back, so a very large log is not windowed.
    """
    base = rows.groupBy(*keys).agg(F.min("station_ft").alias("base_ft"))
    return rows.join(base, keys).withColumn("at_ft", F.col("station_ft") - F.col("base_ft"))


# Station steps crews usually log, best first.
PREFERRED_STEPS = (50, 25, 37, 13, 63, 6, 12, 44, 92)


def _table_arrays(rows: DataFrame, keys: list[str], order: str, *cols: str) -> DataFrame:
    """Rows of one recognised table as a sorted array; a table fits on one page."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("rows"))


def fill_stations(cells: DataFrame, keys: list[str], order: str, value: str, archived: bool = False) -> DataFrame:
    """Missing stations of each table from their neighbours, in row order.

    A filled value is the next row's previous one, so this folds over the table's rows.
    Two known sides share the gap evenly; one side steps by the usual step of the table
    (the observed one nearest 50 ft), or by 50 ft along its direction in the archived form.
    """
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    known = F.col(value).isNotNull()
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    looked = cells.withColumn("_pos", pos).withColumns({
        "_next": F.first(F.when(known, F.col(value)), ignorenulls=True).over(after),
        "_next_pos": F.first(F.when(known, F.col("_pos")), ignorenulls=True).over(after)})
    tables = _table_arrays(looked, keys, "_pos", order, value, "_next", "_next_pos")
    valid = F.filter(F.transform("rows", lambda r: r[value].cast("double")), lambda v: v.isNotNull())
    diffs = F.filter(F.transform(F.col("_valid"), lambda v, i: F.abs(v - F.get(F.col("_valid"), F.greatest(i - 1, F.lit(0))))),
                     lambda d: d > 0)
    nearest = F.array_min(F.transform(F.col("_diffs"), lambda d, i: F.struct(F.abs(d - 50).alias("o"), i.alias("i"), d.alias("d"))))["d"]
    if archived:
        ready = F.size("_valid") >= 1
        step = F.when((F.size("_valid") >= 2) & (F.get("_valid", F.lit(0)) > F.element_at("_valid", -1)), -50.0).otherwise(50.0)
    else:
        ready = (F.size("_valid") >= 2) & (F.size("_diffs") > 0)
        step = nearest
    tables = tables.withColumn("_valid", valid).withColumn("_diffs", diffs).withColumns({"_ready": ready})
    tables = tables.withColumn("_step", F.when(F.col("_ready"), F.coalesce(step, F.lit(0.0))).otherwise(0.0))
    side = 1 if archived else -1
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<double>").alias("out"))

    def add(acc, r):
        share = F.round((r["_next"] - acc["prev"]) / (r["_next_pos"] - r["_pos"] + 1))
        if archived:
            share = F.when((F.abs(share) < 10) | (F.abs(share) > 200), F.col("_step")).otherwise(share)
        guess = (F.when(acc["prev"].isNotNull() & r["_next"].isNotNull(), acc["prev"] + share)
                 .when(acc["prev"].isNotNull(), acc["prev"] + F.col("_step") * side)
                 .when(r["_next"].isNotNull(), r["_next"] - F.col("_step") * side))
        now = F.coalesce(r[value].cast("double"), F.when(F.col("_ready"), guess))
        return F.struct(F.coalesce(now, acc["prev"]).alias("prev"), F.concat(acc["out"], F.array(now)).alias("out"))

    filled = tables.withColumn("out", F.aggregate("rows", start, add, lambda acc: acc["out"]))
    return (filled.select(*keys, F.explode(F.arrays_zip("rows", "out")).alias("z"))
            .select(*keys, F.col(f"z.rows.{order}").alias(order), F.col("z.out").alias("filled_ft"),
                    F.col(f"z.rows.{value}").isNull().alias("was_missing")))


def repair_stations(cells: DataFrame, keys: list[str], order: str, candidates: str) -> DataFrame:
    """One station per row from its candidate readings, each following the one before.

    The reading within 150 ft ahead nearest a usual step wins; else the last two digits
    are kept near the previous hundred; else the previous station plus 50.
    """
    tables = _table_arrays(cells, keys, order, candidates)
    steps = F.array(*[F.lit(s) for s in PREFERRED_STEPS])

    def best(options: Column, prev: Column) -> Column:
        ahead = F.filter(options, lambda c: (c > prev) & (c <= prev + 150))
        ranked = F.transform(ahead, lambda c: F.struct(
            F.array_min(F.transform(steps, lambda s: F.abs(c - prev - s))).alias("off"), (c - prev).alias("gap")))
        return prev + F.array_min(ranked)["gap"]

    def near(options: Column, prev: Column) -> Column:
        hundred = F.floor(prev / 100).cast("int")
        lefts = F.sequence(F.greatest(hundred - 1, F.lit(0)), hundred + 2)
        return F.flatten(F.transform(options, lambda c: F.transform(lefts, lambda h: h * 100 + c % 100)))

    start = F.struct(F.lit(None).cast("int").alias("prev"), F.array().cast("array<int>").alias("out"))

    def add(acc, r):
        prev, options = acc["prev"], r[candidates]
        first = F.array_min(F.filter(options, lambda c: c.between(0, 40000)))
        now = F.when(prev.isNull(), first).otherwise(
            F.coalesce(best(options, prev), best(near(options, prev), prev), prev + 50)).cast("int")
        return F.struct(F.coalesce(now, prev).alias("prev"), F.concat(acc["out"], F.array(now)).alias("out"))

    fixed = tables.withColumn("out", F.aggregate("rows", start, add, lambda acc: acc["out"]))
    return (fixed.select(*keys, F.explode(F.arrays_zip("rows", "out")).alias("z"))
            .select(*keys, F.col(f"z.rows.{order}").alias(order), F.col("z.out").alias("station_int")))


def smooth_numbers(cells: DataFrame, keys: list[str], order: str, value: str, kind: str) -> Column:
    """Depth or cover with blanks and zeros taken from the nearest good rows of the table.

    Returns the Column to add; `kind` is depth or boc.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    good = F.when(F.col(value) != 0, F.col(value))
    left, right = F.last(good, ignorenulls=True).over(before), F.first(good, ignorenulls=True).over(after)
    usual = F.coalesce(F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys)), F.lit(4.3 if kind == "depth" else 9.0))
    filled = F.coalesce(good, F.when(left.isNotNull() & right.isNotNull(), F.round(F.round((left + right) / 2, 6), 1 if kind == "depth" else 0)),
                        left, right, usual)
    if kind == "depth":
        return F.when(filled > 15, F.round(filled / 10, 1)).otherwise(filled)
    whole = F.round(filled)
    return F.when(whole > 20, F.left(whole.cast("long").cast("string"), F.lit(1)).cast("double")).otherwise(whole)


def pair_spans(rows: DataFrame, keys: list[str], order: str, station: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Spans between consecutive rows of a table, with a reject reason for unusable ones.

    Unbounded, the ends are put in order and equal ends are refused; with bounds, the
    step must lie within them.  The last row of a table opens no span.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    paired = rows.withColumns({"_to": F.lead(station).over(w), "_more": F.lead(order).over(w).isNotNull()}).where("_more").drop("_more")
    a, b = F.col(station), F.col("_to")
    if high is None:
        reason = F.when(a.isNull() | b.isNull(), "missing station").when(a == b, "start and end are equal")
        start, end = F.least(a, b), F.greatest(a, b)
    else:
        reason = F.when(a.isNull() | b.isNull(), "missing station").when(
            ~(b - a).between(low, high), F.concat(F.lit("station jump rejected: "), (b - a).cast("long")))
        start, end = a, b
    return paired.withColumns({"start_ft": start, "end_ft": end, "reject_reason": reason}).drop("_to")


def file_summary(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Good spans and refused rows per file."""
    return spans.groupBy(*keys).agg(F.count_if(F.col("reject_reason").isNull()).alias("valid_segments"),
                                    F.count_if(F.col("reject_reason").isNotNull()).alias("invalid_rows"))


def recognised_rows(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Whole flow after recognition: fill stations, need all three fields, pair, grade.

    Repeats of (file, start, end, depth, cover) are dropped later by `stores.best_of_each`.
    """
    filled = fill_stations(cells, keys, order, value, archived=True)
    rows = cells.join(filled, [*keys, order]).where(
        F.col("filled_ft").isNotNull() & F.col("depth_ft").isNotNull() & F.col("boc_ft").isNotNull())
    spans = pair_spans(rows, keys, order, "filled_ft")
    return spans.withColumn("confidence", F.when(F.col("was_missing"), 0.75).otherwise(1.0))


def deviation_spans(rows: DataFrame, keys: list[str], cfg: Deviation = Deviation()) -> DataFrame:
    """Stretches where depth or cover shifts and stays shifted, or notes report a deviation.

    A step against the previous row counts unless the next row is back at the old level.
    Runs start at the row before the first such row and end at the first quiet row;
    near runs merge and short ones are dropped.
    """
    cols = ["station", "station_ft", "depth_ft", "boc_ft"]
    order = ["station_ft", "station"]
    blocked = split_blocks(rows.where(F.col("station_ft").isNotNull()), keys, F.floor(F.col("station_ft") / 5000))
    near = with_neighbours(blocked, keys, order, cols)

    def shifted(name: str, limit: float) -> Column:
        here, before, after = F.col(name), F.col(f"prev.{name}"), F.col(f"next.{name}")
        step = F.round(F.abs(here - before), 6) >= limit
        spike = (F.round(F.abs(after - here), 6) >= limit) & (F.round(F.abs(after - before), 6) < limit)
        return F.coalesce(step, F.lit(False)) & ~F.coalesce(spike, F.lit(False))

    note = has(F.lower("notes"), *DEVIATION_WORDS)
    flagged = (
        near.where(F.col("prev").isNotNull() & (F.col("station_ft") > F.col("prev.station_ft")))
        .withColumns({"depth_hit": shifted("depth_ft", cfg.depth_ft), "boc_hit": shifted("boc_ft", cfg.boc_ft), "note_hit": note})
        .withColumn("hit", F.col("depth_hit") | F.col("boc_hit") | F.col("note_hit"))
        .withColumn("from", F.col("prev")).drop("prev", "next")
    )
    stepped = with_neighbours(flagged, keys, order, ["hit"])
    was = F.coalesce(F.col("prev.hit"), F.lit(False))
    marked = stepped.withColumns({"start_mark": F.when(F.col("hit") & ~was, F.col("station_ft")), "in_run": F.col("hit") | was})
    runs = (
        with_last_mark(marked, keys, order, "start_mark", "run_ft").where("in_run")
        .groupBy(*keys, "run_ft").agg(
            F.min_by(F.struct("from.station", "from.station_ft"), "station_ft").alias("s"),
            F.max_by(F.struct("station", "station_ft"), "station_ft").alias("e"),
            F.min_by(F.struct("depth_ft", "boc_ft"), "station_ft").alias("v"),
            F.count_if(F.col("hit") & (F.col("depth_hit") | F.col("boc_hit"))).alias("numeric_points"),
            F.count_if(F.col("hit") & F.col("note_hit")).alias("note_points"),
            F.bool_or(F.col("hit") & F.col("depth_hit")).alias("depth_hit"),
            F.bool_or(F.col("hit") & F.col("boc_hit")).alias("boc_hit"),
            F.collect_set(F.when(F.col("hit") & (F.col("notes") != ""), F.col("notes"))).alias("notes"))
        .where((F.col("note_points") > 0) | (F.col("numeric_points") >= cfg.sustained_points))
    )
    w = Window.partitionBy(*keys).orderBy("run_ft")
    gap = F.col("s.station_ft") - F.lag("e.station_ft").over(w)
    merged = runs.withColumn("new", F.when(gap <= cfg.merge_gap_ft, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    spans = merged.groupBy(*keys, "part").agg(
        F.min_by("s", "run_ft").alias("s"), F.max_by("e", "run_ft").alias("e"), F.min_by("v", "run_ft").alias("v"),
        F.sum("numeric_points").alias("numeric_points"), F.sum("note_points").alias("note_points"),
        F.bool_or("depth_hit").alias("depth_hit"), F.bool_or("boc_hit").alias("boc_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("notes")))).alias("notes"))
    labels = F.array_compact(F.array(
        F.when(F.col("depth_hit") & F.col("boc_hit"), "Depth + BOC shift").when(F.col("depth_hit"), "Depth deviation")
        .when(F.col("boc_hit"), "BOC shift"), F.when(F.col("note_points") > 0, "Field notes")))
    return spans.where(F.col("e.station_ft") - F.col("s.station_ft") >= cfg.min_length_ft).select(
        *keys, F.col("s.station").alias("start_station"), F.col("e.station").alias("end_station"),
        F.col("s.station_ft").alias("start_ft"), F.col("e.station_ft").alias("end_ft"), "v.depth_ft", "v.boc_ft",
        "numeric_points", "note_points", F.array_join("notes", " | ").alias("notes"), F.array_join(labels, "; ").alias("reason"))


def event_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Range, offsets and depth change of each deviation event."""
    return rows.groupBy(*keys).agg(
        F.min("station_ft").alias("start_ft"), F.max("station_ft").alias("end_ft"),
        F.round(F.max("offset_ft"), 2).alias("max_offset_ft"), F.round(F.avg("offset_ft"), 2).alias("avg_offset_ft"),
        F.round(F.max(F.abs("depth_delta_ft")), 2).alias("max_depth_delta_ft"))


def point_flags(rows: DataFrame, keys: list[str], cfg: PointQa = PointQa()) -> DataFrame:
    """Quality flags of each row against the row before it, with labels and marker colour.

    Expects offset_ft (null when unknown) and wrong_street.
    """
    blocked = split_blocks(rows, keys, F.floor(F.col("station_ft") / 5000))
    near = with_neighbours(blocked, keys, ["station_ft", "station"], ["station_ft", "depth_ft", "boc_ft", "row_no"])

    def jump(name: str, limit: float) -> Column:
        return F.round(F.abs(F.col(name) - F.col(f"prev.{name}")), 6) >= limit

    tests = {
        "SHALLOW_DEPTH": F.col("depth_ft") < cfg.shallow_depth_ft,
        "DEPTH_JUMP": jump("depth_ft", cfg.depth_jump_ft),
        "STATION_GAP": F.col("station_ft") - F.col("prev.station_ft") > cfg.station_gap_ft,
        "BOC_JUMP": jump("boc_ft", cfg.boc_jump_ft),
        "OFF_ROUTE": F.col("offset_ft") > cfg.off_route_ft,
        "WRONG_STREET": F.col("wrong_street"),
        "OUT_OF_SEQUENCE": F.col("row_no") < F.col("prev.row_no"),
    }
    plain = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    risky = F.array_contains(F.col("_plain"), "SHALLOW_DEPTH") & F.arrays_overlap(
        F.col("_plain"), F.array(F.lit("DEPTH_JUMP"), F.lit("BOC_JUMP"), F.lit("WRONG_STREET")))
    flagged = near.withColumn("_plain", plain).withColumn("flags", F.when(
        risky, F.array_append("_plain", F.lit("HIGH_RISK"))).otherwise(F.col("_plain")))
    return flagged.withColumns({
        "labels": F.transform("flags", flag_label), "colour": qa_colour(F.col("flags"), F.col("offset_ft"), cfg.off_route_ft),
    }).drop("_plain", "prev", "next", "_block")


def wrong_street(offset_ft: Column, heading_deg: Column, street_deg: Column, cfg: PointQa = PointQa()) -> Column:
    """Far off the matched street and heading another way."""
    turn = F.abs(F.pmod(heading_deg - street_deg + 180, F.lit(360.0)) - 180)
    return F.coalesce((offset_ft > cfg.wrong_street_ft) & (turn > cfg.wrong_street_deg), F.lit(False))


def extracted_station_rows(rows: DataFrame) -> DataFrame:
    """Recognised records as station rows: station, or start_station when it is blank."""
    text = F.coalesce(F.when(F.trim("station") != "", F.col("station")), F.col("start_station"))
    read = rows.withColumn("_read", st.station_scan(text)).where(F.col("_read").isNotNull())
    return read.select("source_file", F.col("_read").alias("station"), st.feet_from_station(F.col("_read")).alias("station_ft"),
                       st.number(F.col("depth_ft")).alias("depth_ft"), st.number(F.col("boc_ft")).alias("boc_ft"), F.trim("notes").alias("notes"))


def bore_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last station of each log, labelled; logs without stations are refused."""
    return rows.groupBy(*keys).agg(F.min("station_ft").alias("start_ft"), F.max("station_ft").alias("end_ft")).withColumns({
        "start_label": st.station_label(F.col("start_ft")), "end_label": st.station_label(F.col("end_ft")),
        "status": F.when(F.col("start_ft").isNull(), "rejected: no_stations").otherwise("ok")})

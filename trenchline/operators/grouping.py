"""Log rows to continuous runs ("groups"), and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import Grouping
from trenchline.functions.stations import let
from trenchline.functions.text import print_tokens

LOG_KEY = ["project_id", "source_file", "tokens_key"]
GROUP = ["project_id", "group_id"]


def _median(steps: Column, default: float) -> Column:
    ordered = F.array_sort(steps)
    n = F.size(steps)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (upper + lower) / 2).otherwise(F.lit(default))


def _fold(rows: Column, cfg: Grouping) -> Column:
    """Part number of each row of a run: a new part starts where the step exceeds
    max(min_gap, factor x median step of the part so far).

    Only steps above min_gap can start one, so the fold goes over those alone.
    """
    def cuts_of(steps: Column) -> Column:
        wide = F.filter(F.transform(steps, lambda d, i: F.when((i > 0) & (d > cfg.min_gap_ft), i)), lambda i: i.isNotNull())

        def add(cuts: Column, i: Column) -> Column:
            begin = F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.lit(0))
            limit = _median(F.slice(steps, begin + 2, i - begin - 1), cfg.default_step_ft) * cfg.gap_factor
            return F.when(F.get(steps, i) > F.greatest(F.lit(cfg.min_gap_ft), limit), F.array_append(cuts, i)).otherwise(cuts)

        return F.aggregate(wide, F.array().cast("array<int>"), add)

    steps = F.transform(rows, lambda r, i: r["station_ft"] - F.get(rows, F.greatest(i - 1, F.lit(0)))["station_ft"])
    far = F.exists(rows, lambda r: r["far"])
    parts = let(let(steps, cuts_of), lambda cuts: F.transform(rows, lambda r, i: F.size(F.filter(cuts, lambda c: c <= i))))
    return F.when(far, parts).otherwise(F.transform(rows, lambda r: F.lit(0)))


def with_row_keys(rows: DataFrame) -> DataFrame:
    """Adds row_key, a hash of all columns and of the number of the repeat, so identical rows differ.

    Identical rows are counted first (map-side) and spread again, so many repeats of one row
    never meet in one task.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    spread = counted.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return spread.withColumn("row_key", F.xxhash64(*rows.columns, "_nth")).drop("_n", "_nth")


def group_rows(rows: DataFrame, cfg: Grouping = Grouping()) -> DataFrame:
    """Adds group_id: rows of one file and print set without a break.

    Breaks: a repeated station, a change of crew or date, a gap too wide for the run so far.
    Rows with equal (station, date, crew) are first counted with a map-side aggregate, so
    the ordered step sees each place once however many rows repeat it.  Only the adaptive
    gap needs a fold, over one run of strictly rising stations.
    """
    keyed = rows.withColumn("tokens_key", F.array_join(F.array_sort(print_tokens(F.col("print"))), ","))
    place = ["station_ft", "date", "crew"]
    places = keyed.groupBy(*LOG_KEY, *place).agg(
        F.count("*").alias("n"), F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key"))
    w = Window.partitionBy(*LOG_KEY).orderBy(*place)

    def conflict(name: str) -> Column:
        here, before = F.col(name), F.lag(name).over(w)
        return (here != "") & (before != "") & (here != before)

    delta = F.col("station_ft") - F.lag("station_ft").over(w)
    hard = F.coalesce((delta <= 0) | conflict("crew") | conflict("date"), F.lit(True))
    repeats = F.coalesce(F.sum((F.col("n") > 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = places.withColumn("hard", hard).withColumn("run", F.sum(F.col("hard").cast("int")).over(w) + repeats)
    runs = runs.withColumn("far", F.coalesce(delta > cfg.min_gap_ft, F.lit(False)))
    ends = runs.select(*LOG_KEY, *place, "far", F.explode(F.array_compact(F.array(
        F.struct("run", F.col("first_key").alias("row_key")),
        F.when(F.col("n") > 1, F.struct((F.col("run") + 1).alias("run"), F.col("last_key").alias("row_key")))))).alias("e"))
    packed = ends.groupBy(*LOG_KEY, F.col("e.run").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("station_ft", "date", "crew", "far", F.col("e.row_key").alias("row_key")))).alias("rows"))
    labelled = (
        packed.withColumn("part", _fold(F.col("rows"), cfg))
        .select(*LOG_KEY, "run", F.explode(F.arrays_zip("rows", "part")).alias("z"))
        .select(*LOG_KEY, F.col("z.rows.row_key").alias("row_key"), F.concat_ws(".", F.col("run"), F.col("z.part")).alias("place"))
    )
    return keyed.join(labelled, [*LOG_KEY, "row_key"], "left").withColumn("group_id", F.concat_ws(
        "|", "project_id", "source_file", "tokens_key", F.coalesce("place", F.concat(F.lit("r"), F.col("row_key"))))).drop("place")


def summarise_groups(grouped: DataFrame) -> DataFrame:
    """One row per group: range, span, tokens, ordered station rows, note text, warnings.

    A group is one run of strictly rising stations, so its array is bounded by the log's range.
    """
    station_row = F.struct("station_ft", "station", "row_key", "depth_ft", "boc_ft", "date", "crew", "print", "notes")
    packed = grouped.groupBy(*GROUP, "source_file", "tokens_key").agg(
        F.count("*").alias("row_count"), F.round(F.min("station_ft"), 2).alias("min_station_ft"),
        F.round(F.max("station_ft"), 2).alias("max_station_ft"),
        F.min_by("print", F.struct("station_ft", "row_key")).alias("first_print"),
        F.array_join(F.array_sort(F.collect_set("notes")), " ").alias("notes_text"),
        F.sort_array(F.collect_list(station_row)).alias("station_rows"))
    steps = F.transform("station_rows", lambda r, i: r["station_ft"] - F.get(F.col("station_rows"), F.greatest(i - 1, F.lit(0)))["station_ft"])
    later = F.slice(steps, 2, F.greatest(F.size("station_rows") - 1, F.lit(1)))
    return packed.withColumns({
        "span_ft": F.round(F.col("max_station_ft") - F.col("min_station_ft"), 2),
        "print_tokens": F.array_distinct(print_tokens(F.col("first_print"))),
        "monotonic_breaks": F.size(F.filter(later, lambda d: d < 0)),
        "duplicate_stations": F.size(F.filter(later, lambda d: F.abs(d) < 1e-9)),
        "context": F.concat_ws(" ", "source_file", "first_print", "notes_text"),
    })


def order_keys(groups: DataFrame) -> DataFrame:
    """Print order of a group (its lowest sheet, else lowest numeric token) and its anchor key."""
    numeric = F.filter(F.transform("print_tokens", lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))), lambda n: n.isNotNull())
    low = F.coalesce(F.array_min("sheets"), F.array_min(numeric))
    return groups.withColumns({
        "print_order": F.coalesce(low, F.lit(1_000_000_000)),
        "anchor_key": F.when(low.isNotNull(), F.concat(F.lit("sheet::"), low))
        .when(F.size("print_tokens") > 0, F.concat(F.lit("print::"), F.array_min("print_tokens")))
        .otherwise("fallback::unknown")})

"""As-built stretches: points, segments, unions, duplicates, coverage and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import Billing
from trenchline.functions import geo
from trenchline.functions.stations import let
from trenchline.operators import routes
from trenchline.operators.clipping import clip
from trenchline.operators.sequences import split_blocks, with_last_mark, with_neighbours
from trenchline.operators.windows import mapped_ft

KEY = routes.KEY
BLOCK_FT = 2000.0


def _placed(claims: DataFrame, groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accepted claims with their station rows and the length of their route."""
    rows = groups.select("project_id", "group_id", "source_file", "min_station_ft", "span_ft", "station_rows", "first_print")
    return claims.where("accepted").join(rows, ["project_id", "group_id"]).join(
        catalog.select(*KEY, "total_ft", "route_name"), KEY)


def station_points(claims: DataFrame, groups: DataFrame, catalog: DataFrame, segments: DataFrame) -> DataFrame:
    """Located station rows of accepted claims, with their role in the group."""
    rows = _placed(claims, groups, catalog)
    each = rows.select(*KEY, "group_id", "source_file", "min_station_ft", "span_ft", "total_ft", "start_ft", F.size("station_rows").alias("n"),
                       F.posexplode("station_rows").alias("pos", "r"))
    at = mapped_ft(F.col("r.station_ft"), F.col("min_station_ft"), F.col("span_ft"), F.col("total_ft"), F.col("start_ft"))
    role = F.when(F.col("pos") == 0, "start").when(F.col("pos") == F.col("n") - 1, "end").otherwise("station")
    points = each.select(*KEY, "group_id", "source_file", "pos", role.alias("point_role"), "r.station", "r.station_ft", "r.depth_ft", "r.boc_ft",
                         "r.notes", "r.date", "r.crew", "r.print", at.alias("at_ft"))
    return routes.locate(points, segments).withColumns({
        "mapped_ft": F.round("at_ft", 2), "lat": F.round("lat", 8), "lon": F.round("lon", 8)}).drop("ratio", "at_ft")


def built_segments(claims: DataFrame, groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stretches between consecutive rows of accepted claims; empty ones left out."""
    rows = _placed(claims, groups, catalog)
    pairs = F.transform(F.slice("station_rows", 2, F.greatest(F.size("station_rows") - 1, F.lit(1))), lambda b, i: F.struct(
        F.get("station_rows", i).alias("a"), b.alias("b"), (i + 1).alias("row_index")))
    each = rows.select(*KEY, "route_name", "group_id", "source_file", "min_station_ft", "span_ft", "total_ft", F.col("start_ft").alias("anchor_ft"), F.explode(pairs).alias("p"))

    def at(row: str) -> Column:
        return mapped_ft(F.col(f"p.{row}.station_ft"), F.col("min_station_ft"), F.col("span_ft"), F.col("total_ft"), F.col("anchor_ft"))

    return (each.withColumns({"start_ft": at("a"), "end_ft": at("b")}).where("end_ft > start_ft").select(
        *KEY, "route_name", "group_id", "source_file", F.col("p.row_index").alias("row_index"), F.col("p.a.station").alias("start_station"),
        F.col("p.b.station").alias("end_station"), F.round("start_ft", 2).alias("start_ft"), F.round("end_ft", 2).alias("end_ft"),
        F.round(F.col("end_ft") - F.col("start_ft"), 2).alias("length_ft"), F.col("p.a.depth_ft").alias("depth_ft"), F.col("p.a.boc_ft").alias("boc_ft"),
        F.col("p.a.notes").alias("notes"), F.col("p.a.date").alias("date"), F.col("p.a.crew").alias("crew"), F.col("p.a.print").alias("print")))


def with_geometry(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds the clipped polyline of each stretch."""
    lines = catalog.select(*KEY, "coords", "chain")
    return segments.join(lines, KEY).withColumn("coords", clip("coords", "chain", "start_ft", "end_ft")).drop("chain")


def _islands(df: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Stretches (s, e) that meet within the tolerance as one, their feet and counts summed."""
    w = Window.partitionBy(*keys).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("s") <= F.round(reach + tolerance, 9), 0).otherwise(1)
    return (df.withColumn("new", new).withColumn("part", F.sum("new").over(w)).groupBy(*keys, "part")
            .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("raw").alias("raw"), F.sum("n").alias("n")).drop("part"))


def _merged(stretches: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Union of stretches with the raw feet and count that went into each.

    Joining near stretches is associative, so it runs in steps: equal starts combine map-side,
    blocks of the route are merged apart, and only their few results meet per key.
    """
    a, b = F.least("start_ft", "end_ft"), F.greatest("start_ft", "end_ft")
    distinct = stretches.select(*keys, a.alias("s"), b.alias("e")).where("e > s").groupBy(*keys, "s").agg(
        F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("raw"), F.count("*").alias("n"))
    blocks = _islands(distinct.withColumn("block", F.floor(F.col("s") / BLOCK_FT)), [*keys, "block"], tolerance).drop("block")
    return _islands(blocks, keys, tolerance)


def merge_intervals(stretches: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Union of stretches per key, bridging gaps up to the tolerance."""
    return _merged(stretches, keys, tolerance).select(
        *keys, F.col("s").alias("start_ft"), F.col("e").alias("end_ft"), (F.col("e") - F.col("s")).alias("length_ft"))


def coverage(stretches: DataFrame, tolerance: float = Billing().merge_tolerance_ft) -> DataFrame:
    """Per route: merged intervals, raw and unique feet, and what overlap took away; one pass over the stretches."""
    item = F.struct(F.round("s", 2).alias("start_ft"), F.round("e", 2).alias("end_ft"), F.round(F.col("e") - F.col("s"), 2).alias("length_ft"))
    per = _merged(stretches, KEY, tolerance).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(item)).alias("merged"), F.sum("n").alias("interval_count"), F.round(F.sum("raw"), 2).alias("raw_length_ft"),
        F.round(F.sum(F.col("e") - F.col("s")), 2).alias("unique_length_ft"))
    return per.select(*KEY, "merged", "interval_count", F.size("merged").alias("merged_count"), "raw_length_ft", "unique_length_ft",
                      F.round(F.greatest(F.lit(0.0), F.col("raw_length_ft") - F.col("unique_length_ft")), 2).alias("overlap_removed_ft"))


def coverage_totals(covered: DataFrame, catalog: DataFrame, cfg: Billing = Billing()) -> DataFrame:
    """Per project: coverage, completion of the covered routes (of all when none), and billing."""
    lengths = catalog.select(*KEY, F.col("length_ft").alias("design_ft"))
    whole = lengths.groupBy("project_id").agg(F.sum("design_ft").alias("all_ft"))
    part = covered.join(lengths, KEY).groupBy("project_id").agg(
        F.sum("interval_count").alias("interval_count"), F.sum("merged_count").alias("merged_count"), F.round(F.sum("raw_length_ft"), 2).alias("raw_length_ft"),
        F.round(F.sum("unique_length_ft"), 2).alias("covered_ft"), F.sum("design_ft").alias("covered_design_ft"))
    done = F.coalesce("covered_ft", F.lit(0.0))
    design = F.coalesce("covered_design_ft", "all_ft")
    return whole.join(part, "project_id", "left").select(
        "project_id", F.coalesce("interval_count", F.lit(0)).alias("interval_count"), F.coalesce("merged_count", F.lit(0)).alias("merged_count"),
        F.coalesce("raw_length_ft", F.lit(0.0)).alias("raw_length_ft"), done.alias("covered_ft"),
        F.round(F.greatest(F.lit(0.0), F.coalesce("raw_length_ft", F.lit(0.0)) - done), 2).alias("overlap_removed_ft"),
        F.round(design, 2).alias("design_ft"), F.round(F.when(design > 0, F.round(done / design * 100, 8)).otherwise(0.0), 2).alias("completion_pct"), *billing(done, cfg))


def billing(feet: Column, cfg: Billing = Billing()) -> list[Column]:
    """Material, splicing and total for unique feet."""
    def money(rate: float, name: str) -> Column:
        return F.round(F.round(feet * rate, 6), 2).cast("decimal(18,2)").alias(name)
    return [money(cfg.material_rate, "material_total"), money(cfg.splicing_rate, "splicing_total"), money(cfg.material_rate + cfg.splicing_rate, "grand_total")]


def active_coverage(intervals: DataFrame, active: DataFrame, tolerance: float = Billing().merge_tolerance_ft) -> DataFrame:
    """Coverage of each project's active route alone."""
    own = intervals.join(active.select("project_id", "route_id"), ["project_id", "route_id"], "left_semi")
    covered = coverage(own, tolerance).select("project_id", "route_id", "merged_count", "unique_length_ft")
    feet = F.coalesce("unique_length_ft", F.lit(0.0))
    share = F.when(F.col("length_ft") > 0, F.round(F.round(feet / F.col("length_ft") * 100, 8), 2)).otherwise(0.0)
    return active.join(covered, ["project_id", "route_id"], "left").select(
        "project_id", "route_id", "length_ft", F.coalesce("merged_count", F.lit(0)).alias("merged_count"), feet.alias("unique_length_ft"), share.alias("completion_pct"))


def design_length(catalog: DataFrame) -> DataFrame:
    """Feet of distinct routes per project."""
    return catalog.groupBy(*KEY).agg(F.first("length_ft").alias("length_ft")).groupBy("project_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("length_ft"))), 2).alias("design_ft"))


def overlap_class(same_source: Column, overlap: Column, a_len: Column, b_len: Column) -> Column:
    """What one stretch is to an earlier one: duplicate, to trim, minor, or apart."""
    ratio = overlap / F.greatest(F.least(a_len, b_len), F.lit(1e-9))
    return (F.when(same_source & (ratio > 0.85), "drop_duplicate").when(same_source & (ratio > 0.5), "trim_partial")
            .when(overlap > 0, "minor_overlap_keep").otherwise("no_overlap"))


def _piece(s: Column, e: Column) -> Column:
    return F.struct(F.round(s, 2).alias("s"), F.round(e, 2).alias("e"))


def subtract(piece: Column, taken: Column) -> Column:
    """What is left of a stretch beside another: at most two pieces longer than .01 ft."""
    left = F.when(piece["s"] < taken["s"], _piece(piece["s"], F.least(piece["e"], taken["s"])))
    right = F.when(piece["e"] > taken["e"], _piece(F.greatest(piece["s"], taken["e"]), piece["e"]))
    return F.filter(F.array_compact(F.array(left, right)), lambda p: F.round(p["e"] - p["s"], 6) > 0.01)


def deduplicate(stretches: DataFrame) -> DataFrame:
    """Greedy removal of repeated stretches of one (route, file, crew, date).

    Stretches of different sources are both kept, so each source stands alone.  Equal ranges
    are one row before anything is ordered, and ranges that do not meet are settled apart:
    a fold sees only the distinct overlapping ranges of one source in one place.
    """
    keys = [*KEY, "source_file", "crew", "date"]
    once = stretches.groupBy(*keys, F.least("start_ft", "end_ft").alias("s"), F.greatest("start_ft", "end_ft").alias("e")).agg(F.min("row_key").alias("row_key")).where("e > s")
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    clustered = once.withColumn("new", F.when(F.col("s") < reach, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(w))
    packed = clustered.groupBy(*keys, "cluster").agg(F.sort_array(F.collect_list(F.struct("s", "e", "row_key"))).alias("rows"))
    item = "array<struct<s:double,e:double,row_key:bigint>>"

    def against(parts: Column, held: Column) -> Column:
        def one(p: Column) -> Column:
            over = F.greatest(F.lit(0.0), F.least(p["e"], held["e"]) - F.greatest(p["s"], held["s"]))
            ratio = over / F.greatest(F.least(p["e"] - p["s"], held["e"] - held["s"]), F.lit(1e-9))
            left = F.transform(subtract(p, held), lambda q: F.struct(q["s"].alias("s"), q["e"].alias("e"), p["row_key"].alias("row_key")))
            return F.when(F.round(ratio, 9) > 0.85, F.array().cast(item)).when(F.round(ratio, 9) > 0.5, left).otherwise(F.array(p))
        return F.flatten(F.transform(parts, one))

    kept = F.aggregate("rows", F.array().cast(item), lambda acc, r: F.concat(acc, F.aggregate(acc, F.array(r).cast(item), against)))
    # a lone range needs no fold
    return packed.withColumn("k", F.when(F.size("rows") == 1, F.col("rows").cast(item)).otherwise(kept)).select(*keys, F.explode("k").alias("p")).select(
        *keys, F.col("p.s").alias("start_ft"), F.col("p.e").alias("end_ft"), F.round(F.col("p.e") - F.col("p.s"), 2).alias("length_ft"), F.col("p.row_key").alias("row_key"))


def drill_runs(segments: DataFrame, rate: float) -> DataFrame:
    """Consecutive stretches with one route, print and file as one run: first and last station, feet, cost.

    Runs are islands of equal keys in the project's order; files are the blocks, so a large
    project spreads over its files.
    """
    order = ["source_file", "print", "group_id", "row_index"]
    run_key = F.struct("route_id", "print", "source_file")
    blocked = split_blocks(segments.withColumn("k", run_key), ["project_id"], F.col("source_file"))
    near = with_neighbours(blocked, ["project_id"], order, ["k"])
    place = F.struct("source_file", "print", "group_id", "row_index")
    marked = near.withColumn("mark", F.when(F.col("prev").isNull() | (F.col("prev.k") != F.col("k")), place))
    runs = with_last_mark(marked, ["project_id"], order, "mark", "run")
    return runs.groupBy("project_id", "run", "route_id", "print", "source_file").agg(
        F.min_by("start_station", place).alias("start_station"), F.max_by("end_station", place).alias("end_station"),
        F.round(F.sum("length_ft"), 2).alias("length_ft"), F.round(F.sum("length_ft") * rate, 2).alias("cost"), F.count("*").alias("n_segments")).drop("run")


def manual_billing(segments: DataFrame, covered: DataFrame, manual: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Billing by raw feet: the manual figure when given, else summed stretches, else coverage; plus exceptions."""
    raw = segments.groupBy("project_id").agg(F.sum("length_ft").alias("raw_ft"))
    extra = exceptions.groupBy("project_id").agg(F.sum("amount").alias("exception_total"))
    feet = F.coalesce(F.when(F.col("manual_ft") > 0, F.col("manual_ft")), F.when(F.col("raw_ft") > 0, F.col("raw_ft")), F.col("covered_ft"), F.lit(0.0))
    return (manual.join(raw, "project_id", "left").join(covered.select("project_id", "covered_ft"), "project_id", "left").join(extra, "project_id", "left")
            .select("project_id", F.round(feet, 2).alias("footage_ft"), F.round(F.round(feet * F.col("rate"), 6), 2).alias("base_total"),
                    F.round(F.round(feet * F.col("rate") + F.coalesce("exception_total", F.lit(0.0)), 6), 2).alias("final_total")))

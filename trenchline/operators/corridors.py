"""Design-sheet text to a corridor graph, log-to-corridor matching, and the route pool it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.functions import text as tx
from trenchline.functions.stations import feet_from_station, let, station_scan
from trenchline.operators import chains, substrings
from trenchline.operators.sequences import split_blocks, with_neighbours
from trenchline.session import cut_lineage
from trenchline.sources.bore_logs import scan_page_text

LOG = ["project_id", "source_file"]
CHAIN_POOL, CHAINS_KEPT = 18, 10


def _feet(text: Column) -> Column:
    return let(station_scan(text), feet_from_station)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def page_facts(pages: DataFrame) -> DataFrame:
    """Sheet id, streets, labels, station equations and matchlines of each page."""
    text = F.col("compact_text")
    equations = F.filter(F.zip_with(_all(text, tx.EQUATION, 1), _all(text, tx.EQUATION, 2), lambda a, b: F.struct(
        _feet(a).alias("parent_ft"), _feet(b).alias("local_ft"))), lambda e: e["parent_ft"].isNotNull() & e["local_ft"].isNotNull())
    matchlines = F.zip_with(_all(text, tx.MATCHLINE, 1), _all(text, tx.MATCHLINE, 2), lambda s, sheet: F.struct(
        F.filter(F.transform(_all(F.regexp_replace(s, r"\s+", ""), tx.STATION_TOKEN, 0), _feet), lambda v: v.isNotNull()).alias("stations"),
        F.trim(sheet).alias("see_sheet")))
    sheet, drawing = F.regexp_extract(text, tx.SHEET, 1), F.regexp_extract(text, tx.DRAWING, 1)
    labels = F.concat(_all(text, tx.SPLICE, 1), _all(text, tx.HANDHOLE, 1), _all(text, tx.CONTEXT, 0), _all(text, tx.ADDRESS, 0))
    return scan_page_text(pages).withColumns({
        "sheet_id": F.when(sheet != "", sheet).when(drawing != "", drawing).otherwise(F.col("page_number").cast("string")),
        "streets": let(_all(text, tx.STREET, 0), tx.ordered_distinct), "labels": let(labels, tx.ordered_distinct),
        "equations": F.array_sort(equations), "matchlines": matchlines})


def corridor_segments(facts: DataFrame) -> DataFrame:
    """One row per station range, with its chain (main, or a branch after a station reset) and
    the sheets before and after it."""
    text = F.col("compact_text")
    ranges = F.zip_with(_all(text, tx.STATION_RANGE, 1), _all(text, tx.STATION_RANGE, 2), lambda a, b: F.struct(_feet(a).alias("a"), _feet(b).alias("b")))
    base = (
        facts.select("*", F.posexplode(ranges).alias("range_no", "r")).where(F.col("r.a").isNotNull() & F.col("r.b").isNotNull())
        .withColumns({"start_ft": F.least("r.a", "r.b"), "end_ft": F.greatest("r.a", "r.b"),
                      "corridor_id": F.concat_ws("_", F.lit("corr"), "source_file", "page_number", F.col("range_no") + 1)}))
    numbered = F.transform("equations", lambda e, i: F.struct(i.alias("i"), e["parent_ft"].alias("parent_ft"), e["local_ft"].alias("local_ft")))
    branch = F.get(F.filter(numbered, lambda e: (e["local_ft"] <= 0) & (F.col("end_ft") <= F.greatest(e["parent_ft"] - 100.0, F.lit(150.0)))), F.lit(0))

    def touching(at: str) -> Column:
        hits = F.filter("matchlines", lambda m: (m["see_sheet"] != "") & F.exists(m["stations"], lambda v: F.abs(v - F.col(at)) <= 5.0))
        return F.try_element_at(F.transform(hits, lambda m: m["see_sheet"]), F.lit(-1))

    named = F.transform(F.filter("matchlines", lambda m: F.size(m["stations"]) > 0), lambda m: m["see_sheet"])
    return base.withColumn("_b", branch).withColumns({
        "chain_id": F.when(F.col("_b").isNull(), F.concat(F.lit("sheet_"), "sheet_id", F.lit("_main"))).otherwise(
            F.concat(F.lit("sheet_"), "sheet_id", F.lit("_branch_"), F.col("_b.i") + 1)),
        "equation_parent_ft": F.col("_b.parent_ft"), "length_ft": F.col("end_ft") - F.col("start_ft"),
        "sheet_before": touching("start_ft"), "sheet_after": touching("end_ft"), "see_sheets": let(named, tx.ordered_distinct),
        "station_bucket": F.concat(F.floor(F.col("start_ft") / 100).cast("string"), F.lit("xx"))}).drop("_b", "r")


def corridor_edges(segments: DataFrame) -> DataFrame:
    """Neighbours along a chain, and across sheets that refer to each other where ends come
    within 10 ft.

    The sheet link is an equi-join on sheet and a 20-ft bin of the touching end, so pairs
    are formed only where ends are near.
    """
    w = Window.partitionBy("project_id", "chain_id").orderBy("start_ft", "end_ft", "page_number", "corridor_id")
    beside = segments.select("project_id", F.col("corridor_id").alias("src"), F.lag("corridor_id").over(w).alias("before"), F.lead("corridor_id").over(w).alias("after"))
    chained = beside.select("project_id", "src", F.explode(F.array_compact(F.array("before", "after"))).alias("dst"))
    slim = segments.select("project_id", "corridor_id", "sheet_id", "sheet_before", "sheet_after", "see_sheets", "start_ft", "end_ft")
    refers = slim.select("*", F.explode(F.array_compact(F.array_distinct(F.array("sheet_before", "sheet_after")))).alias("sheet"))
    shown = slim.select("*", F.explode("see_sheets").alias("sheet"))
    own = slim.withColumn("sheet", F.col("sheet_id"))

    def near(a: DataFrame, b: DataFrame, a_end: str, b_end: str) -> DataFrame:
        left = a.select("project_id", "sheet", F.col("corridor_id").alias("src"), F.col(a_end).alias("x"),
                        F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(a_end) / 20) + d)).alias("bin"))
        right = b.select("project_id", "sheet", F.col("corridor_id").alias("dst"), F.col(b_end).alias("y"), F.floor(F.col(b_end) / 20).alias("bin"))
        return left.join(right, ["project_id", "sheet", "bin"]).where((F.abs(F.col("x") - F.col("y")) <= 10) & (F.col("src") != F.col("dst"))).select("project_id", "src", "dst")

    crossing = None
    for a, b in ((refers, own), (own, shown)):
        for ends in (("end_ft", "start_ft"), ("start_ft", "end_ft")):
            part = near(a, b, *ends)
            crossing = part if crossing is None else crossing.unionByName(part)
    return chained.unionByName(crossing).distinct()


def log_contexts(rows: DataFrame) -> DataFrame:
    """Range, words and station-reset sign of each log; rows come in row_no order.

    Words are made distinct as rows before they meet per log, so a log carries its
    vocabulary and never its text.
    """
    words = tx.tokens(F.concat_ws(" ", "notes", "print", "crew", "source_file", "date"))
    known = (rows.select(*LOG, F.explode(words).alias("word")).distinct()
             .groupBy(*LOG).agg(F.array_sort(F.collect_list("word")).alias("words")))
    runs = [*LOG, "print"]
    near = with_neighbours(split_blocks(rows, runs, F.floor(F.col("row_no") / 5000)), runs, ["row_no"], ["station_ft"])
    ranges = near.groupBy(*LOG).agg(
        F.min("station_ft").alias("min_ft"), F.max("station_ft").alias("max_ft"),
        F.max(F.coalesce(F.col("station_ft") + 1 < F.col("prev.station_ft"), F.lit(False))).alias("stations_reset"))
    return (ranges.join(known, LOG, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
            .withColumn("span_ft", F.col("max_ft") - F.col("min_ft")))


def match_corridors(logs: DataFrame, segments: DataFrame, keep: int = 8) -> DataFrame:
    """Best corridors of each log, with min-max confidence and the lead of the first."""
    seg = segments.select("project_id", "corridor_id", "sheet_id", "chain_id", "start_ft", "end_ft", "length_ft", "equation_parent_ft", "streets", "labels",
                          F.array_distinct(tx.tokens(F.concat_ws(" ", F.concat("streets", "labels"), "compact_text"))).alias("seg_words"))
    overlap = F.greatest(F.lit(0.0), F.least("end_ft", "max_ft") - F.greatest("start_ft", "min_ft"))
    contained = F.when(F.col("span_ft") <= 0, F.when(F.col("min_ft").between(F.col("start_ft"), F.col("end_ft")), 1.0).otherwise(0.0)).otherwise(
        overlap / F.greatest("span_ft", F.lit(1.0)))
    full = (F.col("start_ft") <= F.col("min_ft") + 5) & (F.col("end_ft") >= F.col("max_ft") - 5)
    shared = F.size(F.array_intersect("words", "seg_words"))
    score = (contained * 650 - F.abs(F.col("length_ft") - F.col("span_ft")) * 0.55 + F.when(full, 240).when(overlap > 0, 120).otherwise(0)
             + F.when(F.col("max_ft") <= F.col("equation_parent_ft"), 90).otherwise(0) + F.least(shared, F.lit(5)) * 24)
    scored = logs.join(seg, "project_id").withColumns({
        "overlap_ft": F.round(overlap, 2), "containment": F.round(contained, 4), "shared_words": shared, "raw_score": F.round(score, 4)})
    w = Window.partitionBy(*LOG)
    spread = F.greatest(F.max("raw_score").over(w) - F.min("raw_score").over(w), F.lit(1e-9))
    ordered = w.orderBy(F.desc("raw_score"), F.asc("corridor_id"))
    ranked = scored.withColumns({
        "confidence": F.round((F.col("raw_score") - F.min("raw_score").over(w)) / spread, 4), "rank": F.row_number().over(ordered),
        "second": F.lead("raw_score").over(ordered)}).where(F.col("rank") <= keep)
    margin = F.when(F.col("rank") == 1, F.round((F.col("raw_score") - F.coalesce("second", "raw_score")) / F.greatest(F.abs("raw_score"), F.lit(1.0)), 4))
    return ranked.withColumn("margin", margin).withColumn("strong", F.coalesce(
        ((F.col("confidence") >= 0.68) & (F.col("margin") >= 0.08)) | ((F.col("confidence") >= 0.84) & (F.col("margin") >= 0.03)), F.lit(False))).withColumn(
        "station_reset", F.col("stations_reset") | F.col("equation_parent_ft").isNotNull()).drop("second", "seg_words")


def anchor_words(best: DataFrame) -> DataFrame:
    """LOG and word: the words of each log's best corridor that may name a design point."""
    text = F.concat_ws(" ", F.concat("streets", "labels"))
    extra = F.regexp_extract_all(text, F.lit(r"(?i)(?:SPLICE\s+LOC\s*\d+|AP-\d+|\d{3})"), F.lit(0))
    words = F.array_distinct(tx.tokens(F.concat_ws(" ", text, F.array_join(extra, " ")), 2, keep_numbers=True))
    return best.select(*LOG, F.explode(words).alias("word"))


def anchor_points(best: DataFrame, points: DataFrame) -> DataFrame:
    """Design points whose name, folder or role holds a word of the best corridor, per log.

    Words meet names through an index of their letter triples (`substrings.holders`), once a
    project; logs then meet the points by the words they share.
    """
    words = anchor_words(best)
    named = points.withColumn("hay", F.lower(F.concat_ws(" ", "name", "folder_path", "role")))
    hits = substrings.holders(words, named, ["project_id"], "word", "hay")
    found = words.join(hits, ["project_id", "word"]).select(*LOG, "hay").distinct().join(named.select("project_id", "hay", "lat", "lon"), ["project_id", "hay"])
    return found.groupBy(*LOG).agg(F.array_sort(F.collect_set(F.struct("lat", "lon"))).alias("anchors"))


def _spot(coords: Column, anchors: Column) -> Column:
    """Least distance from any vertex to any anchor."""
    return F.array_min(F.transform(coords, lambda p: F.array_min(F.transform(anchors, lambda a: geo.flat_ft(p["lat"], p["lon"], a["lat"], a["lon"])))))


def name_penalty(name: Column, folder: Column, role: Column) -> Column:
    """How little a route name says: blank, equal to its folder or role, or a generic term."""
    n, f, r = F.lower(F.trim(name)), F.lower(F.trim(folder)), F.translate(F.lower(F.trim(role)), "_", " ")
    total = (F.when((n == r) | (n == f), 220).otherwise(0) + F.when((r != "") & F.startswith(n, r), 120).otherwise(0)
             + F.when((f != "") & F.contains(n, f), 80).otherwise(0)
             + F.when(tx.has(n, "underground cable", "connections", "backbone", "terminal tail", "vacant pipe"), 60).otherwise(0))
    return F.when(n == "local corridor chain", 5.0).when(n == "", 220.0).otherwise(total.cast("double"))


def gate_inputs(best: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per log: anchors, locality radius, padded box and preferred roles."""
    base = best.select(*LOG, "min_ft", "max_ft", "span_ft", tx.corridor_roles(F.concat_ws(" ", F.concat("labels", "streets"))).alias("roles")).join(anchors, LOG, "left")
    n = F.size("anchors")
    lat = F.aggregate("anchors", F.lit(0.0), lambda a, p: a + p["lat"]) / n
    lon = F.aggregate("anchors", F.lit(0.0), lambda a, p: a + p["lon"]) / n
    base = base.withColumns({"anchors": F.coalesce("anchors", F.array().cast("array<struct<lat:double,lon:double>>"))}).withColumns({"c_lat": lat, "c_lon": lon})
    spread = F.array_max(F.transform("anchors", lambda a: geo.flat_ft(F.col("c_lat"), F.col("c_lon"), a["lat"], a["lon"])))
    base = base.withColumn("spread_ft", spread)
    radius = F.least(F.lit(650.0), F.greatest(F.lit(140.0), F.col("spread_ft") + 120, F.least(F.col("span_ft") * 0.22, F.lit(260.0)), F.least(F.col("max_ft") * 0.18, F.lit(240.0))))
    margin = F.least(F.lit(320.0), F.greatest(F.lit(120.0), F.col("spread_ft") * 0.35 + 120))
    base = base.withColumns({"radius_ft": F.when(n > 0, radius), "margin_ft": F.when(n > 0, margin)})
    dlat, dlon = F.col("margin_ft") / geo.FEET_PER_DEG, F.col("margin_ft") / F.greatest(geo.lon_scale(F.col("c_lat"), floor=0.2), F.lit(1.0))

    def edge(pick, name: str) -> Column:
        return pick(F.transform("anchors", lambda a: a[name]))

    return base.withColumn("box", F.when(n > 0, F.struct(
        (edge(F.array_min, "lat") - dlat).alias("min_lat"), (edge(F.array_max, "lat") + dlat).alias("max_lat"),
        (edge(F.array_min, "lon") - dlon).alias("min_lon"), (edge(F.array_max, "lon") + dlon).alias("max_lon"))))


def gate_routes(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every (log, route) with its locality facts, first reject reason (null when kept) and
    whether it may seed a chain.  Logs without anchors keep all routes."""
    priority = F.col("priority") if "priority" in catalog.columns else F.lit(0.0)
    routes = catalog.select("project_id", "route_id", "route_name", "source_folder", "route_role", F.col("length_ft").alias("route_ft"), "coords", priority.alias("priority"))
    pairs = inputs.join(routes, "project_id")
    anchored = F.size("anchors") > 0
    short = F.col("route_ft") < F.col("max_ft") - 25
    long_ = F.col("route_ft") > F.greatest(F.col("max_ft") * 1.6, F.col("span_ft") * 1.95, F.lit(950.0))
    delta = (F.col("span_ft") > 0) & (F.abs(F.col("route_ft") - F.col("span_ft")) > F.greatest(F.lit(140.0), F.least(F.lit(360.0), F.col("span_ft") * 0.28 + 40)))
    fits = ~short & ~long_ & ~delta
    staged = pairs.withColumns({"fits": fits, "away_ft": F.when(fits & anchored, _spot(F.col("coords"), F.col("anchors")))})
    staged = staged.withColumn("hit", F.coalesce(F.round(F.col("away_ft"), 6) <= F.round("radius_ft", 6), F.lit(False)))
    inside = F.size(F.filter("coords", lambda p: geo.inside_box(p["lat"], p["lon"], F.col("box")))) / F.size("coords")
    first, last = F.get("coords", F.lit(0)), F.element_at("coords", -1)
    end_in = geo.inside_box(first["lat"], first["lon"], F.col("box")) | geo.inside_box(last["lat"], last["lon"], F.col("box"))
    staged = staged.withColumns({
        "box_share": F.round(F.when(F.col("hit"), inside).otherwise(0.0), 4), "end_inside": F.col("hit") & end_in,
        "locality": F.round(F.when(F.col("hit"), F.greatest(F.lit(0.0), 1 - F.col("away_ft") / F.greatest("radius_ft", F.lit(1.0)))).otherwise(0.0), 4)})
    reason = (F.when(~anchored, None).when(short, "length_short").when(long_, "length_long").when(delta, "span_delta")
              .when(~F.col("hit"), "anchor_distance").when((F.col("box_share") < 0.55) & ~F.col("end_inside"), "bbox"))
    place = F.array_position("roles", F.col("route_role"))
    seed = anchored & F.col("away_ft").isNotNull() & (F.col("away_ft") <= F.greatest(F.col("radius_ft") * 1.35, F.col("radius_ft") + 90)) & (
        (F.col("box_share") >= 0.28) | F.col("end_inside"))
    return staged.withColumns({
        "reject": reason, "role_preferred": place > 0, "chain_seed": F.coalesce(seed, F.lit(False)), "anchored": anchored, "gate_ft": F.round("away_ft", 2),
        "penalty": F.round(name_penalty(F.col("route_name"), F.col("source_folder"), F.col("route_role")) * 1.6, 2),
        "role_bonus": F.when(place > 0, (F.size("roles") - place + 1) * 85.0).otherwise(0.0)}).drop("fits", "hit")


def gate_counts(gated: DataFrame) -> DataFrame:
    """Routes kept and refused per reason, per log."""
    reasons = ("length_short", "length_long", "span_delta", "anchor_distance", "bbox")
    return gated.groupBy(*LOG).agg(
        F.count("*").alias("n_routes"), F.count_if(F.col("reject").isNull()).alias("kept"), F.count_if(~F.col("role_preferred")).alias("role"),
        *[F.count_if(F.col("reject") == r).alias(r) for r in reasons])


def local_family(kept: DataFrame, cap: int = 8) -> DataFrame:
    """Logs with more than `cap` anchored routes keep the tightest family of near routes.

    The seed is the route with most others within the radius; its `cap` nearest stay.
    """
    n = F.count("*").over(Window.partitionBy(*LOG))
    counted = kept.withColumn("_n", n)
    few = counted.where((F.col("_n") <= cap) | ~F.col("anchored")).drop("_n")
    c = counted.where((F.col("_n") > cap) & F.col("anchored")).drop("_n").withColumns({
        "y": F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["lat"]) / F.size("coords"),
        "x": F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["lon"]) / F.size("coords")})
    radius = F.least(F.lit(575.0), F.greatest(F.lit(220.0), F.col("span_ft") * 0.55 + 160))
    seeds = c.select(*LOG, F.col("route_id").alias("seed"), F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("locality").alias("seed_locality"))
    near = c.join(seeds, LOG).withColumn("d", geo.flat_ft(F.col("sy"), F.col("sx"), F.col("y"), F.col("x"))).where(F.col("d") <= radius)
    best = (near.groupBy(*LOG, "seed").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.max("seed_locality").alias("l"))
            .groupBy(*LOG).agg(F.max_by("seed", F.struct("n", (-F.round("total", 6)).alias("t"), (-F.col("l")).alias("l"), "seed")).alias("seed")))
    order = Window.partitionBy(*LOG).orderBy(F.round("d", 2), F.desc("locality"), F.desc("box_share"), "penalty", F.abs(F.col("route_ft") - F.col("span_ft")), "route_id")
    family = near.join(best, [*LOG, "seed"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap)
    return few.unionByName(family.select(few.columns))


def synthetic_chains(kept: DataFrame, gated: DataFrame, distances: DataFrame, pool_size: int | None = CHAIN_POOL, keep: int | None = CHAINS_KEPT) -> DataFrame:
    """Chains built from the kept routes of a log, or from its seeds when fewer than two were kept.

    `distances` are the link distances of the catalog.  The pool is the most local routes, all
    of them without `pool_size`.
    """
    n = kept.groupBy(*LOG).agg(F.count("*").alias("_n"))
    enough = n.where("_n >= 2").select(*LOG)
    seeds = gated.where("chain_seed").join(enough, LOG, "left_anti")
    source = kept.join(enough, LOG, "left_semi").unionByName(seeds.select(kept.columns))
    target = F.when(F.col("max_ft") > 0, F.col("max_ft")).otherwise(F.col("span_ft"))
    order = Window.partitionBy(*LOG).orderBy(F.desc("locality"), F.desc("box_share"), F.abs(F.col("route_ft") - F.col("target_ft")), F.coalesce("gate_ft", F.lit(1e9)), F.asc("route_id"))
    pool = source.withColumn("target_ft", target).where("target_ft > 0").withColumn("place", F.row_number().over(order))
    if pool_size is not None:
        pool = pool.where(F.col("place") <= pool_size)
    slim = pool.select(*LOG, "route_id", "route_role", "route_ft", "coords", "locality", "box_share", "gate_ft", "role_bonus", "priority", "target_ft", "place")
    return chains.best_chains(cut_lineage(slim), distances, keep)


def prune_same_names(routes: DataFrame) -> DataFrame:
    """The most local route of each (folder, role, name) per log, with its family size."""
    low = [F.lower(F.trim(c)).alias(f"_{c}") for c in ("source_folder", "route_role", "route_name")]
    order = F.struct((-F.col("locality")).alias("a"), (-F.col("box_share")).alias("b"), F.coalesce("gate_ft", F.lit(1e9)).alias("c"),
                     F.abs(F.col("route_ft") - F.col("span_ft")).alias("d"), F.col("penalty").alias("e"), F.col("route_id").alias("f"))
    rest = [c for c in routes.columns if c not in LOG]
    return (routes.groupBy(*LOG, *low).agg(F.min_by(F.struct(*rest), order).alias("r"), F.count("*").alias("family_size"))
            .select(*LOG, "r.*", "family_size"))


def filtered_pool(gated: DataFrame, catalog: DataFrame, family: int = 8, pool_size: int | None = CHAIN_POOL, keep: int | None = CHAINS_KEPT) -> DataFrame:
    """Final route pool of each log: kept routes, their local family, chains, one per name."""
    kept = local_family(gated.where(F.col("reject").isNull()), family)
    distances = cut_lineage(chains.link_distances(catalog))
    built = synthetic_chains(kept, gated, distances, pool_size, keep)
    cols = [*LOG, "route_id", "route_name", "source_folder", "route_role", "route_ft", "locality", "box_share", "gate_ft", "penalty", "role_bonus", "priority", "coords"]
    spans = gated.select(*LOG, "span_ft").distinct()
    both = kept.select(*cols).unionByName(built.select(*cols)).join(spans, LOG)
    pruned = prune_same_names(both)
    n = F.count("*").over(Window.partitionBy(*LOG))
    return pruned.withColumn("too_broad", n > 6)

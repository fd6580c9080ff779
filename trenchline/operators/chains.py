"""Route chains: sets of a few linked routes that together suit a log.

Which routes may link is one table for a whole catalog, made by a grid join of their ends,
centres and vertices.  A set needs every member to link to another member, so it is a union of
connected sets of at least two: connected sets grow along links, one route at a time, and
those apart meet in a band join on their joint length.  Sets longer than allowed go at once,
as adding routes never shortens them.  Sets carry places of routes; geometry joins last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.functions.stations import let
from trenchline.session import cut_lineage

LOG = ["project_id", "source_file"]
LEAST_LINK_FT, MOST_LINK_FT = 90.0, 240.0
CENTRES, BODY = 1.45, 1.10  # multiples of the link length for centres, and for an end and a body
#: Cells are as wide as the farthest link, with a little to spare for the curvature within one.
CELL_DEG = MOST_LINK_FT * CENTRES / geo.FEET_PER_DEG * 1.01


def _row(lat: Column) -> Column:
    return F.floor(lat / CELL_DEG)


def _column(lon: Column, row: Column) -> Column:
    return F.floor(lon * F.greatest(F.cos(F.radians((row + 0.5) * CELL_DEG)), F.lit(1e-3)) / CELL_DEG)


def _in_cells(points: DataFrame) -> DataFrame:
    return points.withColumn("cy", _row(F.col("lat"))).withColumn("cx", _column(F.col("lon"), F.col("cy")))


def _around(points: DataFrame) -> DataFrame:
    """Each point in its nine cells; columns follow the width of the row they are in."""
    beside = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    rows = points.select("*", beside.alias("dy")).withColumn("cy", _row(F.col("lat")) + F.col("dy")).drop("dy")
    return rows.select("*", beside.alias("dx")).withColumn("cx", _column(F.col("lon"), F.col("cy")) + F.col("dx")).drop("dx")


def _met(a: DataFrame, b: DataFrame, most_ft: float) -> DataFrame:
    """Points of different routes of a project at most `most_ft` apart; b's columns get the prefix b_."""
    here = _in_cells(b).select("project_id", "cy", "cx", *(F.col(c).alias(f"b_{c}") for c in b.columns if c != "project_id"))
    near = _around(a).join(here, ["project_id", "cy", "cx"]).where(F.col("route_id") != F.col("b_route_id"))
    return near.withColumn("ft", geo.flat_ft(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))).where(F.col("ft") <= most_ft)


def link_distances(routes: DataFrame) -> DataFrame:
    """project_id, a, b (a < b) and end_ft, body_ft, centre_ft: how near two routes come, null beyond any link.

    `routes` has project_id, route_id, coords; routes of one point link to none.
    """
    whole = routes.where(F.size("coords") >= 2)
    vertices = whole.select("project_id", "route_id", F.size("coords").alias("n"), F.posexplode("coords").alias("idx", "p")).select(
        "project_id", "route_id", "p.lat", "p.lon", ((F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1)).alias("is_end"))

    def mean(name: str) -> Column:
        return F.aggregate("coords", F.lit(0.0), lambda a, p: a + p[name]) / F.size("coords")

    centres = whole.select("project_id", "route_id", mean("lat").alias("lat"), mean("lon").alias("lon"))
    null = F.lit(None).cast("double")
    bodies = _met(vertices.where("is_end").drop("is_end"), vertices, MOST_LINK_FT * BODY).select(
        "project_id", "route_id", "b_route_id", F.when(F.col("b_is_end"), F.col("ft")).alias("end_ft"), F.col("ft").alias("body_ft"), null.alias("centre_ft"))
    middles = _met(centres, centres, MOST_LINK_FT * CENTRES).select(
        "project_id", "route_id", "b_route_id", null.alias("end_ft"), null.alias("body_ft"), F.col("ft").alias("centre_ft"))
    return (bodies.unionByName(middles).groupBy("project_id", F.least("route_id", "b_route_id").alias("a"), F.greatest("route_id", "b_route_id").alias("b"))
            .agg(*(F.min(c).alias(c) for c in ("end_ft", "body_ft", "centre_ft"))))


def linked(link_ft: Column) -> Column:
    return F.coalesce(F.col("end_ft") <= link_ft, F.lit(False)) | F.coalesce(F.col("body_ft") <= link_ft * BODY, F.lit(False)) | F.coalesce(
        F.col("centre_ft") <= link_ft * CENTRES, F.lit(False))


def pool_links(pool: DataFrame, distances: DataFrame) -> DataFrame:
    """LOG, near, far, feet (of far): links between the routes of each log's pool, both ways."""
    link = F.greatest(F.lit(LEAST_LINK_FT), F.least(F.lit(MOST_LINK_FT), F.col("target_ft") * 0.14 + 30.0))
    both = distances.unionByName(distances.select("project_id", F.col("b").alias("a"), F.col("a").alias("b"), "end_ft", "body_ft", "centre_ft"))
    one = pool.select(*LOG, F.col("route_id").alias("a"), F.col("place").alias("near"), link.alias("link_ft"))
    other = pool.select(*LOG, F.col("route_id").alias("b"), F.col("place").alias("far"), F.col("route_ft").alias("feet"))
    return one.join(both, ["project_id", "a"]).where(linked(F.col("link_ft"))).join(other, [*LOG, "b"]).select(*LOG, "near", "far", "feet")


def _grown(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Sets with one more route that a member links to."""
    each = sets.select(*LOG, "members", "feet", "most_ft", F.explode("members").alias("near"))
    more = each.join(links.withColumnRenamed("feet", "far_feet"), [*LOG, "near"]).where(~F.array_contains("members", F.col("far")))
    more = more.withColumns({"feet": F.col("feet") + F.col("far_feet"), "members": F.array_sort(F.array_append("members", F.col("far")))})
    return more.where(F.col("feet") <= F.col("most_ft")).select(*LOG, "members", "feet", "most_ft").dropDuplicates([*LOG, "members"])


def _side_by_side(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Unions of a pair and another set without a common member, met by bins of joint length."""
    width = F.col("most_ft") - F.col("least_ft")
    here = others.join(pairs.select(*LOG, "least_ft").distinct(), LOG).select(
        *LOG, F.col("members").alias("others"), F.col("feet").alias("other_feet"), F.floor(F.col("feet") / width).alias("bin"))
    lowest, highest = F.floor((F.col("least_ft") - F.col("feet")) / width), F.floor((F.col("most_ft") - F.col("feet")) / width)
    met = pairs.withColumn("bin", F.explode(F.sequence(lowest, highest))).join(here, [*LOG, "bin"]).where(~F.arrays_overlap("members", "others"))
    both = met.withColumns({"feet": F.col("feet") + F.col("other_feet"), "members": F.array_sort(F.concat("members", "others"))})
    return both.where(F.col("feet").between(F.col("least_ft"), F.col("most_ft"))).select(*LOG, "members", "feet", "most_ft")


def linked_sets(pool: DataFrame, links: DataFrame, most_members: int = 5) -> DataFrame:
    """LOG, members (places, rising): sets whose joint length suits the log and whose members all link to another.

    `pool` has LOG, place, route_ft, target_ft.
    """
    slack = 1e-6  # sums of another order differ in their last digits; the caller sums again
    bounds = pool.select(*LOG, "target_ft").distinct().select(
        *LOG, (F.greatest(F.col("target_ft") - 80.0, F.col("target_ft") * 0.84) - slack).alias("least_ft"),
        (F.greatest(F.col("target_ft") * 1.38, F.col("target_ft") + 220.0) + slack).alias("most_ft"))
    own = pool.select(*LOG, F.col("place").alias("near"), F.col("route_ft"))
    pairs = links.where("near < far").join(own, [*LOG, "near"]).join(bounds, LOG).select(
        *LOG, F.array("near", "far").alias("members"), (F.col("feet") + F.col("route_ft")).alias("feet"), "most_ft", "least_ft").where("feet <= most_ft")
    pairs = cut_lineage(pairs)
    sets = [pairs.drop("least_ft")]
    for _ in range(3, most_members + 1):
        sets.append(cut_lineage(_grown(sets[-1], links)))
    if most_members >= 4:
        sets.append(_side_by_side(pairs, sets[0]))
    if most_members >= 5:
        sets.append(_side_by_side(pairs, sets[1]))
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.join(bounds.drop("most_ft"), LOG).where("feet >= least_ft").select(*LOG, "members").dropDuplicates([*LOG, "members"])


def merged_line(parts: Column) -> Column:
    """The points of several lines, one after another, without those that stood before (to 8 decimals)."""
    points = F.flatten(parts)
    keys = F.transform(points, lambda p: F.concat_ws(" ", F.round(p["lat"], 8).cast("string"), F.round(p["lon"], 8).cast("string")))
    return let(F.struct(points.alias("p"), keys.alias("k")), lambda s: F.filter(s["p"], lambda p, i: F.array_position(s["k"], F.get(s["k"], i)) == i + 1))


def best_chains(pool: DataFrame, distances: DataFrame, keep: int | None = 10, most_members: int = 5) -> DataFrame:
    """The chains of each log that come nearest to its target length; all of them without `keep`.

    `pool` has LOG, place (1, 2, ... by log), route_id, route_role, route_ft, coords, locality,
    box_share, gate_ft, role_bonus, priority, target_ft.
    """
    facts = ("route_id", "route_role", "route_ft", "locality", "box_share", "gate_ft", "role_bonus", "priority")
    known = pool.groupBy(*LOG, "target_ft").agg(F.sort_array(F.collect_list(F.struct("place", *facts))).alias("known"))
    sets = linked_sets(pool, cut_lineage(pool_links(pool, distances)), most_members).join(known, LOG)
    part = F.transform("members", lambda m: F.get("known", m - 1))
    sets = sets.withColumn("part", part).drop("known")

    def total(name: str) -> Column:
        return F.aggregate("part", F.lit(0.0), lambda a, p: a + p[name])

    def values(name: str) -> Column:
        return F.transform("part", lambda p: p[name])

    n = F.size("members")
    roles = values("route_role")
    commonest = F.array_max(F.transform(roles, lambda r, i: F.struct(F.size(F.filter(roles, lambda x: x == r)).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    ids = F.array_sort(values("route_id"))
    feet, target = total("route_ft"), F.col("target_ft")
    chains = sets.where(feet.between(F.greatest(target - 80.0, target * 0.84), F.greatest(target * 1.38, target + 220.0))).select(
        *LOG, F.concat(F.lit("synthetic_chain_"), F.array_join(ids, "_")).alias("route_id"), F.lit("Local corridor chain").alias("route_name"),
        F.lit("corridor_chain").alias("source_folder"), commonest.alias("route_role"), F.round(feet, 2).alias("route_ft"), ids.alias("members"),
        F.round(total("locality") / n, 4).alias("locality"), F.round(total("box_share") / n, 4).alias("box_share"), F.array_min(values("gate_ft")).alias("gate_ft"),
        F.lit(5.0).alias("penalty"), F.array_max(values("role_bonus")).alias("role_bonus"), F.round(F.array_max(values("priority")) + n * 0.85, 2).alias("priority"),
        "target_ft", F.col("members").alias("places"))
    order = Window.partitionBy(*LOG).orderBy(F.abs(F.col("route_ft") - F.col("target_ft")), F.desc("locality"), F.desc("box_share"), F.desc("priority"), "route_id")
    if keep is not None:
        chains = chains.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")
    lines = (chains.select(*LOG, F.col("route_id").alias("chain"), F.posexplode("places").alias("nth", "place")).join(pool.select(*LOG, "place", "coords"), [*LOG, "place"])
             .groupBy(*LOG, F.col("chain").alias("route_id")).agg(F.sort_array(F.collect_list(F.struct("nth", "coords"))).alias("parts")))
    return chains.join(lines, [*LOG, "route_id"]).withColumn("coords", merged_line(F.col("parts.coords"))).drop("parts", "target_ft", "places")

"""The main flow: log rows and design routes to groups, matches, as-built tables.

Each step takes the tables it needs.  Tables that several later steps read (catalog, rows,
groups, ranked routes, anchored hypotheses, claims) are kept in the shared folder: they are computed
once, and a lost executor does not send the job back to the raw logs.  Wide ones are kept as
compressed columns, of which each step reads its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.operators import candidates as cand
from trenchline.operators import coverage, gates, grouping, ownership, routes, windows
from trenchline.plans.inputs import view
from trenchline.session import cut_lineage, discard, stored
from trenchline.sources.bore_logs import clean_bore_rows


class Job:
    """Derived tables of one set of inputs, built on first use."""

    def __init__(self, rows: DataFrame, vertices: DataFrame, meta: DataFrame, index: DataFrame):
        self._raw, self._vertices, self._meta, self.index = rows, vertices, meta, index
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark, sf_dir: str) -> "Job":
        return cls(*[view(spark, sf_dir, n) for n in ("bore_rows", "vertices", "route_meta", "sheet_index")])

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def rows(self) -> DataFrame:
        """Accepted log rows with a stable key of their own."""
        return self._once("rows", lambda: stored(grouping.with_row_keys(
            clean_bore_rows(self._raw).where("reject_reason IS NULL").drop("reject_reason", "station_raw")), "rows"))

    @property
    def catalog(self) -> DataFrame:
        return self._once("catalog", lambda: cut_lineage(routes.build_catalog(self._vertices, self._meta)))

    @property
    def grouped_rows(self) -> DataFrame:
        return self._once("grouped_rows", lambda: grouping.group_rows(self.rows))

    @property
    def groups(self) -> DataFrame:
        def make():
            # hints go back to the groups they come from, so these are made once before
            summary = stored(grouping.summarise_groups(self.grouped_rows), "summary")
            found = stored(grouping.order_keys(cand.sheet_hints(summary, self.index, grouping.GROUP)), "groups")
            discard(summary)
            return found
        return self._once("groups", make)

    @property
    def ranked(self) -> DataFrame:
        return self._once("ranked", lambda: stored(cand.rank_pool(cand.score_pool(cand.route_pool(self.groups, self.catalog))), "ranked"))

    @property
    def hypothesis_inputs(self) -> DataFrame:
        return self._once("inputs", lambda: windows.hypothesis_inputs(self.ranked, self.groups, self.catalog, self.index))

    @property
    def anchored(self) -> DataFrame:
        return self._once("anchored", lambda: stored(windows.anchor(self.hypothesis_inputs), "anchored"))

    @property
    def neighbours(self) -> DataFrame:
        return self._once("neighbours", lambda: gates.neighbours(self.catalog, routes.terminal_bearings(self.catalog)))

    @property
    def verdicts(self) -> DataFrame:
        """Every hypothesis with its checks and the gates that look at it alone."""
        return self._once("verdicts", lambda: gates.row_gates(gates.validate(self.anchored), self.neighbours))

    @property
    def evaluated(self) -> DataFrame:
        """Every hypothesis with all gates, its place in the group and its render policy."""
        # projected points have had their say by then
        return self._once("evaluated", lambda: stored(gates.render_policy(gates.choose(gates.group_gates(self.verdicts))).drop(
            "coords", "station_rows", "mapped", "p_route_ft", "p_lat", "p_lon", "p_piece", "p_seg", "allowed_routes", "context"), "evaluated"))

    @property
    def claims(self) -> DataFrame:
        return self._once("claims", lambda: stored(ownership.claim_inputs(self.evaluated), "claims"))

    @property
    def owned(self) -> DataFrame:
        """Settled claims: one row per matched group."""
        return self._once("owned", lambda: ownership.resolve(self.claims))

    @property
    def selected(self) -> DataFrame:
        """The chosen hypothesis of each group."""
        return self._once("selected", lambda: self.evaluated.where("eval_rank = 1"))

    @property
    def station_points(self) -> DataFrame:
        def make():
            dense = self.catalog.select("project_id", "route_id", F.posexplode(F.arrays_zip("coords", "chain")).alias("idx", "p")).select(
                "project_id", "route_id", "idx", "p.coords.lat", "p.coords.lon", F.col("p.chain").alias("chain_ft"))
            return coverage.station_points(self.owned, self.groups, self.catalog, routes.route_segments(dense))
        return self._once("station_points", make)

    @property
    def built(self) -> DataFrame:
        return self._once("built", lambda: coverage.built_segments(self.owned, self.groups, self.catalog))

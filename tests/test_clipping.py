"""Cutting many stretches in one call gives what the column expression gives."""

import random

from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.operators import clipping


def test_cuts_equal_the_column_expression(spark):
    rng, rows = random.Random(8), []
    for k in range(60):
        steps = [rng.choice([0.0, 1e-10, 40.0, 75.5]) for _ in range(rng.choice([1, 2, 9]))]
        chain = [float(sum(steps[:i])) for i in range(len(steps) + 1)]
        coords = [(30 + x / 364000, -96.0) for x in chain]
        for n in range(4):
            ends = [rng.choice([None, float("nan"), -5.0, rng.choice(chain), rng.uniform(0, 500)]) for _ in range(2)]
            rows.append((k * 10 + n, None if k == 7 else coords, chain, *ends))
    df = spark.createDataFrame(rows, "id long, coords array<struct<lat:double,lon:double>>, chain array<double>, start_ft double, end_ft double").coalesce(1)
    both = df.select("id", clipping.clip("coords", "chain", "start_ft", "end_ft").alias("got"),
                     geo.clip(F.col("coords"), F.col("chain"), F.col("start_ft"), F.col("end_ft")).alias("want")).collect()
    assert [(r.id, r.got) for r in both] == [(r.id, r.want) for r in both]
    assert any(r.got is None for r in both) and any(r.got == [] for r in both) and any(r.got and len(r.got) > 3 for r in both)


def test_stretches_are_cut_in_batches(spark):
    """Cut point by point in column expressions, a stretch cost its route's vertices many times over."""
    from tests.conftest import SF_DIR
    from trenchline.plans import catalog

    plan = catalog.QUERIES["clipped_stretches"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_equal_cells_are_read_once(spark):
    """Readings of a cell stand below the join, on distinct texts, not on every row."""
    from tests.conftest import SF_DIR
    from trenchline.plans import catalog

    found = catalog.QUERIES["depth_cover_profiles"](spark, SF_DIR)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [depth_raw" in plan and "Aggregate [boc_raw" in plan
    assert found.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()

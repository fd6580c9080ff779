"""Neighbour, fill-forward and position steps over ordered rows of possibly very large keys.

A plain window puts one key in one task.  `split_blocks` cuts every key into blocks of its own
order: windows run per (key, block), and only the first and last rows of blocks are compared
across blocks, with all branches reading one shared exchange.  Without it, the steps use plain
windows over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def split_blocks(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Rows ready for the steps below; `block` must not fall along a key's order (nulls come first, as they sort)."""
    return df.withColumn(BLOCK, F.struct(block.isNotNull().alias("known"), block.alias("block"))).repartition(*keys, BLOCK)


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Adds structs `prev` and `next` with the values of `cols` in the neighbouring rows."""
    values = F.struct(*cols)
    if BLOCK not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({"prev": F.lag(values).over(w), "next": F.lead(values).over(w)})
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    place = F.struct(*order)
    edges = df.groupBy(*keys, BLOCK).agg(F.min_by(values, place).alias("_first"), F.max_by(values, place).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = edges.select(*keys, BLOCK, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    inner = df.withColumns({"_prev": F.lag(values).over(w), "_next": F.lead(values).over(w)})
    return (inner.join(edges, [*keys, BLOCK])
            .withColumns({"prev": F.coalesce("_prev", "_before"), "next": F.coalesce("_next", "_after")})
            .drop("_prev", "_next", "_before", "_after"))


def with_last_mark(df: DataFrame, keys: list[str], order: list[str], mark: str, name: str) -> DataFrame:
    """Adds the latest non-null `mark` at or before each row."""
    if BLOCK not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(mark, ignorenulls=True).over(w))
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    edges = df.where(F.col(mark).isNotNull()).groupBy(*keys, BLOCK).agg(F.max_by(mark, place).alias("_mark"))
    blocks = df.select(*keys, BLOCK).distinct().join(edges, [*keys, BLOCK], "left")
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, BLOCK, F.last("_mark", ignorenulls=True).over(before).alias("_carried"))
    inner = df.withColumn("_here", F.last(mark, ignorenulls=True).over(w))
    return (inner.join(carried, [*keys, BLOCK])
            .withColumn(name, F.coalesce("_here", "_carried")).drop("_here", "_carried"))


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the row's place (from 0) in its key's order."""
    if BLOCK not in df.columns:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    inner = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order)) - 1
    counts = df.groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return df.withColumn("_at", inner).join(counts, [*keys, BLOCK]).withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_base")

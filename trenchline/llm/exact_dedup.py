"""Exact deduplication: two-pass Bloom filtering, then an exact step on suspected repeats.

Pass one hashes every normalised text and builds the twice-seen filter.  Pass two lets texts
pass that the filter has seen once at most, and only the rest shuffle, as digests.

Defined results
* Null text counts as empty.  A null `doc_id` comes after all others; it stays only where no
  other row of its group has an id.
* Rows that share text and id are one document given several times: each gets its row, the
  first of them alone is kept.
* An empty table gives an empty result.  Extra columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trenchline.llm.bloom import TwiceFilter, twice_seen
from trenchline.llm.tables import stored

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_of(prints: DataFrame) -> TwiceFilter:
    return twice_seen(prints.select(F.xxhash64("text_sha256").alias("h")), prints.count())


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256")), "prints")
    suspected = filter_of(prints).column(F.xxhash64("text_sha256"))
    marked = prints.withColumn("suspected", suspected)
    alone = marked.where("not suspected").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    counted = stored(marked.where("suspected").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies")), "suspects")
    # stored, so that the join below is one of two plain exchanges that Spark can split at a hot text
    groups = stored(counted.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    repeated = (
        counted.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))
    return alone.unionByName(repeated)


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they were."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest(F.col(text)).alias("text_sha256"))
    prints = stored(rows.select("text_sha256"), "prints")
    suspected = filter_of(prints).column(F.xxhash64("text_sha256"))
    marked = rows.withColumn("suspected", suspected)
    place = F.struct(F.col("row")[doc_id].isNull(), F.col("row")[doc_id], F.col("row")[text])
    # the minimum is taken in each task first, so a hot text shuffles one row a task
    first = marked.where("suspected").groupBy("text_sha256").agg(F.min_by("row", place).alias("row"))
    return marked.where("not suspected").select("row.*").unionByName(first.select("row.*"))

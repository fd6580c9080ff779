"""Filter interaction audit: what five filters remove in each of their 120 orders.

The filters are A: under 200 words, B: fewer than half of the words distinct, C: capital
letters above 3% of the characters, D: one of #$%&*| occurs, E: the text equals that of a
smaller doc_id.  What a filter removes in an order depends only on which filters a document
fails, so a document is a five-bit mask, and counts of masks are all that the 120 orders need.

A to D and a digest of the whole text come from one pass over the texts.  For E, tasks count
digests in a counting Bloom sketch; the merged sketch clears the texts that are certainly
unique, and only rows of possible repeats shuffle, as SHA-256 digests of the whole text, to
find the smallest id of each.  Documents that fail E move their counts from mask m to mask
m + E; rows of one text are added up in each task first, so a hot text is a row a task.

Defined results
* Null text is empty, null lang is the part ''.  Each row counts, repeated ids as well; rows
  of one id and text are no copies of each other.  A null id is neither smaller nor larger
  than another, so such a row never fails E and is no original.
* A document is good (toxic) if a row of `labels` with its id says so.
* An empty table gives an empty result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.counting_bloom import possible_repeats
from trenchline.llm.tables import as_bytes, stored, text_slices
from trenchline.llm.words import pieces

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words, percent, percent
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS, _LATER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
COPY = 16  # the bit of E
MEASURES = ("n", "good", "toxic")


def mask_of(text: bytes) -> int:
    """The bits of A to D."""
    words, distinct = 0, set()
    for piece in pieces(text):
        own = piece.split()
        words += len(own)
        distinct.update(own)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    chars = len(text.translate(None, _LATER_BYTES))
    fails = (words < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * chars, _MARKS.search(text) is not None)
    return sum(bit << i for i, bit in enumerate(fails))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, digest (of the text), h; docs: doc_id, part, text."""
    def run(batches):
        for piece in text_slices(batches, "text"):
            texts = as_bytes(piece["text"])
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], piece["part"], pa.array([mask_of(t) for t in texts], pa.int32()), pa.array(digests, pa.binary()),
                 pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())],
                ["doc_id", "part", "mask", "digest", "h"])

    return docs.mapInArrow(run, "doc_id long, part string, mask int, digest binary, h long")


def added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in MEASURES))


def copies(suspects: DataFrame) -> DataFrame:
    """part, mask and counts of the rows whose text a smaller id holds too."""
    by_id = added(suspects.where("doc_id is not null"), "digest", "part", "mask", "doc_id")
    counts = F.struct(*MEASURES)
    groups = by_id.groupBy("digest", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in MEASURES), F.min("doc_id").alias("least"), F.min_by(counts, "doc_id").alias("at_least"))
    # one row for each text and part is left
    groups = groups.withColumn("original", F.min("least").over(Window.partitionBy("digest")) == F.col("least"))
    left = {c: F.col(c) - F.when(F.col("original"), F.col(f"at_least.{c}")).otherwise(0) for c in MEASURES}
    return added(groups.withColumns(left), "part", "mask")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits), n, good, toxic; docs: doc_id, part, text; labels: doc_id, quality, toxic."""
    said = labels.groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("long")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    rows = marked(docs).join(said, "doc_id", "left").withColumn("n", F.lit(1).cast("long")).na.fill(0, ["good", "toxic"])
    rows = stored(rows, "masks")
    moved = stored(copies(possible_repeats(rows, rows.count())), "copies")
    away = moved.select("part", "mask", *((-F.col(c)).alias(c) for c in MEASURES))
    there = moved.withColumn("mask", F.col("mask") + COPY)
    return added(added(rows, "part", "mask").unionByName(away).unionByName(there), "part", "mask")


def all_orders() -> Column:
    """One row for each order and step, with the bits of the step's filter and of those before."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return F.explode(F.array(*(
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit[f]).alias("own"), F.lit(sum(bit[g] for g in order[:i])).alias("before"))
        for order in permutations(FILTERS) for i, f in enumerate(order))))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order and step with its counts."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cells = mask_counts(docs, labels.select("doc_id", "quality", "toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # 32 masks at most
    steps = parts.select("part", "cells", all_orders().alias("s")).select("part", "cells", "s.*")

    def total(measure, keep) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda sum_, c: sum_ + measure(c))

    def fails(c, bits) -> Column:
        return c["mask"].bitwiseAND(F.col(bits)) != 0

    def removed(c) -> Column:
        return fails(c, "own") & ~fails(c, "before")

    # of k filters that a document fails, each comes first in 120 / k of the orders
    share = total(lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long"), lambda c: fails(c, "own"))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda c: ~fails(c, "own") & ~fails(c, "before")).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda c: fails(c, "own") & fails(c, "before")).alias("redundant"),
        total(lambda c: c["n"], lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        share.alias("shapley"))

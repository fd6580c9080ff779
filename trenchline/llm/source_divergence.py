"""Source divergence audit: how far the word rates of two sources of one language lie apart.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case.  A
language keeps the V terms that at least `min_docs` of its documents hold.  A group (language,
source), or a language, gives a kept term with `count` occurrences the smoothed rate
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N being its occurrences of all kept terms.
All of it is whole-number arithmetic.

The distance of two sources is the sum of their rates' differences over all kept terms.  Each
group is a set of sorted (term id, count) arrays, one for each block of term ids, so an array
is bounded whatever the vocabulary is.  Each unordered pair of sources is a task of its own
for each block: the two arrays are co-grouped, the shorter one is searched in the longer one
by searches that go on where the last one ended, and terms of both, of one and of neither are
priced at once.  The sum holds both ways, so each pair is priced once and reported twice.

Defined results
* Null text, lang and source count as ''.  Each row is a document, repeated ids as well.
* A group without any term has a row for each other source of its language; a language
  without kept terms has distance 0 throughout.  Ties go to the smaller item by UTF-8 bytes.
* An empty table gives an empty result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.tables import as_bytes, stored, text_slices
from trenchline.llm.words import pieces

MIN_DOCS, TOP_TERMS = 30, 50
SCALE, SMOOTHING = 1_000_000_000, 5
#: Terms of one block, about; the arrays of a pair's task are no longer than this.
BLOCK_TERMS = 1 << 13
#: Counted terms that a task holds before it hands them on.
HELD_TERMS = 200_000
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Counts:
    """Occurrences and documents of each term in each group, as seen by one task."""

    def __init__(self) -> None:
        self.of: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def add(self, group: tuple, text: bytes) -> None:
        times, docs = self.of[group]
        seen: set[bytes] = set()
        for piece in pieces(text):
            terms = piece.translate(_LETTERS).split()
            times.update(terms)
            seen.update(terms)
        docs.update(seen)

    def held(self) -> int:
        return sum(len(times) for times, _ in self.of.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in self.of.items():
            terms = pa.array(list(times), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(times), pa.string()), pa.array([source] * len(times), pa.string()), terms,
                 pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64())],
                ["lang", "source", "term", "times", "docs"])
        self.of.clear()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, times, docs: counts of each task, to be added up; docs: lang, source, text."""
    def run(batches):
        counts = Counts()
        for part in text_slices(batches, "text"):
            for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), as_bytes(part["text"]), strict=True):
                counts.add((lang, source), text)
            if counts.held() > HELD_TERMS:
                yield from counts.batches()
        yield from counts.batches()

    return docs.mapInArrow(run, "lang string, source string, term string, times long, docs long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, times, lang_times (of the whole language), first (true once a term)."""
    term = Window.partitionBy("lang", "term")
    # dealt by language and term once; sums by source and over all sources need no other exchange
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
    marked = counted.withColumns({
        "lang_docs": F.sum("docs").over(term), "lang_times": F.sum("times").over(term),
        "first": F.row_number().over(term.orderBy("source")) == 1})
    return marked.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "times", "lang_times", "first")


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exact for any count."""
    part = F.lit(SCALE).cast("decimal(11,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    whole = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", part, whole)


def rates(counts: np.ndarray, whole: int) -> np.ndarray:
    """The same for an array; three digits at a time, so that no product leaves 64 bits."""
    rest, out = counts + SMOOTHING, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def block_price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], whole_a: int, whole_b: int) -> tuple[int, int]:
    """Sum of the differences over the terms that a or b holds, and the number of these terms."""
    if len(a[0]) > len(b[0]):
        a, b, whole_a, whole_b = b, a, whole_b, whole_a
    p, q = rates(a[1], whole_a), rates(b[1], whole_b)
    p_none, q_none = (int(rates(np.zeros(1, np.int64), w)[0]) for w in (whole_a, whole_b))
    at = np.searchsorted(b[0], a[0])
    both = at < len(b[0])
    both[both] = b[0][at[both]] == a[0][both]
    met = at[both]
    alone = np.ones(len(q), bool)
    alone[met] = False
    price = np.abs(p[both] - q[met]).sum() + np.abs(p[~both] - q_none).sum() + np.abs(q[alone] - p_none).sum()
    return int(price), len(p) + len(q) - len(met)


def pair_prices(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, a, b, price, present: one row for each pair and block that either holds.

    `pairs` has lang, a, b, whole_a, whole_b; `vectors` lang, source, block, ids, counts.
    """
    def price(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for t in (left, right):
            held = [np.concatenate([x.values.to_numpy() for x in t[c]]) if t.num_rows else np.zeros(0, np.int64) for c in ("ids", "counts")]
            sides.append((held[0], held[1]))
        known = left if left.num_rows else right
        value, present = block_price(*sides, known["whole_a"][0].as_py(), known["whole_b"][0].as_py())
        return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "price": pa.array([value], pa.int64()), "present": pa.array([present], pa.int64())})

    task = ["lang", "a", "b", "block"]
    wanted = [F.col(c).alias(c) for c in (*task, "whole_a", "whole_b", "ids", "counts")]  # columns of their own on both sides
    left, right = (pairs.join(vectors.withColumnRenamed("source", side), ["lang", side]).select(*wanted) for side in "ab")
    return left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(price, "lang string, a string, b string, price long, present long")


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rank 1 for the largest value of a group, ties by item."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.where(F.col("rank") <= most)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = stored(kept_terms(docs, min_docs), "kept_terms")
    languages = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("times").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")

    # sorted arrays for each group and block of term ids
    n_terms = kept.agg(F.sum(F.col("first").cast("long")).alias("n")).first()["n"] or 0
    blocks = -(-n_terms // BLOCK_TERMS) or 1
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    numbered = numbered.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long"))
    cells = numbered.groupBy("lang", "block", "source").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("cells"))
    vectors = stored(cells.select("lang", "source", "block", F.col("cells.id").alias("ids"), F.col("cells.times").alias("counts")), "vectors")

    one, other = (groups.select("lang", "terms", F.col("source").alias(side), F.col("total").alias(f"n_{side}"),
                                (F.col("total") + SMOOTHING * F.col("terms")).alias(f"whole_{side}")) for side in "ab")
    pairs = stored(one.join(other.drop("terms"), "lang").where("a < b"), "source_pairs")
    priced = pair_prices(pairs.where("terms > 0").select("lang", "a", "b", "whole_a", "whole_b"), vectors)
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("price").alias("price"), F.sum("present").alias("present"))
    none = F.lit(0).cast("long")
    absent = F.abs(rate(none, F.col("n_a"), F.col("terms")) - rate(none, F.col("n_b"), F.col("terms")))
    value = F.when(F.col("terms") == 0, none).otherwise(
        F.coalesce("price", none) + (F.col("terms") - F.coalesce("present", none)) * absent)
    both_ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    distances = (pairs.join(priced, ["lang", "a", "b"], "left").select("lang", value.alias("value"), both_ways.alias("way"))
                 .select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"))

    own = rate(F.col("times"), F.col("total"), F.col("terms"))
    whole = rate(F.col("lang_times"), F.col("lang_total"), F.col("terms"))
    rises = (kept.join(groups, ["lang", "source"]).where(F.col("times") > 0)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (own - whole).alias("value")).where("value > 0"))
    return ranked(distances).unionByName(ranked(rises, top_terms))

"""SimHash near-duplicates by multi-index hashing.

A text's features are its three-word shingles (A-Z in lower case, repeats count), each hashed
by XXH64 with seed 42.  A bit of the fingerprint is set if more than half of the hashes have
it.  Fingerprints that differ in at most three bits are linked, and links make components.

Two such fingerprints differ in at most one bit in one of their two halves.  So every
fingerprint stands in the table of each half, and probes the table with the half itself and
with the half's neighbours at one bit; only bits that are 0 are flipped, as a pair that
differs in one bit meets from its lower side already.  What meets is verified on all 64 bits.

Groups of near copies fill a bucket of a half with fingerprints that are all alike.  They are
not paired with each other: first every member of a bucket is held against the one that most
documents have, which makes most of such a group one component.  Then a probe goes on only
to a bucket with a fingerprint of another component, and those of the bucket's largest
component meet the others but not each other.  No link between components is lost, and a
bucket costs its size times its fingerprints outside its largest component.

Defined results
* Fewer than three words are one shingle; a text without words (null, empty) has the
  fingerprint zero and is linked like any other.
* Each row gives a row.  The component is named by its smallest doc_id; null ids are left out
  of that, and a component of null ids alone has the name null.
* An empty table gives an empty result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trenchline.llm.components import components
from trenchline.llm.tables import as_bytes, stored, text_slices
from trenchline.llm.words import pieces

WORDS, SEED, DISTANCE, HALF = 3, 42, 3, 32
#: Bytes of text whose shingle hashes are held at a time.
HASHED_BYTES = 1_000_000


def shingle_hashes(words: list[bytes]) -> list[int]:
    """Hashes of the shingles of at least three words: slices of the words joined by spaces."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:1 - WORDS].tolist(), ends[WORDS - 1:].tolist(), strict=True)]


def set_bits(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit set."""
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """As a signed 64-bit number."""
    last: list[bytes] = []
    n, bits = 0, np.zeros(64, np.int64)
    for piece in pieces(text, HASHED_BYTES):
        words = last + piece.lower().split()
        if len(words) >= WORDS:
            hashes = shingle_hashes(words)
            n, bits = n + len(hashes), bits + set_bits(hashes)
            words = words[1 - WORDS:]
        last = words
    if not n and last:
        n, bits = 1, set_bits([xxhash.xxh64_intdigest(b" ".join(last), SEED)])
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp of every row."""
    def run(batches):
        for part in text_slices(batches, "text"):
            fps = pa.array([fingerprint(t) for t in as_bytes(part["text"])], pa.int64())
            yield pa.RecordBatch.from_arrays([part["doc_id"], fps], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def halves(nodes: DataFrame) -> DataFrame:
    """A row of `nodes` for each half of its fingerprint: half (0 or 1) and key."""
    low, high = F.col("fp").bitwiseAND((1 << HALF) - 1), F.shiftrightunsigned("fp", HALF)
    each = F.posexplode(F.array(low, high)).alias("half", "key")
    return nodes.select("*", each)


def ball(key: str) -> Column:
    """The key and all keys with one more bit set."""
    zeros = F.expr(f"filter(sequence(0, {HALF - 1}), i -> {key} & shiftleft(1L, i) = 0)")
    return F.concat(F.array(key), F.transform(zeros, lambda i: F.col(key).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def star_links(nodes: DataFrame) -> DataFrame:
    """Fingerprints close to the one of their bucket that most documents have; nodes: fp, n."""
    rows = halves(nodes)
    leaders = rows.groupBy("half", "key").agg(F.max(F.struct("n", "fp"))["fp"].alias("leader"))
    met = rows.join(leaders, ["half", "key"]).where((F.col("fp") != F.col("leader")) & close("fp", "leader"))
    return met.select(F.col("fp").alias("a"), F.col("leader").alias("b"))


def outer_links(nodes: DataFrame) -> DataFrame:
    """Pairs of components (a, b) with close fingerprints; nodes: fp, root."""
    table = stored(halves(nodes), "halves")
    sizes = table.groupBy("half", "key", "root").agg(F.count("*").alias("n"))
    buckets = stored(sizes.groupBy("half", "key").agg(
        F.max(F.struct("n", "root"))["root"].alias("top"), F.min("root").alias("low"), F.max("root").alias("high")), "buckets")
    mixed = F.col("low") != F.col("high")
    probes = table.select("half", F.explode(ball("key")).alias("key"), F.col("fp").alias("p_fp"), F.col("root").alias("p_root"))
    hits = stored(probes.join(buckets, ["half", "key"]).where(mixed | (F.col("low") != F.col("p_root"))).drop("low", "high"), "hits")
    others = table.join(buckets.where(mixed), ["half", "key"]).where("root != top").select("half", "key", "fp", "root")
    of_top = hits.where("p_root = top").join(others, ["half", "key"])
    of_rest = hits.where("p_root != top").join(table, ["half", "key"])
    met = of_top.unionByName(of_rest).where((F.col("root") != F.col("p_root")) & close("fp", "p_fp"))
    return met.select(F.col("root").alias("a"), F.col("p_root").alias("b"))


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`nodes` with the root that `roots` (node, root) gives their own root, or else as it is."""
    known = roots.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return nodes.join(known, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
    named = stored(labelled(nodes.withColumn("root", F.col("fp")), components(star_links(nodes.select("fp", "n")))).select("fp", "root", "least"), "stars")
    named = stored(labelled(named, components(outer_links(named.select("fp", "root")))), "components")
    names = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    of_fp = stored(named.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

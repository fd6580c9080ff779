"""Line deduplication over the whole corpus with once-seen and twice-seen Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z in lower case.  A key of
at least `min_chars` code points that at least `min_docs` documents hold loses all its lines
but those in the largest doc_id that holds it.

Pass one fills the two filters with each document's keys; pass two shuffles only suspected
keys (as 128-bit digests) to count their documents and choose the holder.  Documents without
a suspected line pass straight through.

Defined results
* Null or empty text is one empty line.  Repeated keys within a document count once, and all
  its lines of a lost key go.
* Rows with one doc_id are one document; null ids together are one document that keeps a key
  only when no other holds it.  Each row gives a row.
* An empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.llm.bloom import SEGMENT_SCHEMA, BitMaps, TwiceFilter, bits_for, merged, segment_batch
from trenchline.llm.tables import ASCII_SPACE, as_bytes, stored, text_slices

MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars or len(key) >= 4 * min_chars:
        return len(key) >= min_chars
    return sum(b & 0xC0 != 0x80 for b in key) >= min_chars


def long_keys(text: bytes, min_chars: int) -> set[bytes]:
    return {key for line in text.split(b"\n") if len(line) >= min_chars and long_enough(key := line_key(line), min_chars)}


def hashes_of(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)).view(np.int64)


def suspected_keys(text: bytes, seen: TwiceFilter, min_chars: int) -> list[bytes]:
    keys = list(long_keys(text, min_chars))
    return [k for k, hit in zip(keys, seen.hit(hashes_of(keys)), strict=True) if hit] if keys else []


def line_filter(docs: DataFrame, min_chars: int) -> TwiceFilter:
    """`docs` has the one column text."""
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"]
    bits = bits_for(lines or 0)

    def build(batches):
        maps = BitMaps(bits)
        for part in text_slices(batches, "text"):
            keys = [k for text in as_bytes(part["text"]) for k in long_keys(text, min_chars)]
            maps.add(hashes_of(keys))
        for row in maps.segments():
            yield segment_batch([row])

    return merged(docs.mapInArrow(build, SEGMENT_SCHEMA), bits)


def lost_keys(docs: DataFrame, seen: TwiceFilter, min_chars: int, min_docs: int) -> DataFrame:
    """One row per document that loses lines: doc_id and the digests of its lost keys."""
    def suspects(batches):
        for part in text_slices(batches, "text"):
            ids, keys = [], []
            for doc_id, text in zip(part["doc_id"].to_pylist(), as_bytes(part["text"]), strict=True):
                found = suspected_keys(text, seen, min_chars)
                ids += [doc_id] * len(found)
                keys += [xxhash.xxh128_digest(k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    holders = stored(docs.mapInArrow(suspects, "doc_id long, key binary").distinct(), "suspects")
    # counts and holders are combined in each task first; stored, so that a hot key's join can be split
    lost = stored(holders.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs).drop("n"), "lost")
    return (holders.join(lost, "key").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
            .groupBy("doc_id").agg(F.collect_list("key").alias("lost")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_lines, n_dropped."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = line_filter(docs.select("text"), min_chars)
    lost = lost_keys(docs, seen, min_chars, min_docs)

    @F.pandas_udf("boolean")
    def suspected(texts):
        return texts.map(lambda t: bool(suspected_keys(t.encode("utf-8", "surrogatepass"), seen, min_chars)))

    def strip_lost(batches):
        for part in text_slices(batches, "text"):
            texts, dropped = [], []
            for whole, gone in zip(as_bytes(part["text"]), part["lost"].to_pylist(), strict=True):
                lines = whole.split(b"\n")
                gone = set(gone or ())
                stay = [x for x in lines if len(x) < min_chars or xxhash.xxh128_digest(line_key(x)) not in gone] if gone else lines
                texts.append(b"\n".join(stay))
                dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(dropped, pa.int64()), part["n_lines"]],
                ["doc_id", "text", "n_dropped", "n_lines"])

    n_lines = F.size(F.split("text", "\n", -1)).cast("long")
    marked = docs.withColumn("suspected", suspected("text"))
    clean = marked.where("not suspected").select("doc_id", "text", F.lit(0).cast("long").alias("n_dropped"), n_lines.alias("n_lines"))
    # only documents with a suspected line travel
    rest = marked.where("suspected").select("doc_id", "text", n_lines.alias("n_lines"))
    null_safe = rest["doc_id"].eqNullSafe(lost["doc_id"])
    joined = rest.join(lost, null_safe, "left").select(rest["doc_id"], "text", "lost", "n_lines")
    return clean.unionByName(joined.mapInArrow(strip_lost, "doc_id long, text string, n_dropped long, n_lines long"))

"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The pattern never matches across a step from a non-space to a space, nor from a letter or a
digit to another kind of character, whatever stands around; long texts are cut there and
their pieces encoded one after another, with the same ids as in one go.  (The reverse steps
are no safe places: `'s` after a sign is one match.)

Defined results: null counts as empty; empty texts have no ids; each row gives a row, so
repeated rows and null ids are kept; extra columns play no part; empty tables stay empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.llm.tables import text_slices, worker_state

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a text that are encoded in one go.
PIECE_CHARS = 100_000
SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


def encoder(path: str) -> tiktoken.Encoding:
    def load():
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_state(("tiktoken", path), load)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at the first safe place after every `size` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def ids_of(text: str, coder: tiktoken.Encoding, size: int = PIECE_CHARS) -> np.ndarray:
    if len(text) <= size:
        return np.asarray(coder.encode_ordinary(text), "<u4")
    return np.concatenate([np.asarray(coder.encode_ordinary(x), "<u4") for x in pieces(text, size)])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """doc_id and ids, the ids packed as little-endian unsigned 32-bit integers."""
    def run(batches):
        coder = encoder(ranks)
        for part in text_slices(batches, "text"):
            packed = [ids_of(x or "", coder).tobytes() for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(packed, pa.binary())], ["doc_id", "ids"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for (which need not be valid UTF-8)."""
    def run(batches):
        coder = encoder(ranks)
        for part in text_slices(batches, "ids"):
            raw = [coder.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """`decode` of `encode` in one pass, so that a task needs one Python worker instead of two."""
    def run(batches):
        coder = encoder(ranks)
        for part in text_slices(batches, "text"):
            ids = [ids_of(x or "", coder) for x in part["text"].to_pylist()]
            raw = [coder.decode_bytes(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

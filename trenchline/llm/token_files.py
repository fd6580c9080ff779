"""Token ids as files: Parquet list columns in the order of doc_id, and their reader.

Layout of a folder: `tokens/` holds one row per document (doc_id, n_tokens, local_start,
ids, part), ordered by doc_id within and across its files; `parts/` holds, per file, the
number of ids in all files before it.  Ids are dictionary-encoded pages inside controlled row
groups; doc_id and the counts, which rise slowly, get the delta encoding of version-2 pages.
The writer adds page indexes, so a range of documents, or the counts alone, can be read
without the ids.

Documents are range-partitioned by doc_id and sorted inside a partition (the sort spills);
places over all files come from one row per file.  Spark's committer writes the files, so a
repeated task leaves no half-written or doubled part.

Texts are encoded by the tokenizers library, one stretch between single spaces at a time:
no match of the byte-level pattern crosses a step from a non-space to a space, so stretches
give the same ids as the whole text.  A lone line end between other characters is a match of
its own and parts stretches too; the signs that end a word are parted from it.  Arrow finds the
distinct stretches and words of many texts, and a bounded cache keeps words seen lately.  Most
new words are one run of letters, a single match: their bytes go to the library's model without
the pattern.  A text where a space has white space beside it, or that holds the string of a
special token (which the library gives that token's id), is encoded whole.

Defined results: null counts as empty and holds the end id alone; rows with one doc_id follow
each other in the order of their texts; null ids come last; an empty table gives a folder
without rows; extra columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trenchline.llm.tables import new_path, text_slices, worker_state

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
CACHE_ENTRIES = 800_000
PARTING, TOGETHER = "\r", 20_000
#: Stands before what no space leads: the head of a text, and what follows a lone line end.
LED = "\x01"
LONE = re.compile(r"\n(?=\S)(?<=\S\n)")
#: Letters below U+0250, which the pattern takes together in any version of Unicode.
LETTERS = re.compile(rf"{LED}?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: A stretch that ends in signs after a letter.
SIGNED = r"(?s)^(?P<word>.*\pL)(?P<signs>[.,;:!?#$%&*|()\"']+)$"
SLICE_BYTES = 4_000_000
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 32 << 20, 256 << 10, 1 << 20


class StretchEncoder:
    """The library's ids of whole texts, by way of the stretches between single spaces.

    New words are encoded together, a carriage return between them: it is a match and a
    token of its own there, so its id parts the result again.  The cache keeps two generations,
    so that words in use stay when those seen once go; a word that was not cut at a safe place
    has no ids there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the library takes for one token wherever they stand in a text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + [LED]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.parting, self.line = self.whole(PARTING), self.whole("\n").tobytes()
        if len(self.parting) != 1:
            raise ValueError(f"{path} has no token of its own for a carriage return")
        # the characters that the byte-level step puts for the bytes of letters below U+0250
        self.byte_chars, alone = np.zeros(256, "<u2"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for x in map(chr, range(0x250)):
            self.byte_chars[list(x.encode())] = [ord(c) for c in alone.pre_tokenize_str(x)[0][0]]
        steps = json.loads(self.tokenizer.to_str())
        before, self.model = steps["pre_tokenizer"] or {}, None
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not steps["normalizer"]:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(chr(self.byte_chars[ord(PARTING)]), "isolated")

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def parted(self, ids: np.ndarray) -> list[bytes]:
        ends = [*(4 * np.flatnonzero(ids == self.parting)).tolist(), 4 * len(ids)]
        raw, starts = ids.tobytes(), [0, *(e + 4 for e in ends[:-1])]
        return [raw[i:j] for i, j in zip(starts, ends, strict=True)]

    def together(self, stretches: list[str]) -> list[bytes]:
        return self.parted(self.whole(PARTING.join(stretches))) if stretches else []

    def runs(self, words: list[str]) -> list[bytes]:
        """The ids of runs of letters, with or without a space before them, from the model alone."""
        if self.model is None:
            return self.together(words)
        coded = self.byte_chars[np.frombuffer(PARTING.join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        return self.parted(np.asarray(self.model.encode_batch_fast([coded], add_special_tokens=False)[0].ids, "<u4"))

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words with what leads them; none of those not cut at a safe place."""
        if len(self.known) + len(words) > CACHE_ENTRIES // 2:
            self.known, self.old, self.signs = {}, self.known, {}
        known, old, runs, rest = self.known, self.old, [], []
        for x in words:
            if x in known:
                continue
            if x in old:
                known[x] = old[x]
            elif LETTERS.fullmatch(x):
                runs.append(x)
            elif (y := x.removeprefix(LED)) and not y[0].isspace() and not y[-1].isspace() and PARTING not in y:
                rest.append(x)
            else:
                known[x] = b""
        for new, encode in ((runs, self.runs), (rest, self.together)):
            for i in range(0, len(new), TOGETHER):
                part = new[i:i + TOGETHER]
                known.update(zip(part, encode([x[1:] if x[0] == LED else " " + x for x in part]), strict=True))
        return list(map(known.__getitem__, words))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if not texts:
            return []
        held = np.array([any(a in x for a in self.added) for x in texts])
        cut = pc.split_pattern(pa.array([LED if h else LED + LONE.sub(" " + LED, x) for x, h in zip(texts, held, strict=True)], pa.string()), " ")
        starts, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        stretches, codes = coded.dictionary, coded.indices.to_numpy()
        # each distinct stretch is a line end or nothing, a word, and signs or nothing
        signed = pc.extract_regex(stretches, SIGNED)
        words = pc.coalesce(pc.struct_field(signed, 0), stretches).dictionary_encode()
        signs = pc.fill_null(pc.struct_field(signed, 1), "").dictionary_encode()
        word_ids, sign_list = self.words(words.dictionary.to_pylist()), signs.dictionary.to_pylist()
        new = [x for x in sign_list if x and x not in self.signs]
        self.signs.update(zip(new, self.together(new), strict=True))
        pieces = [b"", self.line, *word_ids, *(self.signs[x] if x else b"" for x in sign_list)]
        slots = np.stack([pc.starts_with(stretches, LED).to_numpy(zero_copy_only=False).astype(np.int64),
                          words.indices.to_numpy() + 2, signs.indices.to_numpy() + 2 + len(word_ids)], 1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        of_stretches = gathered(np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(sizes)[slots.ravel()], sizes[slots.ravel()])
        totals = sizes[slots].sum(1)
        lengths, heads = totals[codes], starts[:-1]
        stops, whole = np.cumsum(totals)[codes], held | np.logical_or.reduceat((sizes[slots[:, 1]] == 0)[codes], heads)
        lengths[heads] -= len(self.line) // 4  # no line end leads the head of a text
        packed = gathered(of_stretches, stops, lengths).tobytes()
        bounds = 4 * np.concatenate([[0], np.cumsum(lengths)])[starts]
        return [self.whole(x).tobytes() if w else packed[i:j] for x, w, i, j in zip(texts, whole, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def gathered(values: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that end before `stops`, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(stops - ends, lengths) + np.arange(lengths.sum())]


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every text, append the end id, and write the files described above."""
    def run(batches):
        coder = worker_state(("tokenizers", vocabulary), lambda: StretchEncoder(vocabulary))
        end, start = np.asarray([end_id], "<u4").tobytes(), 0
        for part in text_slices(batches, "text", SLICE_BYTES):
            rows = [x + end for x in coder.ids(part["text"].fill_null("").to_pylist())]
            offsets = np.cumsum([0, *(len(x) // 4 for x in rows)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(np.diff(offsets), pa.int64()), pa.array(start + offsets[:-1], pa.int64()), ids],
                ["doc_id", "n_tokens", "local_start", "ids"])
            start += int(offsets[-1])

    order = [F.asc_nulls_last("doc_id")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = rows.mapInArrow(run, "doc_id long, n_tokens long, local_start long, ids array<int>").withColumn("part", F.spark_partition_id())
    (rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.dictionary.page.size", DICTIONARY_BYTES).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#local_start", "false")
     .parquet(f"{path}/tokens"))
    sums = docs.sparkSession.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; columns and documents not asked for are not read."""
    tokens = spark.read.parquet(f"{path}/tokens")
    parts = spark.read.parquet(f"{path}/parts")
    return tokens.join(parts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for part in batches:
            lists = part["ids"]
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["start"], part["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents to `path` (or a new folder in the shared one) and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)

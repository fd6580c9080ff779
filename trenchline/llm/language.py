"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines
tell the languages of that family apart.  Inputs are relative frequencies of hashed letter
trigrams (and the shorter grams they hold at word ends) over the whole text in lower case, so
a prediction is a sum of weights over all places of the text: one pass, no cut-off.

Models are fitted on at most `PER_LANGUAGE` labelled documents a language (chosen by a hash of
the id), which bounds what the driver gathers.  Prediction sees the text alone.

Defined results: null texts and texts without a letter are `und` with score 0; so is every
text if nothing is labelled.  Languages without an entry in the family table form a family of
their own.  Rows with null or repeated ids each get a row; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trenchline.llm.tables import stored, text_slices

PER_LANGUAGE = 300
FEATURES = 1 << 14
UNKNOWN = "und"
HELD_OUT, PARTS = 2, 4
#: Languages by family; a code that is missing here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
CHUNK = 1 << 20  # characters of a text taken up at a time


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), f"own:{lang}")


def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x11000)], np.uint32)


def gram_codes(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed trigrams of a text whose non-letters count as one space; chunks overlap by two."""
    lower = text.lower()
    for start in range(0, max(1, len(lower)), CHUNK):
        points = np.frombuffer(lower[max(0, start - 2):start + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < len(letters), letters[np.minimum(points, len(letters) - 1)], points)
        if start == 0:
            points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
        a, b, c = points[:-2], points[1:-1], points[2:]
        full = (b != 0) | (a != 0) & (c != 0)
        mixed = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D))[full]
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * np.uint32(0x2545F491) >> np.uint32(18)).astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def frequencies(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and relative frequencies of a text's grams."""
    counts = sum(np.bincount(codes, minlength=FEATURES) for codes in gram_codes(text, letters))
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


def support_vectors(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of a linear SVM, by dual coordinate descent."""
    weights, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
    lifted = [(np.append(at, FEATURES), np.append(x / (np.linalg.norm(x) or 1), 0.3)) for at, x in rows]
    squares = np.array([x @ x for _, x in lifted])
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = lifted[i]
            slope = y[i] * (weights[at] @ x) - 1
            new = min(cost, max(0.0, alpha[i] - slope / squares[i]))
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return weights


class LanguageModel:
    """Family machines (one against the rest) and, within families, one machine a pair."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        own = np.array(langs)
        kin = np.array([family_of(x) for x in langs])
        machines, self.family_at, self.pair_at = [], {}, {}
        for f in self.families if len(self.families) > 1 else ():
            self.family_at[f] = len(machines)
            machines.append(support_vectors(rows, np.where(kin == f, 1.0, -1.0)))
        for f in self.families:
            for a, b in combinations([x for x in self.langs if family_of(x) == f], 2):
                use = np.flatnonzero((own == a) | (own == b))
                self.pair_at[a, b] = len(machines)
                machines.append(support_vectors([rows[i] for i in use], np.where(own[use] == a, 1.0, -1.0)))
        self.weights = np.stack(machines, axis=1).astype(np.float32) if machines else np.zeros((FEATURES + 1, 0), np.float32)

    def margins(self, text: str, letters: np.ndarray) -> np.ndarray:
        """Each machine's margin, of frequencies scaled to length one as in training."""
        counts = sum(np.bincount(codes, minlength=FEATURES) for codes in gram_codes(text, letters))
        at = np.flatnonzero(counts)
        x = counts[at].astype(np.float32)
        return (x @ self.weights[at]) / max(1e-9, float(np.sqrt((x * x).sum()))) + 0.3 * self.weights[-1]

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return UNKNOWN, 0.0
        sure = 1 / (1 + np.exp(-4 * self.margins(text, letters).astype(np.float64)))
        family = max(self.families, key=lambda f: (sure[self.family_at[f]] if self.family_at else 1.0, f))
        score = sure[self.family_at[family]] if self.family_at else 1.0
        kin = [x for x in self.langs if family_of(x) == family]
        votes = dict.fromkeys(kin, 0.0)
        for a, b in combinations(kin, 2):
            p = sure[self.pair_at[a, b]]
            votes[a] += p
            votes[b] += 1 - p
        best = max(kin, key=lambda x: (votes[x], x))
        return best, float(score * (votes[best] / (len(kin) - 1) if len(kin) > 1 else 1.0))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % PARTS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows that are not held out; docs: doc_id, text, lang."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the window keeps `per_language` rows of a language in each task before anything shuffles
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    sample = stored(labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("doc_id", "lang").distinct(), "lang_sample")

    def extract(batches):
        letters = letter_table()
        for part in text_slices(batches, "text"):
            rows = [frequencies(t, letters) if has_letter(t) else (np.zeros(0, int), np.zeros(0)) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["lang"], pa.array([at.tolist() for at, _ in rows], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in rows], pa.list_(pa.float32()))],
                ["lang", "at", "x"])

    chosen = labelled.join(sample, ["doc_id", "lang"]).select("doc_id", "lang", "text").orderBy("doc_id", "text").select("lang", "text")
    got = [r for r in chosen.mapInArrow(extract, "lang string, at array<int>, x array<float>").collect() if r.at]
    return LanguageModel([(np.array(r.at), np.array(r.x)) for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        letters, own = letter_table(), shared.value
        for part in text_slices(batches, "text"):
            found = [own.predict(t, letters) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, predict for all."""
    return predict(docs, fit(docs.select("doc_id", "text", "lang")))

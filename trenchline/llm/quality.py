"""Quality classification by hierarchical empirical Bayes.

A logistic regression on measures of the whole text gives each document's evidence.  Soft
counts of good documents are summed by host and by path below the host; each host's rate is
shrunk toward the global rate, each path's toward its host's, by strengths estimated from the
spread of the rates (method of moments), so sparse sites stay near their prior.  A document is
kept if its site's prior odds times its own likelihood ratio are at least even.

Documents of the given tables carry no url: their `source` takes the place of the host and
`lang` that of the path; other columns or expressions can be named.

The classifier is fitted on at most `SAMPLE` labelled rows (by a hash of the id), the bound of
what the driver gathers.  Site counts cover all documents and are grouped with a map-side sum,
so a host with a third of all rows costs one row a task.

Defined results: null and empty texts score as any other text, by measures of zero (short
texts carry little evidence); a null host or path is a site of its own; labels that are null
or contradict each other take no part; without labels of both kinds every document is kept;
rows with null or repeated ids each get a row; extra columns play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trenchline.llm.tables import ASCII_SPACE, as_bytes, stored, text_slices

SAMPLE = 20_000
SITES_TO_BROADCAST = 100_000
THRESHOLD = 0.5
#: Bounds of a document's log likelihood ratio.
MOST_EVIDENCE = 12.0

LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
CAPITALS, DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
SIGNS = bytes(set(range(0x21, 0x7F)) - set(LETTERS) - set(DIGITS) - set(b".,;:'\"-()"))
MEASURES = ("length", "capitals", "digits", "signs", "spaces", "distinct", "commonest", "signed_words", "word_length", "lines", "repeated_lines")


def measures(text: bytes) -> list[float]:
    """Style measures of a whole text, each about 0 to 1."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(MEASURES)
    share = lambda table: (n - len(text.translate(None, table))) / n
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip(ASCII_SPACE)]
    signs, count = share(SIGNS), len(words)
    # words with a sign differ from those without; only texts with signs need a look at each
    signed = sum(m for w, m in counts.items() if w.translate(None, SIGNS) != w) / count if signs else 0.0
    return [
        np.log1p(count) / 10, share(CAPITALS), share(DIGITS), signs, share(ASCII_SPACE),
        len(counts) / count ** 0.9, max(counts.values()) / count, signed, min(1.0, (n / count) / 20),
        min(1.0, len(lines) / count), 1 - len(set(lines)) / len(lines),
    ]


class Evidence:
    """Logistic regression on standardised measures and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25):
        self.usable = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.usable:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self.lifted(x)
        self.weights = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(rounds):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (p - y) + ridge * self.weights
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), gradient)
            self.weights -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        rate = y.mean()
        self.prior = float(np.log(rate / (1 - rate)))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, under the rate of the labelled rows."""
        return np.clip(self.lifted(x) @ self.weights, -30, 30) if self.usable else np.full(len(x), 30.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1)."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")
    chosen = stored(agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality"), "labelled")

    def extract(batches):
        for part in text_slices(batches, "text"):
            rows = [measures(t) for t in as_bytes(part["text"])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["quality"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInArrow(extract, "doc_id long, quality int, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    return Evidence(np.array([r.x for r in got]).reshape(-1, len(MEASURES)), np.array([r.quality for r in got], float))


def evidence_column(text: Column, model: Evidence) -> Column:
    @F.pandas_udf("double")
    def log_odds(texts):
        import pandas as pd

        rows = [measures((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        return pd.Series(model.log_odds(np.array(rows).reshape(-1, len(MEASURES))))

    return log_odds(text)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def shrunk(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (good + strength * prior) / (n + strength)


def strength_of(groups: DataFrame, rate: Column, prior: Column) -> float:
    """How many documents the prior is worth, by the method of moments over groups.

    The spread of the groups' rates beyond what chance in n documents gives is the variance of
    a beta distribution around the prior; strength = p(1 - p)/variance - 1.
    """
    g = groups.select(F.col("n").alias("n"), rate.alias("r"), prior.alias("p")).where("n > 0")
    s = g.agg(F.sum(F.expr("n * (r - p) * (r - p)")).alias("spread"), F.sum(F.expr("p * (1 - p)")).alias("chance"), F.sum(F.expr("n * p * (1 - p)")).alias("mass"), F.sum("n").alias("n")).first()
    if not s["n"] or not s["mass"]:
        return 10.0
    variance = max(0.0, s["spread"] - s["chance"]) / s["n"]
    mean = s["mass"] / s["n"]
    return float(min(1e6, max(1.0, mean / variance - 1 if variance > 0 else 1e6)))


def site_priors(scored: DataFrame) -> DataFrame:
    """host, path, prior from all documents' soft counts; scored: host, path, p."""
    counts = stored(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "sites")
    whole = counts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = min(0.999, max(0.001, (whole["good"] or 0.0) / max(1, whole["n"] or 0)))
    hosts = counts.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    s = strength_of(hosts, F.col("good") / F.col("n"), F.lit(rate))
    hosts = hosts.select(F.col("host").alias("of"), shrunk(F.col("good"), F.col("n"), F.lit(rate), F.lit(s)).alias("host_prior"))
    paths = stored(counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "paths")
    t = strength_of(paths, F.col("good") / F.col("n"), F.col("host_prior"))
    prior = shrunk(F.col("good"), F.col("n"), F.col("host_prior"), F.lit(t))
    return stored(paths.select("host", "path", F.greatest(F.lit(0.001), F.least(F.lit(0.999), prior)).alias("prior")), "priors")


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: row (the given columns), doc_score, site_prior, posterior, kept."""
    model = fit(docs, labels)
    sites = (F.col("source") if host is None else host).alias("host"), (F.col("lang") if path is None else path).alias("path")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *sites, evidence_column(F.col("text"), model).alias("odds"))
    if not model.usable:
        return rows.select("row", F.lit(1.0).alias("doc_score"), F.lit(1.0).alias("site_prior"), F.lit(1.0).alias("posterior"), F.lit(True).alias("kept"))
    slim = docs.select(*sites, (1 / (1 + F.exp(-evidence_column(F.col("text"), model)))).alias("p"))
    priors = site_priors(slim)
    if priors.count() <= SITES_TO_BROADCAST:
        priors = F.broadcast(priors)  # of checked size; beyond it Spark shuffles and splits hot sites
    priors = priors.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("prior").alias("site_prior"))
    joined = rows.join(priors, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    prior = F.coalesce("site_prior", F.lit(0.5))
    ratio = F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), F.col("odds") - model.prior))
    posterior = 1 / (1 + F.exp(-(logit(prior) + ratio)))
    out = joined.select("row", (1 / (1 + F.exp(-F.col("odds")))).alias("doc_score"), prior.alias("site_prior"), posterior.alias("posterior"))
    return out.withColumn("kept", F.col("posterior") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier keeps, all columns as they were."""
    return judge(docs, labels).where("kept").select("row.*")

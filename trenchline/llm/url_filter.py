"""URL filters: host and path rules, then a logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits that host and its subdomains, and the
longest fitting rule decides.  All other urls are judged by a logistic regression on hashed
character n-grams (of host and path, told apart), trained on a small table of labelled urls
of at most `SAMPLE` rows, which is the bound of what the driver gathers.

Defined results: null urls, and those without `://`, have an empty host and path, fit no rule
and get the verdict of the intercept; very long urls are read whole; with no labelled rows of
both kinds the method says the only label there is, or allow; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query: rule string to verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
GRAMS = (2, 3, 4)
FEATURES = 1 << 14
SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null; rules are a parameter of some hundreds at most."""
    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    return F.coalesce(F.lit(None).cast("string"), *(F.when(fits(r), F.lit(r)) for r in sorted(rules, key=lambda r: (-len(r), r))))


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *(F.when(rule == r, F.lit(v)) for r, v in rules.items()))


def grams(text: str, kind: int) -> np.ndarray:
    """Hashed n-grams of the UTF-8 bytes between two end marks."""
    raw = np.frombuffer(b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint64)
    found = []
    for n in GRAMS:
        if len(raw) >= n:
            code = np.full(len(raw) - n + 1, 8 * n + kind, np.uint64)
            for i in range(n):
                code = (code ^ raw[i:len(raw) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            found.append(code % np.uint64(FEATURES))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: each n-gram counts once, and a url has length one."""
    at = np.unique(np.concatenate([grams(host, 0), grams(path, 1)]))
    return at, np.full(len(at), 1 / np.sqrt(max(1, len(at))))


class UrlModel:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, host: str, path: str) -> float:
        """The probability that the url is to be blocked."""
        if not host and not path:
            return float(1 / (1 + np.exp(-self.intercept)))
        at, x = features(host, path)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[at] @ x, -30, 30))))


def train(rows: list[tuple[str, str, int]], epochs: int = 6, rate: float = 0.5, penalty: float = 1e-6) -> UrlModel:
    """Logistic regression by AdaGrad over (host, path, blocked) rows."""
    weights, seen, intercept, seen_0 = np.zeros(FEATURES), np.full(FEATURES, 1e-8), 0.0, 1e-8
    if not rows:
        return UrlModel(weights, -1.0)
    given = [(*features(h, p), y) for h, p, y in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(given)):
            at, x, y = given[i]
            slip = 1 / (1 + np.exp(-np.clip(intercept + weights[at] @ x, -30, 30))) - y
            step = slip * x + penalty * weights[at]
            seen[at] += step * step
            weights[at] -= rate * step / np.sqrt(seen[at])
            seen_0 += slip * slip
            intercept -= rate * slip / np.sqrt(seen_0)
    return UrlModel(weights, float(intercept))


def labelled_by_rules(urls: DataFrame, rules: dict[str, str], sample: int = SAMPLE) -> DataFrame:
    """host, path, blocked of at most `sample` urls that a rule decides, chosen by a hash."""
    ruled = urls.where(F.col("rule").isNotNull()).select("host", "path", (verdict_of(F.col("rule"), rules) == "block").cast("int").alias("blocked"))
    return ruled.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: dict[str, str] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (of being blocked, by the method).

    `labelled` has host, path and blocked (0 or 1); without it, urls that rules decide serve.
    """
    where = F.col(url)
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(where).alias("host"), path_of(where).alias("path"))
    urls = urls.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = labelled_by_rules(urls, rules)
    known = labelled.where(F.col("blocked").isNotNull()).select(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")), "blocked")
    model = train([tuple(r) for r in known.limit(SAMPLE).collect()])

    @F.pandas_udf("double")
    def score(hosts, paths):
        import pandas as pd

        return pd.Series([model.score(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    judged = urls.withColumn("score", score("host", "path"))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

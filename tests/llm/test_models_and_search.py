"""Language, quality, url filter and search: held-out accuracy, rules and brute force."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF_DIR, odd_rows, rows
from trenchline.llm import language, quality, url_filter, vector_search

BIG = "/root/testdata/sf0.01"


# language --------------------------------------------------------------------------------------

def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    found = language.identify(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    seen = found.collect()
    assert len(seen) == docs.count()
    for r in seen:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in seen if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_language_of_odd_rows(spark, documents, odd_docs, clashing_docs, no_docs):
    model = language.fit(documents.select("doc_id", "text", "lang"))
    found = rows(language.predict(odd_docs, model))
    assert found == rows(language.predict(clashing_docs, model)) and len(found) == len(odd_rows())
    for r in language.predict(odd_docs, model).collect():
        text = [x.text for x in odd_rows() if x.doc_id == r.doc_id][0]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) or r.doc_id is None
    assert language.identify(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs.where("lang is null")).collect()} == {"und"}


def test_language_sees_the_whole_text(spark, documents):
    model = language.fit(documents.select("doc_id", "text", "lang"))
    letters = language.letter_table()
    short = documents.where("lang = 'de'").first().text
    long = "the and of that with " + short * (3 * language.CHUNK // len(short))
    assert model.predict(long, letters)[0] == "de"
    assert np.concatenate(list(language.gram_codes("ab cde", letters))).size == 6


# quality ---------------------------------------------------------------------------------------

def test_quality_of_rows_not_learned_from(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    learned, unseen = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    seen = [(r.row.doc_id, r.kept) for r in quality.judge(docs, learned).collect()]
    assert len(seen) == docs.count()
    assert np.mean([kept == (unseen[i] == 1) for i, kept in seen if i in unseen]) > 0.98


def test_sparse_sites_shrink_to_the_prior(spark):
    scored = spark.createDataFrame(
        [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("tiny", "a", 0.0)] + [(None, None, 0.9)] * 5, "host string, path string, p double")
    prior = {(r.host, r.path): r.prior for r in quality.site_priors(scored).collect()}
    assert abs(prior["big", "a"] - 0.9) < 0.05 and abs(prior["bad", "a"] - 0.1) < 0.05
    assert 0.05 < prior["tiny", "a"] < 0.5 and len(prior) == 4


def test_quality_odd_rows(odd_docs, clashing_docs, labels, documents, no_docs):
    judged = quality.judge(clashing_docs.unionByName(documents, allowMissingColumns=True), labels)
    assert judged.count() == clashing_docs.count() + documents.count()
    assert judged.where("kept is null or not posterior between 0 and 1").count() == 0
    assert quality.keep_good(clashing_docs, labels.limit(0)).columns == clashing_docs.columns
    assert quality.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.keep_good(no_docs, labels).count() == 0


# urls ------------------------------------------------------------------------------------------

def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in url_filter.RULES
            if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://Ex.COM", "https://Ex.COM/", "a://b://c/d", "x://example.com/en/1?q#f", "x://www.example.com/en/",
            "x://a.www.example.com/en/x", "x://wwwexample.com/en/", "x://net/es/", "x://é.net/fr/é?://", "x://notnet/es/", "x://a.org#/com/", "x://b.org?c=/",
            "x://" + "h" * 5000 + "/" + "p" * 50_000, "x://a.org/\n/b"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS * 2)], "page_id long, url string")
    given = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url")
    for table in (pages, given):
        urls = sorted((r.page_id, r.url) for r in table.collect()) if table is given else list(enumerate(ODD_URLS * 2))
        for (page, url), r in zip(urls, sorted(url_filter.judge(table).collect(), key=lambda r: r.page_id), strict=True):
            assert (r.page_id, r.host, r.path, r.rule) == (page, *by_hand(url))
            assert r.verdict == (url_filter.RULES[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_method_learns_from_labelled_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = url_filter.judge(pages).where("rule is not null").select("page_id", "host", "path", "verdict", (F.col("page_id") % 2).alias("half"))
    halves = ruled.withColumn("blocked", (F.col("verdict") == "block").cast("int"))
    judged = url_filter.judge(pages, halves.where("half = 0").select("host", "path", "blocked"))
    seen = judged.join(halves.where("half = 1").select("page_id", "blocked"), "page_id").select("score", "blocked").collect()
    assert len(seen) > 300 and np.mean([(r.score >= 0.5) == (r.blocked == 1) for r in seen]) > 0.97


# search ----------------------------------------------------------------------------------------

def whole(v):
    return None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * float(x)) for x in v]


def search_by_hand(given, asked, k=10):
    usable = [(i, w) for i, v in given if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in sorted({i: w for i, w in usable if i in asked}.items()):
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v)))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def test_search_finds_the_best(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 64)
    monkeypatch.setattr(vector_search, "QUERIES", 2)
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    given = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert rows(vector_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))) == search_by_hand(given, {i for i, _ in given if i % 100 == 0})


def test_search_odd_vectors(spark):
    rng = np.random.default_rng(1)
    given = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(1, 60)] + [(0, [1.0] * 40), (100, [0.0] * 40)]
    given += [(i, [0.5] * 40) for i in range(200, 260)]  # ties
    given += [(300, None), (301, [float("nan")] * 40), (302, [float("inf")] * 40), (303, [None] * 40), (304, []), (305, [1.0, 2.0]), (400, [3.0, 4.0]), (None, [1.0] * 40), (230, [0.5] * 40)]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("q", "c", "v", "id", "score")})
    asked = {0, 100, 200, 230, 300, 400}
    assert rows(vector_search.top_k(vectors, vectors.where(F.col("vec_id").isin(*asked)))) == search_by_hand(given, asked)
    assert vector_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e12])
def test_search_large_components(spark, size):
    rng = np.random.default_rng(2)
    given = [(i, [float(x) for x in rng.normal(size=5) * size]) for i in range(30)]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    edge = 2**63 - 1
    want = [(q, n, i, max(-edge - 1, min(edge, s))) for q, n, i, s in search_by_hand(given, {0})]
    found = rows(vector_search.top_k(vectors, vectors.where("vec_id = 0")))
    assert sorted(r[3] for r in found) == sorted(r[3] for r in want)


def test_search_moves_little(spark):
    """Floats are shuffled as floats, no table lies between the cells and their merge, and candidates are copied for every eight blocks of queries only."""
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    found = vector_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))
    assert all("/embeddings.parquet" in x for x in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 4 and "double" not in plan.lower()
    assert vector_search.grid(600_000, 6_000) == (74, 1) and vector_search.grid(0, 0) == (1, 1)


def test_search_odd_floats(spark):
    given = [(1, [1.0, 2.0]), (2, [1.5, -2.0]), (3, [float("nan"), 1.0]), (4, [1.0, float("inf")]), (5, [float("-inf"), 1.0]), (6, [None, 1.0]), (7, [None, None]), (8, None), (9, []), (10, [0.1, 0.3])]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<float>")
    kept = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert rows(vector_search.top_k(vectors, vectors)) == search_by_hand(kept, {i for i, _ in given})


def random_search(size):
    """Vectors whose length falls along their dimensions, with ties, repeated ids and the queries among the candidates."""
    rng = np.random.default_rng(3)
    m = np.floor(rng.normal(size=(40, 300)) * size * np.geomspace(1, 0.01, 40)[:, None])
    m[:, 100:140] = m[:, [7]]
    ids = np.sort(rng.integers(0, 250, 300))
    return m, ids, np.arange(0, 300, 13)


@pytest.mark.parametrize("size", [50, 1e4, 1e9, 1e12])
@pytest.mark.parametrize("few", [1, 4, 1000])
def test_best_pairs_over_several_blocks(monkeypatch, size, few):
    for name, value in (("CANDIDATES", 32), ("TOGETHER", 5), ("FEW", few)):
        monkeypatch.setattr(vector_search, name, value)
    m, ids, asked = random_search(size)
    q, c, scores = vector_search.best_pairs(m[:, asked], ids[asked], m, ids, 10)
    got = [[(s, int(ids[j])) for i, j, s in zip(q, c, scores.tolist(), strict=True) if i == n] for n in range(len(asked))]
    whole_rows, edge = [[int(x) for x in v] for v in m.T], 2**63 - 1
    for n, a in enumerate(asked):
        dots = (sum(x * y for x, y in zip(whole_rows[a], v, strict=True)) for v in whole_rows)
        want = sorted((-max(-edge - 1, min(edge, s)), int(i)) for s, i in zip(dots, ids, strict=True) if i != ids[a])[:10]
        assert got[n] == [(-s, i) for s, i in want]


def test_open_pairs_are_those_above_the_floor(monkeypatch):
    m, _, asked = random_search(50)
    rest, scores = vector_search.remaining(m), m[:, asked].T @ m
    floors = np.sort(scores, axis=1)[:, -20]
    for few in (1, 4, 1000):
        monkeypatch.setattr(vector_search, "FEW", few)
        q, c, found = vector_search.open_pairs(m[:, asked], m, rest[:, asked], rest, floors)
        want = np.argwhere(scores > floors[:, None])
        assert sorted(zip(q.tolist(), c.tolist(), found.tolist(), strict=True)) == [(i, j, scores[i, j]) for i, j in want.tolist()]

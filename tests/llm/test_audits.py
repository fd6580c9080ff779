"""The audits and SimHash against plain programs over the same rows."""

import re
import subprocess
import sys
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import CLASHING, odd_rows, rows
from trenchline.llm import counting_bloom, filter_audit, simhash, source_divergence
from trenchline.llm.words import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_pieces_keep_all_words(limit):
    text = ("aa b\tccc  \n\x0b dddd\x1ce " * 40).encode() + b"x" * 300 + b" end"
    cut = list(pieces(text, limit))
    assert [w for p in cut for w in p.split()] == text.split()
    assert all(len(p) <= max(limit + 10, 310) for p in cut)


# source divergence -----------------------------------------------------------------------------

def divergence_by_hand(given, min_docs, top=50):
    occurrences, held, groups = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for i, r in enumerate(given):
        lang, source = r.lang or "", r.source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r.text or ""))
        occurrences[lang, source].update(terms)
        for t in terms:
            held[lang, t].add(i)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (own, t), docs in held.items() if own == lang and len(docs) >= min_docs)
        counts = {s: {t: occurrences[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if counts[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [1, 2, 4, 100])
def test_divergence_odd_rows(odd_docs, clashing_docs, min_docs):
    want = divergence_by_hand(odd_rows(), min_docs)
    assert rows(source_divergence.audit(odd_docs, min_docs=min_docs)) == want
    if min_docs == 2:
        assert rows(source_divergence.audit(clashing_docs, min_docs=min_docs)) == want


def test_divergence_documents_in_many_blocks(documents, no_docs, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_TERMS", 300)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 500)
    assert rows(source_divergence.audit(documents, min_docs=10, top_terms=7)) == divergence_by_hand(documents.collect(), 10, 7)
    assert source_divergence.audit(no_docs).count() == 0


def test_rates_are_exact_beyond_64_bits():
    counts, whole = np.array([0, 1, 10**13, 8 * 10**13], np.int64), 9 * 10**13 + 7
    assert source_divergence.rates(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]


def test_rate_column_is_exact(spark):
    from pyspark.sql import functions as F

    given = spark.createDataFrame([(c, 9 * 10**13, 12345) for c in (0, 1, 10**13, 8 * 10**13)], "c long, n long, v long")
    found = [r[0] for r in given.select(source_divergence.rate(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert found == [1 + 10**9 * (c + 5) // (9 * 10**13 + 5 * 12345) for c in (0, 1, 10**13, 8 * 10**13)]


# filter audit ----------------------------------------------------------------------------------

def masks_by_hand(given, labels):
    firsts = defaultdict(list)
    for r in given:
        if r.doc_id is not None:
            firsts[r.text or ""].append(r.doc_id)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    cells = defaultdict(lambda: [0, 0, 0])
    for r in given:
        text = r.text or ""
        words = WORD.findall(text)
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            re.search(r"[#$%&*|]", text), r.doc_id is not None and r.doc_id > min(firsts[text])), strict=True) if bad)
        cell = cells[r.lang or "", fails]
        cell[0] += 1
        cell[1] += r.doc_id is not None and r.doc_id in good
        cell[2] += r.doc_id is not None and r.doc_id in toxic
    return cells


def audit_by_hand(given, labels):
    cells, out, shapley = masks_by_hand(given, labels), [], Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, _ in cells}:
            own = [(f, c) for (p, f), c in cells.items() if p == part]
            for i, filt in enumerate(order):
                before = set(order[:i])
                gone = [c for f, c in own if filt in f and not before & set(f)]
                shapley[part, filt] += sum(c[0] for c in gone)
                out.append((part, "".join(order), i + 1, sum(c[0] for f, c in own if not (before | {filt}) & set(f)), sum(c[0] for c in gone),
                            sum(c[0] for f, c in own if filt in f and before & set(f)), sum(c[0] for f, c in own if f == filt),
                            sum(c[1] for c in gone), sum(c[2] for c in gone)))
    return sorted(((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out), key=repr)


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (9, 1, None), (10, None, 1), (99, 1, 1), (None, 1, 1)]


def test_audit_odd_rows(spark, odd_docs, clashing_docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = audit_by_hand(odd_rows(), LABELS)
    assert rows(filter_audit.audit(odd_docs, labels)) == rows(filter_audit.audit(clashing_docs, labels.selectExpr("*", "1 as n", "2 as mask"))) == want


def test_audit_documents_and_none(documents, labels, no_docs):
    found = rows(filter_audit.audit(documents, labels))
    assert found == audit_by_hand(documents.collect(), [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert {r[0] for r in rows(filter_audit.audit(documents, labels.limit(0)).select("good_lost"))} == {0}


def test_audit_of_very_long_and_hot_texts(spark):
    # one text holds a third of all rows, one is far beyond a piece
    given = spark.createDataFrame([(i, "Hot TEXT | of many" if i % 3 == 0 else f"text {i}", "en", None, 0) for i in range(3000)]
                                  + [(5000, "ab " * 900_000, "en", None, 0), (5001, "ab " * 900_000, "de", None, 0)], "doc_id long, text string, lang string, source string, n long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(filter_audit.audit(given, none)) == audit_by_hand(given.collect(), [])


def test_sketch_clears_unique_hashes_only(spark):
    rng = np.random.default_rng(5)
    once, twice = rng.integers(-2**63, 2**63, 6000), rng.integers(-2**63, 2**63, 300)
    given = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(5)
    found = Counter(r.h for r in counting_bloom.possible_repeats(given, 6600).collect())
    assert all(found[int(x)] == 2 for x in twice)
    assert len(found) - len(twice) < 0.05 * len(once)


# SimHash ---------------------------------------------------------------------------------------

def fingerprint_by_hand(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps):
    """Smallest id reachable; fps: (doc_id, fingerprint)."""
    known = sorted({f for _, f in fps})
    parent = {f: f for f in known}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for a, b in combinations(known, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {f: least.get(root(f)) for f in known}


def simhash_by_hand(given):
    fps = [(r.doc_id, fingerprint_by_hand(r.text)) for r in given]
    names = components_by_hand(fps)
    return sorted(((i, f"{f:016x}", names[f]) for i, f in fps), key=repr)


def test_simhash_odd_rows(odd_docs, clashing_docs, no_docs):
    assert set(CLASHING) <= set(clashing_docs.columns)
    assert rows(simhash.near_duplicates(odd_docs)) == rows(simhash.near_duplicates(clashing_docs)) == simhash_by_hand(odd_rows())
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_documents(documents):
    assert rows(simhash.near_duplicates(documents)) == simhash_by_hand(documents.collect())


@pytest.mark.parametrize("limit", [1, 30, 1000])
def test_fingerprint_of_long_texts_in_pieces(monkeypatch, limit):
    text = "One two  three four five six seven eight nine ten\n" * 9
    monkeypatch.setattr(simhash, "HASHED_BYTES", limit)
    assert simhash.fingerprint(text.encode()) % 2**64 == fingerprint_by_hand(text)


def signed(f):
    return f - 2**64 if f >= 2**63 else f


def test_links_of_crowded_fingerprints(spark):
    """Clouds of fingerprints that share halves: chains, near misses at four bits and a dense group."""
    rng = np.random.default_rng(11)
    fps = set()
    for centre in [int(x) for x in rng.integers(0, 2**63, 6)]:
        fps.add(centre)
        for _ in range(60):
            f = centre
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
        fps |= {centre ^ (int(x) << 32) for x in rng.integers(0, 2**31, 40)}
    fps |= {0, 2**64 - 1, 2**63, 7, 15 << 60}
    given = list(enumerate(sorted(fps)))
    names = components_by_hand(given)
    nodes = spark.createDataFrame([(signed(f), 1 + i % 5) for i, f in given], "fp long, n long")
    from pyspark.sql import functions as F

    first = simhash.labelled(nodes.withColumn("root", F.col("fp")), simhash.components(simhash.star_links(nodes))).select("fp", "root")
    found = simhash.labelled(first, simhash.components(simhash.outer_links(first)))
    groups, want = defaultdict(set), defaultdict(set)
    for r in found.collect():
        groups[r.root].add(r.fp % 2**64)
    for f, name in names.items():
        want[name].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 30


# near-duplicates: memory of the signatures -----------------------------------------------------

def test_signatures_of_short_texts_take_little_memory():
    """A slice of texts of eight words, in a process of its own: peak above the start, in MB."""
    code = """
import resource, numpy as np
from trenchline.llm import near_dup as nd
rng = np.random.default_rng(1)
sets = [nd.shingles(b' '.join(b'w%06d' % x for x in rng.integers(0, 10**6, 8)), known) for known in [nd.WordHashes()] for _ in range(nd.SIGNED_BYTES // 64)]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak(); nd.signatures(sets); print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    assert float(out.stdout) < 150

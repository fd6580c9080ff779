"""Exact, line and near deduplication against plain programs over the same rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import CLASHING, odd_rows, rows
from trenchline.llm import bloom, exact_dedup, line_dedup, near_dup
from trenchline.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# exact -----------------------------------------------------------------------------------------

def exact_by_hand(given):
    groups = defaultdict(list)
    for r in given:
        groups[plain_text(r.text)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, sha(text)))
    return sorted(out, key=repr)


def test_exact_odd_rows(odd_docs):
    assert rows(exact_dedup.mark_duplicates(odd_docs)) == exact_by_hand(odd_rows())


def test_exact_documents(documents):
    assert rows(exact_dedup.mark_duplicates(documents)) == exact_by_hand(documents.collect())


def test_exact_rows_that_stay(clashing_docs, no_docs):
    stay = exact_dedup.drop_duplicates(clashing_docs)
    assert stay.columns == clashing_docs.columns and set(CLASHING) <= set(stay.columns)
    want = sorted((r[0] for r in exact_by_hand(odd_rows()) if r[3]), key=repr)
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == want
    assert exact_dedup.mark_duplicates(no_docs).count() == exact_dedup.drop_duplicates(no_docs).count() == 0


def test_exact_hot_text(spark):
    given = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('text ', id)) as text")
    found = exact_dedup.mark_duplicates(given)
    assert found.where("not kept").count() == 6_666
    assert found.where("group_size = 6667").count() == 6_667 and found.count() == 20_000


def test_filter_never_misses_a_repeat(spark):
    rng = np.random.default_rng(3)
    once, twice = rng.integers(-2**63, 2**63, 5000), rng.integers(-2**63, 2**63, 500)
    table = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(7)
    found = bloom.twice_seen(table, 6000)
    assert found.hit(twice).all() and found.hit(once).mean() < 0.02
    assert bloom.twice_seen(table, 6000, times=1).hit(once).all()


# lines -----------------------------------------------------------------------------------------

def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def lines_by_hand(given):
    holders = defaultdict(set)
    for r in given:
        for line in (r.text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 20:
                holders[key].add(r.doc_id)
    out = []
    for r in given:
        lines = (r.text or "").split("\n")
        stay = []
        for line in lines:
            own = holders.get(lower(line.strip(SPACE)), ())
            largest = max((i for i in own if i is not None), default=None)
            if len(own) < 3 or r.doc_id == largest:
                stay.append(line)
        out.append((r.doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def lines_found(docs):
    return rows(line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text"))


def test_lines_odd_rows(odd_docs, clashing_docs):
    assert lines_found(odd_docs) == lines_found(clashing_docs) == lines_by_hand(odd_rows())


def test_lines_documents(documents):
    assert lines_found(documents) == lines_by_hand(documents.collect())


def test_lines_empty_table(no_docs):
    assert lines_found(no_docs) == []


# near ------------------------------------------------------------------------------------------

def multiset(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes_by_hand(given):
    """The classes of equal or similar rows, as a set of frozensets of row places."""
    sets = [multiset(r.text) for r in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = {(i, j) for own in where.values() for i in own for j in own if i < j}
    for i, j in pairs:
        if similarity(sets[i], sets[j]) >= 0.8:
            root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(given)):
        classes[find(i)].append(i)
    return list(classes.values())


def near_by_hand(given):
    out = []
    for own in classes_by_hand(given):
        ids = [given[i].doc_id for i in own]
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept))
    return sorted(out, key=repr)


def test_near_odd_rows(odd_docs, clashing_docs):
    assert rows(near_dup.classes(odd_docs)) == near_by_hand(odd_rows())
    stay = near_dup.drop_near_duplicates(clashing_docs)
    assert stay.columns == clashing_docs.columns
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == sorted((r[0] for r in near_by_hand(odd_rows()) if r[3]), key=repr)


def test_near_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows(near_dup.classes(docs)) == near_by_hand(docs.collect())


def test_near_copies_of_one_original(spark):
    """Copies that are near their original but not near each other meet through it alone."""
    words = [f"w{i}" for i in range(200)]
    given = [(1000, " ".join(words))]
    for i in range(40):
        own = list(words)
        for k in range(3):
            own[(5 * i + 61 * k) % 200] = f"new{i}x{k}"
        given.append((i, " ".join(own)))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = near_dup.classes(docs)
    assert rows(found) == near_by_hand(docs.collect())
    assert found.select("class_id").distinct().count() == 1


def test_near_shared_passage_is_no_copy(spark):
    """Texts that share half of their words stay apart, however many they are."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(300).selectExpr("id as doc_id", f"concat('{passage} ', array_join(transform(sequence(1, 40), x -> concat('o', id, '_', x)), ' ')) as text")
    assert near_dup.classes(docs).where("class_size > 1").count() == 0


def test_near_empty_table(no_docs):
    assert near_dup.classes(no_docs).count() == near_dup.drop_near_duplicates(no_docs).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 2**63, 300).astype(np.uint64)
    agree, want = [], []
    for trial in range(30):
        own = [rng.integers(0, 2**63, 100).astype(np.uint64) for _ in range(2)]
        elements = [np.concatenate([shared + np.uint64(trial * 1_000_003), x]) for x in own]
        weights = [rng.integers(1, 9, 400), rng.integers(1, 9, 400)]
        a, b = (Counter(dict(zip(e.tolist(), w.tolist(), strict=True))) for e, w in zip(elements, weights, strict=True))
        s = near_dup.signatures([(e, w) for e, w in zip(elements, weights, strict=True)])
        agree.append((s[0] == s[1]).mean())
        want.append(similarity(a, b))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    assert np.isfinite(s).all()


@pytest.mark.parametrize("size", [1, 2, 40, 5000])
def test_signatures_do_not_depend_on_the_batch(size):
    rng = np.random.default_rng(size)
    one = rng.integers(0, 2**63, size).astype(np.uint64), rng.integers(1, 4, size)
    two = rng.integers(0, 2**63, 77).astype(np.uint64), np.ones(77, np.int64)
    assert (near_dup.signatures([one, two])[0] == near_dup.signatures([one])[0]).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(1000, i) for i in range(1001, 1100)] + [(2001, 2000), (2000, 2001)]
    found = rows(components(spark.createDataFrame(links, "a long, b long")))
    assert found == sorted([(i, 0) for i in range(51)] + [(i, 1000) for i in range(1000, 1100)] + [(2000, 2000), (2001, 2000)], key=repr)

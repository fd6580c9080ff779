"""Encoding, token files and mixing against the libraries themselves and plain sums."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows, rows
from trenchline.llm import bpe, mixing, token_files


def own_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODER = own_encoding()
TEXTS = st.text(st.sampled_from(list("ab'sStT 1٣é中!?\n\t\r\x0b\x1c\x85  ​\U0001f600")), max_size=60)


# BPE -------------------------------------------------------------------------------------------

def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


def bpe_by_hand(docs):
    out = []
    for r in docs:
        ids = CODER.encode_ordinary(r.text or "")
        out.append((r.doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trip(odd_docs, documents, no_docs):
    for docs in (odd_docs, documents, no_docs):
        assert rows(bpe.digests(bpe.decode(bpe.encode(docs)))) == bpe_by_hand(docs.collect())


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_safe_cuts_keep_the_ids(text, size):
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.ids_of(text, CODER, size).tolist() == CODER.encode_ordinary(text)


def test_decoding_part_of_a_character(spark):
    ids = CODER.encode_ordinary("\U0001f9ff")
    docs = spark.createDataFrame([(1, bytearray(packed(ids[:1])))], "doc_id long, ids binary")
    assert bytes(bpe.decode(docs).first().decoded) == CODER.decode_bytes(ids[:1]) != "\U0001f9ff".encode() and len(ids) > 1


# token files -----------------------------------------------------------------------------------

def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def files_by_hand(docs):
    tokenizer, start, out = library(), 0, []
    for r in sorted(docs, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_files(odd_docs, documents, no_docs):
    for docs in (odd_docs, documents, no_docs):
        assert rows(token_files.checksums(token_files.token_table(docs.repartition(5)))) == files_by_hand(docs.collect())


def test_files_are_in_order_and_read_selectively(spark, documents, tmp_path):
    token_files.write_tokens(documents.repartition(6), str(tmp_path / "t"))
    table = token_files.read_tokens(spark, str(tmp_path / "t"))
    plan = table.select("doc_id", "n_tokens").where("doc_id = 7")._jdf.queryExecution().toString()
    scan = [x for x in plan.splitlines() if "FileScan" in x or "ReadSchema" in x]
    assert any("doc_id" in x and "ids" not in x for x in scan) and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in plan
    last = -1
    for file in sorted((tmp_path / "t" / "tokens").glob("part-*.parquet")):
        ids = [r.doc_id for r in spark.read.parquet(str(file)).select("doc_id").collect()]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_stretches_keep_the_ids(texts):
    assert CACHED.ids(texts) == [packed(library_ids(text)) for text in texts]


CACHED, LIBRARY = token_files.StretchEncoder(token_files.VOCABULARY), library()


def test_strings_of_special_tokens_are_what_the_library_makes_of_them():
    texts = ["<|endoftext|> hi", "a<|endoftext|>b c", "plain words", "x <|endoftext|>", "<|endoftext|", "one <|endof text|> two", "<|endoftext|><|endoftext|>"]
    found = token_files.StretchEncoder(token_files.VOCABULARY).ids(texts)
    assert found == [packed(library_ids(text)) for text in texts]
    assert found[0] == packed([50256, 23105])


def test_a_full_cache_starts_over(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 5)
    coder = token_files.StretchEncoder(token_files.VOCABULARY)
    for texts in (["\n\nhead a", "\r\n\nb c"], ["a b c d e f", ""], ["x y  z", "a b c q r s t u v"], ["p\rq r", "one\n two", " lead"], ["it word's word' word'' it's, it%%% 's (x) a\n. b. ٣. é."]):
        assert coder.ids(texts) == [packed(library_ids(text)) for text in texts]


def test_lines_and_signs_make_no_new_words():
    coder = token_files.StretchEncoder(token_files.VOCABULARY)
    coder.ids(["one two.\nThree four"])
    seen, texts = set(coder.known), ["one two!\nThree, four.\nThree", "x\x01y two", "\x01", "one\n\ntwo two.\n", "\none \ntwo\r three"]
    assert coder.ids(texts[:1]) == [packed(library_ids(texts[0]))] and set(coder.known) == seen
    assert coder.ids(texts) == [packed(library_ids(text)) for text in texts] and coder.ids([]) == []


def test_words_in_use_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 12)
    coder, encoded = token_files.StretchEncoder(token_files.VOCABULARY), []
    runs = coder.runs
    monkeypatch.setattr(coder, "runs", lambda words: encoded.extend(words) or runs(words))
    for i in range(0, 30, 3):
        text = f"start kept {'bcd'[i % 2]}{'x' * i} y{'x' * i} z{'x' * i}"
        assert coder.ids([text]) == [packed(library_ids(text))]
    assert encoded.count(" kept") == 1 and len(coder.known) + len(coder.old) <= 12


def test_runs_of_letters_by_the_model_alone():
    words = [" word", "Éternité", " ɏɐ", " naïve", "ß", " Straßenbahn", " ªµº"]
    assert CACHED.model is not None and CACHED.runs(words[:2]) == [packed(library_ids(x)) for x in words[:2]]
    assert CACHED.ids(words) == [packed(library_ids(x)) for x in words]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


# mixing ----------------------------------------------------------------------------------------

def targets_by_hand(sizes):
    """Share by weight; what is above twice a source's size is shared again, until none is."""
    sources = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, free, target = 1.5 * sum(sizes.values()), list(sources), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        above = [s for s in free if rate * weight[s] > 2 * sizes[s]]
        if not above:
            return target | {s: rate * weight[s] for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in above]
    return target


@pytest.mark.parametrize("name", ["odd_docs", "documents"])
def test_mix_meets_its_targets(request, name):
    docs = request.getfixturevalue(name)
    found = mixing.mix_words(docs).collect()
    sources = {(r.doc_id, len((r.text or "").encode().split())): r.source for r in docs.collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        s = sources[r.doc_id, r.size]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(found) == docs.count() and target == pytest.approx(targets_by_hand(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 and all(r.source_size == sizes[s] for r in found if sources[r.doc_id, r.size] == s)


def test_mix_agrees_with_itself(documents):
    assert rows(mixing.mix_words(documents)) == rows(mixing.mix_words(documents.repartition(7)))


def test_small_blocks_give_the_same_words(spark, documents):
    sized = documents.select("doc_id", "source", mixing.words(documents["text"]).alias("size"))
    few, many = (rows(mixing.taken_words(sized, ["doc_id", "size"], n).select("doc_id", "taken")) for n in (1 << 20, 50))
    assert few == many


def test_slots_follow_the_weights_all_along(spark):
    sources = spark.createDataFrame([(0, 500), (1, 200), (2, 100), (3, 3), (4, 0)], "number long, slots long")
    slots = sorted(mixing.schedule(spark, sources).collect(), key=lambda r: r.slot)
    need = {0: 500, 1: 200, 2: 100, 3: 3}
    got = defaultdict(int)
    for n, r in enumerate(slots, 1):
        assert r["rank"] == got[r.number]
        got[r.number] += 1
        if n <= 700:
            assert all(abs(got[s] - n * need[s] / 803) <= 8 for s in need)
    assert dict(got) == need


def test_every_prefix_of_the_mix_follows_the_weights(spark):
    """In the order of their first slots, documents of each source come at the rate of its target."""
    given = spark.range(9000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "5 + id % 7 as size")
    found = mixing.taken_words(given, ["doc_id", "size"], 100).where("first_slot is not null").collect()
    last = max(r.first_slot for r in found)
    target, whole = ({r.source: float(r[c]) for r in found} for c in ("target", "source_size"))
    for part in (0.1, 0.3, 0.5, 0.7, 0.9):
        held = defaultdict(int)
        for r in found:
            if r.first_slot <= part * last:
                held[r.source] += r.size
        # the last slot of the schedule ends the source with the largest target; others stand at the same share of theirs
        shares = {s: min(held[s] / target[s], 1.0) for s in target if held[s] < 0.98 * whole[s]}
        assert shares and max(shares.values()) - min(shares.values()) < 0.05
    assert any(r.again_slot is not None and r.again_slot > r.first_slot for r in found)


def test_mixed_rows_lie_in_the_order_of_the_schedule(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('word ', 200) as text", "concat('s', id % 4) as source")
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    slots = {r.doc_id: (r.first_slot, r.again_slot) for r in mixing.taken_words(sized, ["doc_id", "size"]).collect()}
    mixed = [r.doc_id for r in mixing.mix_documents(docs).collect()]
    seen, before, out_of_order = set(), -1, 0
    for i in mixed:
        first, again = slots[i]
        slot = again if i in seen and again is not None else first
        seen.add(i)
        out_of_order += slot < before
        before = max(before, slot)
    assert out_of_order == 0 and len(mixed) > 5000


def test_documents_of_the_mix(clashing_docs, no_docs):
    mixed = mixing.mix_documents(clashing_docs)
    assert mixed.columns == clashing_docs.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id, len((r.text or "").encode().split())] += 1
    size = {(r.doc_id, len((r.text or "").encode().split())) for r in odd_rows()}
    assert set(times) <= size and all(n > 0 for _, n in times)
    assert mixing.mix_documents(no_docs).count() == mixing.mix_words(no_docs).count() == 0


def test_one_pass_round_trip_is_decode_of_encode(odd_docs, clashing_docs, no_docs):
    want = rows(bpe.decode(bpe.encode(odd_docs)))
    assert rows(bpe.round_trip(odd_docs)) == rows(bpe.round_trip(clashing_docs)) == want
    assert bpe.round_trip(no_docs).count() == 0

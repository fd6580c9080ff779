"""The pipeline: stages take effect one after another, and the last one's rows are right."""

import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SF_DIR
from tests.llm.test_dedup import exact_by_hand, near_by_hand
from tests.llm.test_tokens_and_mix import CODER, packed


def test_stages(spark, documents, labels, tmp_path):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    good, exact, near, mix, tokens = seen
    assert all(df.columns == documents.columns for df in seen[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    fine = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(ids[0] & bad) <= 0.02 * len(bad) + 1 and len(fine - ids[0]) <= 0.02 * len(fine) + 1
    assert ids[1] == {r[0] for r in exact_by_hand(good.collect()) if r[3]}
    assert ids[2] == {r[0] for r in near_by_hand(exact.collect()) if r[3]}
    texts = {r.doc_id: r.text for r in near.collect()}
    assert ids[3] <= ids[2] and {r.doc_id: r.text for r in mix.collect()} == {i: texts[i] for i in ids[3]}
    want = Counter()
    for r in mix.collect():
        coded = CODER.encode_ordinary(r.text or "")
        want[r.doc_id, len(coded), hashlib.sha256(packed(coded)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in tokens.collect()) == want


def test_run_gives_the_same(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_run_on_odd_and_on_no_rows(spark, odd_docs, clashing_docs, no_docs, labels, tmp_path):
    """Odd rows, extra columns of clashing names and an empty table go through all stages."""
    for name, docs in (("odd", odd_docs), ("clashing", clashing_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.limit(0).write.parquet(str(tmp_path / name / "labels.parquet"))
    odd, clashing, none = ([tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()] for name in ("odd", "clashing", "none"))
    assert none == [] and Counter(odd) == Counter(clashing) and odd
    # of the equal and of the near texts one each is left, and texts without words are in no mix
    left = {r[0] for r in odd}
    assert not left & {3, 4, 12} and len(left & {1, 2}) == 1 and len(left & {8, 9, 10}) <= 1

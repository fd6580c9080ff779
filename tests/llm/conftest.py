"""Small documents that hold every odd case, shared by the tests of all operators."""

import pytest
from pyspark.sql import Row

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = ("row", "kept", "size", "start", "copies", "suspected", "node", "content", "number", "target", "host", "path", "odds", "_id", "times")

LINE = "This very line stands in many of the documents here."
WORDS = " ".join(f"word{i}" for i in range(60))


def odd_rows():
    texts = [
        (1, "alpha beta  gamma", "en", "a"), (2, "alpha beta gamma", "en", "a"), (2, "alpha beta gamma", "en", "a"),
        (3, "", "en", None), (4, None, None, None), (None, "alpha\tbeta gamma", None, "b"), (None, None, "de", "b"),
        (5, f"{LINE}\nfirst", "en", "a"), (6, f"  {LINE.upper()}\t\nsecond\n{LINE}", "en", "b"), (7, f"{LINE}\n\n", "fr", "c"),
        (7, f"{LINE}\n\n", "fr", "c"), (8, WORDS, "en", "a"), (9, WORDS + " end", "en", "a"), (10, WORDS + " end", "en", "a"),
        (11, "é" * 19 + "\n" + "é" * 20, "fr", "ü"), (12, "\n", "en", ""), (13, "x y", "en", "a"), (14, "a" * 300_000 + " " + "b" * 5, "en", "a"),
        (15, "one  two \n three four five 's don't 123abc!!\x1c", "en", "b"), (16, "<|endoftext|> 中文字 \U0001f600", None, "a"),
    ]
    return [Row(doc_id=i, text=t, lang=g, source=s, n_chars=None if t is None else len(t)) for i, t, g, s in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def rows(df):
    """All rows as tuples, in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)

"""The store by file: replaces, failed writes, older versions, buckets of very different size."""

import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trenchline.sources.keyed_store import BUCKET, KeyedStore

SCHEMA = "project_id string, source_file string, v long"


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-") + "/store"


def values(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_replace_and_versions(spark, path):
    store = KeyedStore(spark, path, SCHEMA, buckets=4)
    assert store.version() == 0 and values(store.read()) == []
    first = [("p", f"f{i}", i) for i in range(20)] + [("q", "f1", 100), ("p", "f1", 101)]
    assert store.replace(frame(spark, *first)) == 1
    assert store.replace(frame(spark, ("p", "f1", -1), ("p", "new", -2))) == 2
    want = sorted([r for r in first if r[:2] != ("p", "f1")] + [("p", "f1", -1), ("p", "new", -2)])
    assert values(store.read()) == values(KeyedStore(spark, path, SCHEMA, buckets=4).read()) == want
    assert values(store.read(version=1)) == sorted(first)
    assert store.replace(frame(spark)) == 2  # nothing came
    # only touched buckets were written again
    touched = spark.read.json(path + "/manifest").groupBy("version").count().collect()
    assert {r["version"]: r["count"] for r in touched}[2] <= 2
    with pytest.raises(ValueError, match="4 buckets"):
        KeyedStore(spark, path, SCHEMA, buckets=8)


def test_failed_write_leaves_the_old_state(spark, path):
    store = KeyedStore(spark, path, SCHEMA, buckets=2)
    store.replace(frame(spark, ("p", "a", 1), ("p", "b", 2), ("p", "c", 3)))
    # the rows of one file cannot be made: some buckets' files may be written before that
    broken = spark.range(2000).select(
        F.lit("p").alias("project_id"), F.concat(F.lit("f"), F.col("id") % 50).alias("source_file"),
        F.when(F.col("id") < 1999, F.col("id")).otherwise(F.raise_error(F.lit("half way")).cast("long")).alias("v")).repartition(8)
    with pytest.raises(PySparkException, match="half way"):
        store.replace(broken)
    assert store.version() == 1 and values(store.read()) == [("p", "a", 1), ("p", "b", 2), ("p", "c", 3)]
    assert store.replace(frame(spark, ("p", "b", 9))) == 2
    assert values(store.read()) == [("p", "a", 1), ("p", "b", 9), ("p", "c", 3)]


def test_data_without_a_manifest_are_not_seen(spark, path, monkeypatch):
    """The writer is lost after the data, before the manifest."""
    store = KeyedStore(spark, path, SCHEMA, buckets=2)
    store.replace(frame(spark, ("p", "a", 1), ("p", "b", 2)))
    real = spark.createDataFrame

    def lost(data, schema=None, *args, **kwargs):
        if schema is not None and str(schema).startswith("version long") and data:
            raise RuntimeError("writer lost")
        return real(data, schema, *args, **kwargs)

    incoming = frame(spark, ("p", "a", 7))
    monkeypatch.setattr(spark, "createDataFrame", lost)
    with pytest.raises(RuntimeError, match="writer lost"):
        store.replace(incoming)
    monkeypatch.undo()
    assert values(store.read()) == [("p", "a", 1), ("p", "b", 2)]
    assert store.vacuum() == 1
    assert values(store.read()) == [("p", "a", 1), ("p", "b", 2)]
    store.replace(incoming)
    store.replace(frame(spark, ("p", "b", 8), ("p", "a", 9)))
    assert store.vacuum() >= 1 and values(store.read()) == [("p", "a", 9), ("p", "b", 8)]


def test_one_very_large_file(spark, path):
    store = KeyedStore(spark, path, SCHEMA, buckets=3)
    rows = spark.range(60_000).select(F.lit("p").alias("project_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("source_file"), F.col("id").alias("v"))
    store.replace(rows)
    store.replace(frame(spark, ("p", "f2", -1)))
    assert store.read().count() == 60_000 and BUCKET not in store.read().columns
    assert store.read().where("source_file = 'hot'").count() == 40_000

"""Reading the given tables, storing intermediate ones, and small helpers for Python tasks."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: The characters that count as white space between words: \x20 and \x09-\x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that a Python task takes up at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a new temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="spark-"))
    return made


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends here, lost executors do no harm."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps over its tasks (tokenizers, caches).

    A worker keeps one object, so that stages that follow each other do not add up.
    """
    holder = sys.modules.setdefault("_trenchline_worker_state", types.ModuleType("_trenchline_worker_state"))
    kept = holder.__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice are about `limit` bytes; a longer text is a slice of its own.

    When a task's batches are done, its worker gives the memory back that it no longer needs.
    """
    for batch in batches:
        sizes = batch.column(column)
        if batch.num_rows == 0:
            continue
        start = total = 0
        lengths = pa.compute.binary_length(sizes).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay alive beside those that work."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).fill_null(b"").to_pylist()

"""One ordered pass over many keys at once, for rules that need the last row kept.

Rows are dealt by key and sorted within partitions; a task walks its partition batch by batch
and carries a small state from row to row, from batch to batch and from key to key.  A key of
any length takes no more memory than a batch, and short keys cost no call of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


#: Types of columns that a pass can add to those it reads.
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class Rule(Protocol):
    """State of one key.  `push` and `end` give the rows that are now certain, as tuples."""

    def push(self, row: tuple) -> Iterator[tuple]: ...

    def end(self) -> Iterator[tuple]: ...


def ordered_pass(df: DataFrame, keys: list[str], order: list[str], rule: Callable[[], Any], out: str, batch_rows: int = 10_000) -> DataFrame:
    """Rows of `out` (a schema; keys first) that a new `rule()` gives for each key.

    A rule sees the columns of `df` after the keys, in their order, and gives the columns of
    `out` after the keys.
    """
    values = [c for c in df.columns if c not in keys]
    n_keys = len(keys)
    dealt = df.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = df.sparkSession.createDataFrame([], out).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, held, types = None, None, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            held.clear()
            return made

        for rows in batches:
            types = [rows.schema.field(f.name).type if f.name in rows.schema.names else TYPES[f.dataType.simpleString()] for f in schema.fields]
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if row[:n_keys] != key or now is None:
                    if now is not None:
                        held.extend(key + r for r in now.end())
                    key, now = row[:n_keys], rule()
                held.extend(key + r for r in now.push(row[n_keys:]))
            if len(held) >= batch_rows:
                yield batch()
        if now is not None:
            held.extend(key + r for r in now.end())
            yield batch()

    return dealt.mapInArrow(run, out)

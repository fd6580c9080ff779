"""A store of rows by file: an upload replaces its files' rows, and readers see whole versions only.

Rows lie in a fixed number of buckets by a hash of their keys.  A replace writes the touched
buckets anew into a folder of its own and then appends, as one small file, the manifest rows
(version, bucket, folder) that make them current; a bucket's folder is the one of its highest
version.  A write that fails before that last step leaves no trace that a reader meets, and
files of older versions stay until `vacuum`, so readers of an older version go on undisturbed.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
MANIFEST = "version long, bucket int, buckets int, folder string"


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: tuple[str, ...] = ("project_id", "source_file"), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        if (known := self._manifest().select("buckets").distinct().collect()) and known[0][0] != buckets:
            raise ValueError(f"the store has {known[0][0]} buckets")

    def _folder(self, name: str):
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return fs_path, fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> DataFrame:
        place, files = self._folder("manifest")
        if not files.exists(place):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def version(self) -> int:
        """The version that readers see now; 0 for an empty store."""
        return self._manifest().agg(F.max("version")).first()[0] or 0

    def _current(self, version: int | None) -> dict[int, str]:
        """Folder of each bucket that has rows: as many entries as buckets, at most."""
        seen = self._manifest() if version is None else self._manifest().where(F.col("version") <= version)
        return dict(seen.groupBy("bucket").agg(F.max_by("folder", "version")).collect())

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/{BUCKET}={bucket}" for bucket, folder in sorted(folders.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an earlier one that is not yet vacuumed."""
        return self._rows(self._current(version))

    def replace(self, incoming: DataFrame) -> int:
        """Rows of the keys of `incoming` become those of `incoming`; the new version is returned."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        incoming = incoming.select(*self.schema.names).withColumn(BUCKET, bucket)
        touched = {r[0] for r in incoming.select(BUCKET).distinct().collect()}
        if not touched:
            return self.version()
        # the version and the folders come from one look at the manifest
        version, current = self.version() + 1, self._current(None)
        old = self._rows({b: folder for b, folder in current.items() if b in touched}).withColumn(BUCKET, bucket)
        kept = old.join(incoming.select(*self.keys).distinct(), self.keys, "left_anti")
        folder = f"data/v{version:010d}-{uuid.uuid4().hex}"
        # balanced by bucket: a bucket with a very large file is written by several tasks
        (kept.unionByName(incoming).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}"))
        rows = [(version, b, self.buckets, folder) for b in sorted(touched)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return version

    def vacuum(self) -> int:
        """Remove folders that the newest version does not read, those of failed writes too; how many went."""
        place, files = self._folder("data")
        if not files.exists(place):
            return 0
        live = {folder.removeprefix("data/") for folder in self._current(None).values()}
        gone = [s.getPath() for s in files.listStatus(place) if s.getPath().getName() not in live]
        for old in gone:
            files.delete(old, True)
        return len(gone)

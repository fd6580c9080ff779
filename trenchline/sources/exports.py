"""Text outputs: CSV tables of saved and recognised rows, and map features one per line.

Every writer goes through Spark's committer, one file per partition, each with a header, so a
repeated task leaves no doubled rows; readers take the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trenchline.operators.quality import file_summary
from trenchline.sources.design import line_geojson, point_geojson

# Columns of the saved-row table, and the names of the recognition tables.
SAVED_COLUMNS = ("station", "depth", "boc")
VALID, INVALID, SUMMARY = "ocr_valid_segments", "ocr_invalid_rows", "ocr_file_summary"


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled, nulls empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_saved_rows(rows: DataFrame, path: str) -> None:
    write_csv(rows.select(*SAVED_COLUMNS), path)


def write_recognition(spans: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Good spans, refused rows, and counts per file, as three tables under `path`."""
    write_csv(spans.where(F.col("reject_reason").isNull()).drop("reject_reason"), f"{path}/{VALID}")
    write_csv(spans.where(F.col("reject_reason").isNotNull()).withColumnRenamed("reject_reason", "segment_reason"), f"{path}/{INVALID}")
    write_csv(file_summary(spans, keys or ["source_file"]), f"{path}/{SUMMARY}")


def route_feature(lines: DataFrame) -> DataFrame:
    """The design route of a report as a map feature; expects coords and route_name."""
    return lines.withColumn("feature", line_geojson(F.col("coords"), F.struct(F.col("route_name").alias("name"), F.lit("design_route").alias("type"))))


def point_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One map feature per judged row, with its flags and colour among the properties."""
    return rows.withColumn("feature", point_geojson(F.col("lat"), F.col("lon"), F.struct(*properties)))


def write_features(features: DataFrame, path: str, by: str = "project_id") -> None:
    """Features as text, one per line, in a folder per project."""
    features.select(by, F.col("feature").alias("value")).write.mode("overwrite").partitionBy(by).text(path)

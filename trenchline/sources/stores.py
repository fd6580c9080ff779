"""Row stores and logs: replace by source, append with dedupe, issue log, photo index, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_source(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Files in `incoming` replace all their earlier rows; other files stay.

    The list of incoming file names is distinct before the anti-join, so a file
    with many rows costs one key.
    """
    keys = ["project_id", "source_file"]
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exact dedupe keeping the first row of each key; a map-side aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))


def best_of_each(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Dedupe keeping the row of highest score, the earliest of equals."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))


def append_rows(existing: DataFrame, incoming: DataFrame, replace: bool) -> DataFrame:
    """Append (or replace) saved rows; repeats of (station, depth, boc) keep their first place."""
    both = incoming.withColumn("_part", F.lit(1))
    if not replace:
        both = existing.withColumn("_part", F.lit(0)).unionByName(both)
    ranked = both.withColumn("_place", F.struct("_part", "line_number"))
    return first_of_each(ranked, ["station", "depth", "boc"], "_place").drop("_part", "_place")


def audit_append(uploads: DataFrame, path: str) -> None:
    uploads.select("source_file", "date", "crew", "job_name", "print").write.mode("append").parquet(path)


def upsert_issues(reports: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per fingerprint with its count and latest details; the newest `keep` of them, or all.

    The limit is the log's own size, applied after the aggregate.
    """
    newest = F.struct("ts", "event_id")
    log = reports.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_seen"),
        F.max_by("details", newest).alias("details"), F.max("event_id").alias("last_id"))
    return log if keep is None else log.orderBy(F.desc("last_seen"), "fingerprint").limit(keep)


def newest_issues(reports: DataFrame, keep: int = 200) -> DataFrame:
    """The newest `keep` reports, repeats included."""
    return reports.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def station_identity(route: Column, file: Column, station: Column, mapped_ft: Column, lat: Column, lon: Column) -> Column:
    """SHA-256 of the parts that identify a located station."""
    return F.sha2(F.concat_ws(
        "|", F.coalesce(route, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(station, F.lit("")),
        F.format_string("%.3f", mapped_ft), F.format_string("%.8f", lat), F.format_string("%.8f", lon)), 256)


def judge_photos(uploads: DataFrame, per_upload: int = 10) -> DataFrame:
    """Every uploaded file with its photo_id, or the reason why it is refused."""
    sizes = uploads.groupBy("upload_id").agg(F.count("*").alias("n"))
    # fixed values: the texts that a refused upload gets
    reason = F.when(F.col("n") > per_upload, f"Upload up to {per_upload} files at a time.").when(
        ~F.coalesce(F.lower(F.trim("content_type")), F.lit("")).rlike("^(image/|$)"), F.concat("filename", F.lit(" is not an image upload.")))
    photo_id = F.left(F.sha2(F.concat_ws("|", "station_hash", "filename", "uploaded_at"), 256), F.lit(24))
    judged = uploads.join(sizes, "upload_id").withColumn("reject_reason", reason).drop("n")
    return judged.withColumn("photo_id", F.when(F.col("reject_reason").isNull(), photo_id))


def accept_photos(uploads: DataFrame, per_upload: int = 10) -> DataFrame:
    """The accepted files."""
    return judge_photos(uploads, per_upload).where(F.col("reject_reason").isNull()).drop("reject_reason")


def photo_index(photos: DataFrame, points: DataFrame) -> DataFrame:
    """Photos of located stations, by station hash."""
    return points.join(photos, "station_hash").select(
        "station_hash", "route_id", "source_file", "station", "photo_id", "filename", "uploaded_at")

"""Sinks: snapshots, reports and changes that are applied only to what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(files: DataFrame, path: str, snapshot_id: str) -> None:
    """Append files(path, content, sha256) as one snapshot; backups are partitions, not archives."""
    files.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(path)


def read_snapshot(spark, path: str, snapshot_id: str) -> DataFrame:
    """One snapshot; only its partition is read. Rows whose content is not what their hash says are an error."""
    rows = spark.read.parquet(path).where(F.col("snapshot_id") == snapshot_id)
    return rows.withColumn("is_readable", F.sha2("content", 256) == F.col("sha256"))


def apply_plan(preview: DataFrame, current: DataFrame) -> DataFrame:
    """path, action (write, skip, refuse) of preview(path, original_sha256, desired_sha256) against current(path, current_sha256):
    a file is written if it is still what the preview saw, skipped if it is as desired, refused otherwise."""
    joined = preview.join(current, "path", "left")
    same = F.col("original_sha256").eqNullSafe(F.col("current_sha256"))
    action = F.when(F.col("desired_sha256").eqNullSafe(F.col("current_sha256")), "skip").when(same, "write").otherwise("refuse")
    return joined.select("path", action.alias("action"))


def merged(current: DataFrame, preview: DataFrame) -> DataFrame:
    """current(path, text) after a preview(path, original_sha256, text): all or nothing, so any refusal leaves it as it is."""
    now = current.select("path", F.sha2("text", 256).alias("current_sha256"))
    plan = apply_plan(preview.select("path", "original_sha256", F.sha2("text", 256).alias("desired_sha256")), now)
    refused = plan.agg(F.count_if(F.col("action") == "refuse").alias("n_refused"))
    new = preview.select("path", F.col("text").alias("_new"))
    joined = current.join(new, "path", "full_outer").crossJoin(F.broadcast(refused))  # one row
    text = F.when((F.col("n_refused") == 0) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("text"))
    return joined.select("path", text.alias("text")).where("text is not null")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Drift of files as they arrive: every micro-batch is classified against a manifest table and merged into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import drift


def classified(batch: DataFrame, manifest: DataFrame) -> DataFrame:
    """What a batch of files(path, kind, text) would change: the manifest is what is known of the files as they stand."""
    outputs = batch.select("path", "kind", F.sha2("text", 256).alias("desired_sha256"))
    return drift.classify_outputs(outputs, manifest, manifest.select("path", F.col("after_sha256").alias("current_sha256")))


def watch(files: DataFrame, read_manifest, write_result, checkpoint: str):
    """Start a query over a stream of files. read_manifest() gives the manifest as it is when a batch begins;
    write_result(frame, batch_id) must be idempotent for a batch_id, as a batch is repeated after a failure."""
    run = lambda batch, batch_id: write_result(classified(batch, read_manifest()), batch_id)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_by_window(changes: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Changes(at, change) counted by event-time window; rows later than the watermark are left out."""
    return changes.withWatermark("at", late).groupBy(F.window("at", width), "change").agg(F.count(F.lit(1)).alias("n_changes")).select(F.col("window.start").alias("start"), "change", "n_changes")

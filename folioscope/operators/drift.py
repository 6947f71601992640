"""Fingerprints and drift: outputs against a manifest and the files as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFLICT = "existing-file-is-manual-or-hash-drifted"


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("sha256", F.sha2(F.col(text), 256))


def classify_outputs(outputs: DataFrame, manifest: DataFrame, current: DataFrame) -> DataFrame:
    """outputs(path, kind, desired_sha256) against manifest(path, after_sha256, marker) and current(path, current_sha256).

    create: no such file; unchanged: same content; update: other content. An update conflicts unless the manifest's hash
    is the file's and, but for attachments, the file has the generator's marker.
    """
    trusted = F.col("after_sha256").eqNullSafe(F.col("current_sha256")) & ((F.col("kind") == "attachment") | F.coalesce(F.col("marker"), F.lit(False)))
    exists = F.col("current_sha256").isNotNull()
    action = F.when(~exists, "create").when(F.col("current_sha256") == F.col("desired_sha256"), "unchanged").otherwise("update")
    joined = outputs.join(manifest.select("path", "after_sha256", "marker"), "path", "left").join(current, "path", "left")
    return joined.select(
        "path", "kind", "desired_sha256", "current_sha256", exists.alias("file_exists"), action.alias("action"),
        F.when((action == "update") & ~trusted, CONFLICT).alias("conflict"),
    )


def count_actions(classified: DataFrame) -> DataFrame:
    return classified.groupBy("action").agg(F.count(F.lit(1)).alias("n_files"), F.count("conflict").alias("n_conflicts"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, modified) between two tables of path and state."""
    joined = before.select("path", F.col("state").alias("_b")).join(after.select("path", F.col("state").alias("_a")), "path", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return joined.select("path", change.alias("change")).where("change is not null")


def merge_manifest(previous: DataFrame, current: DataFrame, include_new: bool = True) -> DataFrame:
    """path, after_sha256 and position: previous records in their order with current ones in place, then new ones if wanted.

    Both have path, after_sha256 and position."""
    p, c = previous.select("path", F.col("after_sha256").alias("_ph"), F.col("position").alias("_pp")), current.select("path", F.col("after_sha256").alias("_ch"), F.col("position").alias("_cp"))
    joined = p.join(c, "path", "full_outer" if include_new else "left")
    return joined.select("path", F.coalesce("_ch", "_ph").alias("after_sha256"), F.col("_pp").isNull().alias("is_new"), F.coalesce("_pp", "_cp").alias("position"))


def baseline_conflicts(report: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a report whose hash is not the manifest's: report(path, sha256), manifest(path, after_sha256)."""
    return report.join(manifest.select("path", "after_sha256"), "path").where(F.col("sha256") != F.col("after_sha256")).select("path", "sha256", "after_sha256")


def audit(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """path and issue of generated files that are gone or have another hash."""
    gone = manifest.join(current, "path", "left_anti").select("path", F.lit("missing-generated-file").alias("issue"))
    drifted = manifest.join(current, "path").where(F.col("after_sha256") != F.col("current_sha256")).select("path", F.lit("generated-file-hash-drift").alias("issue"))
    return gone.unionByName(drifted)


def rollback_plan(backup: DataFrame, created: DataFrame, current: DataFrame) -> DataFrame:
    """path, action (restore, delete, refuse): a rollback refuses files that have changed since the run. backup: path,
    before_sha256, after_sha256; created: path, after_sha256; current: path, current_sha256."""
    restored = backup.select("path", "after_sha256", F.lit("restore").alias("action"))
    both = restored.unionByName(created.select("path", "after_sha256", F.lit("delete").alias("action"))).join(current, "path", "left")
    return both.select("path", F.when(F.col("after_sha256").eqNullSafe(F.col("current_sha256")), F.col("action")).otherwise("refuse").alias("action"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """sha256, number of copies and least id of texts that several rows have."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n_copies"), F.min(doc_id).alias("first_id")).where("n_copies > 1")

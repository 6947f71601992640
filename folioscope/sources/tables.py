"""Readers of corpora and a writer for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are no content, at the top or at any depth, and folders of dependencies and built files.
EXCLUDED = (".obsidian", ".claudian", ".trash", "file")
EXCLUDED_ANYWHERE = ("file", ".obsidian", ".trash")
GENERATED = ("node_modules", "vendor", "venv", "env", "dist", "build", "__pycache__")
DOT_FILES = (".memory.json", ".gitkeep")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that spark.checkpoint.dir names (one of our own only if it names none) and read it back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-ckpt-"))
    path = f"{sc.getCheckpointDir()}/folioscope-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def markdown_files(spark: SparkSession, root: str, include: list[str] | None = None) -> DataFrame:
    """path (below root), text and has_bom of Markdown files, but for those in hidden or generated folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    relative = F.replace(path, base, F.lit(""))
    text = F.decode("content", "UTF-8")
    files = raw.select(relative.alias("path"), F.regexp_replace(text, "^﻿", "").alias("text"), text.startswith("﻿").alias("has_bom"))
    kept = files.where(~F.split("path", "/")[0].isin(*EXCLUDED))
    return kept.where(F.col("path").isin(*include)) if include is not None else kept


# The scans below are predicates over tables of paths below a root, from a reader or a listing of any kind.


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _folders(path: Column) -> Column:
    return F.slice(_parts(path), 1, F.size(_parts(path)) - 1)


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def is_content(path: Column) -> Column:
    """Markdown outside of excluded folders at any depth, upper and lower case alike."""
    return path.endswith(".md") & ~F.exists(_parts(path), lambda p: F.lower(p).isin(*EXCLUDED_ANYWHERE))


def is_kept(path: Column) -> Column:
    """Files in no hidden folder whose name has no dot in front, but for two known ones."""
    name = F.element_at(_parts(path), -1)
    return ~F.exists(_folders(path), lambda p: p.startswith(".")) & (~name.startswith(".") | name.isin(*DOT_FILES))


def is_page(path: Column, sections: list[str]) -> Column:
    """Markdown at the root, without a dot in front, or in one of the managed sections and not hidden there."""
    top = F.size(_parts(path)) == 1
    return is_markdown(path) & ((top & ~path.startswith(".")) | (~top & _parts(path)[0].isin(*sections) & is_kept(path)))


def is_project_markdown(path: Column) -> Column:
    """Markdown of a project outside of hidden folders and those of dependencies and built files."""
    hidden = F.exists(_parts(path), lambda p: p.startswith("."))
    return is_markdown(path) & ~hidden & ~F.exists(_folders(path), lambda p: F.lower(p).isin(*GENERATED))


def strict_text(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(files with text, those whose bytes are no UTF-8), so that a caller can fail on any of the latter."""
    good = F.is_valid_utf8(F.col(content).cast("string"))
    return files.where(good).withColumn("text", F.col(content).cast("string")), files.where(~good)

"""Helpers shared by the operators: table access, shared scratch tables, row numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it names none, one of our own, in a local session only:
    executors elsewhere would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-ckpt-"))
    return sc.getCheckpointDir()


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for so many rows: one for each core at least, else in proportion."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def stored(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back.

    Unlike a cached frame it outlives lost executors, and unlike an RDD checkpoint its size is known to the planner. The
    table is deleted when the session ends, or earlier by discard. With tasks, at most so many write it, without a further
    shuffle: for each file in a local folder Hadoop starts three processes from the executor (chmod), each of which is as
    large as the executor for a moment.
    """
    spark = df.sparkSession
    df = df if tasks is None else df.coalesce(tasks)
    path = f"{shared_folder(spark)}/folioscope-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, at = _file(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a stored frame that nothing reads any more; any other frame stays as it is."""
    if path := getattr(df, "_folioscope_path", None):
        system, at = _file(df.sparkSession, path)
        system.delete(at, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))

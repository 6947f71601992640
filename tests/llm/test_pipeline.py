import re

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == cp.COLUMNS, name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids and len(rows) > 0.8 * docs.count()
        docs = out
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", r.text) for r in rows)
    packed = cp.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in rows}


def test_empty(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_without_labels(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    blank = docs.limit(1).withColumn("text", F.lit("12 !!"))
    assert cp.language_id(spark, docs.unionByName(blank), SF).count() == docs.count()


def test_language_is_told_once(spark):
    """The filter on the predicted language runs the model no second time, which doubles the time and the Python workers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = cp.language_id(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

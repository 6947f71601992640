"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import block_neighbours, bpe, html_text, langid, packing, pii, pivot_topk, sharding, simhash, token_counts
from folioscope.llm.common import read_table


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    said = langid.identify(docs.select("doc_id", "text"), model=model)
    return said.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return pivot_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, most=2)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.withColumn("edits", token_counts.sample_edits(F.col("text"), F.col("doc_id")))
    return token_counts.edited_counts(edited, rank_file(), public_tokenizers.PATTERN)


def op10_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return block_neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES = {
    f.__name__: f
    for f in (op1_html_text, op2_sharding, op3_language_id, op4_pivot_topk, op5_best_fit_packing, op6_pii, op7_simhash, op8_byte_bpe, op9_token_counts, op10_block_neighbours)
}
# op10's squares are added up as numpy does for up to 128 components, a multiple of eight: in eight lanes, then the lanes by pairs.
ORACLE: dict[str, str] = {
    "op4_pivot_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_block_neighbours": """
WITH v AS (
  SELECT vec_id, len(embedding) AS dim, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])) AS d
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.dim = c.dim
  WHERE q.vec_id % 100 = 0
), l AS (
  SELECT query_id, vec_id, list_transform(range(1, 9), lambda n: list_reduce(list_slice(d, n, len(d), 8), lambda a, x: a + x)) AS e FROM s
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, sqrt(((e[1] + e[2]) + (e[3] + e[4])) + ((e[5] + e[6]) + (e[7] + e[8]))) AS score FROM l)
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}

"""Views over the driver tables, each defined once for Spark and once as SQL for the oracle.

Spark reads a view as a DataFrame; the oracle reads the same rows from a CTE of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, kind and content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("chapter").alias("kind"), "text")


DOC_FILES_SQL = "doc_files AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, 'chapter' AS kind, text FROM documents)"


def manifest_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a previous run recorded: nine documents in ten, some with another hash, some without a marker."""
    i = F.col("doc_id")
    return doc_files(spark, sf_dir).where(i % 10 != 0).select(
        "path", "kind", F.when(i % 7 == 0, F.sha2(F.concat(F.col("text"), F.lit("~")), 256)).otherwise(F.sha2(F.col("text"), 256)).alias("after_sha256"), (i % 11 != 0).alias("marker")
    )


MANIFEST_SQL = (
    "manifest_prev AS (SELECT path, kind, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '~') ELSE sha256(text) END AS after_sha256, "
    "doc_id % 11 <> 0 AS marker FROM doc_files WHERE doc_id % 10 <> 0)"
)


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that stand on disk now: a thirteenth are gone."""
    return doc_files(spark, sf_dir).where(F.col("doc_id") % 13 != 0).select("path", F.sha2("text", 256).alias("current_sha256"))


CURRENT_SQL = "current_files AS (SELECT path, sha256(text) AS current_sha256 FROM doc_files WHERE doc_id % 13 <> 0)"


def docs_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents after an edit: in every third one digits were rewritten."""
    return table(spark, sf_dir, "documents").select("doc_id", edited().alias("text"))


def edited():
    """The edited text of a document."""
    return F.when(F.col("doc_id") % 3 == 0, F.translate("text", "0123456789", "1234567890")).otherwise(F.col("text"))


CANDIDATE_SQL = "docs_candidate AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, '0123456789', '1234567890') ELSE text END AS text FROM documents)"

# pages.html as Markdown. The steps use no lookaround, so that both engines run them.
_MD = [("<h1>([^<]*)</h1>", "\n# {1}\n"), ('<li><a href="([^"]*)">([^<]*)</a></li>', "- [{2}]({1})\n"), ("</?p>", "\n"), ("<br>", "\n"), ("<[^>]*>", "")]


def pages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("html")
    for pattern, new in _MD:
        text = F.regexp_replace(text, pattern, new.replace("{1}", "$1").replace("{2}", "$2"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", text.alias("text"))


def _pages_md_sql() -> str:
    text = "html"
    for pattern, new in _MD:
        new = new.replace("{1}", "\\1").replace("{2}", "\\2")
        text = f"regexp_replace({text}, '{pattern}', " + " || chr(10) || ".join(f"'{x}'" for x in new.split("\n")) + ", 'g')"
    return f"pages_md AS (SELECT page_id AS doc_id, url, {text} AS text FROM pages)"


PAGES_MD_SQL = _pages_md_sql()


def conv_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: frontmatter, then for each turn a heading with the role, the text (every fourth turn in a
    fence) with an image and its caption behind every other one, a roman page number and the turn's source line."""
    t = F.col("turn")
    body = F.when(t % 4 == 3, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    turn = t.cast("string")
    figure = F.when(t % 2 == 1, F.concat(F.lit("\n![[image-"), turn, F.lit(".png]]\n\nFigure "), turn, F.lit(". A figure"))).otherwise("")
    piece = F.concat(F.lit("\n## "), F.col("role"), F.lit("\n"), body, figure, F.lit("\nix\n\n> Source PDF, p. "), turn, F.lit("\n"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"])
    head = F.concat(F.lit("---\ntitle: Conversation "), F.col("conv_id").cast("string"), F.lit("\n---\n"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pieces.alias("_p")).select(F.col("conv_id").alias("doc_id"), F.concat(head, F.array_join("_p", "")).alias("text"))


_NL = "chr(10)"
CONV_MD_SQL = f"""conv_md AS (
  SELECT conv_id AS doc_id, '---' || {_NL} || 'title: Conversation ' || CAST(conv_id AS VARCHAR) || {_NL} || '---' || {_NL} || string_agg(
    {_NL} || '## ' || role || {_NL} || CASE WHEN turn % 4 = 3 THEN '```' || {_NL} || text || {_NL} || '```' ELSE text END
    || CASE WHEN turn % 2 = 1 THEN {_NL} || '![[image-' || CAST(turn AS VARCHAR) || '.png]]' || {_NL} || {_NL} || 'Figure ' || CAST(turn AS VARCHAR) || '. A figure' ELSE '' END
    || {_NL} || 'ix' || {_NL} || {_NL} || '> Source PDF, p. ' || CAST(turn AS VARCHAR) || {_NL}, '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""


def lines_sql(view: str, name: str = "lines") -> str:
    """The line table of a view, for the oracle."""
    return f"{name} AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {view})"


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as page ranges along one axis, with overlaps: start at 5 * conv_id, as many pages as turns times two."""
    agg = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("conv_id").alias("range_id"), (F.col("conv_id") % 7).alias("part"), (F.col("conv_id") * 5).alias("start_page"), (F.col("conv_id") * 5 + F.col("n") * 2).alias("end_page"))


RANGES_SQL = "page_ranges AS (SELECT conv_id AS range_id, conv_id % 7 AS part, conv_id * 5 AS start_page, conv_id * 5 + count(*) * 2 AS end_page FROM conversations GROUP BY conv_id)"


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages: one from each page to the page of twice its id, whether or not there is one, and some with .md cut."""
    i = F.col("page_id")
    path = lambda n: F.concat(F.lit("p/"), n.cast("string"), F.lit(".md"))
    target = F.when(i % 5 == 0, F.concat(F.lit("p/"), (i * 2).cast("string"))).when(i % 11 == 0, F.concat(F.lit("../"), i.cast("string"))).otherwise(path(i * 2))
    return table(spark, sf_dir, "pages").select(path(i).alias("src"), target.alias("target"))


LINKS_SQL = (
    "link_targets AS (SELECT 'p/' || CAST(page_id AS VARCHAR) || '.md' AS src, CASE WHEN page_id % 5 = 0 THEN 'p/' || CAST(page_id * 2 AS VARCHAR) "
    "WHEN page_id % 11 = 0 THEN '../' || CAST(page_id AS VARCHAR) ELSE 'p/' || CAST(page_id * 2 AS VARCHAR) || '.md' END AS target FROM pages), "
    "page_files AS (SELECT 'p/' || CAST(page_id AS VARCHAR) || '.md' AS path FROM pages)"
)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))


def memory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of a knowledge base, with fields derived from doc_id, some of them wrong."""
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("kb/"), i.cast("string"), F.lit(".md")).alias("path"),
        F.when(i % 17 == 0, "").otherwise(pick(("state", "knowledge", "decision", "log", "memo"), i)).alias("type"),
        F.when(i % 6 == 1, "superseded").otherwise("active").alias("status"),
        F.when(i % 19 == 0, "2024-13-01").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 500).cast("int")), "yyyy-MM-dd")).alias("updated"),
        F.concat(F.lit("t"), (i % 400).cast("string")).alias("topic"),
        F.when(i % 4 == 0, F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), (i % 490).cast("int")), "yyyy-MM-dd")).alias("verified"),
        F.when(i % 8 == 0, F.lit("abcdef1")).when(i % 9 == 0, F.lit("xyz")).alias("verified_rev"),
        F.when(i % 5 == 3, pick(("feature", "bug", "chat"), i)).alias("kind"),
        F.lit(None).cast("string").alias("task_status"),
        F.when(i % 2 == 0, F.array(F.lit("a.md"))).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.lit(None).cast("array<string>").alias("source_logs"),
        F.when(i % 10 == 2, F.concat(F.lit("kb/"), F.floor(i / 2).cast("string"), F.lit(".md"))).alias("supersedes"),
        F.col("source").alias("group"), F.col("text").alias("body"),
    )


MEMORY_SQL = """memory_pages AS (SELECT 'kb/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE (['state', 'knowledge', 'decision', 'log', 'memo'])[CAST(doc_id % 5 + 1 AS INTEGER)] END AS type,
  CASE WHEN doc_id % 6 = 1 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN doc_id % 19 = 0 THEN '2024-13-01' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 500 AS INTEGER), '%Y-%m-%d') END AS updated,
  't' || CAST(doc_id % 400 AS VARCHAR) AS topic,
  CASE WHEN doc_id % 4 = 0 THEN strftime(DATE '2024-01-05' + CAST(doc_id % 490 AS INTEGER), '%Y-%m-%d') END AS verified,
  CASE WHEN doc_id % 8 = 0 THEN 'abcdef1' WHEN doc_id % 9 = 0 THEN 'xyz' END AS verified_rev,
  CASE WHEN doc_id % 5 = 3 THEN (['feature', 'bug', 'chat'])[CAST(doc_id % 3 + 1 AS INTEGER)] END AS kind,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_sources,
  CASE WHEN doc_id % 10 = 2 THEN 'kb/' || CAST(doc_id // 2 AS VARCHAR) || '.md' END AS supersedes,
  source AS "group", text AS body FROM documents)"""

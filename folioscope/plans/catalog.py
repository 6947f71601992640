"""Registered queries and their SQL.

Every query runs over its whole tables; the oracle's SQL computes the same rows with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import scalar as s
from folioscope.functions import unicode as u
from folioscope.operators import anchors as an
from folioscope.operators import drift, integrity, knowledge, layout, links, ranges, repair, report, structure
from folioscope.operators import lines as ln
from folioscope.plans import views as v
from folioscope.sources import changes, frontmatter
from folioscope.sources.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query, with the oracle's SQL if it can be said in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents")


# Fingerprints and drift


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", s.fingerprint(F.col("text")).alias("sha256"))


_OUT = "outputs AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, 'chapter' AS kind, sha256(text) AS desired_sha256 FROM docs_candidate JOIN (SELECT doc_id, source FROM documents) USING (doc_id))"
_CLASSIFIED = """classified AS (SELECT o.path, o.kind, o.desired_sha256, c.current_sha256, c.current_sha256 IS NOT NULL AS file_exists,
  CASE WHEN c.current_sha256 IS NULL THEN 'create' WHEN c.current_sha256 = o.desired_sha256 THEN 'unchanged' ELSE 'update' END AS action,
  CASE WHEN c.current_sha256 IS NOT NULL AND c.current_sha256 <> o.desired_sha256 AND NOT (m.after_sha256 IS NOT DISTINCT FROM c.current_sha256 AND coalesce(m.marker, false))
    THEN 'existing-file-is-manual-or-hash-drifted' END AS conflict
  FROM outputs o LEFT JOIN manifest_prev m ON o.path = m.path LEFT JOIN current_files c ON o.path = c.path)"""
_DRIFT = (v.DOC_FILES_SQL, v.MANIFEST_SQL, v.CURRENT_SQL, v.CANDIDATE_SQL, _OUT, _CLASSIFIED)


@query("SELECT * FROM classified", *_DRIFT)
def drift_classify(spark, sf_dir):
    files = v.doc_files(spark, sf_dir).select("doc_id", "path", "kind")
    desired = v.docs_candidate(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("desired_sha256"))  # hashes, not texts, are joined
    outputs = files.join(desired, "doc_id").select("path", "kind", "desired_sha256")
    return drift.classify_outputs(outputs, v.manifest_prev(spark, sf_dir), v.current_files(spark, sf_dir))


@query("SELECT action, count(*) AS n_files, count(conflict) AS n_conflicts FROM classified GROUP BY action", *_DRIFT)
def drift_counts(spark, sf_dir):
    return drift.count_actions(drift_classify(spark, sf_dir))


@query(
    "SELECT coalesce(m.path, c.path) AS path, CASE WHEN m.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'modified' END AS change "
    "FROM manifest_prev m FULL JOIN current_files c ON m.path = c.path WHERE m.path IS NULL OR c.path IS NULL OR m.after_sha256 <> c.current_sha256",
    v.DOC_FILES_SQL, v.MANIFEST_SQL, v.CURRENT_SQL,
)
def snapshot_diff(spark, sf_dir):
    return drift.snapshot_diff(v.manifest_prev(spark, sf_dir).withColumnRenamed("after_sha256", "state"), v.current_files(spark, sf_dir).withColumnRenamed("current_sha256", "state"))


def _positions(df: DataFrame, sha: str) -> DataFrame:
    return df.select("path", F.col(sha).alias("after_sha256"), F.regexp_extract("path", "/([0-9]+)", 1).cast("long").alias("position"))


@query(
    "SELECT coalesce(p.path, c.path) AS path, coalesce(c.current_sha256, p.after_sha256) AS after_sha256, p.path IS NULL AS is_new, "
    "CAST(regexp_extract(coalesce(p.path, c.path), '/([0-9]+)', 1) AS BIGINT) AS position FROM manifest_prev p FULL JOIN current_files c ON p.path = c.path",
    v.DOC_FILES_SQL, v.MANIFEST_SQL, v.CURRENT_SQL,
)
def manifest_merge(spark, sf_dir):
    return drift.merge_manifest(_positions(v.manifest_prev(spark, sf_dir), "after_sha256"), _positions(v.current_files(spark, sf_dir), "current_sha256"))


@query(
    "SELECT c.path, c.current_sha256 AS sha256, m.after_sha256 FROM current_files c JOIN manifest_prev m ON c.path = m.path WHERE c.current_sha256 <> m.after_sha256",
    v.DOC_FILES_SQL, v.MANIFEST_SQL, v.CURRENT_SQL,
)
def baseline_conflicts(spark, sf_dir):
    return drift.baseline_conflicts(v.current_files(spark, sf_dir).withColumnRenamed("current_sha256", "sha256"), v.manifest_prev(spark, sf_dir))


@query(
    "SELECT path, 'missing-generated-file' AS issue FROM manifest_prev WHERE path NOT IN (SELECT path FROM current_files) UNION ALL "
    "SELECT m.path, 'generated-file-hash-drift' FROM manifest_prev m JOIN current_files c ON m.path = c.path WHERE m.after_sha256 <> c.current_sha256",
    v.DOC_FILES_SQL, v.MANIFEST_SQL, v.CURRENT_SQL,
)
def audit_generated(spark, sf_dir):
    return drift.audit(v.manifest_prev(spark, sf_dir), v.current_files(spark, sf_dir))


@query(
    "SELECT m.path, CASE WHEN m.after_sha256 IS NOT DISTINCT FROM c.current_sha256 THEN CASE WHEN m.marker THEN 'restore' ELSE 'delete' END ELSE 'refuse' END AS action "
    "FROM manifest_prev m LEFT JOIN current_files c ON m.path = c.path",
    v.DOC_FILES_SQL, v.MANIFEST_SQL, v.CURRENT_SQL,
)
def rollback_plan(spark, sf_dir):
    m = v.manifest_prev(spark, sf_dir)
    return drift.rollback_plan(m.where("marker"), m.where("not marker"), v.current_files(spark, sf_dir))


@query("SELECT sha256(text) AS sha256, count(*) AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return drift.exact_duplicates(docs(spark, sf_dir))


# Scalars


def _scalar(name: str, column: Callable, sql: str, view: str = "documents", *ctes: str) -> None:
    def run(spark, sf_dir):
        source = docs(spark, sf_dir) if view == "documents" else v.pages_md(spark, sf_dir)
        return source.select("doc_id", column(F.col("text")).alias("out"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM {view}", *ctes)(run)


_FOLD = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_scalar(
    "normalise_text", s.normalise_text,
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(text, '­﻿�', ''), ' ', ' '), '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')",
)
_scalar("heading_lookup", s.heading_lookup, "lower(trim(regexp_replace(" + _FOLD.format("translate(text, '*_`', '')") + ", '[. ]+$', '')))")
_scalar("match_key", s.match_key, "lower(" + _FOLD.format(r"translate(regexp_replace(text, '!\[\[[^\]]*\]\]', '', 'g'), '*_`﻿­', '')") + ")")
_scalar("safe_component", s.safe_component, "coalesce(nullif(regexp_replace(" + _FOLD.format(r"""regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g')""") + ", '[. ]+$', ''), ''), 'Untitled')")
_scalar("cell_with_breaks", s.cell_with_breaks, r"replace(replace(trim(text), '|', '\|'), chr(10), '<br>')")
_scalar("cell_on_one_line", s.cell_on_one_line, r"trim(replace(regexp_replace(text, '\s+', ' ', 'g'), '|', '\|'))")
_scalar("clean_span_text", s.clean_span_text, "replace(translate(text, '­�', ''), ' ', ' ')")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + doc_id % 3 AS VARCHAR) END AS page_range FROM documents")
def page_range(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", s.page_range(F.col("doc_id"), F.col("doc_id") + F.col("doc_id") % 3).alias("page_range"))


# Lines


@query("SELECT doc_id, line_no, line FROM lines", v.lines_sql("documents"))
def line_explode(spark, sf_dir):
    return ln.explode_lines(docs(spark, sf_dir))


@query("SELECT doc_id, line_no, line FROM lines WHERE trim(line) NOT IN ('Eron.', 'All rights reserved.') AND NOT regexp_matches(trim(line), '^[A-Z][a-z]+\\.$')".replace("\\\\", "\\"), v.lines_sql("documents"))
def line_filter(spark, sf_dir):
    return ln.without_lines(ln.explode_lines(docs(spark, sf_dir)), ["Eron.", "All rights reserved."], [r"^[A-Z][a-z]+\.$"])


_CONV = (v.CONV_MD_SQL, v.lines_sql("conv_md"))


def conv_lines(spark, sf_dir) -> DataFrame:
    return ln.explode_lines(v.conv_md(spark, sf_dir))


@query("SELECT * FROM (SELECT doc_id, line_no, line, starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') AS is_fence, coalesce(sum(CAST(starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM lines)", *_CONV)
def fence_mask(spark, sf_dir):
    return ln.fence_mask(conv_lines(spark, sf_dir))


@query("SELECT doc_id, line_no, line FROM (SELECT *, trim(line) = '' AND coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY line_no), false) AS again FROM lines) WHERE NOT again", v.PAGES_MD_SQL, v.lines_sql("pages_md"))
def blank_collapse(spark, sf_dir):
    return ln.collapse_blank(ln.explode_lines(v.pages_md(spark, sf_dir)))


@query("SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(trim(line), '[^0-9\\s].*\\s[0-9]+$') AND lower(trim(regexp_replace(line, '[0-9]+\\s*$', ''))) = '> source pdf, p.'", *_CONV)
def running_header_lines(spark, sf_dir):
    titles = v.conv_md(spark, sf_dir).select("doc_id", F.lit("> Source PDF, p.").alias("title"))
    return ln.running_headers(conv_lines(spark, sf_dir), titles)


@query(
    "SELECT doc_id, line_no, line FROM (SELECT *, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) "
    "WHERE regexp_matches(trim(line), '^[ivxlcdmIVXLCDM]+$') AND regexp_matches(CASE WHEN trim(l1) <> '' THEN l1 WHEN trim(l2) <> '' THEN l2 WHEN trim(l3) <> '' THEN l3 END, '^>?\\s*\\[?Source PDF, p\\. ?([0-9]+)')",
    *_CONV,
)
def roman_footer_lines(spark, sf_dir):
    return ln.roman_footers(conv_lines(spark, sf_dir))


_SECTIONS = r"""masked AS (SELECT *, starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') AS fence, coalesce(sum(CAST(starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM lines),
heads AS (SELECT *, NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6} ') AS is_heading FROM masked),
sections AS (SELECT doc_id, line_no, line, is_heading, CAST(sum(CAST(is_heading AS INTEGER)) OVER w AS BIGINT) AS section_no, last_value(CASE WHEN is_heading THEN line END IGNORE NULLS) OVER w AS heading FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("SELECT * FROM sections", *_CONV, _SECTIONS)
def section_segments(spark, sf_dir):
    return ln.sections(conv_lines(spark, sf_dir))


@query(
    "SELECT d.doc_id, t.title FROM (SELECT DISTINCT doc_id FROM lines) d CROSS JOIN (SELECT unnest(['user', 'assistant', 'system', 'summary']) AS title) t "
    "WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = d.doc_id AND NOT s.is_heading AND trim(s.line) <> '' AND lower(trim(regexp_replace(s.heading, '^#+ ', ''))) = t.title)",
    *_CONV, _SECTIONS,
)
def section_required(spark, sf_dir):
    return ln.required_sections(conv_lines(spark, sf_dir), v.conv_md(spark, sf_dir).select("doc_id"), ["user", "assistant", "system", "summary"])


_KEY = "lower(trim(regexp_replace(trim(regexp_replace(translate(trim(regexp_replace(line, '^#+ ', '')), '*_`', ''), '\\s+', ' ', 'g')), '[. ]+$', '')))"


@query(f"SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#+) ', 1)) AS INTEGER) AS level, trim(regexp_replace(line, '^#+ ', '')) AS title, {_KEY} AS key FROM sections WHERE is_heading", v.PAGES_MD_SQL, v.lines_sql("pages_md"), _SECTIONS)
def heading_index(spark, sf_dir):
    return ln.headings(ln.explode_lines(v.pages_md(spark, sf_dir)))


@query(f"SELECT {_KEY} AS key, count(*) AS n_headings, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM sections WHERE is_heading GROUP BY 1", *_CONV, _SECTIONS)
def topic_index(spark, sf_dir):
    return ln.headings(conv_lines(spark, sf_dir)).groupBy("key").agg(F.count(F.lit(1)).alias("n_headings"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_DUP_VIEW = "dup_md AS (SELECT doc_id, '# Part ' || CAST(doc_id % 5 AS VARCHAR) || chr(10) || chr(10) || '> Source PDF, p. 3' || chr(10) || '## *Part ' || CAST(doc_id % 3 AS VARCHAR) || '.*' || chr(10) || text AS text FROM documents)"


@query(
    "SELECT doc_id, CAST(3 AS INTEGER) AS line_no, '## *Part ' || CAST(doc_id % 3 AS VARCHAR) || '.*' AS line FROM documents WHERE doc_id % 5 = doc_id % 3", _DUP_VIEW)
def duplicate_leading_heading(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat(F.lit("# Part "), (i % 5).cast("string"), F.lit("\n\n> Source PDF, p. 3\n## *Part "), (i % 3).cast("string"), F.lit(".*\n"), F.col("text"))
    return ln.duplicate_leading_headings(ln.explode_lines(docs(spark, sf_dir).select("doc_id", text.alias("text"))))


@query(
    "SELECT doc_id, line_no, line FROM (SELECT *, lag(trim(line)) OVER w AS before, lead(line) OVER w AS after, lag(line) OVER w AS b FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) "
    "WHERE trim(line) = '' AND regexp_matches(b, '^[ \\t]*[0-9]+[.)] ') AND regexp_matches(after, '^[ \\t]*[0-9]+[.)] ') AND length(regexp_extract(b, '^([ \\t]*)', 1)) = length(regexp_extract(after, '^([ \\t]*)', 1))",
    "list_md AS (SELECT doc_id, regexp_replace(text, '\\n', chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '1. ' ELSE ' 2) ' END, 'g') AS text FROM documents)", v.lines_sql("list_md"),
)
def ordered_spacing(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n1. ")).otherwise(F.lit("\n\n 2) "))
    return ln.ordered_spacing(ln.explode_lines(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), mark).alias("text"))))


@query(
    "SELECT doc_id, line_no, line FROM (SELECT *, lag(line) OVER w AS b, lead(line) OVER w AS a FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE trim(line) = '' AND starts_with(b, '- ') AND starts_with(a, '- ')",
    "list_md AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10) || '- ') AS text FROM documents)", v.lines_sql("list_md"),
)
def unordered_spacing(spark, sf_dir):
    return ln.unordered_spacing(ln.explode_lines(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n- ")).alias("text"))))


@query("SELECT doc_id, CAST(2 AS INTEGER) AS line_no, '> Source PDF, p. 4' AS line FROM documents")
def source_ref_dedup(spark, sf_dir):
    text = F.concat_ws("\n", F.lit("> [Source PDF, p. 4](a.pdf)"), F.lit("## Part"), F.lit("> Source PDF, p. 4"), "text")
    return ln.source_reference_repeats(ln.plain_source_references(ln.explode_lines(docs(spark, sf_dir).select("doc_id", text.alias("text")))))


@query(
    "SELECT doc_id, CAST(first_line AS INTEGER) AS first_line, n_rows, '| Term | Description |' || chr(10) || '| --- | --- |' || chr(10) || rows AS table_md FROM ("
    "SELECT doc_id, min(line_no) AS first_line, count(*) AS n_rows, string_agg('| **' || trim(regexp_extract(line, '^- \\*\\*([^*]+)\\*\\*: (.*)$', 1)) || '** | ' || replace(trim(regexp_extract(line, '^- \\*\\*([^*]+)\\*\\*: (.*)$', 2)), '|', '\\|') || ' |', chr(10) ORDER BY line_no) AS rows FROM ("
    "SELECT *, sum(CAST(NOT regexp_matches(line, '^- \\*\\*([^*]+)\\*\\*: (.*)$') AND trim(line) <> '' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM lines) "
    "WHERE regexp_matches(line, '^- \\*\\*([^*]+)\\*\\*: (.*)$') GROUP BY doc_id, run HAVING count(*) >= 2)",
    "def_md AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '\\*', '', 'g'), '\\n(\\w+) ', chr(10) || '- **\\1**: ', 'g') END AS text FROM documents)", v.lines_sql("def_md"),
)
def definition_tables(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.regexp_replace(F.replace("text", F.lit("*"), F.lit("")), r"\n(\w+) ", "\n- **$1**: "))
    return ln.definition_tables(ln.explode_lines(docs(spark, sf_dir).select("doc_id", text.alias("text"))))


@query(
    "SELECT doc_id, CAST(line_no AS INTEGER) AS first_line, 'note' AS callout_type, ltrim(substr(line, 6)) AS body, CAST(1 AS BIGINT) AS n_lines FROM lines WHERE starts_with(line, 'Note: ')",
    "note_md AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10) || 'Note: ') AS text FROM documents)", v.lines_sql("note_md"),
)
def callouts(spark, sf_dir):
    return ln.callouts(ln.explode_lines(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\nNote: ")).alias("text"))))


# Ranges


@query("SELECT turn * 40 + conv_id AS page, min(range_id) AS range_id FROM conversations c JOIN page_ranges r ON c.turn * 40 + c.conv_id BETWEEN start_page AND end_page WHERE TRUE GROUP BY 1 HAVING count(DISTINCT range_id) = 1", v.RANGES_SQL)
def range_owner(spark, sf_dir):
    points = v.table(spark, sf_dir, "conversations").select((F.col("turn") * 40 + F.col("conv_id")).alias("page"))
    return ranges.unique_owner(points, "page", v.page_ranges(spark, sf_dir), "range_id", "start_page", "end_page")


@query(
    "SELECT DISTINCT p.page, coalesce((SELECT CAST(arg_min(part, range_id) AS VARCHAR) FROM page_ranges r WHERE p.page BETWEEN start_page AND end_page), 'none') AS part FROM (SELECT DISTINCT turn * 40 + conv_id AS page FROM conversations) p",
    v.RANGES_SQL,
)
def part_assignment(spark, sf_dir):
    points = v.table(spark, sf_dir, "conversations").select((F.col("turn") * 40 + F.col("conv_id")).alias("page")).distinct()
    parts = v.page_ranges(spark, sf_dir).withColumn("part", F.col("part").cast("string"))
    return ranges.first_range(points, "page", parts, "range_id", "start_page", "end_page", "part", "none")


@query("SELECT a.range_id, count(b.range_id) AS n_overlaps FROM page_ranges a LEFT JOIN page_ranges b ON a.range_id <> b.range_id AND a.start_page <= b.end_page AND b.start_page <= a.end_page GROUP BY a.range_id", v.RANGES_SQL)
def overlap_count(spark, sf_dir):
    r = v.page_ranges(spark, sf_dir)
    return ranges.overlap_counts(r, "range_id", r, "start_page", "end_page")


@query(
    "SELECT part, min(start_page) AS start_page, max(end_page) AS end_page, count(*) AS n_merged FROM (SELECT *, sum(fresh) OVER (PARTITION BY part ORDER BY start_page, end_page) AS run FROM ("
    "SELECT *, CASE WHEN start_page <= max(end_page) OVER (PARTITION BY part ORDER BY start_page, end_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 22 THEN 0 ELSE 1 END AS fresh FROM page_ranges)) GROUP BY part, run",
    v.RANGES_SQL,
)
def interval_merge(spark, sf_dir):
    return ranges.merge_intervals(v.page_ranges(spark, sf_dir), "part", "start_page", "end_page", 22)


_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"


@query(
    f"SELECT p_brand, min(c) AS low, max(c) AS high, CAST(sum(c) AS DOUBLE) / count(*) AS centre, count(*) AS n_positions FROM (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY c ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT p_brand, {_CENTS} AS c, CASE WHEN {_CENTS} - lag({_CENTS}) OVER (PARTITION BY p_brand ORDER BY {_CENTS}) <= 150 THEN 0 ELSE 1 END AS fresh FROM part)) GROUP BY p_brand, run"
)
def cluster_positions(spark, sf_dir):
    part = v.table(spark, sf_dir, "part").select("p_brand", F.round(F.col("p_retailprice") * 100).cast("long").alias("c"))
    return ranges.cluster_positions(part, "p_brand", "c", 150)


@query(
    "SELECT doc_id, line_no, next_no AS caption_no FROM (SELECT *, first_value(CASE WHEN trim(line) <> '' THEN line_no END IGNORE NULLS) OVER w AS next_no, first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER w AS next_line FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) "
    "WHERE starts_with(line, '![[') AND starts_with(next_line, 'Figure ')",
    *_CONV,
)
def asof_caption(spark, sf_dir):
    return ranges.caption_after(conv_lines(spark, sf_dir), F.col("line").startswith("![["), F.col("line").startswith("Figure "))


@query(
    "SELECT doc_id, line_no, page, marker_no FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM (SELECT *, rank() OVER (PARTITION BY doc_id, line_no ORDER BY CASE WHEN d > 0 THEN 1 ELSE 0 END, abs(d)) AS r FROM ("
    "SELECT a.doc_id, a.line_no, a.page, m.line_no AS marker_no, m.line_no - a.line_no AS d FROM (SELECT doc_id, line_no, CAST(regexp_extract(line, 'image-([0-9]+)', 1) AS INTEGER) AS page FROM lines WHERE starts_with(line, '![[')) a "
    "JOIN (SELECT doc_id, line_no, CAST(regexp_extract(line, 'p\\. ([0-9]+)', 1) AS INTEGER) AS page FROM lines WHERE starts_with(line, '> Source')) m ON a.doc_id = m.doc_id AND a.page = m.page) WHERE d >= -8 AND d < 7 AND d <> 0) WHERE r = 1) WHERE n = 1",
    *_CONV,
)
def nearest_marker(spark, sf_dir):
    lines = conv_lines(spark, sf_dir)
    anchors = lines.where(F.col("line").startswith("![[")).select("doc_id", "line_no", F.regexp_extract("line", "image-([0-9]+)", 1).cast("int").alias("page"))
    markers = lines.where(F.col("line").startswith("> Source")).select("doc_id", F.col("line_no").alias("marker_no"), s.source_page(F.col("line")).alias("page"))
    return ranges.nearest_marker(anchors, markers)


_GRID = "line_points AS (SELECT doc_id AS grid, line_no AS point, length(line) AS x, line_no AS y FROM lines)"


@query(
    "SELECT grid, point, CAST(c.row AS BIGINT) AS row, CAST(c.col AS BIGINT) AS col FROM (SELECT p.grid, p.point, min({'row': r.i, 'col': k.i}) AS c FROM line_points p JOIN range(0, 4) r(i) ON p.y >= r.i * 10 - 1.5 AND p.y < r.i * 10 + 10 + 1.5 JOIN range(0, 4) k(i) ON p.x >= k.i * 100 - 1.5 AND p.x < k.i * 100 + 100 + 1.5 GROUP BY p.grid, p.point)",
    v.lines_sql("documents"), _GRID,
)
def grid_place(spark, sf_dir):
    points = ln.explode_lines(docs(spark, sf_dir)).select(F.col("doc_id").alias("grid"), F.col("line_no").alias("point"), F.length("line").alias("x"), F.col("line_no").alias("y"))
    grids = points.select("grid").distinct()
    rows = grids.select("grid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("row")).withColumn("y0", F.col("row") * 10).withColumn("y1", F.col("row") * 10 + 10)
    columns = grids.select("grid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("col")).withColumn("x0", F.col("col") * 100).withColumn("x1", F.col("col") * 100 + 100)
    return ranges.place_in_grid(points, rows, columns)


@query(
    "SELECT doc_id, title, start_page, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page) - 1, last_page) AS end_page FROM ("
    "SELECT doc_id, line_no // 8 AS start_page, arg_min(line, line_no) AS title, max(last_page) AS last_page FROM (SELECT *, max(line_no // 8) OVER (PARTITION BY doc_id) AS last_page FROM lines) WHERE starts_with(line, '## ') GROUP BY doc_id, line_no // 8)",
    *_CONV,
)
def outline_ranges(spark, sf_dir):
    page = F.floor(F.col("line_no") / 8)
    lines = conv_lines(spark, sf_dir).withColumn("page", page).withColumn("last_page", F.max(page).over(Window.partitionBy("doc_id")))
    outline = lines.where(F.col("line").startswith("## ")).select("doc_id", "page", F.col("line").alias("title"), F.col("line_no").alias("ord"), "last_page")
    return ranges.chapter_ranges(outline, "doc_id", "page", "title", "last_page")


@query(
    "SELECT doc_id, string_agg(t, ';' ORDER BY y, priority, t) AS merged FROM (SELECT doc_id, line_no * 10 AS y, 1 AS priority, line AS t FROM lines UNION ALL SELECT doc_id, n_chars % 97 AS y, 0 AS priority, '[table]' AS t FROM documents) GROUP BY doc_id",
    v.lines_sql("documents"),
)
def ordered_merge(spark, sf_dir):
    d = docs(spark, sf_dir)
    text = ln.explode_lines(d).select("doc_id", (F.col("line_no") * 10).cast("long").alias("y"), F.lit(1).alias("priority"), F.col("line").alias("t"))
    events = d.select("doc_id", (F.col("n_chars") % 97).alias("y"), F.lit(0).alias("priority"), F.lit("[table]").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "priority", "t")))
    return text.unionByName(events).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ";").alias("merged"))


# Anchors and fidelity


@query()
def anchor_tokens(spark, sf_dir):
    return an.anchors(v.conv_md(spark, sf_dir)).unionByName(an.anchors(docs(spark, sf_dir)))


def _plain_anchors(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.lit("numbers").alias("category"), F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("ord", "value"))


_NUMS = "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS value, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) - 1 AS ord FROM "


@query(
    "SELECT doc_id, 'numbers' AS category, CAST(ord AS INTEGER) AS ord, source_value, candidate_value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM ("
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.ord, b.ord) AS ord, a.value AS source_value, b.value AS candidate_value FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.ord = b.ord WHERE a.value IS DISTINCT FROM b.value)) WHERE r = 1",
    v.CANDIDATE_SQL, f"a AS ({_NUMS} documents)", f"b AS ({_NUMS} docs_candidate)",
)
def fidelity_first_diff(spark, sf_dir):
    return an.first_differences(_plain_anchors(docs(spark, sf_dir)), _plain_anchors(v.docs_candidate(spark, sf_dir)))


@query()
def fidelity_full(spark, sf_dir):
    return an.row_differences(docs(spark, sf_dir).select("doc_id", "text", v.edited().alias("after")), "text", "after")


# Links


@query("SELECT doc_id, 'markdown' AS kind, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ord, unnest(t) AS target FROM (SELECT doc_id, regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^()\\s]*)\\)', 1) AS t FROM pages_md)", v.PAGES_MD_SQL)
def link_extract(spark, sf_dir):
    return links.extract(v.pages_md(spark, sf_dir))


_RESOLVED = """resolved AS (SELECT src, target, CASE WHEN starts_with(target, '../') THEN NULL WHEN target IN (SELECT path FROM page_files) THEN target WHEN target || '.md' IN (SELECT path FROM page_files) THEN target || '.md' END AS path,
  CASE WHEN starts_with(target, '../') THEN 'escaping' WHEN target IN (SELECT path FROM page_files) OR target || '.md' IN (SELECT path FROM page_files) THEN NULL ELSE 'missing' END AS reason FROM link_targets)"""


@query("SELECT * FROM resolved", v.LINKS_SQL, _RESOLVED)
def link_resolve(spark, sf_dir):
    return links.resolve(v.link_targets(spark, sf_dir), v.page_files(spark, sf_dir))


@query("SELECT reason, count(*) AS n_links FROM resolved WHERE reason IS NOT NULL GROUP BY reason", v.LINKS_SQL, _RESOLVED)
def broken_links(spark, sf_dir):
    return link_resolve(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n_links"))


@query(
    "SELECT node, CAST(min(steps) AS INTEGER) AS steps FROM reach GROUP BY node", v.LINKS_SQL, _RESOLVED,
    "reach AS (SELECT 'p/1.md' AS node, 0 AS steps UNION SELECT r.path, steps + 1 FROM reach JOIN resolved r ON reach.node = r.src WHERE r.path IS NOT NULL AND steps < 100)",
)
def reachability(spark, sf_dir):
    edges = link_resolve(spark, sf_dir).where("path is not null").select("src", F.col("path").alias("dst"))
    starts = spark.createDataFrame([("p/1.md",)], "node string")
    return links.reachable(edges, starts, stored)


@query(
    "SELECT DISTINCT start AS node FROM walk WHERE steps > 0 AND node = start",
    "succ AS (SELECT page_id AS src, CASE WHEN page_id % 10 < 4 THEN page_id // 10 * 10 + (page_id + 1) % 4 ELSE page_id - 1 END AS dst FROM pages)",
    "walk AS (SELECT src AS start, src AS node, 0 AS steps FROM succ UNION SELECT start, dst, steps + 1 FROM walk JOIN succ ON walk.node = succ.src WHERE steps < 12)",
)
def supersession_cycles(spark, sf_dir):
    i = F.col("page_id")
    succ = F.when(i % 10 < 4, F.floor(i / 10) * 10 + (i + 1) % 4).otherwise(i - 1)
    return links.cycles(v.table(spark, sf_dir, "pages").select(i.alias("src"), succ.alias("dst")), stored)


_FILES = "page_paths AS (SELECT page_id AS page, regexp_extract(url, '//([^?#]*)', 1) AS source FROM pages)"


@query(
    "SELECT page, count(DISTINCT change) AS n_changes FROM page_paths JOIN (SELECT change, array_to_string(string_split(change, '/')[1:k], '/') AS source FROM (SELECT change, unnest(range(1, len(string_split(change, '/')) + 1)) AS k FROM "
    "(SELECT DISTINCT source AS change FROM page_paths WHERE page % 3 = 0))) USING (source) GROUP BY page",
    _FILES,
)
def impact_pages(spark, sf_dir):
    paths = v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("url", "//([^?#]*)", 1).alias("source"))
    changes = paths.where("page % 3 = 0").select(F.col("source").alias("path"), F.lit(None).cast("string").alias("previous_path"))
    return links.impact(changes, paths)


@query(
    "SELECT destination, n_sources, occupied FROM (SELECT m.destination, count(*) AS n_sources, bool_or(f.path IS NOT NULL) AND NOT bool_or(m.source = m.destination) AS occupied FROM moves m LEFT JOIN (SELECT DISTINCT path FROM doc_files) f ON m.destination = f.path GROUP BY m.destination) WHERE n_sources > 1 OR occupied",
    v.DOC_FILES_SQL, "moves AS (SELECT path AS source, string_split(path, '/')[1] || '/' || CAST(doc_id // 2 AS VARCHAR) || '.md' AS destination FROM doc_files)",
)
def migration_collisions(spark, sf_dir):
    files = v.doc_files(spark, sf_dir)
    moves = files.select(F.col("path").alias("source"), F.concat(F.split("path", "/")[0], F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".md")).alias("destination"))
    return links.collisions(moves, files.select("path"))


# Integrity and reports

TODAY = "2025-03-01"
_T = f"DATE '{TODAY}'"
_DATED = "dated AS (SELECT *, try_cast(updated AS DATE) AS u, try_cast(verified AS DATE) AS ver FROM memory_pages)"
_RULES = " UNION ".join(
    f"SELECT '{severity}' AS severity, '{name}' AS rule, path FROM dated WHERE {when}"
    for severity, name, when in [
        ("error", "missing-type", "type = ''"),
        ("error", "bad-type", "type = 'memo'"),
        ("error", "bad-date", "u IS NULL"),
        ("warning", "updated-in-future", f"u > {_T}"),
        ("error", "verified-after-updated", f"ver > u OR ver > {_T}"),
        ("warning", "stale", f"status = 'active' AND type IN ('state', 'knowledge') AND {_T} - coalesce(ver, u) > 90"),
        ("error", "bad-verified-rev", "verified_rev IS NOT NULL AND (ver IS NULL OR verified_rev = 'xyz')"),
        ("error", "bad-log-kind", "type = 'log' AND kind = 'chat'"),
        ("warning", "no-evidence", "status = 'active' AND type IN ('state', 'knowledge', 'decision') AND n_sources = 0"),
    ]
)
_MORE = (
    " UNION SELECT 'error', 'several-active', path FROM (SELECT path, count(*) OVER (PARTITION BY type, topic) AS n FROM dated WHERE status = 'active' AND type IN ('state', 'knowledge', 'decision')) WHERE n > 1"
    " UNION SELECT 'error', CASE WHEN o.path IS NULL THEN 'supersedes-missing' WHEN o.type <> p.type THEN 'supersedes-other-type' WHEN o.status <> 'superseded' AND p.status = 'active' AND p.type <> 'log' THEN 'superseded-not-marked' END AS rule, p.path"
    " FROM dated p LEFT JOIN dated o ON p.supersedes = o.path WHERE p.supersedes IS NOT NULL AND (o.path IS NULL OR o.type <> p.type OR (o.status <> 'superseded' AND p.status = 'active' AND p.type <> 'log'))"
)


@query(_RULES + _MORE, v.MEMORY_SQL, _DATED)
def integrity_findings(spark, sf_dir):
    return integrity.inspect(v.memory_pages(spark, sf_dir), F.lit(TODAY).cast("date"))


_KB_LINKS = """kb_links AS (SELECT src, target, CASE WHEN target IN (SELECT path FROM memory_pages) THEN target WHEN target || '.md' IN (SELECT path FROM memory_pages) THEN target || '.md' END AS path FROM (
  SELECT 'kb/' || CAST(doc_id AS VARCHAR) || '.md' AS src, unnest(['kb/' || CAST(doc_id * 2 AS VARCHAR) || '.md', CASE WHEN doc_id % 3 = 0 THEN 'kb/' || CAST(doc_id * 2 + 1 AS VARCHAR) ELSE 'kb/' || CAST(doc_id AS VARCHAR) || '.md' END]) AS target FROM documents))"""
_REACHED = "reached AS (WITH RECURSIVE r(node) AS (SELECT 'kb/1.md' UNION SELECT l.path FROM r JOIN kb_links l ON l.src = r.node WHERE l.path IS NOT NULL) SELECT node FROM r)"
_FULL = (
    " UNION SELECT CASE WHEN past AND NOT ends_with(target, '.md') THEN 'warning' ELSE 'error' END, CASE WHEN past AND NOT ends_with(target, '.md') THEN 'historical-source-gone' ELSE 'missing-link' END, src FROM (SELECT l.*, p.type = 'log' OR p.status IN ('archived', 'superseded', 'deprecated') AS past FROM kb_links l JOIN memory_pages p ON p.path = l.src WHERE l.path IS NULL)"
    " UNION SELECT 'error', 'duplicate-number', path FROM (SELECT path, count(*) OVER (PARTITION BY CAST(n AS BIGINT)) AS k FROM (SELECT path, regexp_extract(path, 'kb/0*([0-9]{1,2})', 1) AS n FROM memory_pages WHERE type = 'decision') WHERE n <> '') WHERE k > 1"
    " UNION SELECT 'error', 'missing-from-log-map', path FROM memory_pages WHERE type = 'log' AND path NOT IN (SELECT path FROM kb_links WHERE src = 'kb/2.md' AND path IS NOT NULL)"
    " UNION SELECT 'error', 'missing-from-category-map', path FROM memory_pages WHERE (type = 'decision' AND path NOT IN (SELECT path FROM kb_links WHERE src = 'kb/3.md' AND path IS NOT NULL)) OR (type = 'knowledge' AND path NOT IN (SELECT path FROM kb_links WHERE src = 'kb/4.md' AND path IS NOT NULL))"
    " UNION SELECT 'warning', 'unreachable', path FROM memory_pages WHERE type IN ('state', 'decision', 'knowledge', 'log') AND path NOT IN (SELECT node FROM reached)"
    " UNION SELECT 'error', 'navigation-no-active-map', path FROM memory_pages WHERE path IN ('kb/1.md', 'kb/2.md', 'kb/3.md', 'kb/4.md')"
    " UNION SELECT 'error', CASE WHEN p.type = 'state' THEN 'required-state-not-current' ELSE 'required-state-missing' END, r.path FROM (SELECT unnest(['kb/5.md', 'kb/6.md', 'kb/25.md', 'kb/none.md']) AS path) r LEFT JOIN memory_pages p ON p.path = r.path WHERE p.type IS DISTINCT FROM 'state' OR p.status <> 'active'"
)


@query(_RULES + _MORE + _FULL, v.MEMORY_SQL, _DATED, _KB_LINKS, _REACHED)
def integrity_report(spark, sf_dir):
    pages, i = v.memory_pages(spark, sf_dir), F.col("doc_id")
    path = lambda n: F.concat(F.lit("kb/"), n.cast("string"), F.lit(".md"))
    targets = F.array(path(i * 2), F.when(i % 3 == 0, F.concat(F.lit("kb/"), (i * 2 + 1).cast("string"))).otherwise(path(i)))
    found = links.resolve(docs(spark, sf_dir).select(path(i).alias("src"), F.explode(targets).alias("target")), pages.select("path"))
    maps = {"decision": "kb/3.md", "knowledge": "kb/4.md"}
    return integrity.full_report(pages, found, F.lit(TODAY).cast("date"), "kb/1.md", "kb/2.md", maps, ["kb/5.md", "kb/6.md", "kb/25.md", "kb/none.md"], r"kb/0*([0-9]{1,2})", stored)


@query("SELECT type, topic, count(*) AS n_active FROM memory_pages WHERE status = 'active' GROUP BY type, topic HAVING count(*) > 1", v.MEMORY_SQL)
def unique_active(spark, sf_dir):
    return integrity.duplicate_active(v.memory_pages(spark, sf_dir))


@query('SELECT "group", count(*) AS n_pages, CAST(sum(length(body)) AS BIGINT) AS n_chars, count(*) FILTER (length(body) > 6000) AS n_over, sum(length(body)) > 16000 AS over_total FROM memory_pages GROUP BY "group"', v.MEMORY_SQL)
def read_budget(spark, sf_dir):
    return integrity.budget(v.memory_pages(spark, sf_dir))


@query("SELECT source, lang, count(*) AS n_docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM documents GROUP BY source, lang")
def catalog_index(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(ids, ",").alias("doc_ids"))


@query(
    "SELECT conv_id AS \"case\", CAST(sum(r) AS BIGINT) AS n_reads, count(*) FILTER (r > 0) AS n_files, count(*) FILTER (r > 1) AS n_repeated, CAST(sum(w) AS BIGINT) AS n_writes, CASE WHEN sum(u) = 0 THEN CAST(coalesce(sum(c), 0) AS BIGINT) END AS characters FROM ("
    "SELECT conv_id, turn // 2 AS f, count(*) FILTER (role <> 'system') AS r, count(*) FILTER (role = 'system') AS w, sum(length(text)) FILTER (role <> 'system') AS c, count(*) FILTER (role <> 'system' AND turn = 7) AS u FROM conversations GROUP BY conv_id, turn // 2) GROUP BY conv_id"
)
def trace_metrics(spark, sf_dir):
    calls = v.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case"), F.when(F.col("role") == "system", "write").otherwise("read").alias("operation"), F.floor(F.col("turn") / 2).cast("string").alias("path"),
        F.when(F.col("turn") != 7, F.length("text")).alias("characters"),
    )
    return integrity.trace_metrics(calls)


@query("SELECT source, lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_totals(spark, sf_dir):
    return docs(spark, sf_dir).rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# Repair


def _markdown(spark, sf_dir) -> DataFrame:
    """Conversations and pages as one Markdown corpus."""
    return v.conv_md(spark, sf_dir).unionByName(v.pages_md(spark, sf_dir).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))


@query()
def repair_corpus(spark, sf_dir):
    return repair.repair(_markdown(spark, sf_dir)).drop("changes")


@query()
def repair_totals(spark, sf_dir):
    return repair.totals(repair.repair(_markdown(spark, sf_dir)))


# Sources and configuration


@query("SELECT conv_id AS doc_id, 'title' AS key, 'string' AS kind, 'Conversation ' || CAST(conv_id AS VARCHAR) AS value FROM conversations GROUP BY conv_id")
def frontmatter_fields(spark, sf_dir):
    return frontmatter.fields(v.conv_md(spark, sf_dir)).select("doc_id", "key", "kind", "value")


@query("SELECT conv_id AS doc_id, length('---' || 'title: Conversation ' || CAST(conv_id AS VARCHAR) || '---') + 3 AS n_front FROM conversations GROUP BY conv_id")
def frontmatter_split(spark, sf_dir):
    return frontmatter.split(v.conv_md(spark, sf_dir)).select("doc_id", F.length("frontmatter").alias("n_front"))


@query(
    """SELECT CASE WHEN k = 11 THEN 'untracked' ELSE 'commit' END AS scope, (['added', 'modified', 'deleted', 'renamed', 'copied', 'type_changed', 'unmerged', 'unknown', 'broken_pair', NULL, NULL, 'untracked'])[CAST(k + 1 AS INTEGER)] AS change,
  CASE WHEN k IN (3, 4) THEN 'new/' ELSE 'old/' END || CAST(doc_id AS VARCHAR) AS path, CASE WHEN k IN (3, 4) THEN 'old/' || CAST(doc_id AS VARCHAR) END AS previous_path, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT doc_id, doc_id % 12 AS k FROM documents) WHERE k NOT IN (9, 10)
  UNION ALL SELECT DISTINCT 'commit', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CASE WHEN doc_id % 12 = 10 THEN 'unterminated_git_path_list' WHEN doc_id % 24 = 9 THEN 'truncated_git_change_record' ELSE 'unsupported_git_change_record' END FROM documents WHERE doc_id % 12 IN (9, 10)"""
)
def change_records(spark, sf_dir):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 12
    old, new = F.concat(F.lit("old/"), i), F.concat(F.lit("new/"), i)
    code = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R100", "C75", "T", "U", "X", "B"))), (F.least(k, F.lit(8)) + 1).cast("int"))
    raw = (
        F.when(k == 11, F.concat(old, F.lit("\0"))).when(k == 10, F.concat_ws("\0", F.lit("M"), old)).when(F.col("doc_id") % 24 == 9, F.concat_ws("\0", F.lit("R100"), old, F.lit("")))
        .when(k == 9, F.concat_ws("\0", F.lit("Q7"), old, F.lit(""))).when(k.isin(3, 4), F.concat_ws("\0", code, old, new, F.lit(""))).otherwise(F.concat_ws("\0", code, old, F.lit("")))
    )
    rows = docs(spark, sf_dir).select(F.when(k == 11, "untracked").otherwise("commit").alias("scope"), raw.alias("raw"))
    return changes.changes(rows).withColumn("error", F.lit(None).cast("string")).unionByName(changes.change_errors(rows), allowMissingColumns=True)


# Layout: documents as pages, a line each in a block of its own


def page_dicts(spark, sf_dir) -> DataFrame:
    rows = ln.explode_lines(docs(spark, sf_dir))
    n = F.col("line_no")
    y, size = 70.0 + 14.0 * (n % 50), F.when(n % 10 == 0, 18.0).when(n % 10 == 5, 14.0).otherwise(10.0)
    box = F.array(F.lit(50.0), y, 50.0 + 5.0 * F.length("line"), y + size)
    span = F.struct(F.col("line").alias("text"), box.alias("bbox"), size.alias("size"), F.when(n % 7 == 3, "Mono").otherwise("Serif").alias("font"), F.when(n % 4 == 1, 16).otherwise(0).alias("flags"))
    block = F.struct(box.alias("bbox"), F.array(F.struct(box.alias("bbox"), F.array(span).alias("spans"))).alias("lines"))
    pages = rows.groupBy(F.col("doc_id").alias("doc"), F.floor(n / 50).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return pages.select("doc", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), "blocks")


@query(
    "SELECT doc_id AS doc, line_no // 50 AS page, count(*) AS n_lines, CAST(sum(length(trim(line))) AS BIGINT) AS n_chars FROM lines WHERE trim(line) <> '' GROUP BY 1, 2",
    v.lines_sql("documents"),
)
def page_lines(spark, sf_dir):
    return layout.line_boxes(page_dicts(spark, sf_dir)).groupBy("doc", F.col("page").cast("long").alias("page")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "SELECT doc_id AS doc, CAST(n // 50 AS INTEGER) AS page, CAST(n % 50 AS INTEGER) AS block_no, 50.0::DOUBLE AS x0, y AS y0, 50.0::DOUBLE + 5 * length(line) AS x1, y + size AS y1, size, "
    "CASE WHEN n % 7 = 3 AND length(t) >= 60 THEN 'code' WHEN size >= 12 AND length(t) <= 140 AND NOT regexp_matches(t, '[.!?:;,]$') THEN 'heading' WHEN regexp_matches(t, '^([-*+●•▪‣◦]|[0-9]+[.)])(\\s|$)') THEN 'list' ELSE 'text' END AS kind, "
    "CASE WHEN n % 7 = 3 AND length(t) >= 60 THEN NULL WHEN size >= 12 AND length(t) <= 140 AND NOT regexp_matches(t, '[.!?:;,]$') THEN CASE WHEN size < 17 THEN 2 ELSE 3 END END AS level, t AS text FROM "
    "(SELECT doc_id, line, line_no AS n, trim(line) AS t, 70.0::DOUBLE + 14 * (line_no % 50) AS y, CASE WHEN line_no % 10 = 0 THEN 18.0::DOUBLE WHEN line_no % 10 = 5 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM lines) WHERE t <> ''",
    v.lines_sql("documents"),
)
def page_entries(spark, sf_dir):
    return layout.entries(page_dicts(spark, sf_dir))


@query()
def page_text(spark, sf_dir):
    pages = page_dicts(spark, sf_dir)
    rows = layout.without_page_numbers(layout.entries(pages), pages)
    events = pages.select("doc", "page", F.lit(300.0).alias("y0"), F.lit(50.0).alias("x0"), F.lit(0).alias("priority"), F.lit("![[image]]").alias("markdown"))
    return layout.rendered(rows, events)


@query(
    "SELECT doc_id AS doc, CAST(count(DISTINCT line_no // 50) AS BIGINT) AS n_pages, CAST(sum(length(trim(line))) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id",
    v.lines_sql("documents"),
)
def page_probe(spark, sf_dir):
    return layout.probe(page_dicts(spark, sf_dir)).select("doc", "n_pages", "n_chars")


# Reports


@query(
    "SELECT \"group\", string_agg(CASE WHEN status = 'active' THEN '- ' ELSE '- (old) ' END || path, chr(10) ORDER BY status <> 'active', path) AS catalog FROM memory_pages GROUP BY \"group\"",
    v.MEMORY_SQL,
)
def catalog_pages(spark, sf_dir):
    return report.catalog(v.memory_pages(spark, sf_dir))


@query()
def casefold_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", u.casefold(u.nfkc(F.col("text"))).alias("key"))


@query(
    "SELECT doc_id, unnest(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^()\\s]*)\\)', 1)) AS target FROM pages_md",
    v.PAGES_MD_SQL,
)
def nested_link_targets(spark, sf_dir):
    return v.pages_md(spark, sf_dir).select("doc_id", F.explode(u.link_targets(F.col("text"))).alias("target"))


@query()
def unified_diffs(spark, sf_dir):
    changed = docs(spark, sf_dir).select("doc_id", "text", v.edited().alias("after")).where("text <> after")
    return changed.select("doc_id", u.unified_diff(F.col("text"), F.col("after")).alias("d")).select("doc_id", "d.diff", "d.n_lines")


@query(
    "SELECT k.key AS title_key, CAST(count(h.doc_id) AS BIGINT) AS n_headings, CASE WHEN count(h.doc_id) = 1 THEN 'linked' WHEN count(h.doc_id) = 0 THEN 'missing' ELSE 'ambiguous' END AS outcome FROM (SELECT unnest(['user', 'system', 'none']) AS key) k "
    "LEFT JOIN (SELECT doc_id, lower(trim(regexp_replace(line, '^#+ ', ''))) AS key FROM sections WHERE is_heading) h ON h.key = k.key GROUP BY k.key",
    *_CONV, _SECTIONS,
)
def toc_matches(spark, sf_dir):
    wanted = spark.createDataFrame([("user",), ("system",), ("none",)], "title string")
    return report.toc_matches(wanted, ln.headings(conv_lines(spark, sf_dir)))


@query(
    "SELECT role AS lens, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS n_lines FROM (SELECT doc_id, section_no, lower(trim(regexp_replace(max(heading), '^#+ ', ''))) AS role, count(*) FILTER (NOT is_heading) AS n FROM sections WHERE section_no > 0 GROUP BY doc_id, section_no) WHERE role IN ('user', 'system') GROUP BY role",
    *_CONV, _SECTIONS,
)
def lens_sections(spark, sf_dir):
    return report.lens(conv_lines(spark, sf_dir), r"(?i)^#+ (user|system)\s*$").groupBy("lens").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_lines").alias("n_lines"))


# Knowledge base


@query("SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM masked WHERE NOT fence AND NOT inside GROUP BY doc_id", *_CONV, _SECTIONS)
def prose_without_code(spark, sf_dir):
    return knowledge.without_code(v.conv_md(spark, sf_dir))


_REVISIONS = "revisions AS (SELECT * FROM (VALUES ('abcdef1', 'c1'), ('main', 'c1'), ('0123abc', 'c2')) AS t(name, commit))"


@query(
    "SELECT path, CASE WHEN m.verified_rev IS NULL THEN 'missing' WHEN NOT regexp_matches(m.verified_rev, '^[0-9a-fA-F]{7,64}$') THEN 'invalid' WHEN r.commit IS NULL THEN 'unresolved' WHEN r.commit = 'c1' THEN 'matches_base' ELSE 'differs_from_base' END AS baseline FROM memory_pages m LEFT JOIN revisions r ON m.verified_rev = r.name",
    v.MEMORY_SQL, _REVISIONS,
)
def page_baselines(spark, sf_dir):
    revisions = spark.createDataFrame([("abcdef1", "c1"), ("main", "c1"), ("0123abc", "c2")], "name string, commit string")
    return knowledge.baselines(v.memory_pages(spark, sf_dir), revisions, "main")


@query(
    "SELECT path, CAST(n_sources AS BIGINT) AS n_changes, CASE WHEN n_sources = 1 THEN 'affected' ELSE 'unassessable' END AS assessment, CASE WHEN verified_rev IS NULL THEN 'missing' WHEN verified_rev = 'xyz' THEN 'invalid' ELSE 'matches_base' END AS baseline FROM memory_pages",
    v.MEMORY_SQL,
)
def page_impact(spark, sf_dir):
    revisions = spark.createDataFrame([("abcdef1", "c1"), ("main", "c1"), ("0123abc", "c2")], "name string, commit string")
    changed = spark.createDataFrame([("a.md", None), ("b.md", "old.md")], "path string, previous_path string")
    return knowledge.impact_report(changed, v.memory_pages(spark, sf_dir), revisions, "main")


@query("SELECT path, CASE WHEN kind IS NULL THEN 'log-without-kind' ELSE 'log-in-other-folder' END AS issue FROM memory_pages WHERE type = 'log' AND (kind IS NULL OR kind IN ('feature', 'bug'))", v.MEMORY_SQL)
def log_layout(spark, sf_dir):
    return knowledge.log_layout(v.memory_pages(spark, sf_dir), {"feature": "logs/feature", "bug": "logs/bug"})


@query(
    "SELECT CAST(range_id AS VARCHAR) AS section_id, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page, CASE WHEN start_page < 1 OR end_page < start_page THEN 'bad-range' WHEN end_page > 400 THEN 'beyond-last-page' END AS error FROM page_ranges",
    v.RANGES_SQL,
)
def checked_sections(spark, sf_dir):
    rows = v.page_ranges(spark, sf_dir).select(F.col("range_id").cast("string").alias("section_id"), F.col("start_page").cast("string"), F.col("end_page").cast("string"))
    return knowledge.checked_sections(rows, F.lit(400))


@query(
    "SELECT m.path, m.type FROM memory_pages m WHERE m.type <> 'moc' AND m.path NOT IN (SELECT 'kb/' || CAST(doc_id * 2 AS VARCHAR) || '.md' FROM documents WHERE doc_id % 5 = 4)",
    v.MEMORY_SQL,
)
def uncovered_pages(spark, sf_dir):
    pages = v.memory_pages(spark, sf_dir)
    i = F.col("doc_id")
    maps = docs(spark, sf_dir).where(i % 5 == 4).select(F.concat(F.lit("maps/"), i.cast("string")).alias("src"), F.concat(F.lit("kb/"), (i * 2).cast("string"), F.lit(".md")).alias("path"))
    both = pages.select("path", "type").unionByName(maps.select(F.col("src").alias("path"), F.lit("moc").alias("type")))
    return knowledge.uncovered(both, maps)


@query()
def contents_text(spark, sf_dir):
    heads = ln.headings(conv_lines(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("path"), "title")
    entries = heads.distinct().withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("title"))).select(F.col("path").alias("doc"), "ord", F.lit("Part").alias("part"), F.lit("Turns").alias("chapter"), "title", "path")
    return knowledge.toc_text(entries, heads)


@query(
    "SELECT doc_id, line_no, image, caption, TRY_CAST(page AS INTEGER) AS page FROM (SELECT *, regexp_extract(src, 'p\\. ([0-9]+)', 1) AS page FROM (SELECT doc_id, line_no, line AS image, "
    "first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS caption, "
    "last_value(CASE WHEN starts_with(line, '> Source') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS src FROM lines)) WHERE starts_with(image, '![[') AND starts_with(caption, 'Figure ')",
    *_CONV,
)
def figure_pairs(spark, sf_dir):
    return structure.figure_pairs(conv_lines(spark, sf_dir)).select("doc_id", "line_no", "image", "caption", "page")

"""A knowledge base of pages in a project: visible prose, coverage, baselines, impact, layout and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scalar as s
from folioscope.operators import lines as ln
from folioscope.operators import links


def without_code(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text without fenced code, comments (to the end of the text if unclosed) and inline code."""
    open_ = ln.matched_fences(ln.explode_lines(docs, doc_id, text)).where("not is_fence and not in_fence")
    prose = ln.join_lines(open_.select("doc_id", "line_no", "line"))
    return prose.select("doc_id", s.chain(F.col("text"), (r"(?s)<!--.*?(?:-->|\z)", ""), (r"(`+)(?!`)(?s:.+?)(?<!`)\1(?!`)", "")).alias("text"))


def hook_status(docs: DataFrame, begin: str, end: str, legacy: str) -> DataFrame:
    """doc_id and status of instruction texts: managed (both markers once, in order), legacy (an old clause), invalid, missing."""
    text = F.coalesce("text", F.lit(""))
    count = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    b, e = count(begin), count(end)
    managed = (b == 1) & (e == 1) & (F.instr(text, begin) < F.instr(text, end))
    return docs.select("doc_id", F.when(managed, "managed").when((b > 0) | (e > 0), "invalid").when(text.rlike(legacy), "legacy").otherwise("missing").alias("status"))


def baselines(pages: DataFrame, revisions: DataFrame, base: str) -> DataFrame:
    """path and baseline of pages(path, verified_rev) against revisions(name, commit): missing, invalid, unresolved,
    matches_base or differs_from_base."""
    base_commit = revisions.where(F.col("name") == base).select(F.first("commit").alias("_base"))
    joined = pages.join(revisions.select(F.col("name").alias("verified_rev"), F.col("commit").alias("_own")), "verified_rev", "left").crossJoin(F.broadcast(base_commit))  # one row
    state = (
        F.when(F.col("verified_rev").isNull(), "missing").when(~s.is_revision(F.col("verified_rev")), "invalid").when(F.col("_own").isNull(), "unresolved")
        .when(F.col("_own") == F.col("_base"), "matches_base").otherwise("differs_from_base")
    )
    return joined.select("path", state.alias("baseline"))


def impact_report(changes: DataFrame, pages: DataFrame, revisions: DataFrame, base: str) -> DataFrame:
    """path, n_changes and baseline of active pages that changes touch, and pages that cannot be assessed (no sources).

    pages: path, status, verified_rev, sources. Archived pages are left out."""
    active = pages.where("status <> 'archived'")
    touched = links.impact(changes.dropDuplicates(["path", "previous_path"]), active.select(F.col("path").alias("page"), F.explode("sources").alias("source")))
    blind = active.where(F.size(F.coalesce("sources", F.array().cast("array<string>"))) == 0).select(F.col("path").alias("page"))
    rows = touched.select("page", "n_changes", F.lit("affected").alias("assessment")).unionByName(blind.select("page", F.lit(0).cast("long").alias("n_changes"), F.lit("unassessable").alias("assessment")))
    return rows.join(baselines(active, revisions, base).withColumnRenamed("path", "page"), "page").withColumnRenamed("page", "path")


def uncovered(pages: DataFrame, link_rows: DataFrame) -> DataFrame:
    """Pages that no map of contents links to. pages: path, type; link_rows: src, path."""
    maps = pages.where("type = 'moc'").select(F.col("path").alias("src"))
    covered = link_rows.join(maps, "src").select("path").distinct()
    return pages.where("type <> 'moc'").join(covered, "path", "left_anti").select("path", "type")


def log_layout(pages: DataFrame, folders: dict[str, str]) -> DataFrame:
    """path and issue of logs in a folder that is not their kind's, or without a kind. folders: kind to folder."""
    known = F.create_map(*(F.lit(x) for kv in folders.items() for x in kv))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    issue = F.when(F.col("kind").isNull(), "log-without-kind").when(F.try_element_at(known, F.col("kind")) != folder, "log-in-other-folder")
    return pages.where("type = 'log'").select("path", issue.alias("issue")).where("issue is not null")


def checked_sections(rows: DataFrame, n_pages: Column) -> DataFrame:
    """Section rows (section_id, start_page, end_page) with an error where 1 <= start <= end <= pages does not hold."""
    start, end = F.col("start_page").try_cast("int"), F.coalesce(F.col("end_page"), F.col("start_page")).try_cast("int")
    error = F.when(start.isNull() | end.isNull(), "not-a-page").when((start < 1) | (end < start), "bad-range").when(end > n_pages, "beyond-last-page")
    return rows.select("section_id", start.alias("start_page"), end.alias("end_page"), error.alias("error"))


def provenance(rows: DataFrame, generator: str, tags: list[str]) -> DataFrame:
    """Frontmatter records of generated files: rows(book, kind, title, source_path, source_hash, start_page, end_page, extra
    map<string,string>). Extra fields never override."""
    own = F.create_map(
        F.lit("book"), F.col("book"), F.lit("kind"), F.col("kind"), F.lit("title"), F.col("title"), F.lit("source"), F.col("source_path"), F.lit("source_hash"), F.col("source_hash"),
        F.lit("source_pages"), F.concat(F.lit("["), F.col("start_page").cast("string"), F.lit(", "), F.col("end_page").cast("string"), F.lit("]")), F.lit("generator"), F.lit(generator),
    )
    extra = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    every = s.merge_tags(F.array(*map(F.lit, tags)), F.array("kind"))
    return rows.withColumn("fields", F.map_concat(own, extra)).withColumn("tags", every)


def toc_text(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """doc and Markdown of its table of contents: entries(doc, ord, part, chapter, title, path) as links where exactly one heading
    of headings(path, title) in the chapter's file says the same and both are free of damaged characters, else as text."""
    heads = headings.select("path", s.heading_lookup(F.col("title")).alias("key"), F.col("title").alias("_head"))
    found = heads.groupBy("path", "key").agg(F.count(F.lit(1)).alias("_n"), F.first("_head").alias("_head"))
    rows = entries.withColumn("key", s.heading_lookup(F.col("title"))).join(found, ["path", "key"], "left")
    sure = (F.col("_n") == 1) & s.is_reliable(F.col("title"), F.col("_head"))
    line = F.when(F.coalesce(sure, F.lit(False)), F.concat(F.lit("- "), s.note_link(F.concat("path", F.lit("#"), "_head"), F.col("title")))).otherwise(F.concat(F.lit("- "), F.col("title")))
    w = Window.partitionBy("doc").orderBy("ord")
    new = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.col(c).isNotNull())
    head = F.concat(F.when(new("part"), F.concat(F.lit("## "), F.col("part"), F.lit("\n"))).otherwise(""), F.when(new("chapter"), F.concat(F.lit("### "), F.col("chapter"), F.lit("\n"))).otherwise(""))
    text = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("_line").alias("l")))), lambda x: x["l"])
    return rows.withColumn("_line", F.concat(head, line)).groupBy("doc").agg(F.array_join(text, "\n").alias("text"))


def fragments_joined(lines: DataFrame, icons: DataFrame, slack: float = 2.0) -> DataFrame:
    """Line fragments of a page joined where an inline image fills the gap between them: lines(doc, page, x0, y0, x1, y1, text),
    icons(doc, page, x0, y0, x1, y1, embed). Fragments of a row are islands; the image's embed stands in the gap."""
    page = ["doc", "page"]
    down = Window.partitionBy(*page).orderBy("y0")
    rows = lines.withColumn("_row", F.sum(F.coalesce(F.col("y0") - F.lag("y0").over(down) > 1, F.lit(True)).cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*page, "_row").orderBy("x0")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_left", F.lag("x1").over(w))
    gaps = rows.where("_left is not null").select(*page, "_row", "_n", F.col("_left").alias("g0"), F.col("x0").alias("g1"), F.col("y0").alias("t"), F.col("y1").alias("b"))
    fits = (F.col("x0") >= F.col("g0") - slack) & (F.col("x1") <= F.col("g1") + slack) & (F.col("y0") < F.col("b")) & (F.col("y1") > F.col("t"))
    filled = gaps.join(icons, page).where(fits).groupBy(*page, "_row", "_n").agg(F.min_by("embed", "x0").alias("_embed"))
    marked = rows.join(filled, [*page, "_row", "_n"], "left").withColumn("_run", F.sum(F.col("_embed").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.concat(F.when(F.col("_embed").isNotNull(), F.concat(F.col("_embed"), F.lit(" "))).otherwise(""), F.trim("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", part.alias("p")))), lambda x: x["p"]), " ")
    return marked.groupBy(*page, "_row", "_run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text")).drop("_row", "_run")

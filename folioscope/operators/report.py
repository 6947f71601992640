"""Catalogs, maps of contents, topic indexes and tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scalar as s
from folioscope.operators import lines as ln


def catalog(pages: DataFrame) -> DataFrame:
    """group and its catalog: active pages first, then the others, by path."""
    order = F.array_sort(F.collect_list(F.struct((F.col("status") != "active").alias("old"), "path")))
    lines = F.transform(order, lambda x: F.concat(F.when(x["old"], "- (old) ").otherwise("- "), x["path"]))
    return pages.groupBy("group").agg(F.array_join(lines, "\n").alias("catalog"))


def contents_map(chapters: DataFrame) -> DataFrame:
    """One Markdown map for each book from chapters(book, ord, part, path, title): parts in order of their first chapter."""
    w = Window.partitionBy("book", "part")
    rows = chapters.withColumn("_first", F.min("ord").over(w))
    line = F.concat(F.lit("- "), s.note_link(F.col("path"), F.col("title")))
    part = rows.groupBy("book", "part", "_first").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]).alias("_lines"))
    head = F.when(F.coalesce("part", F.lit("")) != "", F.concat(F.lit("## "), F.col("part"), F.lit("\n\n"))).otherwise("")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("_first", F.concat(head, F.array_join("_lines", "\n")).alias("b")))), lambda x: x["b"])
    return part.groupBy("book").agg(F.array_join(blocks, "\n\n").alias("contents"))


def topics(headings: DataFrame) -> DataFrame:
    """Topics of headings(path, title, level): levels 2 to 4, each once for its lower-case title and path, in that order."""
    rows = headings.where("level between 2 and 4").withColumn("key", F.lower("title")).dropDuplicates(["key", "path"])
    return rows.select("key", "title", "path").orderBy("key", "path")


def toc_matches(wanted: DataFrame, headings: DataFrame) -> DataFrame:
    """title_key, n_headings and outcome of wanted titles: linked if one heading has the title, else missing or ambiguous."""
    keys = wanted.select(s.heading_lookup(F.col("title")).alias("title_key"))
    found = headings.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    joined = keys.join(found, F.col("title_key") == F.col("key"), "left").withColumn("n_headings", F.coalesce("_n", F.lit(0)))
    return joined.select("title_key", "n_headings", F.when(F.col("n_headings") == 1, "linked").when(F.col("n_headings") == 0, "missing").otherwise("ambiguous").alias("outcome"))


def lens(lines: DataFrame, pattern: str) -> DataFrame:
    """Sections whose heading matches: doc_id, section_no, lens (the pattern's first group, lower case), text and n_lines."""
    rows = ln.sections(lines).where(F.col("heading").rlike(pattern) & ~F.col("is_heading"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id", "section_no", F.lower(F.regexp_extract("heading", pattern, 1)).alias("lens")).agg(F.array_join(body, "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def todo_counts(lines: DataFrame, titles: list[str]) -> DataFrame:
    """doc_id and its open to-do items in the named sections."""
    rows = ln.sections(lines).where(F.lower(F.trim(F.regexp_replace("heading", "^#+ ", ""))).isin(*titles))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"^\s*[-*+] \[ \] ")).alias("n_open"))


def toc_outline(words: DataFrame, right: float = 100.0, alone: float = 150.0) -> DataFrame:
    """Lines of a table of contents from words(doc, page, block_no, line_no, word_no, x0, text): title and print page.

    A page number is a last word of one to three digits in the right column: 100 points right of the line's first word, or
    from 150 points on if it stands alone. Blocks keep the order in which they come."""
    first = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "x0", "text"))), lambda x: F.struct(x["x0"].alias("x0"), x["text"].alias("text")))
    lines = words.groupBy("doc", "page", "block_no", "line_no").agg(first.alias("w"))
    last, n = F.element_at("w", -1), F.size("w")
    marked = last["text"].rlike("^[0-9]{1,3}$") & F.when(n == 1, last["x0"] >= alone).otherwise(last["x0"] >= F.col("w")[0]["x0"] + right)
    title = F.array_join(F.transform(F.when(marked, F.slice("w", 1, n - 1)).otherwise(F.col("w")), lambda x: x["text"]), " ")
    kind = F.when(title.rlike(r"(?i)^part\s+[0-9ivxlc]+"), "part").when(title.rlike(r"(?i)^(chapter\s+)?[0-9]{1,2}[.:]?\s+\S"), "chapter").when(title.rlike(r"(?i)^(index|other books|appendix|afterword|glossary)\b"), "back").otherwise("section")
    return lines.select("doc", "page", "block_no", "line_no", s.clean_pdf_text(title).alias("title"), F.when(marked, last["text"].cast("int")).alias("print_page"), kind.alias("kind"))


def toc_tree(outline: DataFrame) -> DataFrame:
    """Sections under their chapters, chapters under their parts: the last chapter and part above each line."""
    w = Window.partitionBy("doc").orderBy("page", "block_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    above = lambda k: F.last(F.when(F.col("kind") == k, F.col("title")), ignorenulls=True).over(w)
    return outline.withColumn("part", above("part")).withColumn("chapter", F.when(F.col("kind").isin("chapter", "section"), above("chapter")))

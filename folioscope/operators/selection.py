"""Selection by number or name, reasons and styles of lines, images of pages, and measures that a person must take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scalar as s
from folioscope.operators import lines as ln
from folioscope.sources.settings import chosen, option

# Why a blank line between two items of a list stays, and the form of a figure's caption.
INNER_AMBIGUOUS = "ambiguous paragraph/list boundary inside the item"
INNER_BLANK = "the item contains an internal paragraph or block separator"
STRUCTURED = "the item contains structured Markdown content"
NESTED = {False: "the item contains a nested unordered list", True: "the item contains a nested ordered list"}
AMBIGUOUS = "ambiguous paragraph/list boundary"
CAPTION = r"^(\s*)(?:>\s*)?(Figure\s+\d+(?:\.\d+)?\s*[–-]\s*.+?)\s*$"


def selection_key(value: Column) -> Column:
    """Numbers without leading zeros; other names in lower case."""
    return F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "^0+(?=[0-9])", "")).otherwise(F.lower(value))


def selected(rows: DataFrame, by: str, selection: str | None) -> DataFrame:
    """The rows whose number or name the selection lists, or all without one. ValueError names what no row has."""
    parts = chosen(selection)
    if parts is None:
        return rows
    asked = rows.sparkSession.createDataFrame([(x,) for x in parts], "_asked string").withColumn("_key", selection_key(F.col("_asked")))
    missing = asked.join(rows.select(selection_key(F.col(by)).alias("_key")).distinct(), "_key", "left_anti").collect()  # as many as parts at most
    if missing:
        raise ValueError(f"not found: {', '.join(sorted(r['_asked'] for r in missing))}")
    return rows.withColumn("_key", selection_key(F.col(by))).join(F.broadcast(asked.select("_key").distinct()), "_key", "left_semi").drop("_key")


def separator_reason(body: Column, base: Column) -> Column:
    """Why the blank line after an item of indent base must stay, by the lines of the item below its first; null if it need
    not. Blank lines inside the item come first, then the first line that has a reason."""
    blank = lambda x: F.trim(x) == ""
    indent = lambda x: s.indentation(x)

    def reason(x: Column) -> Column:
        text = F.trim(x)
        marked = text.rlike(r"^(?:```|~~~|!\[|>|\|)")
        nested = lambda ordered: ln._item(x, ordered).isNotNull() & (indent(x) > base)
        return F.when(blank(x), F.lit(None)).when(marked, STRUCTURED).when(nested(False), NESTED[False]).when(nested(True), NESTED[True]).when(indent(x) <= base, AMBIGUOUS)

    inner = F.when(F.exists(body, lambda x: ~blank(x) & (indent(x) <= base)), INNER_AMBIGUOUS).otherwise(INNER_BLANK)
    first = F.get(F.filter(F.transform(body, reason), lambda r: r.isNotNull()), F.lit(0))
    return F.when(F.exists(body, blank), inner).otherwise(first)


def caption_styled(line: Column, style: str = "blockquote") -> Column:
    """A figure's caption as a quoted or a plain line; any other line as it is."""
    mark = "> " if option("figure_caption_style", style) == "blockquote" else ""
    return F.when(line.rlike(CAPTION), F.regexp_replace(line, CAPTION, f"$1{mark}$2")).otherwise(line)


def caption_with_source(caption: Column, page: Column, url: Column) -> Column:
    """A caption with a link to its source, unless it has one."""
    link = F.concat(F.lit(" ([Source PDF, p. "), page.cast("string"), F.lit("]("), url, F.lit("))"))
    return F.when(F.contains(caption, F.lit("[Source PDF, p.")), caption).otherwise(F.concat(F.rtrim(caption), link))


def page_images(placed: DataFrame) -> DataFrame:
    """One row for each image of a page: page, xref, file_name, x0, y0, x1, y1 (the union of its boxes), placement, bytes, sha256.

    placed: page, xref, ext, data, page_height, and a box x0, y0, x1, y1 for each place, or nulls where none is known; such an
    image goes below the page. Images without data are left out.
    """
    some = placed.where(F.col("data").isNotNull() & (F.length("data") > 0))
    one = some.groupBy("page", "xref").agg(
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.max("page_height").alias("_h"), F.min("ext").alias("_ext"), F.min(F.length("data")).cast("long").alias("bytes"), F.min(F.sha2("data", 256)).alias("sha256"),
    )
    lost = F.col("x0").isNull()
    below = F.coalesce("_h", F.lit(0.0)) + 1.0
    name = F.concat(F.format_string("Figure-p%04d-%d.", F.col("page").cast("long"), F.col("xref").cast("long")), F.coalesce("_ext", F.lit("bin")))
    return one.select(
        "page", "xref", name.alias("file_name"), F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", below).alias("y0"), F.coalesce("x1", F.lit(0.0)).alias("x1"), F.coalesce("y1", below).alias("y1"),
        F.when(lost, "fallback-page-end").otherwise("pdf-coordinate").alias("placement"), "bytes", "sha256",
    )


def manual_metrics(cases: DataFrame) -> DataFrame:
    """case, metric, status and denominator of what a person must judge.

    cases: case, has_evidence, n_facts, n_conflicts, n_criteria, n_pages_read and n_memory_calls (null if not known)."""
    counted = {"required_facts_recovered": "n_facts", "conflicts_identified": "n_conflicts", "next_step_criteria_met": "n_criteria"}
    given = {"unrelated_pages_read": "n_pages_read", "unnecessary_memory_calls": "n_memory_calls"}
    seen = F.when(F.col("has_evidence"), "requires_manual_review").otherwise("not_run")
    row = lambda name, status, n: F.struct(F.lit(name).alias("metric"), status.alias("status"), n.cast("long").alias("denominator"))
    rows = [row(m, F.when(F.coalesce(F.col(c), F.lit(0)) == 0, "not_applicable").otherwise(seen), F.when(F.col(c) != 0, F.col(c))) for m, c in counted.items()]
    rows += [row(m, seen, F.col(c)) for m, c in given.items()]
    rows += [row(m, seen, F.lit(None)) for m in ("false_current_claims", "authorization_and_injection_behavior")]
    return cases.select("case", F.explode(F.array(*rows)).alias("m")).select("case", "m.metric", "m.status", "m.denominator")

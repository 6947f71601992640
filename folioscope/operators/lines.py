"""The line table and operators over neighbouring lines.

lines(doc_id, line_no, line) is made once; every operator uses windows over one partitioning and order (doc_id, line_no), so
that a chain of them shares one exchange and sort. Order matters within a document, never across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folioscope.functions import scalar as s

def w() -> WindowSpec:
    """The one partitioning and order that all windows share."""
    return Window.partitionBy("doc_id").orderBy("line_no")


def before() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, 0)


def after() -> WindowSpec:
    return w().rowsBetween(1, Window.unboundedFollowing)


def explode_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line. A line end at the end of a text begins an empty line."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def join_lines(lines: DataFrame) -> DataFrame:
    """doc_id and text; the inverse of explode_lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def is_fence(line: Column, rule: str) -> Column:
    """Whether a line is a fence. Rules: backticks, both (backticks or tildes), long (three or more of either, bare or with a
    word behind)."""
    t = F.trim(line)
    return {"backticks": t.startswith("```"), "both": t.startswith("```") | t.startswith("~~~"), "long": t.rlike(r"^(`{3,}|~{3,})[^`]*$")}[rule]


def fence_mask(lines: DataFrame, rule: str = "both") -> DataFrame:
    """is_fence and in_fence by toggling: a line is inside if an odd number of fences stand before it."""
    return lines.withColumn("is_fence", is_fence(F.col("line"), rule)).withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before()), F.lit(0)) % 2 == 1)


def matched_fences(lines: DataFrame) -> DataFrame:
    """in_fence by opening and closing marks: a fence is closed by the same character, at least as long, with nothing after
    it; what else looks like a fence inside is content. A fold over the document's fence lines."""
    t = F.trim("line")
    marked = lines.withColumn("_mark", F.nullif(F.regexp_extract(t, r"^(`{3,}|~{3,})", 1), F.lit(""))).withColumn("_bare", t.rlike(r"^(`{3,}|~{3,})$"))
    fences = marked.where("_mark is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "_mark", "_bare"))).alias("f"))
    first = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<line_no:int,opens:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["open"] == ""
        closes = ~opens & x["_bare"] & (F.left(x["_mark"], F.lit(1)) == F.left(acc["open"], F.lit(1))) & (F.length(x["_mark"]) >= F.length(acc["open"]))
        row = F.array(F.struct(x["line_no"].alias("line_no"), opens.alias("opens")))
        return F.struct(F.when(opens, x["_mark"]).when(closes, "").otherwise(acc["open"]).alias("open"), F.when(opens | closes, F.concat(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    toggles = fences.select("doc_id", F.explode(F.aggregate("f", first, step, lambda acc: acc["out"])).alias("x")).select("doc_id", F.col("x.line_no").alias("line_no"), F.lit(True).alias("is_fence"))
    joined = lines.join(toggles, ["doc_id", "line_no"], "left").withColumn("is_fence", F.coalesce("is_fence", F.lit(False)))
    return joined.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before()), F.lit(0)) % 2 == 1)


def without_lines(lines: DataFrame, equal: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Drop lines that, trimmed, equal one of a set or match one of the patterns."""
    t = F.trim("line")
    bad = F.lit(False)
    if equal:
        bad = bad | t.isin(*equal)
    for p in patterns:
        bad = bad | t.rlike(p)
    return lines.where(~bad)


def collapse_blank(lines: DataFrame) -> DataFrame:
    """Of a run of blank lines outside of backtick fences the first stays."""
    masked = fence_mask(lines, "backticks").withColumn("_blank", (F.trim("line") == "") & ~F.col("in_fence"))
    again = F.col("_blank") & F.coalesce(F.lag("_blank").over(w()), F.lit(False))
    return masked.withColumn("_drop", again).where("not _drop").select("doc_id", "line_no", "line")


def running_headers(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines that repeat the document's title with a page number, to be dropped. titles: doc_id, title."""
    plain = F.lower(F.trim(F.regexp_replace("line", r"[0-9]+\s*$", "")))
    joined = lines.join(titles, "doc_id").where(F.trim("line").rlike(r"[^0-9\s].*\s[0-9]+$"))
    return joined.where(plain == F.lower(F.trim("title"))).select("doc_id", "line_no", "line")


def roman_footers(lines: DataFrame, ahead: int = 3) -> DataFrame:
    """Lines of roman letters alone whose next line with text, at most three lines on, names a source page."""
    nearest = F.coalesce(*(F.when(F.trim(F.lead("line", d).over(w())) != "", F.lead("line", d).over(w())) for d in range(1, ahead + 1)))
    found = lines.withColumn("_next", nearest)
    return found.where(F.trim("line").rlike("^(?i)[ivxlcdm]+$") & F.col("_next").rlike(s.SOURCE_LINE)).select("doc_id", "line_no", "line")


def _item(line: Column, ordered: bool) -> Column:
    return F.nullif(F.regexp_extract(line, r"^([ \t]*)[0-9]+[.)] " if ordered else r"^([ \t]*)[-*+] ", 0), F.lit(""))


def ordered_spacing(lines: DataFrame) -> DataFrame:
    """Single blank lines between two ordered items of one indent, to be dropped."""
    indent = F.when(_item(F.col("line"), True).isNotNull(), F.length(F.regexp_extract("line", r"^([ \t]*)", 1)))
    rows = lines.withColumn("_i", indent)
    both = F.lag("_i").over(w()) == F.lead("_i").over(w())
    return rows.withColumn("_drop", (F.trim("line") == "") & both).where("_drop").select("doc_id", "line_no", "line")


def unordered_spacing(lines: DataFrame) -> DataFrame:
    """Blank lines between an unordered item and the next one of the same indent, to be dropped, when all lines between them
    are blank or plain continuations of the item (deeper than it, no item, heading, fence, quote or table)."""
    indent = F.when(_item(F.col("line"), False).isNotNull(), s.indentation(F.col("line")))
    blank = F.trim("line") == ""
    body = ~blank & indent.isNull()
    structural = body & (F.trim("line").rlike(r"^(#{1,6} |```|~~~|>|\||[0-9]+[.)] )") | (s.indentation(F.col("line")) == 0))
    rows = lines.withColumn("_i", indent).withColumn("_bad", structural).withColumn("_blank", blank)
    rows = rows.withColumn("_item", F.sum(F.col("_i").isNotNull().cast("int")).over(so_far()))
    of = Window.partitionBy("doc_id", "_item")
    rows = rows.withColumn("_own", F.max("_i").over(of)).withColumn("_spoiled", F.max("_bad").over(of))
    rows = rows.withColumn("_next", F.first("_i", ignorenulls=True).over(after()))
    after_text = F.coalesce(F.max(F.when(~F.col("_blank"), F.col("line_no"))).over(of), F.lit(-1))
    rows = rows.withColumn("_tail", F.col("line_no") > after_text)
    keep = F.col("_blank") & F.col("_tail") & (F.col("_item") > 0) & (F.col("_own") == F.col("_next")) & ~F.col("_spoiled")
    return rows.withColumn("_drop", keep).where("_drop").select("doc_id", "line_no", "line")


def sections(lines: DataFrame) -> DataFrame:
    """lines with the heading line above them (section_no 0 and a null heading before the first) outside of fences."""
    masked = fence_mask(lines)
    head = ~F.col("in_fence") & ~F.col("is_fence") & F.col("line").rlike("^#{1,6} ")
    rows = masked.withColumn("is_heading", head).withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(so_far()))
    return rows.withColumn("heading", F.last(F.when(F.col("is_heading"), F.col("line")), ignorenulls=True).over(so_far())).select("doc_id", "line_no", "line", "is_heading", "section_no", "heading")


def required_sections(lines: DataFrame, wanted: DataFrame, titles: list[str]) -> DataFrame:
    """doc_id and title for each wanted document's required section that is missing or has no text."""
    there = sections(lines).where(~F.col("is_heading") & (F.trim("line") != "")).select("doc_id", F.lower(F.trim(F.regexp_replace("heading", "^#+ ", ""))).alias("title")).distinct()
    need = wanted.select("doc_id", F.explode(F.array(*map(F.lit, titles))).alias("title"))
    return need.join(there, ["doc_id", "title"], "left_anti")


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title and key of headings."""
    head = sections(lines).where("is_heading")
    return head.select("doc_id", "line_no", F.length(F.regexp_extract("line", "^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title")).withColumn("key", s.heading_lookup(F.col("title")))


def duplicate_leading_headings(lines: DataFrame, within: int = 16) -> DataFrame:
    """Second headings within the first lines that say the same as the one before with nothing but blanks and source lines
    between, to be dropped."""
    rows = lines.where(F.col("line_no") < within).withColumn("_head", F.col("line").rlike("^#{1,6} "))
    rows = rows.withColumn("_text", ~F.col("_head") & (F.trim("line") != "") & ~F.col("line").rlike(s.SOURCE_LINE))
    key = s.heading_lookup(F.regexp_replace("line", "^#+ ", ""))
    rows = rows.withColumn("_key", F.when(F.col("_head"), key)).withColumn("_texts", F.sum(F.col("_text").cast("int")).over(so_far()))
    at = Window.partitionBy("doc_id").orderBy("line_no")
    heads = rows.where("_head").withColumn("_n", F.row_number().over(at)).withColumn("_before", F.lag("_key").over(at)).withColumn("_quiet", F.lag("_texts").over(at) == F.col("_texts"))
    return heads.where("_n = 2 and _before = _key and _quiet").select("doc_id", "line_no", "line")


def source_reference_repeats(lines: DataFrame) -> DataFrame:
    """Source lines whose page is that of the source line before with headings (one at least) and blanks between, to be
    dropped. Chains compare with the source line right before, dropped or not, which names the same page."""
    rows = lines.withColumn("_page", s.source_page(F.col("line"))).withColumn("_head", F.col("line").rlike("^#{1,6} "))
    rows = rows.withColumn("_other", F.col("_page").isNull() & ~F.col("_head") & (F.trim("line") != ""))
    rows = rows.withColumn("_heads", F.sum(F.col("_head").cast("int")).over(so_far())).withColumn("_others", F.sum(F.col("_other").cast("int")).over(so_far()))
    at = Window.partitionBy("doc_id").orderBy("line_no")
    refs = rows.where("_page is not null")
    refs = refs.withColumn("_same", (F.lag("_page").over(at) == F.col("_page")) & (F.lag("_others").over(at) == F.col("_others")) & (F.lag("_heads").over(at) < F.col("_heads")))
    return refs.where("_same").select("doc_id", "line_no", "line")


def plain_source_references(lines: DataFrame) -> DataFrame:
    """Linked source lines become plain ones."""
    return lines.withColumn("line", F.regexp_replace("line", r"^(>\s*)\[(Source PDF, p\. ?[0-9]+)\]\([^)]*\)", "$1$2"))


def definition_tables(lines: DataFrame, least: int = 2) -> DataFrame:
    """Runs of definition items (blank lines between them count as part of the run) of at least two: doc_id, first_line, n_rows
    and the table's Markdown. Indented lines in lower case right behind an item go on with its description."""
    rows = lines.withColumn("_d", s.definition(F.col("line"))).withColumn("_is", F.col("_d").isNotNull()).withColumn("_like", ~F.col("_is") & F.col("line").rlike(r"^\s+\p{Ll}"))
    rows = rows.withColumn("_part", F.sum(F.col("_is").cast("int")).over(so_far())).withColumn("_noise", F.sum((~F.col("_is") & ~F.col("_like")).cast("int")).over(so_far()))
    since = F.max(F.when(F.col("_is"), F.col("_noise"))).over(Window.partitionBy("doc_id", "_part"))
    rows = rows.withColumn("_more", F.col("_like") & F.coalesce(F.col("_noise") == since, F.lit(False)))
    cut = ~F.col("_is") & ~F.col("_more") & (F.trim("line") != "")
    held = rows.withColumn("_run", F.sum(cut.cast("int")).over(so_far())).where("_is or _more")
    text = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("_d.description", F.trim("line")).alias("t")))), lambda x: x["t"])
    items = held.groupBy("doc_id", "_run", "_part").agg(F.min("line_no").alias("line_no"), F.max("_d.label").alias("label"), F.array_join(text, " ").alias("description"))
    row = F.concat(F.lit("| **"), F.col("label"), F.lit("** | "), s.cell_escaped_once(F.col("description")), F.lit(" |"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("row")))), lambda x: x["row"])
    found = items.groupBy("doc_id", "_run").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_rows"), F.concat(F.lit("| Term | Description |\n| --- | --- |\n"), F.array_join(table, "\n")).alias("table_md"))
    return found.where(F.col("n_rows") >= least).drop("_run")


def merged_fences(lines: DataFrame) -> DataFrame:
    """Lines with neighbouring code fences of one language merged, where a source line and blanks alone stand between; the
    source line goes behind the merged fence."""
    rows = fence_mask(lines, "backticks").withColumn("_open", F.col("is_fence") & ~F.col("in_fence")).withColumn("_close", F.col("is_fence") & F.col("in_fence"))
    rows = rows.withColumn("_block", F.sum(F.col("_open").cast("int")).over(so_far()))
    outside = ~F.col("is_fence") & ~F.col("in_fence")
    of = Window.partitionBy("doc_id", "_block")
    source = outside & F.col("line").rlike(s.SOURCE_LINE)
    rows = rows.withColumn("_sources", F.sum(source.cast("int")).over(of)).withColumn("_texts", F.sum((outside & ~source & (F.trim("line") != "")).cast("int")).over(of))
    rows = rows.withColumn("_language", F.max(F.when(F.col("_open"), F.trim("line"))).over(of))
    block = rows.where("_open").select("doc_id", "_block", "_language", "_sources", "_texts")
    order = Window.partitionBy("doc_id").orderBy("_block")
    joins = (F.lead("_language").over(order) == F.col("_language")) & (F.col("_sources") == 1) & (F.col("_texts") == 0)
    block = block.select("doc_id", "_block", F.coalesce(joins, F.lit(False)).alias("_on")).withColumn("_from", F.coalesce(F.lag("_on").over(order), F.lit(False)))
    block = block.withColumn("_group", F.sum((~F.col("_from")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(block, ["doc_id", "_block"], "left")
    on, from_ = F.coalesce("_on", F.lit(False)), F.coalesce("_from", F.lit(False))
    last = F.max(F.when(F.col("_close"), F.col("line_no"))).over(Window.partitionBy("doc_id", "_group"))
    gone = (F.col("_open") & from_) | (F.col("_close") & on) | (outside & on & (F.trim("line") == ""))
    at = F.when(outside & on, last + F.lit(0.5)).otherwise(F.col("line_no").cast("double"))
    kept = rows.withColumn("_at", at).withColumn("_gone", gone).where("not _gone")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "line_no")) - 1
    return kept.select("doc_id", place.alias("line_no"), "line")


CALLOUT_LEAD = r"^(?:\*\*)?(Note|Tip|Warning|Important|Caution|Example|Info)(?::\*\*|\*\*:|\*\*|:)\s*(.*)$"


def callouts(lines: DataFrame) -> DataFrame:
    """Labelled paragraphs: doc_id, first_line, callout_type, body and its number of lines. A callout takes the lines after
    its label up to a blank or structural line, another label or a fence."""
    masked = fence_mask(lines)
    lead = masked.withColumn("_lead", ~F.col("in_fence") & F.col("line").rlike(CALLOUT_LEAD)).withColumn("_stop", (F.trim("line") == "") | F.col("is_fence") | F.col("line").rlike(r"^\s*(#{1,6} |[-*+] |[0-9]+[.)] |>|\|)"))
    run = lead.withColumn("_part", F.sum((F.col("_lead") | F.col("_stop")).cast("int")).over(so_far()))
    of = Window.partitionBy("doc_id", "_part")
    run = run.withColumn("_is", F.max("_lead").over(of)).where("_is")
    text = F.when(F.col("_lead"), F.regexp_extract("line", CALLOUT_LEAD, 2)).otherwise(F.trim("line"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), lambda t: t != "")
    kind = F.lower(F.max(F.when(F.col("_lead"), F.regexp_extract("line", CALLOUT_LEAD, 1))))
    return run.groupBy("doc_id", "_part").agg(F.min("line_no").alias("first_line"), kind.alias("callout_type"), F.array_join(parts, " ").alias("body"), F.count(F.lit(1)).alias("n_lines")).drop("_part")


def next_nonblank(distance: int) -> Column:
    return F.first(F.when(F.trim("line") != "", F.col("line_no")), ignorenulls=True).over(w().rowsBetween(1, distance))


def previous_nonblank(distance: int) -> Column:
    return F.last(F.when(F.trim("line") != "", F.col("line_no")), ignorenulls=True).over(w().rowsBetween(-distance, -1))

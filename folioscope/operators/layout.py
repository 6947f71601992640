"""Page geometry: lines, entries, drawn tables, boxes and images of pages, and their text in reading order.

pages has doc, page, width, height and blocks: array<struct<bbox array<double>, lines array<struct<bbox, spans
array<struct<text, bbox, size, font, flags>>>>>>. Coordinates grow to the right and downward. Everything is windows and joins
keyed by (doc, page); a page is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scalar as s

PAGE = ["doc", "page"]
SPAN = "struct<text:string,bbox:array<double>,size:double,font:string,flags:int>"
PAGES_SCHEMA = f"doc long, page int, width double, height double, blocks array<struct<bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<{SPAN}>>>>>"


def _w(*order: str):
    return Window.partitionBy(*PAGE).orderBy(*order)


def raw_lines(pages: DataFrame) -> DataFrame:
    """doc, page, block_no, line_no, x0, y0, x1, y1, spans of every line."""
    blocks = pages.select(*PAGE, F.posexplode("blocks").alias("block_no", "b"))
    rows = blocks.select(*PAGE, "block_no", F.posexplode("b.lines").alias("line_no", "l"))
    return rows.select(*PAGE, "block_no", "line_no", *(F.col("l.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), F.col("l.spans").alias("spans"))


def line_boxes(pages: DataFrame) -> DataFrame:
    """Line boxes with their text; fragments on one baseline (both edges within a point) that lie at most 16 points or twice
    their height apart are one line."""
    rows = raw_lines(pages).withColumn("text", F.array_join(F.transform("spans", lambda x: s.clean_span_text(x["text"])), "")).where(F.trim("text") != "")
    down = _w("y0")
    rows = rows.withColumn("_row", F.sum(F.coalesce(F.col("y0") - F.lag("y0").over(down) > 1, F.lit(True)).cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy(*PAGE, "_row").orderBy("x0", "block_no", "line_no")
    gap = F.greatest(F.lit(16.0), 2 * (F.col("y1") - F.col("y0")))
    same = (F.abs(F.col("y0") - F.lag("y0").over(order)) <= 1) & (F.abs(F.col("y1") - F.lag("y1").over(order)) <= 1) & (F.col("x0") - F.lag("x1").over(order) <= gap)
    marked = rows.withColumn("_run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: F.trim(x["text"]))
    return marked.groupBy(*PAGE, "_row", "_run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(parts, " ").alias("text")).drop("_row", "_run")


def joined_spans(spans: Column) -> Column:
    """Text of spans in order; a space fills a gap of over 0.65 points and 4.5 % of the font's size."""
    first = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("x1"))

    def step(acc: Column, x: Column) -> Column:
        text = s.clean_span_text(x["text"])
        apart = (x["bbox"][0] - acc["x1"] > F.greatest(F.lit(0.65), 0.045 * x["size"])) & ~acc["text"].rlike(r"\s$") & ~text.rlike(r"^\s")
        return F.struct(F.concat(acc["text"], F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), text).alias("text"), x["bbox"][2].alias("x1"))

    return F.aggregate(spans, first, step, lambda acc: F.trim(acc["text"]))


def entries(pages: DataFrame, code_ratio: float = 0.72, code_lines: int = 2, code_chars: int = 60) -> DataFrame:
    """One row for each block with text: its box, text, kind (code, heading, list, header, text) and heading level.

    Code: monospace characters reach the ratio over two lines or sixty characters. Headings: set in 12 points or more, up to
    140 characters, no closing stop; level 2 below 17 points, 3 from there on. Headers: headings above the first 60 points.
    """
    rows = raw_lines(pages).withColumn("text", joined_spans(F.col("spans"))).where("text <> ''")
    chars = lambda pick: F.aggregate("spans", F.lit(0), lambda n, x: n + F.when(pick(x), F.length(F.trim(x["text"]))).otherwise(0))
    rows = rows.withColumn("_mono", chars(lambda x: s.is_monospace(x["font"], x["flags"]))).withColumn("_all", chars(lambda x: F.lit(True))).withColumn("_size", F.array_max(F.transform("spans", lambda x: x["size"])))
    text = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    blocks = rows.groupBy(*PAGE, "block_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("_lines"), F.sum("_mono").alias("_mono"), F.sum("_all").alias("_all"), F.max("_size").alias("size")
    )
    plain = F.array_join("_lines", " ")
    code = (F.col("_mono") >= code_ratio * F.col("_all")) & ((F.size("_lines") >= code_lines) | (F.col("_all") >= code_chars))
    heading = (F.col("size") >= 12) & (F.length(plain) <= 140) & ~plain.rlike(r"[.!?:;,]$")
    kind = F.when(code, "code").when(heading & (F.col("y0") < 60), "header").when(heading, "heading").when(s.is_list_marker(plain), "list").otherwise("text")
    out = blocks.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.when(F.col("size") < 17, 2).otherwise(3)))
    return out.select(*PAGE, "block_no", "x0", "y0", "x1", "y1", "size", "kind", "level", F.when(F.col("kind") == "code", F.array_join("_lines", "\n")).otherwise(plain).alias("text"))


def without_page_numbers(rows: DataFrame, pages: DataFrame, edge: float = 0.2) -> DataFrame:
    """entries without page numbers in the top or bottom fifth of the page."""
    joined = rows.join(pages.select(*PAGE, "height"), PAGE)
    near = (F.col("y0") <= edge * F.col("height")) | (F.col("y1") >= (1 - edge) * F.col("height"))
    return joined.where(~(s.is_page_number(F.col("text")) & near)).drop("height")


def rendered(rows: DataFrame, events: DataFrame) -> DataFrame:
    """doc, page, text: entries and events (doc, page, y0, x0, priority, markdown: tables, images, callouts) in reading order."""
    md = F.when(F.col("kind") == "code", F.concat(F.lit("```"), s.code_language(F.col("text")), F.lit("\n"), F.col("text"), F.lit("\n```"))).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    text = rows.where("kind <> 'header'").select(*PAGE, "y0", F.lit(1).alias("late"), "x0", F.lit(0).alias("priority"), md.alias("markdown"))
    both = text.unionByName(events.select(*PAGE, "y0", F.lit(0).alias("late"), "x0", "priority", "markdown"))
    ordered = F.array_sort(F.collect_list(F.struct("y0", "late", "x0", "priority", "markdown")))
    return both.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda x: x["markdown"]), "\n\n").alias("text"))


# Drawn tables


def grid_segments(drawings: DataFrame) -> DataFrame:
    """drawings(doc, page, ax, ay, bx, by) as horizontal (30 points or longer) and vertical (12 or longer) segments: orient, lo,
    hi along the segment and pos across it."""
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    orient = F.when((dy <= 1) & (dx >= 30), "h").when((dx <= 1) & (dy >= 12), "v")
    flat = orient == "h"
    return drawings.where(orient.isNotNull()).select(
        *PAGE, orient.alias("orient"), F.when(flat, F.least("ax", "bx")).otherwise(F.least("ay", "by")).alias("lo"), F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest("ay", "by")).alias("hi"),
        F.when(flat, (F.col("ay") + F.col("by")) / 2).otherwise((F.col("ax") + F.col("bx")) / 2).alias("pos"),
    )


def grid_boundaries(segments: DataFrame, pages: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Horizontal boundaries: segments clustered by height, below 60 points, as wide as 160 points and 45 % of the page."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    rows = segments.where("orient = 'h'").withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(w) <= tolerance, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*PAGE, "_run").agg(F.avg("pos").alias("y"), F.min("lo").alias("x0"), F.max("hi").alias("x1")).drop("_run")
    wide = merged.join(pages.select(*PAGE, "width"), PAGE)
    return wide.where((F.col("y") > 60) & (F.col("x1") - F.col("x0") >= F.greatest(F.lit(160.0), 0.45 * F.col("width")))).drop("width")


def grid_runs(boundaries: DataFrame, segments: DataFrame, least: int = 3) -> DataFrame:
    """Runs of boundaries that belong together, numbered by page: neighbours match in span (ends within 12 points, overlap 120
    points and 82 % of the wider) and lie within 90 points, and within 35 unless a vertical segment bridges them."""
    w = _w("y")
    rows = boundaries.withColumn("_n", F.row_number().over(w))
    for c in ("y", "x0", "x1"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(w))
    vertical = segments.where("orient = 'v'").select(*PAGE, F.col("lo").alias("v0"), F.col("hi").alias("v1"))
    bridged = rows.join(vertical, PAGE).where((F.col("v0") <= F.col("_y") + 3) & (F.col("v1") >= F.col("y") - 3)).select(*PAGE, "_n").distinct().withColumn("_bridge", F.lit(True))
    rows = rows.join(bridged, [*PAGE, "_n"], "left")
    overlap = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    span = (F.abs(F.col("x0") - F.col("_x0")) <= 12) & (F.abs(F.col("x1") - F.col("_x1")) <= 12) & (overlap >= F.greatest(F.lit(120.0), 0.82 * F.greatest(F.col("x1") - F.col("x0"), F.col("_x1") - F.col("_x0"))))
    gap = F.col("y") - F.col("_y")
    same = F.coalesce(span & (gap <= 90) & ((gap <= 35) | F.coalesce("_bridge", F.lit(False))), F.lit(False))
    rows = rows.withColumn("run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "run"))).where(F.col("_size") >= least)
    return rows.select(*PAGE, "run", "y", "x0", "x1", (F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("y")) - 1).alias("row"))


def grid_columns(runs: DataFrame, segments: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Column positions of each run: vertical segments of 8 points or more in its range, clustered; one that covers 55 % of the
    run or two make a column."""
    extent = runs.groupBy(*PAGE, "run").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    inside = segments.where("orient = 'v' and hi - lo >= 8").join(extent, PAGE).where((F.col("hi") >= F.col("top") - 3) & (F.col("lo") <= F.col("bottom") + 3))
    w = Window.partitionBy(*PAGE, "run").orderBy("pos")
    rows = inside.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(w) <= tolerance, 0).otherwise(1)).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.max((F.least("hi", "bottom") - F.greatest("lo", "top")) / (F.col("bottom") - F.col("top")))
    kept = rows.groupBy(*PAGE, "run", "_c").agg(F.avg("pos").alias("x"), share.alias("_share"), F.count(F.lit(1)).alias("_n")).where("_share >= 0.55 or _n >= 2")
    return kept.select(*PAGE, "run", "x", (F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("x")) - 1).alias("col"))


def grid_cells(runs: DataFrame, columns: DataFrame, lines: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """doc, page, run, row, col, text: lines placed by their middle's height and left edge; where cells overlap by the tolerance
    the first wins. Every cell has a row, empty ones too."""
    nxt = lambda c, by: F.lead(c).over(Window.partitionBy(*PAGE, "run").orderBy(by))
    rows = runs.select(*PAGE, "run", "row", F.col("y").alias("r0"), nxt("y", "row").alias("r1")).where("r1 is not null")
    cols = columns.select(*PAGE, "run", "col", F.col("x").alias("c0"), nxt("x", "col").alias("c1")).where("c1 is not null")
    cells = rows.join(cols, [*PAGE, "run"])
    middle = (F.col("y0") + F.col("y1")) / 2
    placed = lines.join(cells, PAGE).where((middle >= F.col("r0") - tolerance) & (middle < F.col("r1") + tolerance) & (F.col("x0") >= F.col("c0") - tolerance) & (F.col("x0") < F.col("c1") + tolerance))
    first = placed.withColumn("_p", F.row_number().over(Window.partitionBy(*PAGE, "run", "y0", "x0", "text").orderBy("row", "col"))).where("_p = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ")
    filled = first.groupBy(*PAGE, "run", "row", "col").agg(text.alias("text"))
    return cells.select(*PAGE, "run", "row", "col").join(filled, [*PAGE, "run", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def discovered_tables(cells: DataFrame) -> DataFrame:
    """doc, page, run, headers, rows, status and reason of drawn tables: three columns at least, a whole header, no empty row."""
    by_row = cells.groupBy(*PAGE, "run", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))
    table = by_row.groupBy(*PAGE, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("all"))
    headers, body = F.col("all")[0], F.slice("all", 2, F.size("all"))
    blank = lambda row: ~F.exists(row, lambda c: c != "")
    reason = (
        F.when(F.size(headers) < 3, "fewer-than-three-columns").when(F.exists(headers, lambda c: c == ""), "header-not-whole")
        .when(F.size(body) == 0, "no-rows").when(F.exists(body, blank), "empty-row")
    )
    return table.select(*PAGE, "run", headers.alias("headers"), body.alias("rows"), F.when(reason.isNull(), "converted").otherwise("skipped").alias("status"), reason.alias("reason"))


def merged_tables(tables: DataFrame) -> DataFrame:
    """Converted tables of one header on consecutive pages as one: doc, start_page, end_page, headers, rows."""
    w = Window.partitionBy("doc").orderBy("page", "run")
    good = tables.where("status = 'converted'")
    on = (F.lag("headers").over(w) == F.col("headers")) & (F.col("page") - F.lag("page").over(w) <= 1)
    runs = good.withColumn("_t", F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "run", "rows"))), lambda x: x["rows"]))
    return runs.groupBy("doc", "_t").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.first("headers").alias("headers"), rows.alias("rows")).drop("_t")


def table_markdown(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, s.cell_with_breaks), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(rows, line), "\n"))


# Boxes and images


def callout_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """boxes(doc, page, box, x0, y0, x1, y1, curved, filled) with the lines inside (inset 4 points across, 2 down): label, type,
    body, status and reason. Boxes are curved, unfilled, 180 points wide and 20 to 180 high."""
    fit = boxes.where("curved and not filled and x1 - x0 >= 180 and y1 - y0 between 20 and 180").select(*PAGE, "box", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = (F.col("x0") >= F.col("bx0") - 4) & (F.col("x1") <= F.col("bx1") + 4) & (F.col("y0") >= F.col("by0") - 2) & (F.col("y1") <= F.col("by1") + 2)
    held = fit.join(lines, PAGE).where(inside).groupBy(*PAGE, "box").agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]).alias("t"))
    rows = fit.select(*PAGE, "box").join(held, [*PAGE, "box"], "left")
    label = F.try_element_at("t", F.lit(1))
    kind, body = s.callout_label(label), F.slice("t", 2, F.size("t"))
    reason = F.when(label.isNull(), "no-text").when(kind.isNull(), "no-label").when(F.size("t") < 2, "no-body")
    return rows.select(*PAGE, "box", label.alias("label"), kind.alias("callout_type"), F.array_join(body, " ").alias("body"), F.when(reason.isNull(), "converted").otherwise("skipped").alias("status"), reason.alias("reason"))


def image_roles(images: DataFrame, lines: DataFrame) -> DataFrame:
    """images(doc, page, image, x0, y0, x1, y1) by the lines that they usefully overlap (0.75 points and a tenth of the lower
    height): none is block; several are ambiguous; one is inline-icon if the image is of the line's size, or else block."""
    im = images.select(*PAGE, "image", *(F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")))
    shared = F.least("y1", "iy1") - F.greatest("y0", "iy0")
    useful = (shared >= F.greatest(F.lit(0.75), 0.1 * F.least(F.col("y1") - F.col("y0"), F.col("iy1") - F.col("iy0")))) & (F.col("ix0") < F.col("x1")) & (F.col("ix1") > F.col("x0"))
    hits = im.join(lines, PAGE).where(useful).groupBy(*PAGE, "image").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("y1") - F.col("y0")).alias("h"))
    rows = im.join(hits, [*PAGE, "image"], "left")
    small = (F.col("ix1") - F.col("ix0") <= F.greatest(F.lit(24.0), 3 * F.col("h"))) & (F.col("iy1") - F.col("iy0") <= F.greatest(F.lit(24.0), 2 * F.col("h")))
    role = F.when(F.coalesce("n", F.lit(0)) == 0, "clear-block").when(F.col("n") > 1, "ambiguous").when(small, "inline-icon").otherwise("clear-block")
    return rows.select(*PAGE, "image", role.alias("role"))


def probe(pages: DataFrame, threshold: float = 0.2) -> DataFrame:
    """By document: pages, pages with text, characters, share of pages without text and whether it is likely scanned."""
    chars = F.aggregate(F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda x: x["spans"])))), F.lit(0), lambda n, x: n + F.length(F.trim(x["text"])))
    agg = pages.withColumn("_c", F.coalesce(chars, F.lit(0))).groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("_c") > 0).alias("n_text_pages"), F.sum("_c").alias("n_chars"))
    ratio = F.round(1 - F.col("n_text_pages") / F.col("n_pages"), 6)
    return agg.withColumn("non_text_ratio", ratio).withColumn("likely_scanned", (F.col("n_text_pages") == 0) | (ratio >= threshold))

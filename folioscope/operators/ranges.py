"""Range, overlap, as-of and nearest joins; intervals, clusters and grids.

Range joins carry an equality (a document, or a bucket of the position), so that they never plan as nested loops over
everything: intervals are dealt to the buckets that they touch, points to theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def in_range(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, width: int = 64) -> DataFrame:
    """Pairs of a point and a closed range that holds it. width is about the length of a usual range."""
    left = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return left.join(_bucketed(ranges.where(F.col(start) <= F.col(end)), start, end, width), "_bucket").where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def unique_owner(points: DataFrame, at: str, ranges: DataFrame, owner: str, start: str, end: str) -> DataFrame:
    """at and its owner, for points that exactly one range holds."""
    return in_range(points.select(at).distinct(), at, ranges, start, end).groupBy(at).agg(F.count(F.lit(1)).alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")


def first_range(points: DataFrame, at: str, ranges: DataFrame, order: str, start: str, end: str, value: str, default: str) -> DataFrame:
    """points with the value of the first range, by order, that holds them, or a default."""
    found = in_range(points.select(at).distinct(), at, ranges, start, end).groupBy(at).agg(F.min_by(value, order).alias(value))
    return points.join(found, at, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def overlap_counts(left: DataFrame, key: str, right: DataFrame, start: str, end: str, width: int = 64) -> DataFrame:
    """key and the number of other ranges that each range overlaps; both tables have key, start and end."""
    a = _bucketed(left.select(F.col(key).alias("a"), F.col(start).alias("a0"), F.col(end).alias("a1")), "a0", "a1", width)
    b = _bucketed(right.select(F.col(key).alias("b"), F.col(start).alias("b0"), F.col(end).alias("b1")), "b0", "b1", width)
    # of the buckets that two ranges share, the first counts
    shared = F.floor(F.greatest("a0", "b0") / width) == F.col("_bucket")
    pairs = a.join(b, "_bucket").where((F.col("a") != F.col("b")) & (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")) & shared)
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_overlaps"))
    return left.select(F.col(key)).join(counted, F.col(key) == F.col("a"), "left").select(key, F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"))


def merge_intervals(rows: DataFrame, by: str, start: str, end: str, gap: float = 0) -> DataFrame:
    """Unions of intervals that overlap or lie at most gap apart."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_run")


def cluster_positions(rows: DataFrame, by: str, position: str, tolerance: float) -> DataFrame:
    """Single-link clusters of positions: least, greatest, mean and size of each."""
    w = Window.partitionBy(by).orderBy(position)
    marked = rows.withColumn("_new", F.when(F.col(position) - F.lag(position).over(w) <= tolerance, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "_run").agg(F.min(position).alias("low"), F.max(position).alias("high"), F.avg(position).alias("centre"), F.count(F.lit(1)).alias("n_positions")).drop("_run")


def caption_after(lines: DataFrame, anchor: Column, caption: Column, distance: int = 6) -> DataFrame:
    """Forward as-of: each anchor line with the next line that is not blank, if that is a caption at most six lines on."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.when(F.trim("line") != "", F.struct("line_no", "line", caption.alias("is_caption")))
    found = lines.withColumn("_next", F.first(text, ignorenulls=True).over(w.rowsBetween(1, distance))).withColumn("_anchor", anchor)
    return found.where("_anchor and _next.is_caption").select("doc_id", "line_no", F.col("_next.line_no").alias("caption_no"))


def nearest_marker(anchors: DataFrame, markers: DataFrame, before: int = 8, after: int = 7) -> DataFrame:
    """anchors(doc_id, line_no, page) with the nearest marker(doc_id, marker_no, page) of the same page from before lines
    above to after lines below (exclusive): above wins over below, then the smaller distance; ties are left out."""
    pairs = anchors.join(markers, ["doc_id", "page"]).withColumn("_d", F.col("marker_no") - F.col("line_no")).where((F.col("_d") >= -before) & (F.col("_d") < after) & (F.col("_d") != 0))
    w = Window.partitionBy("doc_id", "line_no")
    ranked = pairs.withColumn("_r", F.rank().over(w.orderBy((F.col("_d") > 0).cast("int"), F.abs("_d"))))
    best = ranked.where("_r = 1").withColumn("_n", F.count(F.lit(1)).over(w))
    return best.where("_n = 1").select("doc_id", "line_no", "page", "marker_no")


def place_in_grid(points: DataFrame, rows: DataFrame, columns: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """points(grid, point, x, y) in cells of rows(grid, row, y0, y1) and columns(grid, col, x0, x1), each bound widened by the
    tolerance; of cells that overlap by it the first wins."""
    by_row = points.join(rows, "grid").where((F.col("y") >= F.col("y0") - tolerance) & (F.col("y") < F.col("y1") + tolerance))
    by_cell = by_row.join(columns, "grid").where((F.col("x") >= F.col("x0") - tolerance) & (F.col("x") < F.col("x1") + tolerance))
    first = by_cell.groupBy("grid", "point").agg(F.min(F.struct("row", "col")).alias("c"))
    return first.select("grid", "point", F.col("c.row").alias("row"), F.col("c.col").alias("col"))


def chapter_ranges(outline: DataFrame, by: str, page: str, title: str, last: str) -> DataFrame:
    """Outline rows as page ranges: of rows of one page the first counts, a range ends before the next begins."""
    one = outline.groupBy(by, page).agg(F.min_by(title, "ord").alias(title), F.min("ord").alias("ord"), F.max(last).alias(last))
    w = Window.partitionBy(by).orderBy(page)
    return one.select(by, title, F.col(page).alias("start_page"), F.coalesce(F.lead(page).over(w) - 1, F.col(last)).alias("end_page"))

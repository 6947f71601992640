"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, stored, tasks_for

#: Links that a task writes of a round, where tasks are bounded.
TASK_LINKS = 1 << 16


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over undirected edges (a, b), a > b, without repeats."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    linked = large.join(low, "a")
    small = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return small.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """node, root for every node of edges (a, b); root is the least node of the component.

    Every round is a few joins over what is left of the edges and is written to the shared folder, so a lost executor
    costs at most one round. Rounds grow with the logarithm of the longest chain. Loops and repeats do no harm; an empty
    table gives an empty result. tasks: as in stored; rounds after the first
    take fewer if there are few links.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    said = None
    while True:
        before, edges = edges, stored(_stars(edges) if said is not None else edges, "stars", tasks)
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == said or not now[0]:
            break
        said = now
        if tasks is not None:
            tasks = min(tasks, tasks_for(edges.sparkSession, now[0], TASK_LINKS))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

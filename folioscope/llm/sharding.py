"""Sharding by a hierarchical weighted hash tree (law ``key``).

A topology is a tree: regions hold racks, racks hold shards, every shard has a weight and a node's weight is the sum of
its shards' weights. A row descends from the root: at each level every child draws -ln(u) / weight, where u in (0, 1) is
a hash of the row's key, the child's name and nothing else, and the smallest draw wins. A child wins in proportion to its
weight. If a shard's weight changes, only draws of nodes on its path change, so rows move only into or out of subtrees
whose weights changed; children elsewhere keep their rows among themselves.

Growth opens a region of its own for the new shard: no other draw changes, so the shard takes rows only into itself.
``tree(n)`` puts the first eight shards into two regions of two racks of two shards and every further one into a region
of its own, so that the law holds for every step from eight shards on.

Only column expressions are used. The draws need doc_id alone. Slots are numbered by two levels: rows are counted by
(shard, bucket of the key's hash), the counts are summed up into offsets, and rows are numbered inside each (shard,
bucket); no task ever sees a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]


def tree(shards: int, base: int = 8) -> list[Leaf]:
    """The topology of so many shards of weight 1."""
    leaves = [(f"g{s // 4}", f"k{s // 2}", s, 1.0) for s in range(min(shards, base))]
    return leaves + [(f"n{s}", f"n{s}", s, 1.0) for s in range(base, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    h = F.xxhash64(key, F.lit(name))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _first(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; a tie (a hash collision) goes to the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, name, w) for name, w, _ in children]
    least = F.least(*draws)
    return reduce(lambda rest, x: F.when(x[0] == least, x[1][2]).otherwise(rest), list(zip(draws, children))[:-1][::-1], children[-1][2])


def place(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard that key descends to. A null key is a key like any other."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        if leaf[3] <= 0:
            raise ValueError("weights must be positive")
        regions.setdefault(leaf[0], {}).setdefault(leaf[1], []).append(leaf)
    weight = lambda rows: sum(x[3] for x in rows)
    by_region = []
    for region, racks in regions.items():
        by_rack = [(f"{region}/{rack}", weight(rows), _first(key, [(f"{region}/{rack}/{x[2]}", x[3], F.lit(x[2])) for x in rows])) for rack, rows in racks.items()]
        by_region.append((region, weight([x for rows in racks.values() for x in rows]), _first(key, by_rack)))
    return _first(key, by_region)


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    size is the UTF-8 length of text plus 1, with no bytes for a null text, whose crc is that of the empty string. Rows
    with equal doc_ids (and those with a null one) share a shard and get slots of their own. An empty table gives an
    empty result; further columns are ignored. Equal texts are told apart by their doc_ids, as law ``key`` demands.
    buckets is the number of pieces in which each shard is numbered.
    """
    shards_now, shards_next = tree(shards), tree(shards + 1)
    key = F.col("doc_id")
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int").alias("bucket")
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = docs.select(place(key, shards_now).alias("shard"), bucket).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * buckets rows, whatever the input
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("ahead"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place(key, shards_now).cast("int").alias("shard"),
        place(key, shards_next).cast("int").alias("grown_shard"),
        bucket,
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside).cast("long"))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("ahead") + F.col("place") - 1).alias("slot"), "grown_shard"
    )

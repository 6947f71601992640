"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of B bits is cut into so few segments that two fingerprints within the allowed distance differ in at most
one bit of some segment: half as many as the distance, plus one. For each segment and each of its bits there is one key:
the segment with that bit left out. Two segments that differ in at most one bit share a key, so candidates are found by
equality alone. Rows are dealt and sorted by key; a run of equal keys is verified in one task against the whole
fingerprints and reports a spanning forest of its links, at most one link for each row, never all pairs. A run longer than
RUN_ROWS is not verified in one task: its fingerprints are keyed by the pairs of bits that can differ, where equal keys
mean a link, so that such runs split up and each key needs only its least member.

Components are built over distinct fingerprints; copies of a text add no work.

``without_near_copies`` checks each such link against the texts' sets of shingles, and adds the similar texts whose
fingerprints lie further apart, found by rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, stored, tasks_for
from folioscope.llm.components import components

#: Longer runs of one key are split up by pairs of bits.
RUN_ROWS = 8192
#: Shingles that are hashed at a time.
_BLOCK = 1 << 17
#: Jaccard similarity of the sets of shingles from which on two texts are near copies.
SIMILARITY = 0.8
#: Bits of a set's parity word, and buckets of the counts by which shingles are ordered.
PARITY_BITS, BUCKETS = 256, 1 << 20
#: Runs of one shingle of up to so many texts are compared in full at once; those of more first by nearest pairs.
FEW_ROWS = 16
#: Tables of without_near_copies are written by a task for so many documents, or by one for each core.
TASK_DOCS = 1 << 14


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case: runs without space, tab, LF, VT, FF and CR."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(own: list[bytes], size: int, seed: int = 42, digest=xxhash.xxh64_digest) -> Iterator[bytes]:
    """Hashes of all shingles, repeats included; fewer words than size make one shingle."""
    if 0 < len(own) <= size:
        yield digest(b" ".join(own), seed)
    elif own:
        for at in range(0, len(own) - size + 1, _BLOCK):
            part = own[at : at + _BLOCK + size - 1]
            joined = part if size == 1 else map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
            yield b"".join([digest(x, seed) for x in joined])


def majority(blocks: Iterator[bytes], bits: int) -> np.ndarray:
    """Bits that are set in over half of the hashes, as bytes from the most significant on; zero without a hash."""
    total, count = np.zeros(bits, dtype=np.int64), 0
    for block in blocks:
        rows = np.frombuffer(block, dtype=np.uint8).reshape(-1, bits // 8)
        for at in range(0, len(rows), 4096):
            total += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
        count += len(rows)
    return np.packbits(total * 2 > count)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits: each is the majority of that bit of the shingles' XXH64 (seed 42)."""
    return int.from_bytes(majority(shingle_hashes(words(text), size), 64).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a signed long, for each row of docs."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", fp("text").alias("fp"))


def _keys(segments: list[Column], width: int) -> Column:
    """Keys of all one-wildcard variants: number of segment and bit above the segment without that bit."""
    return F.array(
        *(F.lit((n * width + i) << 32).bitwiseOR(s.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))) for n, s in enumerate(segments) for i in range(width))
    )


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis. Words are counted unsigned: of a negative one numpy counts its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _forest(run: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of a run of fingerprints (rows of words) under distance at most most."""
    links, left = [], np.arange(1, len(run))
    queue = [0]
    while True:
        if not queue:
            if not len(left):
                return links
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        if len(left):
            hit = _distance(run[left], run[at]) <= most
            found = left[hit]
            links += [(at, int(x)) for x in found]
            queue += [int(x) for x in found]
            left = left[~hit]


def _linked(most: int, payload: int, run_rows: int):
    """Over rows sorted by key: links of each run as (x..., y...), and rows of overlong runs with y null."""
    def emit(x: np.ndarray, y: np.ndarray | None) -> pd.DataFrame:
        out = pd.DataFrame({f"x{i}": x[:, i] for i in range(payload)})
        for i in range(payload):
            out[f"y{i}"] = pd.array(y[:, i], dtype="Int64") if y is not None else pd.array([None] * len(x), dtype="Int64")
        return out

    def close(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.unique(run, axis=0)
        pairs = np.array(_forest(run, most), dtype=np.int64).reshape(-1, 2)
        return run[pairs[:, 0]], run[pairs[:, 1]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, long = None, np.zeros((0, payload), dtype=np.int64), False
        for batch in batches:
            keys, rows = batch["key"].to_numpy(), batch[[f"p{i}" for i in range(payload)]].to_numpy(dtype=np.int64)
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            xs, ys = [], []
            first = 0
            if keys[0] == key:  # the run of the batch before goes on
                part = rows[: cuts[1]]
                first = 1
                if long or len(held) + len(part) > run_rows:
                    for x in ([part] if long else [held, part]):
                        yield emit(x, None)
                    held, long = held[:0], True
                else:
                    held = np.concatenate([held, part])
                if len(cuts) == 2:
                    continue
            if len(held) > 1 and not long:
                x, y = close(held)
                xs.append(x)
                ys.append(y)
            starts, stops = cuts[first:-2], cuts[first + 1 : -1]
            two = starts[stops - starts == 2]
            if len(two):
                a, b = rows[two], rows[two + 1]
                near = _distance(a, b) <= most
                xs.append(a[near])
                ys.append(b[near])
            for a, b in zip(starts[stops - starts > 2], stops[stops - starts > 2], strict=True):
                if b - a > run_rows:
                    yield emit(rows[a:b], None)
                else:
                    x, y = close(rows[a:b])
                    xs.append(x)
                    ys.append(y)
            key, held = keys[-1], rows[cuts[-2] :]
            long = len(held) > run_rows
            if long:
                yield emit(held, None)
                held = held[:0]
            if xs and sum(map(len, xs)):
                yield emit(np.concatenate(xs), np.concatenate(ys))
        if len(held) > 1 and not long:
            x, y = close(held)
            if len(x):
                yield emit(x, y)

    return scan


def candidate_links(nodes: DataFrame, segments: list[Column], width: int, payload: list[Column], most: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links between nodes whose payload (64-bit words) differs in at most most bits, found by shared variants of segments
    (longs of width bits). Columns x0.., y0..; rows with null y are members of overlong runs."""
    p = len(payload)
    keyed = nodes.select(*(c.alias(f"p{i}") for i, c in enumerate(payload)), F.explode(_keys(segments, width)).alias("key"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    schema = ", ".join([f"x{i} long" for i in range(p)] + [f"y{i} long" for i in range(p)])
    return dealt.mapInPandas(_linked(most, p, run_rows), schema)


def _pair_links(fps: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """Links among fingerprints by keys that leave out as many bits as may differ: equal keys are links, and each member
    is linked to the least of its key."""
    masks = [sum(1 << b for b in c) for c in combinations(range(bits), most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(~m)) for m in signed))).alias("n", "rest"))
    least = keyed.groupBy("n", "rest").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return keyed.join(least, ["n", "rest"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, most: int = 2, run_rows: int = RUN_ROWS, tasks: int | None = None) -> DataFrame:
    """Links (a, b) of at most ``most`` (two or three) differing bits among the distinct fingerprints fp of fps. They connect
    all that any such links connect; not each link is among them. tasks: as in stored."""
    if not 2 <= most <= 3:
        raise ValueError("two segments of 32 bits serve distances of two and three")
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    found = stored(candidate_links(fps, half, 32, [F.col("fp")], most, run_rows).distinct(), "links", tasks)
    edges = found.where("y0 is not null").select(F.col("x0").alias("a"), F.col("y0").alias("b"))
    overlong = found.where("y0 is null").select(F.col("x0").alias("fp")).distinct()
    return edges if overlong.isEmpty() else edges.unionByName(_pair_links(overlong, most))


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 2, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    component_id is the least doc_id that can be reached over links of at most ``most`` (two or three) differing bits. A
    null or empty text has fingerprint zero, linked like any other. Rows with a null doc_id take part, but lend no id: a
    component of such rows alone has a null one. Repeated rows get a row each; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, size), "fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(fingerprint_links(nodes, most, run_rows))
    rooted = nodes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def linked_texts(marked: DataFrame, most: int, run_rows: int, tasks: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints link. marked: distinct pairs of node and fp; a node can have several.
    One node stands for each fingerprint, and the others of that fingerprint are paired with it."""
    hubs = marked.groupBy("fp").agg(F.min("node").alias("hub"))
    apart = fingerprint_links(hubs.select("fp"), most, run_rows, tasks)
    for end in ("a", "b"):
        apart = apart.join(hubs.withColumnRenamed("fp", end), end).drop(end).withColumnRenamed("hub", f"{end}_")
    both = apart.toDF("a", "b").unionByName(marked.join(hubs, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    return both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _distinct(blocks: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(blocks, dtype=">u8").astype(np.uint64)).view(np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    return _distinct(b"".join(shingle_hashes(words(text), size)))


def _similar(texts: DataFrame, pairs: DataFrame, named: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets of shingles reach the similarity. texts: text, _k1, _k2; named: node, _k1,
    _k2 of one text for each node."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t, size) for t in batch])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node")
    sets = texts.join(ends, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("node", shingles("text").alias("s"))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def shingle_counts(docs: DataFrame, size: int, blocks: int = 64) -> np.ndarray:
    """Number of texts by bucket of shingles. It decides the order of shingles alone, never the result."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, shingle_set(text, size) & (BUCKETS - 1), 1)
        yield pd.DataFrame({"block": range(blocks), "counts": [x.tobytes() for x in np.split(total, blocks)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [total.astype(np.int64).tobytes()]})

    schema = "block int, counts binary"
    out = np.zeros((blocks, BUCKETS // blocks), dtype=np.int64)
    for r in docs.select("text").mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect():
        out[r.block] = np.frombuffer(r.counts, dtype=np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def copy_signature(text: str | None, size: int, similarity: float, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(the fingerprint, two words that name the set of shingles, its size, its parity words) and its rarest shingles: of two
    sets that reach the similarity each has one among the other's, as a set that lacks all of them shares too few."""
    blocks = b"".join(shingle_hashes(words(text), size))
    fp, own = int.from_bytes(majority(iter([blocks]), 64).tobytes(), "big", signed=True), _distinct(blocks)
    name = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
    odd = np.packbits(np.bincount(own >> 24 & (PARITY_BITS - 1), minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.int64)
    rare = own[np.lexsort((own, counts[own & (BUCKETS - 1)]))]
    most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    return [fp, *name.tolist(), len(own), *odd.tolist()], rare[: most if len(own) else 0].copy()  # a view would hold all of them


_ROW = ["node", "n", "pos", *(f"b{i}" for i in range(PARITY_BITS // 64)), "root"]


def _possible(x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (_ROW) can reach the similarity, and how many shingles they differ in at least. Sizes, the places
    of the shared shingle, as that of the first one, and parities bound the shared part from above, without a loss."""
    n, m = x[..., 1], y[..., 1]
    gap = _distance(x[..., 3:-1], y[..., 3:-1])
    shared = np.minimum(n - x[..., 2], m - y[..., 2])
    able = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    able &= shared * (1 + similarity) >= similarity * (n + m) - 1e-6
    able &= gap * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6
    return able & ((x[..., -1] != y[..., -1]) | (x[..., -1] == 0)), gap


def _run_pairs(run: np.ndarray, similarity: float, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of a run: all of them, or each row's nearest."""
    step = max(1, (1 << 18) // len(run))
    for at in range(0, len(run), step):
        part = run[at : at + step]
        able, gap = _possible(part[:, None], run[None, :], similarity)
        here = np.arange(at, at + len(part))
        if nearest:
            able[np.arange(len(part)), here] = False
            best = np.where(able, gap, 1 << 30).argmin(axis=1)
            hit = able[np.arange(len(part)), best]
            yield part[hit, 0], run[best[hit], 0]
        else:
            i, j = np.nonzero(able & (np.arange(len(run))[None, :] > here[:, None]))
            yield part[i, 0], run[j, 0]


def _possible_pairs(similarity: float, run_rows: int | None, nearest: bool):
    """Over rows sorted by key: pairs (a, b) of each run that can reach the similarity; all of them, or with nearest those of
    runs of up to FEW_ROWS and of longer runs each row's nearest. With nearest, rows of longer runs follow with kind 1, to be
    compared in full, and those of runs of over run_rows with kind 2 instead."""
    columns = ["key", *_ROW]

    def emit(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        a, b = np.minimum(a, b), np.maximum(a, b)
        out = pd.DataFrame(np.unique(np.stack([a, b], axis=1), axis=0), columns=["a", "b"])
        out["kind"] = 0
        return out.assign(**dict.fromkeys(columns, 0))

    def left(keys: np.ndarray, rows: np.ndarray, kind: int) -> pd.DataFrame:
        out = pd.DataFrame(np.column_stack([keys, rows]), columns=columns)
        out.insert(0, "kind", kind)
        out.insert(0, "b", 0)
        out.insert(0, "a", 0)
        return out

    def close(keys: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        few = np.repeat(sizes <= FEW_ROWS, sizes)
        some_keys, some = keys[few], rows[few]
        active, d, xs, ys = np.arange(len(some)), 1, [], []
        while True:
            active = active[active + d < len(some)]
            active = active[some_keys[active] == some_keys[active + d]]
            if not len(active):
                break
            able, _ = _possible(some[active], some[active + d], similarity)
            xs.append(some[active[able], 0])
            ys.append(some[active[able] + d, 0])
            d += 1
        if xs:
            yield emit(np.concatenate(xs), np.concatenate(ys))
        for start, n in zip(starts[sizes > FEW_ROWS], sizes[sizes > FEW_ROWS], strict=True):
            run = rows[start : start + n]
            if nearest and run_rows and n > run_rows:
                yield left(keys[start : start + n], run, 2)
                continue
            if not nearest and run[0, -1] and (run[:, -1] == run[0, -1]).all():
                continue
            for x, y in _run_pairs(run, similarity, nearest):
                yield emit(x, y)
            if nearest:
                yield left(keys[start : start + n], run, 1)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts, long = np.zeros(0, dtype=np.int64), [], None
        for batch in batches:
            if not len(batch):
                continue
            now, rows = batch["key"].to_numpy(), batch[_ROW].to_numpy(dtype=np.int64)
            if long is not None:
                same = now == long
                if same.any():
                    yield left(now[same], rows[same], 2)
                    now, rows = now[~same], rows[~same]
                if not len(now):
                    continue
                long = None
            if len(keys) and now[-1] == keys[0]:  # all of one run
                keys, parts = np.concatenate([keys, now]), [*parts, rows]
            else:
                keys, rows = np.concatenate([keys, now]), np.concatenate([*parts, rows])
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                yield from close(keys[:cut], rows[:cut])
                keys, parts = keys[cut:], [rows[cut:]]
            if nearest and run_rows and len(keys) > max(run_rows, FEW_ROWS):
                yield left(keys, np.concatenate(parts), 2)
                long, keys, parts = keys[0], keys[:0], []
        if len(keys):
            yield from close(keys, np.concatenate(parts))

    schema = ", ".join(f"{c} long" for c in ["a", "b", "kind", *columns])
    return lambda rows: rows.select(*columns).repartition("key").sortWithinPartitions("key").mapInPandas(scan, schema)


def _tiles(rows: DataFrame, run_rows: int) -> DataFrame:
    """Rows of overlong runs under keys of pairs of tiles, so that any two rows of a run share a key, and about run_rows rows
    each."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    n = F.greatest(F.lit(2), F.ceil(F.col("k") * 2 / run_rows)).cast("long")
    tiled = rows.join(counts, "key").withColumn("tiles", n).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    # an end meets each other tile in a key; its own tile comes with every one of them
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).where("other <> tile")
    return dealt.withColumn("key", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))).select("key", *_ROW)


def without_near_copies(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY, run_rows: int = RUN_ROWS, most: int = 2) -> DataFrame:
    """docs without near copies: of each group linked by a similarity of their sets of shingles of ``size`` words, the row
    with the least doc_id stays (of rows with one doc_id, one of them; a null doc_id comes last). All columns are kept.

    Texts without a word are copies of each other. Repeated rows are copies. An empty table stays empty. Texts whose
    fingerprints link at ``most`` differing bits, as in near_duplicates, are checked by their sets, as a repeated shingle can
    decide all bits. Similar texts can have fingerprints further apart, and a link that fails can stand between two that are
    similar; so texts that share one of their rarest shingles, as any two that reach the similarity do, are checked too, and
    the groups are those of comparing all pairs. Of long runs of one shingle each text is first compared with its nearest
    one; then all pairs that are not linked yet.
    """
    columns = docs.columns
    tasks = tasks_for(docs.sparkSession, docs.count(), TASK_DOCS)
    write = lambda df, name: stored(df, name, tasks)
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, size))
    names = ["fp", "h0", "h1", "n", *_ROW[3:-1]]

    @F.pandas_udf(f"struct<{', '.join(f'{c}: long' for c in names)}, rare: array<long>>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [copy_signature(t, size, similarity, counts.value) for t in batch]
            out = pd.DataFrame([x for x, _ in own], columns=names, dtype="int64")
            out["rare"] = [x for _, x in own]
            yield out

    key = [F.xxhash64(F.lit(n), F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias(f"_k{n}") for n in (1, 2)]
    signed = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), *key, signature("text").alias("s"))
    sets = write(signed.select("id", "_k1", "_k2", "s.*"), "copies")
    best = F.min(F.struct("id", "_k1", "_k2")).alias("best")
    same = sets.groupBy("h0", "h1").agg(best, *(F.first(c).alias(c) for c in [*names[3:], "rare"]))
    nodes = write(same.withColumn("node", F.xxhash64("h0", "h1")), "nodes")
    marked = write(sets.select(F.xxhash64("h0", "h1").alias("node"), "fp").distinct(), "fps")
    discard(sets)
    keyed = nodes.select("node", "n", *_ROW[3:-1], F.lit(0).cast("long").alias("root"), F.posexplode("rare").alias("pos", "key"))
    named, texts = nodes.select("node", "best._k1", "best._k2"), docs.select("text", *key)

    linked = write(linked_texts(marked, most, run_rows, tasks), "linked")
    found = write(_possible_pairs(similarity, run_rows, True)(keyed), "near")
    overlong = found.where("kind = 2")
    if not overlong.isEmpty():
        found = found.unionByName(write(_possible_pairs(similarity, None, True)(_tiles(overlong, run_rows)), "near"))
    pairs = write(found.where("kind = 0").select("a", "b").unionByName(linked).distinct(), "pairs")
    edges = write(_similar(texts, pairs, named, size, similarity), "links")
    rest = found.where("kind = 1")
    if not rest.isEmpty():
        roots = components(edges, tasks).withColumnRenamed("root", "r")
        rooted = rest.drop("root").join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("root", F.coalesce("r", "node"))
        more = _possible_pairs(similarity, None, False)(rooted).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        edges = edges.unionByName(write(_similar(texts, write(more, "pairs"), named, size, similarity), "links"))
    member = components(edges, tasks).where("node <> root").withColumnRenamed("node", "member")
    rooted = nodes.select("node", "best").join(member, F.col("node") == F.col("member"), "left")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best._k1", "best._k2")
    return docs.select(*columns, *key).join(kept, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select(*columns).coalesce(tasks)

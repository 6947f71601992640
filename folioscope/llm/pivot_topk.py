"""Exact top-k by integer inner product with a pivot-distance index.

Vectors are lifted so that inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Every x' is keyed by its nearest pivot and its distance from it; runs of
neighbouring distances of one pivot form annuli of bounded size (a run that is too long because distances tie is split by
hash). A query first searches one annulus of its nearest pivot, which bounds its k-th score from below. It then visits only
annuli that the triangle inequality and the pivots' bisectors leave open; within one, sorted strips are expanded from the
query's own distance outwards until the bound closes them. Skipped annuli cannot hold a better or an equal score.

Pivots are fitted on a bounded sample (PIVOT_SAMPLE rows by hash); every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored
from folioscope.llm.vectors import collapse, finite, first_k, meet, rows_of

PIVOTS = 24
PIVOT_SAMPLE = 2048
RINGS = 64
ANNULUS = 2048
CHUNK = 4096
STRIP = 256
#: Products of components up to this size add up exactly in double precision for all practical lengths.
EXACT = float(1 << 20)
_FOUND = "query_row long, query_id long, vec_id long, score long"


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal from the sample's mean."""
    if not len(sample):
        return sample
    chosen = [int(np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lifted(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows with a component more, so that all have the norm sqrt(most)."""
    return np.concatenate([rows, np.sqrt(np.maximum(0, most - (rows**2).sum(axis=1)))[:, None]], axis=1)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0, squared))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers; beyond double precision in Python's integers, held to the range of a long."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: [[int(v) for v in row] for row in a]
    a, b, lim = whole(q), whole(x), (1 << 63) - 1
    return np.array([[max(-lim - 1, min(lim, sum(u * v for u, v in zip(r, s, strict=True)))) for s in b] for r in a], dtype=np.int64).reshape(len(a), len(b))


def search_annulus(queries: pd.DataFrame, annulus: pd.DataFrame, pivots: np.ndarray, most: float, k: int) -> pd.DataFrame:
    """The k best of one annulus for each query of a chunk. queries may have the k-th score found so far in ``least``."""
    out: list[pd.DataFrame] = []
    if len(queries) and len(annulus):
        vectors, dist = rows_of(annulus["v"]), annulus["dist"].to_numpy()
        x, ids, number = collapse(annulus["vec_id"].to_numpy(), vectors, k + 1)
        span = np.full(len(x), 0.0)  # all rows of one vector have one distance
        order0 = np.argsort(annulus["vec_id"].to_numpy(), kind="stable")
        _, inverse = np.unique(vectors[order0], axis=0, return_inverse=True)
        span[inverse.reshape(-1)] = dist[order0]
        order = np.argsort(span, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        x, span = x[order], span[order]
        number = place[number]
        by = np.argsort(number, kind="stable")
        ids, number = ids[by], number[by]
        first = np.searchsorted(number, np.arange(len(x) + 1))
        q = rows_of(queries["v"])
        own, row = queries["query_id"].to_numpy(), queries["query_row"].to_numpy()
        length = (q**2).sum(axis=1)
        at = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots[annulus["pivot"].iloc[0]][None, :])[:, 0]
        least = queries["least"].to_numpy(dtype=np.float64) if "least" in queries else np.full(len(q), -np.inf)
        least = np.where(np.isnan(least), -np.inf, least)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]
        strips = [(s, min(s + STRIP, len(x))) for s in range(0, len(x), STRIP)]
        gap = np.stack([np.maximum(0, np.maximum(span[a] - at, at - span[b - 1])) for a, b in strips], axis=1)
        bound = (length[:, None] + most - np.maximum(0, gap - 1e-6 * (1 + at[:, None])) ** 2) / 2
        turn = np.argsort(-bound, axis=1, kind="stable")
        for n in range(len(strips)):
            open_ = bound[np.arange(len(q)), turn[:, n]] >= least - 1e-6 * (1 + np.abs(least))
            open_ |= np.isinf(least)
            if not open_.any():
                break
            for s in np.unique(turn[open_, n]):
                mine = np.flatnonzero(open_ & (turn[:, n] == s))
                a, b = strips[s]
                score = _scores(q[mine], x[a:b])
                names, of = ids[first[a] : first[b]], number[first[a] : first[b]] - a
                for m, sc in zip(mine, score[:, of], strict=True):
                    good = (names != own[m]) & (sc >= least[m])
                    v, i = np.concatenate([held[m][0], sc[good]]), np.concatenate([held[m][1], names[good]])
                    pick = np.lexsort((i, -v))[:k]
                    held[m] = (v[pick], i[pick])
                    if len(pick) == k:
                        least[m] = max(least[m], float(v[pick[-1]]))
        for m, (v, i) in enumerate(held):
            out.append(pd.DataFrame({"query_row": row[m], "query_id": own[m], "vec_id": i, "score": v}))
    if not out:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "score")})
    return pd.concat(out).astype("int64")


class Index:
    """The annuli of the vectors of one length."""

    def __init__(self, vectors: DataFrame, dim: int, annulus: int = ANNULUS):
        """vectors: vec_id and v, components as whole numbers in double precision."""
        rows = vectors.where(F.size("v") == dim)
        sample = rows_of(rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(PIVOT_SAMPLE).toPandas()["v"])
        self.most = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))).first()[0] or 0.0) * (1 + 1e-12)
        self.pivots = choose_pivots(lifted(sample, self.most), PIVOTS)
        self.width = 2 * math.sqrt(self.most) / RINGS or 1.0
        pivots, most, width = self.pivots, self.most, self.width

        def key(batches):
            for batch in batches:
                d = _distances(lifted(rows_of(batch["v"]), most), pivots)
                near = d.argmin(axis=1)
                batch["pivot"], batch["dist"] = near.astype(np.int32), d[np.arange(len(d)), near]
                batch["ring"] = np.minimum(RINGS, batch["dist"] // width).astype(np.int32)
                yield batch[["vec_id", "v", "pivot", "dist", "ring"]]

        keyed = stored(rows.select("vec_id", "v").mapInPandas(key, "vec_id long, v array<double>, pivot int, dist double, ring int"), "keyed")
        # at most PIVOTS * (RINGS + 1) rows
        rings = sorted(tuple(r) for r in keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)), F.min("dist"), F.max("dist")).collect())
        self.annuli: list[tuple[int, int, float, float]] = []  # pivot, number of parts, least and greatest distance
        where: list[tuple[int, int, int, int]] = []
        size = 0
        for pivot, ring, n, lo, hi in rings:
            if self.annuli and self.annuli[-1][0] == pivot and size + n <= annulus:
                last = self.annuli[-1]
                self.annuli[-1] = (pivot, 1, last[2], max(last[3], hi))
                size += n
            else:
                self.annuli.append((pivot, -(-n // annulus), lo, hi))
                size = n
            where.append((pivot, ring, len(self.annuli) - 1, self.annuli[-1][1]))
        spark = vectors.sparkSession
        placed = spark.createDataFrame(where, "pivot int, ring int, annulus int, parts int")
        part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int")
        self.rows = keyed.join(F.broadcast(placed), ["pivot", "ring"]).select("vec_id", "v", "pivot", "dist", "annulus", part.alias("part"))

    def visits(self, batch: pd.DataFrame, home: bool) -> pd.DataFrame:
        """For each query the annuli to search: its home (the annulus of its nearest pivot that is nearest to it, first
        part), or all others that its bound ``least`` leaves open."""
        q = rows_of(batch["v"])
        d = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.pivots)
        length = (q**2).sum(axis=1)
        pivot, parts, lo, hi = (np.array(c) for c in zip(*self.annuli, strict=True))
        gap = np.maximum(0, np.maximum(lo[None, :] - d[:, pivot], d[:, pivot] - hi[None, :]))
        nearest = d[:, pivot].min(axis=1)  # among pivots that have rows
        at = np.where(d[:, pivot] > nearest[:, None], np.inf, gap).argmin(axis=1)
        rows, annulus, part = [], [], []
        if home:
            rows, annulus, part = np.arange(len(q)), at, np.zeros(len(q), dtype=np.int64)
        else:
            bisector = np.maximum(0, (d[:, pivot] - d.min(axis=1)[:, None]) / 2)
            least = batch["least"].to_numpy(dtype=np.float64)
            bound = (length[:, None] + self.most - np.maximum(0, np.maximum(gap, bisector) - 1e-6 * (1 + d[:, pivot])) ** 2) / 2
            open_ = np.isnan(least)[:, None] | (bound >= (least - 1e-6 * (1 + np.abs(least)))[:, None])
            for i, j in zip(*np.nonzero(open_), strict=True):
                for p in range(parts[j]):
                    if not (j == at[i] and p == 0):
                        rows.append(i)
                        annulus.append(j)
                        part.append(p)
        out = batch.iloc[np.asarray(rows, dtype=np.int64)][["query_row", "least"] if "least" in batch else ["query_row"]].copy()
        out["annulus"], out["part"] = np.asarray(annulus, dtype=np.int32), np.asarray(part, dtype=np.int32)
        return out

    def search(self, queries: DataFrame, k: int, home: bool, chunk: int) -> DataFrame:
        """The visitors of a part of an annulus are dealt into chunks of about ``chunk`` queries, and the part's rows are
        copied once for each; what no query visits is not shuffled."""
        pivots, most = self.pivots, self.most
        bound = ["least"] if "least" in queries.columns else []
        light = _Visits(self)
        schema = ", ".join(["query_row long", *(f"{c} double" for c in bound), "annulus int", "part int"])
        go = stored(queries.select("query_row", "v", *bound).mapInPandas(lambda batches: (light.visits(b, home) for b in batches if len(b)), schema), "visits")
        chunks = go.groupBy("annulus", "part").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
        mine = F.pmod(F.xxhash64("query_row", F.lit("chunk")), F.col("chunks")).cast("int").alias("chunk")
        left = go.join(chunks, ["annulus", "part"]).join(queries.select("query_row", "query_id", "v"), "query_row").select("query_row", "query_id", "v", *bound, "annulus", "part", mine)
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        right = self.rows.join(chunks, ["annulus", "part"]).select("vec_id", "v", "pivot", "dist", "annulus", "part", every)
        return meet(left, right, ["annulus", "part", "chunk"], lambda a, b: search_annulus(a, b, pivots, most, k), _FOUND)


class _Visits:
    """What workers need of an index to choose annuli."""

    def __init__(self, index: Index):
        self.pivots, self.most, self.annuli = index.pivots, index.most, index.annuli

    visits = Index.visits


def whole_numbers(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) of every vector that is whole and finite."""
    good = table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    v = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    return good.select("vec_id", v.alias("v"))


def _floor(x):
    """floor that stays in double precision, whatever the size."""
    cut = x - x % F.lit(1.0)
    return F.when(F.abs(x) >= 2.0**52, x).when(cut > x, cut - 1).otherwise(cut)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, annulus: int = ANNULUS, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score over tables of vec_id and embedding: each query's k highest inner products of vectors
    made whole numbers, ties to smaller vec_id.

    Null, empty and non-finite vectors and rows with a null vec_id take no part. Candidates are the rows of the query's
    length with another vec_id; repeated queries are answered once. An empty table gives an empty result.
    """
    rows, asked = whole_numbers(vectors), whole_numbers(queries).dropDuplicates(["vec_id"])
    spark = vectors.sparkSession
    parts = []
    for (dim,) in sorted(tuple(r) for r in asked.select(F.size("v")).distinct().collect()):
        index = Index(rows, dim, annulus)
        named = asked.where(F.size("v") == dim).select(F.col("vec_id").alias("query_row"), F.col("vec_id").alias("query_id"), "v")
        if not index.annuli:
            continue
        near = stored(index.search(named, k, True, chunk), "home")
        bound = near.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
        far = index.search(named.join(bound, "query_row", "left"), k, False, chunk)
        parts.append(first_k(near.unionByName(far), k, F.col("score").desc()))
    out = parts[0] if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

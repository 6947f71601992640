"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks and queries into chunks, both of bounded size. In each tile (a chunk and a block) vectors are
quantised to int8 codes, one scale for each side; the product of the code matrices gives all distances with an error bound
from the vectors' own quantisation residuals (Cauchy-Schwarz). A pair whose lower bound is over the k-th least upper bound
of its query cannot be among the tile's k nearest; surviving pairs are recomputed in double precision and a heap keeps
each query's k. The tiles' lists are merged for each query. Results are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.vectors import collapse, finite, first_k, meet, rows_of

BLOCK = 4096
CHUNK = 4096
_SCHEMA = "query_row long, query_id long, vec_id long, score double"


def quantised(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 codes, their scale, and each row's residual norm."""
    scale = float(np.abs(rows).max(initial=0.0)) / 127 or 1.0
    codes = np.rint(rows / scale).astype(np.int8)
    return codes, scale, np.linalg.norm(rows - codes * scale, axis=1)


def squared_bounds(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances of all pairs of rows."""
    (qc, qs, qr), (xc, xs, xr) = quantised(q), quantised(x)
    # float32 holds sums of int8 products exactly up to 2**24
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    products = (qc.astype(kind) @ xc.astype(kind).T).astype(np.float64) * (qs * xs)
    qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    error = qr[:, None] * xn[None, :] + (qn + qr)[:, None] * xr[None, :]
    middle = (qn**2)[:, None] + (xn**2)[None, :] - 2 * products
    slack = 2 * error + 1e-9 * ((qn**2)[:, None] + (xn**2)[None, :] + 1e-300)
    return middle - slack, middle + slack


def tile_nearest(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of the block for every query of the chunk, but its own row."""
    out: list[tuple] = []
    if len(queries) and len(block):
        x, ids, number = collapse(block["vec_id"].to_numpy(), rows_of(block["embedding"]), k + 1)
        named: list[list[int]] = [[] for _ in range(len(x))]
        for i, n in zip(ids.tolist(), number.tolist(), strict=True):
            named[n].append(i)
        q = rows_of(queries["embedding"])
        for at in range(0, len(q), 128):
            part = q[at : at + 128]
            low, high = squared_bounds(part, x)
            if high.shape[1] > k + 1:  # one more, as one may be the query itself
                limit = np.partition(high, k, axis=1)[:, k]
            else:
                limit = np.full(len(part), np.inf)
            for i in range(len(part)):
                row, own = int(queries["query_row"].iloc[at + i]), int(queries["query_id"].iloc[at + i])
                alive = np.flatnonzero(low[i] <= limit[i])
                exact = np.sqrt(((x[alive] - part[i]) ** 2).sum(axis=1))
                heap: list[tuple[float, int]] = []
                for d, j in zip(exact.tolist(), alive.tolist(), strict=True):
                    for vec in named[j]:
                        if vec == own:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (-d, -vec))
                        elif (-d, -vec) > heap[0]:
                            heapq.heapreplace(heap, (-d, -vec))
                out += [(row, own, -vec, -d) for d, vec in heap]
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype({"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) over tables of vec_id and embedding.

    Vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor do rows with a null
    vec_id; only vectors of the query's own length are its candidates, and no row of its own vec_id is. Repeated queries
    are answered once. An empty table, or a query without candidates, gives no rows.
    """
    good = lambda df: df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    vectors, asked = good(vectors).withColumn("dim", F.size("embedding")), good(queries).dropDuplicates(["vec_id"]).withColumn("dim", F.size("embedding"))
    blocks, chunks = max(1, -(-vectors.count() // block)), max(1, -(-asked.count() // chunk))
    mine = lambda n, name: F.pmod(F.xxhash64("vec_id", F.lit("deal")), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select(F.col("vec_id").alias("query_row"), F.col("vec_id").alias("query_id"), "embedding", "dim", mine(chunks, "chunk"), every(blocks, "block"))
    right = vectors.select("vec_id", "embedding", "dim", mine(blocks, "block"), every(chunks, "chunk"))
    found = meet(left, right, ["dim", "chunk", "block"], lambda a, b: tile_nearest(a, b, k), _SCHEMA)
    return first_k(found, k, F.col("score"))

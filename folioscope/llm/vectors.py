"""Vectors: which rows take part, blocks of bounded size, and joins of query chunks with blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector has components and all are numbers; false for null."""
    inf = F.lit(math.inf)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def rows_of(column: pd.Series) -> np.ndarray:
    """A matrix in double precision from a column of arrays of one length."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def collapse(ids: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, and of each its ids in order, ``keep`` of them at most, as a flat array with the number of the row.

    Equal vectors score alike and ties go to smaller ids, so that of one vector no more than k ids (and one that may be
    the query's own) can be among a query's first k.
    """
    order = np.argsort(ids, kind="stable")
    distinct, number = np.unique(rows[order], axis=0, return_inverse=True)
    number = number.reshape(-1)
    by_row = np.argsort(number, kind="stable")
    sorted_numbers = number[by_row]
    starts = np.searchsorted(sorted_numbers, np.arange(len(distinct)))
    rank = np.arange(len(by_row)) - starts[sorted_numbers]
    few = by_row[rank < keep]
    return distinct, ids[order][few], number[few]


def meet(queries: DataFrame, blocks: DataFrame, on: list[str], tile: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """tile(queries, vectors) for every value of ``on``; both sides are bounded by the caller's choice of ``on``."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return tile(left, right)

    return queries.groupBy(*on).cogroup(blocks.groupBy(*on)).applyInPandas(run, schema)


def first_k(found: DataFrame, k: int, best: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k first of each query by best, ties to smaller vec_id; repeated finds count once
    for each row of the table that they stand for."""
    w = Window.partitionBy("query_row").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

import duckdb
import numpy as np
import pytest

from folioscope.llm import block_neighbours, pivot_topk, queries

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0, 4) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int, score double, query_id int")


def usable(rows, zero):
    return {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}


def plain_top(rows, asked, k):
    own = {i: [int(np.floor(256 * x)) for x in v] for i, v in usable(rows, True).items()}
    out = []
    for q in sorted(set(asked) & set(own)):
        scored = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def plain_near(rows, asked, k):
    own, out = usable(rows, False), []
    for q in sorted(set(asked) & set(own)):
        near = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return out


def result(df):
    return sorted(tuple(r) for r in df.collect())


EDGE = (
    [(i, [float(i % 3), 1.0, -2.0]) for i in range(40)]
    + [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (106, [1.0, 2.0]), (107, [2.0, 1.0]), (108, [0.001] * 3)]
)


@pytest.mark.parametrize("size", [3, 4096])
def test_edges(spark, size):
    d = vectors(spark, EDGE)
    asked = [0, 5, 10, 100, 102, 103, 105, 106, 108]
    some = d.where(d.vec_id.isin(asked))
    assert result(pivot_topk.top_k(d, some, 5, annulus=size, chunk=size)) == plain_top(EDGE, asked, 5)
    assert result(block_neighbours.nearest(d, some, 10, block=size, chunk=size)) == plain_near(EDGE, asked, 10)
    empty = vectors(spark, [])
    assert pivot_topk.top_k(empty, empty).count() == block_neighbours.nearest(empty, empty).count() == 0
    assert pivot_topk.top_k(d.where("vec_id = 0"), d.where("vec_id = 0")).count() == 0


def test_clusters_and_scales(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 8)) * 3
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rnd.normal(size=8) * 0.05)]) for i in range(300)] + [(400, [3000.0] * 8), (401, [-3000.0] * 8), (402, [1e-6] * 8)]
    d, asked = vectors(spark, rows), [0, 50, 100, 150, 200, 250, 400, 402]
    some = d.where(d.vec_id.isin(asked))
    assert result(pivot_topk.top_k(d, some, 5, annulus=20, chunk=3)) == plain_top(rows, asked, 5)
    assert result(block_neighbours.nearest(d, some, 10, block=64, chunk=3)) == plain_near(rows, asked, 10)


def test_huge_components(spark):
    rows = [(i, [1e30 * (i + 1), 1.0]) for i in range(6)]
    got = pivot_topk.top_k(vectors(spark, rows), vectors(spark, rows[:1]), 2).collect()
    assert len(got) == 2 and all(r.score == (1 << 63) - 1 for r in got)


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    q, x = rnd.normal(size=(20, 64)), rnd.normal(size=(50, 64)) * 5
    low, high = block_neighbours.squared_bounds(q, x)
    exact = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()


def test_queries_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids = [i for i, _ in rows]
    assert result(queries.op4_pivot_topk(spark, SF)) == plain_top(rows, [i for i in ids if i % 50 == 0], 5)
    assert result(queries.op10_block_neighbours(spark, SF)) == plain_near(rows, [i for i in ids if i % 100 == 0], 10)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert result(queries.QUERIES[name](spark, SF).select(*columns)) == sorted(want.fetchall())

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import vector_topk as V


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
            out.update({(i, r): (j, -s) for r, (s, j) in enumerate(best, 1)})
    return out


def test_repeated_rows_and_ids(spark):
    """Copies of a row count as rows; a query leaves out its own id however often it is there; an id of two vectors asks twice."""
    same = [0.5, 0.25]
    rows = [(10, same)] * 7 + [(3, same)] * 2 + [(4, [0.5, 0.0]), (20, same), (20, [0.0, 0.5])]
    got = sorted(tuple(r) for r in V.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, part_rows=3).collect())
    q = lambda a, b: int(256 * a[0]) * int(256 * b[0]) + int(256 * a[1]) * int(256 * b[1])
    want = []
    for i, v in {(i, tuple(v)) for i, v in rows if i % 10 == 0}:
        best = sorted((-q(v, x), j) for j, x in rows if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_far_parts_are_left_out(spark):
    """Tight clusters: the second pass sends a query to few parts."""
    rng = np.random.RandomState(2)
    centre = rng.randn(12, 16)
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = (centre[np.arange(2400) % 12] + 0.01 * rng.randn(2400, 16)).astype(np.float32)
    pivots = np.concatenate([np.floor(256 * centre), np.zeros((12, 1))], axis=1)
    v = np.floor(256 * x.astype(np.float64))
    limit = float((v * v).sum(axis=1).max())
    lift = np.sqrt(limit - (v * v).sum(axis=1))
    d = V.distances(v, lift, pivots)
    own = d.argmin(axis=1)
    parts = V.Parts([(p, 0, d[own == p, p].min(), d[own == p, p].max(), 1) for p in range(12)], pivots)
    kth = np.sort(v[:24] @ v.T, axis=1)[:, -6].astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(24)), pa.array(np.ones(24, np.int32)), pa.array([r.astype(np.int64).tolist() for r in v[:24]], pa.list_(pa.int64())), pa.array(kth)], names=["query_id", "qn", "q", "kth"])
    sent = sum(b.num_rows for b in V.route(parts, 16, limit, False)([batch]))
    assert sent < 24 * 11 / 4
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    got = V.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, part_rows=100, n_pivots=12).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute(rows, 5, 100)


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5]) for i in range(3000)] + [(5000, [0.5, 0.25])]
    got = V.top_k(frame(spark, rows), F.col("vec_id") % 1000 == 0, part_rows=50).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute(rows, 5, 1000)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")


@pytest.mark.parametrize("options", [{}, {"n_pivots": 3, "part_rows": 20, "query_rows": 4, "ring": 4}, {"n_pivots": 1, "ring": 1}])
def test_equals_brute_force(spark, options):
    rng = np.random.RandomState(6)
    x = (rng.randn(4, 8)[rng.randint(0, 4, 150)] + 0.3 * rng.randn(150, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[3].tolist()) for i in range(40)] + [(300, [0.0] * 8), (301, None), (302, [float("nan")] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (305, [])]
    got = V.top_k(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, **options).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute(rows, 5, 10)


def test_few_and_none(spark):
    rows = [(0, [0.5, 0.5]), (10, [0.5, -0.5]), (3, [0.25, 0.0])]
    got = V.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == brute(rows, 5, 10)
    assert V.top_k(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert V.top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 10 == 0).count() == 0

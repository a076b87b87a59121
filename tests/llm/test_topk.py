import numpy as np
import pytest
from pyspark.sql import functions as F

from textbarge.llm import topk


def brute(rows, k, every):
    fits = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(fits):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(fits) if m != n and len(v) == len(q))
            out += [(i, r, j, max(-2**63, min(-s, 2**63 - 1))) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def search(spark, rows, k=5, every=5):
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    return sorted(map(tuple, topk.top_k(table, F.col("vec_id") % every == 0, k=k).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("kind", ["unit", "clustered", "lengths", "axis"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 8))
    if kind == "clustered":
        v = rng.normal(size=(10, 8))[rng.integers(0, 10, 500)] + rng.normal(size=(500, 8)) * 0.05
    if kind == "axis":
        v = np.eye(8)[rng.integers(0, 8, 500)] + rng.normal(size=(500, 8)) * 0.02
    if kind != "lengths":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    else:
        v *= rng.lognormal(0, 1.5, (500, 1))
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    assert search(spark, rows) == brute(rows, 5, 5)


def test_awkward_rows(spark):
    same = [0.5, 0.25]
    rows = [(0, same), (5, same), (1, same), (1, same), (1, [0.1, 0.1]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (None, same),
            (-5, [-0.5, -0.25]), (15, []), (16, []), (20, [1.0, 2.0, 3.0]), (25, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [1e12, 1.0]), (8, [2e7, 0.0]), (30, [-1.0, 0.001])]
    assert search(spark, rows) == brute([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 5)
    assert search(spark, []) == []
    assert search(spark, [(0, same)]) == []


def test_repeated_ids_are_rows(spark):
    rows = [(1, [0.9, 0.0]), (1, [0.8, 0.0]), (5, [1.0, 0.0]), (5, [0.5, 0.0]), (2, [0.7, 0.0])]
    got = search(spark, rows)
    assert got == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5, 5)
    assert sorted(r[2] for r in got if r[3] > 100 * 256) and len(got) == 8


def test_products_beyond_doubles():
    v = np.array([[2**31 - 1] * 8, [2**31 - 2] * 8], np.int64)
    q = np.array([3, 1, 0, 0, 0, 0, 0, 2], np.int64) * 2**20
    assert topk._products(v, q).tolist() == [int(sum(int(a) * int(b) for a, b in zip(r, q))) for r in v]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidspan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"rank": F.lit(1), "score": F.lit("x")})
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **how).collect())


def test_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PACK", 32)
    monkeypatch.setattr(topk, "QUERY_PACK", 3)
    r = np.random.default_rng(2)
    rows = [(k, r.normal(0, 0.3, 8).tolist()) for k in range(400)]
    same = rows[7][1]
    rows += [(k, same) for k in range(400, 600)]  # far more ties than k
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, same), (1200, []), (1250, [1.0, 2.0]), (1251, [0.5, 1.0]), (1300, [0.0] * 8)]
    assert found(spark, rows) == brute(rows)


def test_few_candidates_and_bins(spark):
    rows = [(k, [float(k), 1.0]) for k in (0, 1, 2, 50)]
    assert found(spark, rows, bins=4) == brute(rows)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
    with pytest.raises(ValueError):
        found(spark, [(0, [1e12]), (1, [1e12])])


def test_large_products_are_exact(spark):
    rows = [(k, [3e5 + k, 2e5 - k, float(k)]) for k in range(120)]
    assert found(spark, rows) == brute(rows)


def _plans(spark):
    """Physical plans of all executions of the session so far."""
    list_ = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [list_.apply(k).physicalPlanDescription() for k in range(list_.size())]


def test_copies_of_queries_are_not_gathered_on_the_driver(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(0, 0.3, 8).tolist()) for k in range(300)]
    before = len(_plans(spark))
    assert found(spark, rows) == brute(rows)
    made = [p for p in _plans(spark)[before:] if "explode(" in p]
    assert made and not any("BroadcastExchange" in p for p in made)


def test_a_task_sends_only_bins_that_can_hold_the_kth_score():
    import pyarrow as pa

    r = np.random.default_rng(5)
    q, packs = r.integers(-99, 99, (6, 8)).astype(np.int16), [r.integers(-99, 99, (50, 8)).astype(np.int16) for _ in range(4)]
    ids = np.arange(100, 300).reshape(4, 50)
    low, need = np.full(6, -(8 * 99**2)), np.full(6, 3)
    given = {
        "dim": [8] * 4, "block": [0] * 4, "deal": [0] * 4, "qids": [np.arange(6).tobytes()] * 4, "q": [q.tobytes()] * 4,
        "low": [low] * 4, "need": [need] * 4, "ids": [i.tobytes() for i in ids], "m": [m.tobytes() for m in packs],
    }
    sent = pa.Table.from_batches(topk._counter(64, 4096)(iter([pa.RecordBatch.from_pydict(given)]))).to_pylist()
    scores = q.astype(int) @ np.concatenate(packs).astype(int).T
    for k in range(6):
        bins, n = np.unique((scores[k] - low[k]) // 64, return_counts=True)
        least = bins[np.flatnonzero(np.cumsum(n[::-1])[::-1] >= 3)[-1]]
        assert {x["bin"]: x["n"] for x in sent if x["query_id"] == k} == {b: c for b, c in zip(bins.tolist(), n.tolist()) if b >= least}

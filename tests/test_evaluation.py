import pytest
from pyspark.sql import functions as F

from bidspan.functions.scoring import relative_gain
from bidspan.operators import aggregates as ag
from bidspan.plans import evaluation as ev
from bidspan.plans import vectors as vx

GRADES = {"a": 3, "b": 2, "c": 0, "d": 1}


def run_of(spark, items, query="q"):
    return spark.createDataFrame([(query, i, r) for r, i in enumerate(items, 1)], "query_id string, item_id string, rank int")


def judged(spark, grades=None, query="q"):
    return spark.createDataFrame([(query, i, g) for i, g in (grades or GRADES).items()], "query_id string, item_id string, grade int")


def ndcg(spark, items, grades=None, **kw):
    row = ev.ndcg(run_of(spark, items), judged(spark, grades), **kw).first()
    return row["ndcg"], row["unjudged"]


def test_ndcg_worked_values(spark):
    assert ndcg(spark, ["b", "a", "c", "d"])[0] == pytest.approx(0.835448, abs=1e-6)
    assert ndcg(spark, ["a", "b", "d"])[0] == pytest.approx(1.0)
    assert ndcg(spark, ["x", "a"])[0] == pytest.approx(0.470202, abs=1e-6) and ndcg(spark, ["x", "a"])[1] == 1
    assert ndcg(spark, ["x", "a"], unjudged="condensado")[0] == pytest.approx(0.745253, abs=1e-6)
    assert ndcg(spark, ["a"], {"a": 0, "b": 0})[0] is None
    assert ndcg(spark, ["x"], GRADES)[0] == 0
    late = [f"z{i}" for i in range(10)]
    assert ndcg(spark, late)[0] == ndcg(spark, [*late, "a"])[0] == 0


def test_reciprocal_rank(spark):
    rr = lambda items, g=None: ev.reciprocal_rank(run_of(spark, items), judged(spark, g)).first()["rr"]
    assert rr(["c", "d", "b"]) == pytest.approx(1 / 3)
    assert rr(["c", "d"]) == 0
    assert rr(["c"], {"c": 0, "d": 1}) is None


@pytest.mark.parametrize(
    "a, b, value",
    [
        ([0, 1, 2, 3], [0, 1, 2, 3], 1.0), ([0, 1, 2, 3], [3, 2, 1, 0], -1.0), ([0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 1, 2, 2, 3, 3, 3], 0.85),
        ([0, 1, 2, 3, 3, 2], [0, 1, 2, 2, 3, 1], 0.846154), ([2, 2, 2], [2, 2, 2], None),
    ],
)
def test_kappa(spark, a, b, value):
    got = ev.kappa(spark.createDataFrame(list(zip(a, b)), "rating_a int, rating_b int")).first()
    assert got["kappa"] == (None if value is None else pytest.approx(value, abs=1e-6))
    assert got["exact_agreement"] == pytest.approx(sum(x == y for x, y in zip(a, b)) / len(a))


def test_relative_gain(one):
    assert one(relative_gain, 0.5, 0.55) == pytest.approx(0.1)
    assert one(relative_gain, 0.0, 0.3) is None


def test_bootstrap_is_seeded_and_ordered(spark):
    pairs = spark.createDataFrame([(i, 0.4 + i / 200, 0.5 + (i * 7 % 13) / 50) for i in range(50)] + [(99, None, 1.0)], "query_id int, base double, candidate double")
    one, two = [ev.bootstrap(pairs, 300, "s").first() for _ in range(2)]
    assert one == two and one["low"] <= one["estimate"] <= one["high"]
    same = spark.createDataFrame([(i, 0.709810, 1.0) for i in range(100)], "query_id int, base double, candidate double")
    flat = ev.bootstrap(same, 100, "s").first()
    assert flat["low"] == pytest.approx(flat["high"]) and flat["estimate"] == pytest.approx(0.408828, abs=1e-5)


def test_segments_and_gate(spark):
    scores = spark.createDataFrame([(i, "sigla" if i < 10 else "erro", 0.5, 0.4 if i < 10 else 0.9) for i in range(19)], "query_id int, segment string, base double, candidate double")
    got = {r["segment"]: r["reason"] for r in ev.segments(scores).collect()}
    assert got == {"sigla": "regressão no segmento", "erro": "segmento insuficiente"}
    m = spark.createDataFrame([(99, None)], "n int, gain double")
    row = ev.gate(m, [(F.col("n") >= 100, "poucas"), (F.col("gain") >= 0.1, "ganho"), (F.lit(True), "nunca")]).first()
    assert row["reasons"] == ["poucas", "ganho"] and row["pass"] is False


def test_fusion_worked_values(spark):
    lists = [spark.createDataFrame([(i, r) for r, i in enumerate(ids, 1)], "bid_id string, rank int") for ids in (["a", "b"], ["b", "c"])]
    got = {r["bid_id"]: r["rrf_score"] for r in vx.fuse_rrf([(lists[0], 1.0), (lists[1], 1.0)]).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["c"] == pytest.approx(1 / 62)


def test_latency_summary_nearest_rank(spark):
    s = ag.latency_summary(spark.createDataFrame([(v,) for v in range(1, 101)], "ms long"), "ms").first()
    assert (s["n"], s["p50"], s["p95"], s["p99"], s["min"], s["max"], s["mean"]) == (100, 50, 95, 99, 1, 100, 51)
    empty = ag.latency_summary(spark.createDataFrame([], "ms long"), "ms").first()
    assert empty["p50"] is None and empty["max"] is None
    odd = spark.createDataFrame([(-3.5,), (0.0,), (0.25,), (7.0,)], "ms double")
    assert ag.latency_summary(odd, "ms").first()["p50"] == 0.0

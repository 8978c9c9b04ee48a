"""Operators that spread one key over slices, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from bidspan.operators import aggregates as ag
from bidspan.operators import windows as wn
from bidspan.plans import vectors as vx

KINDS = "timeouts int, e429 int, e5xx int, other int"


def test_health_of_one_job_with_nearly_all_calls(spark):
    r = random.Random(2)
    rows = []
    for i in range(2000):
        job = 1 if r.random() < 0.9 else r.randint(2, 6)
        good = r.random() < (0.02 if job == 1 else 0.5) and job != 6
        rows.append((job, i, f"2026-03-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:00:00", good, r.randint(1, 500), 0, 1, 0, -1))
    rows.append((7, 9000, "2026-03-01 00:00:00", True, 5, 1, None, 0, 0))
    df = spark.createDataFrame(rows, f"job_id int, event_id int, at string, ok boolean, latency_ms int, {KINDS}").withColumn("ts", F.col("at").cast("timestamp"))
    jobs = defaultdict(list)
    for x in rows:
        jobs[x[0]].append(x)
    want = {}
    for job, calls in jobs.items():
        calls.sort(key=lambda x: (x[2], x[1]))
        streak = 0
        for x in calls:
            streak = 0 if x[3] else streak + 1
        want[job] = (len(calls), sum(x[3] for x in calls), sum(x[4] for x in calls), max(x[4] for x in calls), streak)
    found = {x["job_id"]: (x["requests"], x["succeeded"], x["latency_total_ms"], x["latency_max_ms"], x["consecutive_failures"]) for x in ag.api_health(df).collect()}
    assert found == want
    plan = ag.api_health(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_spans_of_one_document_over_many_slices(spark):
    r = random.Random(3)
    spans = [("a", s, s + r.choice([0, 3, 40])) for s in (r.randint(0, 4000) for _ in range(800))]
    spans += [("a", 5000, 9000), ("a", 5100, 5200), ("a", 9000, 9001), ("a", 9002, 9003), ("b", -50, -10), ("b", -10, 5), (None, 1, 2), (None, 2, 7), ("c", 3, 3)]
    want = []
    for doc in ("a", "b", "c", None):
        held = None
        for _, s, e in sorted(x for x in spans if x[0] == doc):
            if held and s <= held[1]:
                held[1] = max(held[1], e)
            else:
                held = [s, e]
                want.append((doc, held))
    df = spark.createDataFrame(spans, "doc string, start int, end int").repartition(5)
    for width in (7, 100, 10**6):
        found = {(x["doc"], x["start"], x["end"]) for x in wn.interval_merge(df, ["doc"], width=width).collect()}
        assert found == {(d, s, e) for d, (s, e) in want}


def test_places_in_groups(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 1, 2, None]), r.choice(["x", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o string, i int").repartition(6)
    found = {x["i"]: x["place"] for x in wn.rank_in_group(df, ["g"], ["o", "i"], "place").collect()}
    for g in (1, 2, None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, x[1] or "", x[2]))
        assert [found[x[2]] for x in mine] == list(range(1, len(mine) + 1))


def test_the_scan_keeps_k_items_of_each_owner(spark):
    r = random.Random(5)
    rows = [(i, i % 3, [r.choice([0.0, 1.0, 2.0]), 1.0, r.random()]) for i in range(300)]
    items = spark.createDataFrame(rows, "chunk_id int, bid_id int, embedding array<double>").coalesce(1)
    query = spark.createDataFrame([(1, [1.0, 1.0, 0.5])], "query_id int, embedding array<double>")
    every = vx.distances(items, query, "chunk_id", None, owner="bid_id", each=10**6).collect()
    few = vx.distances(items, query, "chunk_id", None, owner="bid_id", each=4).collect()
    assert len(every) == 300 and len(few) == 12
    for bid in range(3):
        want = sorted((x["distance"], x["chunk_id"]) for x in every if x["bid_id"] == bid)[:4]
        assert sorted((x["distance"], x["chunk_id"]) for x in few if x["bid_id"] == bid) == want


def test_counts_under_thresholds(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], [1, 2] if i % 5 == 0 else None) for i in range(200)] + [(900, [0.0] * 4, [1]), (901, None, None)]
    items = spark.createDataFrame(rows, "item_id int, embedding array<double>, known array<int>").repartition(3)
    queries = spark.createDataFrame([(q, [r.gauss(0, 1) for _ in range(4)]) for q in (1, 2, 3)], "query_id int, embedding array<double>")
    far = {(x["query_id"], x["item_id"]): x["distance"] for x in vx.distances(items, queries, "item_id", None).collect()}
    told = {i: set(k or ()) for i, _, k in rows}
    limits = [0.1, 0.7, 1.2]
    want = {(q, t): sum(d < t for (p, i), d in far.items() if p == q and q not in told[i]) for q in (1, 2, 3) for t in limits}
    found = {(x["query_id"], x["threshold"]): x["extra"] for x in vx.counts_under(items, queries, limits, "known").collect()}
    assert found == {k: n for k, n in want.items() if n}

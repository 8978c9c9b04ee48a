import random

from pyspark.sql import functions as F

from bidspan.functions import pieces
from bidspan.operators import windows
from bidspan.plans import extraction as ex

random.seed(7)
TEXTS = [
    "", " ", "curto", "x" * 5000, " ".join("palavra" for _ in range(900)), ("linha de texto\n" * 700) + "fim",
    "".join(random.choice("abc  \né😀") for _ in range(4000)),
]


def rows(spark, make):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return {r["i"]: r["v"] for r in df.select("i", make(F.col("t")).alias("v")).collect()}


def test_chunks_cover_the_text_and_always_move(spark):
    for size, lap in ((1500, 200), (100, 90), (50, 80), (1, 0)):
        got = rows(spark, lambda c, s=size, o=lap: pieces.chunk_overlap(c, s, o))
        for i, text in enumerate(TEXTS):
            body = text.strip()
            assert all(0 < len(p) <= size for p in got[i])
            assert bool(got[i]) == bool(body)
            if body:
                assert body.startswith(got[i][0]) and body.endswith(got[i][-1])


def test_chunk_cap_is_opt_in(spark):
    assert len(rows(spark, lambda c: pieces.chunk_overlap(c, 100, 20))[3]) > 40
    assert len(rows(spark, lambda c: pieces.chunk_overlap(c, 100, 20, pieces.MAX_CHUNKS))[3]) == 40


def test_blocks_rebuild_the_text(spark):
    for cap in (2, 17, 1000, 12000):
        got = rows(spark, lambda c, n=cap: pieces.split_lossless(c, n))
        for i, text in enumerate(TEXTS):
            assert "".join(got[i]) == text and all(0 < len(b) <= cap for b in got[i])


def test_anchor_spans(spark):
    df = spark.createDataFrame([("Prazo de entrega: 5 dias. E-mail: a@b.gov.br, fone: (11) 91234-5678",)], "t string")
    spans = df.select(pieces.anchor_spans(F.col("t")).alias("s")).first()["s"]
    assert {s["pattern"] for s in spans} == {0, 4, 5}


def test_packing_equals_a_plain_loop(spark):
    data = [(b, o, random.randint(1, 50)) for b in range(40) for o in range(random.randint(1, 30))]
    df = spark.createDataFrame(data, "bid_id long, ord int, length int").repartition(5)
    got = {(r["bid_id"], r["ord"]): r["batch"] for r in ex.pack_batches(df, 60).collect()}
    for b in range(40):
        used = number = 0
        first = True
        for _, o, n in [d for d in data if d[0] == b]:
            if not first and used + n > 60:
                used, number = 0, number + 1
            used, first = used + n, False
            assert got[(b, o)] == number


def test_budget_equals_a_plain_loop(spark):
    data = [(b, d, o, random.randint(1, 40)) for b in range(30) for d in range(4) for o in range(random.randint(1, 6))]
    df = spark.createDataFrame(data, "bid_id long, doc_order int, ord int, length int").repartition(5)
    got = {(r["bid_id"], r["doc_order"], r["ord"]): r["kept"] for r in ex.running_budget(df, 100).collect()}
    for b in range(30):
        used, stop = 0, False
        for d in range(4):
            closed = False
            for _, _, o, n in [x for x in data if x[0] == b and x[1] == d]:
                fits = not stop and not closed and used + n <= 100
                closed = closed or not fits
                used += n if fits else 0
                assert got[(b, d, o)] == fits
            stop = stop or used >= 100


def test_interval_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2), (2, 3, 3)], "d int, start int, end int")
    got = sorted(tuple(r) for r in windows.interval_merge(df, ["d"]).select("d", "start", "end").collect())
    assert got == [(1, 0, 7), (1, 8, 9), (2, 3, 3)]


def test_failure_streak_across_days(spark):
    calls = [(1, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i, i not in (0, 9)) for i in range(12)]
    bad = [(j, t, e, not ok) for j, t, e, ok in calls]
    df = spark.createDataFrame(bad, "job_id int, t string, event_id int, ok boolean").withColumn("ts", F.col("t").cast("timestamp"))
    got = [r["streak"] for r in windows.failure_streak(df).orderBy("event_id").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 0, 1, 2]


def test_global_rank_equals_row_number(spark):
    data = [(i, random.choice([None, 1.0, 2.0, 3.0])) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v double")
    got = {r["id"]: r["rank"] for r in windows.global_rank(df, ["v", "id"], [False, True]).collect()}
    want = sorted(data, key=lambda d: (d[1] is None, -(d[1] or 0), d[0]))
    assert all(got[d[0]] == i for i, d in enumerate(want, 1))


def test_slices_of_a_batch_are_cut_as_one(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 10)
    rows = [(1, "abc def ghi"), (2, None), (3, ""), (4, "x" * 25), (5, "y z")]
    out = spark.createDataFrame(rows, "k int, text string").coalesce(1).select("k", pieces.chunk_overlap(F.col("text"), 10, 2).alias("c"))
    got = {r.k: r.c for r in out.collect()}
    assert got[2] is None and got[3] == [] and got[5] == ["y z"] and got[4] == ["x" * 10, "x" * 10, "x" * 9] and got[1][0] == "abc def gh"

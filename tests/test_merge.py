import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from bidspan.operators import aggregates as ag
from bidspan.operators import filters as fl
from bidspan.operators import merge as mg
from bidspan.operators import windows
from bidspan.sources import readers


def clock():
    return F.lit("2026-09-20 12:00:00").cast("timestamp")


CATALOG = """control_no string, object string, closes_at timestamp, updated_at_source timestamp, source_hash string, seen_at timestamp,
team_status string, priority boolean, notes string, accessed_at timestamp, created_at timestamp, changed_at timestamp, synced_at timestamp"""
BATCH = "control_no string, object string, closes_at timestamp, updated_at_source timestamp, source_hash string, seen_at timestamp, position long"


def day(n):
    return dt.datetime(2026, 9, n, tzinfo=dt.timezone.utc)


def batch(spark, *rows):
    return spark.createDataFrame([(k, o, c, u, h, None, i) for i, (k, o, c, u, h) in enumerate(rows)], BATCH)


def empty(spark):
    return spark.createDataFrame([], CATALOG)


def state(df):
    cols = ["control_no", "object", "source_hash", "team_status", "priority", "notes"]
    return sorted(tuple(r) for r in df.select(cols).collect())


A = ("A", "obra a", day(30), day(1), "h1")
B = ("B", "obra b", day(30), day(2), "h1")
A_NEW = ("A", "obra a revista", day(30), day(5), "h2")
A_OLD = ("A", "obra a antiga", day(30), day(1), "h0")


def apply(spark, catalog, *rows, policy="todas"):
    return mg.merge_catalog(catalog, batch(spark, *rows), policy, clock())


def test_replay_is_a_no_op(spark):
    first = mg.result(apply(spark, empty(spark), A, B))
    again = apply(spark, first, A, B)
    assert state(mg.result(again)) == state(first)
    assert {r["action"] for r in again.collect()} == {"ignorado"}
    assert mg.history(again, clock()).count() == 0


def test_late_version_loses_and_team_fields_survive(spark):
    base = mg.result(apply(spark, empty(spark), A, B))
    team, log = mg.merge_team_fields(
        base.withColumn("bid_id", F.col("control_no")),
        spark.createDataFrame([("A", "interessante", True, "ligar", "Status alterado")], "bid_id string, team_status string, priority boolean, notes string, entry string"),
        clock(),
    )
    newer = mg.result(apply(spark, team.drop("bid_id"), A_NEW))
    late = apply(spark, newer, A_OLD)
    rows = {r["control_no"]: r for r in late.collect()}
    assert rows["A"]["object"] == "obra a revista" and rows["A"]["action"] == "ignorado"
    assert (rows["A"]["team_status"], rows["A"]["priority"], rows["A"]["notes"]) == ("interessante", True, "ligar")
    assert rows["B"]["action"] is None and log.count() == 1


def test_equal_version_with_new_content_wins(spark):
    base = mg.result(apply(spark, empty(spark), A))
    same_time = ("A", "obra a corrigida", day(30), day(1), "h9")
    assert apply(spark, base, same_time).first()["action"] == "atualizado"


def test_batch_order_does_not_matter(spark):
    outcomes = {str(state(mg.result(apply(spark, empty(spark), *p)))) for p in itertools.permutations([A, A_NEW, A_OLD])}
    assert len(outcomes) == 1 and "revista" in outcomes.pop()


def test_batches_in_any_order_agree(spark):
    results = set()
    for order in itertools.permutations([A, A_NEW, A_OLD]):
        cat = empty(spark)
        for r in order:
            cat = mg.result(apply(spark, cat, r))
        results.add(str([(s[0], s[1]) for s in state(cat)]))
    assert results == {"[('A', 'obra a revista')]"}


def test_admission_counts(spark):
    known = mg.result(apply(spark, empty(spark), ("K", "velha", day(1), day(1), "h1")))
    merged = apply(spark, known, ("K", "velha 2", day(1), day(2), "h2"), ("C", "fechada", day(1), day(1), "h"), ("N", "sem prazo", None, day(1), "h"), policy="abertas")
    counts = ag.merge_counters(merged).first()
    assert (counts["received"], counts["admitted"], counts["refused"], counts["new"], counts["updated"], counts["ignored"]) == (3, 2, 1, 1, 1, 0)
    assert {r["control_no"] for r in mg.result(merged).collect()} == {"K", "N"}
    with pytest.raises(ValueError):
        apply(spark, known, A, policy="qualquer")


def test_unchanged_rows_still_count_as_seen(spark):
    first = mg.result(apply(spark, empty(spark), A)).withColumns({"synced_at": F.lit("2020-01-01").cast("timestamp"), "changed_at": F.lit("2020-01-01").cast("timestamp")})
    row = apply(spark, first, A).first()
    assert row["synced_at"].year == 2026 and row["changed_at"].year == 2020


def test_page_ledger(spark):
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4, 6, 7)] + [(2, 1), (3, 5), (4, 2)], "segment_id int, page int")
    ledger = spark.createDataFrame([(1, 3), (3, 4), (4, 2)], "segment_id int, next_page int")
    got = {(r["segment_id"], r["page"]): r["decision"] for r in mg.page_ledger(pages, ledger).collect()}
    assert got == {(1, 1): "pular", (1, 2): "pular", (1, 3): "aplicar", (1, 4): "aplicar", (1, 6): "erro", (1, 7): "erro", (2, 1): "aplicar", (3, 5): "erro", (4, 2): "aplicar"}


def test_documents_refresh(spark):
    cols = "bid_id int, seq int, name string, active boolean"
    docs = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (2, 1, "c", True), (3, 1, "d", True)], cols)
    fresh = spark.createDataFrame([(1, 1, "a2", False, 0), (1, 1, "a3", True, 1), (1, 5, "e", True, 2)], cols + ", position int")
    refreshed = spark.createDataFrame([(1,), (3,)], "bid_id int")  # bid 3 answered with an empty list
    merged = mg.merge_documents(docs, fresh, refreshed)
    got = {(r["bid_id"], r["seq"]): (r["name"], r["action"]) for r in merged.collect()}
    assert got == {(1, 1): ("a3", "gravado"), (1, 2): ("b", "removido"), (1, 5): ("e", "gravado"), (2, 1): ("c", None), (3, 1): ("d", "removido")}
    counts = {r["bid_id"]: (r["written"], r["removed"], r["active_docs"]) for r in mg.document_counts(merged).collect()}
    assert counts == {1: (2, 1, 2), 3: (0, 1, 0)}


def test_fingerprint_ignores_document_order(spark):
    cols = "bid_id int, seq int, active boolean, state string, sha256 string, name string, doc_type string"
    rows = [(1, i, True, "extraido", f"s{i}", f"n{i}", "edital") for i in range(5)]
    bids = spark.createDataFrame([(1, "A")], "bid_id int, control_no string")
    make = lambda rs, v: mg.fingerprint(bids, spark.createDataFrame(rs, cols), ["control_no"], [v]).first()["fingerprint"]
    assert make(rows, "m") == make(rows[::-1], "m")
    assert make(rows, "m") != make(rows[:-1], "m") and make(rows, "m") != make(rows, "n")


def test_due_states(spark):
    at = lambda h: dt.datetime(2026, 9, 20, h, tzinfo=dt.timezone.utc)
    rows = [(1, None, None), (2, "pendente", at(11)), (3, "erro", at(7)), (4, "erro", at(5)), (5, "coletando", at(12)), (6, "coletando", at(11)), (7, "completo", at(1))]
    df = spark.createDataFrame(rows, "i int, s string, c timestamp")
    got = {r["i"] for r in df.filter(fl.due_state(F.col("s"), F.col("c"), clock())).collect()}
    assert got == {1, 2, 4, 6}


def test_items_complete(spark):
    rows = [(1, 1)] * 3 + [(2, 1)] * 2 + [(3, 1)] * 3 + [(3, 2)] * 3
    got = {r["bid_id"]: r["complete"] for r in readers.items_complete(spark.createDataFrame(rows, "bid_id int, page int"), 3, 2).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_hot_key_reduces_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("v"))
    plan = windows.best_row(df, ["key"], F.struct("v"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan

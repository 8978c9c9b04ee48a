"""What the queries of the registry read, shuffle and write, where that once grew too fast."""

import os

import pytest
from pyspark.sql import functions as F

from bidspan.operators import projections
from bidspan.registry import all as registry
from bidspan.registry import s1_sources as s1
from bidspan.registry import s7_merge as s7
from bidspan.registry.tables import DOC_NAMES, Tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prompt_items_come_numbered_and_counted_from_one_pass(spark):
    rows = [(1, n, f"d{n}", 10 - n) for n in (3, 1, 2, 1, 5)] + [(2, 1, "x", 1), (None, 1, "y", 1)]
    items = spark.createDataFrame(rows, "bid_id int, number int, description string, tie int")
    items = items.withColumns({c: F.lit(None).cast("string") for c in ("quantity", "unit", "unit_price", "total", "benefit_name", "status_name")})
    parts = projections.prompt_items(items, ["tie"], 2)
    found = {(r["bid_id"], r["part"]): (r["items_total"], [(i["place"], i["number"]) for i in r["items"]]) for r in parts.collect()}
    assert found == {(1, 0): (5, [(1, 1), (2, 1)]), (1, 1): (5, [(3, 2), (4, 3)]), (1, 2): (5, [(5, 5)]), (2, 0): (1, [(1, 1)])}
    assert "<=>" not in plan_of(parts)  # a null-safe key would be shuffled again for the parts


def test_export_counts_documents_without_their_titles(tables):
    bids = s1.export_bids(tables)
    assert DOC_NAMES[0] not in plan_of(bids) and "docs_total" in bids.columns


def test_received_lines_are_stored_compressed(tables, tmp_path):
    rows = s1.item_lines(tables, f"{tmp_path}/items")
    names = [n for n in os.listdir(f"{tmp_path}/items") if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") or n.endswith(".txt.gz") for n in names)
    assert rows.count() == tables.items.count()


def test_received_pages_are_stored_compressed_and_dealt_as_orders(spark, tables, tmp_path):
    pages = s1.envelopes(tables, f"{tmp_path}/pages", damage=False)
    names = [n for n in os.listdir(f"{tmp_path}/pages") if n.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
    assert pages.selectExpr("explode(data) as r").count() == tables.raw("orders").count()
    last = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [last.apply(k).physicalPlanDescription() for k in range(last.size())]
    made = next(p for p in reversed(plans) if "gzip" in p or str(tmp_path) in p and "InsertInto" in p)
    dealt = [line for line in made.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert dealt and not any("numeroPagina" in line for line in dealt)  # listing rows are not shuffled


def test_an_arrival_is_not_one_file(spark, tables):
    held = []
    events = spark.range(0, 4000, 1, 4).select(F.col("id").alias("event_id"))
    s7.arriving(tables, events, "event_id < 300", lambda stream, checkpoint: held.append((stream.isStreaming, checkpoint)))
    assert len(held) == 2 and held[0] == held[1]
    from bidspan import session

    folder = next(p for p in reversed(session._made) if "/events-" in p)
    stored = spark.read.parquet(folder)
    assert len(stored.inputFiles()) >= 8 and stored.count() == 4300


@pytest.mark.parametrize("name", ["merge_documents", "search_lexical", "search_fallback"])
def test_titles_are_classified_once_per_distinct_one(spark, monkeypatch, name):
    def row_by_row(self):
        raise AssertionError("every row classified")

    monkeypatch.setattr(Tables, "docs", property(row_by_row))
    assert registry.queries()[name](spark, SF).columns

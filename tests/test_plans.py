"""Shape of the physical plans: what must reach the scan, and what must never appear."""

import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from bidspan.operators import filters as fl
from bidspan.operators import ordering
from bidspan.operators import windows as wn

SF = "/root/testdata/sf0.001"
NEVER = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    """search_lexical flt_radius join_radius_theta join_config_cross join_query_cross join_citation_source agg_dashboard agg_doc_coverage
    agg_latency_summary incr_window_plan incr_stage_plan merge_catalog topk_overfetch knn_chunks cite_confirm eval_bootstrap eval_kappa rank_text agg_share_of_max""".split(),
)
def test_no_cross_join_and_no_row_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not [bad for bad in NEVER if bad in text]


def test_filters_and_columns_reach_the_scan(tables):
    raw = tables.raw("orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    assert "EqualTo(o_orderstatus,F)" in plan(raw) and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan(raw)
    core = tables.bid_core.filter(fl.unreviewed()).select("bid_id")
    scan = plan(core).split("ReadSchema:")[1].splitlines()[0]
    assert scan.strip() == "struct<o_orderkey:bigint>"


def test_pages_are_top_k(tables):
    text = plan(ordering.page(tables.bid_core, ordering.sort_keys("value", "desc"), 25, 50))
    assert "TakeOrderedAndProject(limit=75, offset=50" in text and "Exchange rangepartitioning" not in text


def test_group_limits_run_before_the_shuffle(tables):
    text = plan(wn.topn_per_group(tables.items, ["suppkey"], [F.desc("total"), F.col("number")], 3))
    assert text.count("WindowGroupLimit") == 2


def test_one_document_filter_reads_documents_once(tables):
    text = plan(fl.has_document(tables.bid_core.select("bid_id"), tables.docs, ["edital", "projeto", "orcamento"]).select("bid_id"))
    assert text.count("l_orderkey") and text.count("Scan parquet") + text.count("FileScan parquet") <= 4 and "LeftSemi" in text


def test_titles_are_classified_once_per_distinct_value(spark, tables):
    from bidspan.functions import classify
    from bidspan.functions import text as tx
    from bidspan.operators import projections

    raw = tables.raw_docs.unionByName(tables.raw_docs.limit(2).withColumns({"source_type": F.lit(None).cast("string"), "title": F.lit(None).cast("string")}))
    rules = {"doc_type": classify.document_type(F.col("source_type"), F.col("title")), "name": tx.clean_title(F.col("title"))}
    once = projections.per_distinct(raw, raw, ["source_type", "title"], rules)
    directly = raw.withColumns(rules).select(*once.columns)
    assert once.exceptAll(directly).count() == 0 and directly.exceptAll(once).count() == 0
    for rows in (once, tables.titled_docs):
        assert "translate" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_document_types_are_counted_before_they_are_classified(spark):
    from bidspan.registry import all as registry

    plan = registry.queries()["cls_document_type"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[source_type#\d+, title#\d+\], ", plan)


def test_only_texts_that_may_hold_a_quote_are_formed_again(spark):
    """The check of quotations reads the candidates' texts, not all of them a second time in full."""
    from bidspan.operators import joins

    quotes = spark.createDataFrame([(1, "uma frase citada do edital [...] com hí-\nfen no meio")], "quote_id long, quote string")
    rows = [("a", "Aqui está uma frase citada do edital, e depois COM HIFEN no meio."), ("b", "uma frase citada do edital, nada mais"), ("c", "outro texto - sem ela"), ("d", None)]
    found = joins.quote_matches(quotes, spark.createDataFrame(rows, "source_id string, text string"))
    assert [tuple(r) for r in found.collect()] == [(1, "a")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()

"""Shape of the physical plans of the training-data operators."""

import pytest

from bidspan.llm import queries

SF = "/root/testdata/sf0.001"
CROSS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
PYTHON = ["Python", "Pandas", "MapInArrow", "ArrowEval"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_packing", "op2_sharding", "op5_lines", "op6_pages", "op7_simhash", "op8_quality", "op9_sketch", "op10_mixing"])
def test_no_cross_join_and_native_where_asked(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not [bad for bad in CROSS if bad in text]
    if name in ("op2_sharding", "op9_sketch", "op10_mixing"):
        assert not [bad for bad in PYTHON if bad in text]


def test_texts_are_shuffled_once_for_fingerprints(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries.QUERIES["op9_sketch"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # both sides ask for the same shuffle, which is made once; none is added for the joins
    assert text.count("REPARTITION_BY_COL") == 2 and text.count("ENSURE_REQUIREMENTS") == 2

"""Spark against DuckDB on the given tables. A cross-section by default; every
query with BIDSPAN_FULL=1, or ``python tests/oracle.py <sf dir>`` for a report."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import oracle
from bidspan.registry import all as registry

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = registry.queries(), registry.oracle_sql()
SAMPLE = """src_documents_array page_quality map_item snapshot_io csv_export purchase_identity detail_view flt_fulltext flt_radius
flt_or_branches flt_due_documents filter_dispatch flt_item_match_state join_full_outer_fusion join_radius_theta join_citation_source
join_nested_children set_known_sources set_union_dedup_sources agg_dashboard agg_doc_coverage agg_frontier agg_api_health agg_latency_summary
agg_threshold_sweep win_failure_streak win_interval_merge win_running_budget win_lexical_rank sort_dynamic page_keyset topk_overfetch
str_clean_title str_money_parse cls_document_type cls_certame dt_local_to_utc dt_business_days_back math_score hash_fingerprint arr_chunk_overlap
arr_split_lossless arr_anchor_windows json_result_validate merge_catalog merge_documents page_idempotent stream_metrics stream_day_counts
incr_window_plan incr_frontier_advance incr_rescore search_lexical search_hybrid rank_text knn_chunks eval_ndcg eval_bootstrap cite_confirm triage_amounts""".split()
CHOSEN = sorted(QUERIES) if os.environ.get("BIDSPAN_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_twin(spark, con, name):
    result = oracle.compare(spark, con, name, QUERIES[name], TWINS.get(name), SF)
    assert result["ok"] is not False, result["problem"]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_entry_stands_without_the_training_data_part(tmp_path):
    """A copy without that subpackage, with the pipeline file and without it, offers the catalogue queries."""
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "bidspan", tmp_path / "bidspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    count = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"]
    for rest in ([], ["corpus_pipeline.py"]):
        for name in rest:
            if (root / name).exists():
                shutil.copy(root / name, tmp_path)
        out = subprocess.run(count, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
        assert out.split() == [str(len(QUERIES))] * 2


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == entry.entry(spark).columns

"""The stages over a small table: decisions against brute force, columns, odd rows."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidspan.llm import lines, queries
from test_simhash import bits, classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Settled(spark, "steps")(stage(spark, docs, SF))
        out.append((name, docs.columns, docs.collect()))
    return out


def test_stages(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    (_, c1, good), (_, c2, cleared), (_, c3, single), (_, c4, mixed), (_, _, packed) = steps
    assert c1 == c2 == c3 == c4 == docs.columns

    scored = {r.doc_id: r.predicted for r in queries.QUERIES["op8_quality"](spark, SF).collect()}
    assert {r.doc_id for r in good} == {d for d, p in scored.items() if p} and all(r.text == start[r.doc_id] for r in good)

    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for r in good:
        for x in r.text.split("\n"):
            holders[key(x)].add(r.doc_id)
    shared = {k: max(v) for k, v in holders.items() if len(k) >= lines.MIN_CHARS and len(v) >= lines.MIN_DOCS}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if shared.get(key(x), r.doc_id) == r.doc_id) for r in good}
    assert {r.doc_id: r.text for r in cleared} == want and all(r.n_chars == len(r.text) for r in cleared)

    ids = sorted(want)
    assert sorted(r.doc_id for r in single) == sorted(set(classes(ids, [bits(want[d]) for d in ids])))

    size = defaultdict(int)
    for r in single:
        size[r.source] += len(r.text.split())
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source] += len(r.text.split())
        assert want[r.doc_id] == r.text or " ".join(want[r.doc_id].split()).startswith(r.text)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < len(size)
    assert all(taken[s] <= 2 * size[s] for s in size)

    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in packed])
    assert sum(ids == 0) >= len(mixed) and sum(r.doc_tokens for r in packed if r.start == 0) == len(ids)


def test_run_is_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[-1][2])


def test_stages_take_odd_rows_and_empty_tables(spark, odd, frame):
    mine = ["gone", "starts", "_stays", "stays", "_score", "_h", "_take", "score", "slot", "row"]
    clashing = odd.withColumns({c: F.lit("mine") for c in mine})
    for docs in (clashing.repartition(2), frame([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert all(r[c] == "mine" for r in out.collect() for c in mine if c in out.columns)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()

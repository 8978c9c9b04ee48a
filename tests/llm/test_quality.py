import zlib

import numpy as np

from bidspan.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op8_quality"](spark, sf).toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(scored.doc_id, scored.held_out))
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3) == (scored.predicted == 1)).all()
    both = scored[scored.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 40 and (both.predicted == both.quality).mean() > 0.95


def test_model_learns_steps_and_interactions():
    r = np.random.default_rng(5)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature helps
    model = quality.train(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.85
    step = quality.train(x, (x[:, 3] > 0.3).astype(float))
    assert ((step.score(x) > 0.5) == (x[:, 3] > 0.3)).mean() > 0.97


def test_base_rate_without_labels(frame):
    none = quality.fit(frame([(1, "a")]), frame([]).selectExpr("doc_id", "1 as quality"))
    assert none.score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    one = quality.train(np.zeros((9, len(quality.FEATURES))), np.ones(9))
    assert one.score(np.zeros((1, len(quality.FEATURES))))[0] > 0.9


def test_labels_that_do_not_count(spark, frame, prose):
    docs = frame([(k, prose(k, 30) if k % 2 else "x x x x") for k in range(80)])
    rows = [(k, k % 2) for k in range(80)]
    good = spark.createDataFrame(rows, "doc_id long, quality int")
    more = [*rows, (None, 1), (3, None), (70, 7), *((k, 1 - k % 2) for k in range(80) if zlib.crc32(str(k).encode()) % 5 == 0)]
    odd = spark.createDataFrame(more, "doc_id long, quality int")
    x = np.array([quality.features(t) for t in ("x x x", prose(1, 40))])
    assert np.allclose(quality.fit(docs, good).score(x), quality.fit(docs, odd).score(x))


def test_odd_rows(odd, frame):
    model = quality.fit(odd, odd.selectExpr("doc_id", "1 as quality"))
    out = quality.score_documents(odd, model)
    rows = out.collect()
    assert set(out.columns) == set(odd.columns) and len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(frame([]), model).count() == 0
    assert set(quality.keep_good(odd, odd.selectExpr("doc_id", "1 as quality")).columns) == set(odd.columns)

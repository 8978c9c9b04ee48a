import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidspan.functions import text as tx
from bidspan.operators import filters as fl
from bidspan.operators import joins, ordering
from bidspan.operators import windows as wn
from bidspan.plans import extraction as ex
from bidspan.plans import index as ix
from bidspan.plans import search as se
from bidspan.plans import vectors as vx
from bidspan.registry import s8_search as s8
from bidspan.registry.tables import MODEL


def ids(df):
    return [r["bid_id"] for r in df.select("bid_id").collect()]


def test_unknown_filter_is_an_error(tables):
    with pytest.raises(ValueError, match="nada"):
        fl.conjunction({"nada": 1}, fl.Context(now=tables.now))


def test_empty_values_are_no_filter(tables):
    assert fl.conjunction({"uf": "", "value_min": None, "open_now": False}, fl.Context(now=tables.now)) is None


def test_filter_count():
    assert fl.filter_count({"uf": "SP", "city": "X", "open_now": True, "term": "", "priority": None}, "SP") == 2
    assert fl.filter_count({"uf": "RJ"}, "SP") == 1


def test_radius_rules(tables):
    with pytest.raises(ValueError, match="origin"):
        fl.resolve_origin(tables.cities, None, 10)
    with pytest.raises(ValueError, match="unknown"):
        fl.resolve_origin(tables.cities, "9999999", 10)
    assert fl.resolve_origin(tables.cities, "0000003", 0)[2] is None
    assert fl.resolve_origin(tables.cities, "", "") == (None, None, None)
    everyone = fl.within_radius(tables.bids, tables.cities, "0000003", None)
    assert everyone.count() == tables.bids.count()
    assert fl.within_radius(tables.bids, tables.cities, "0000003", 1e6).filter("km is null").count() == 0


def test_or_branches_equal_one_predicate(tables):
    preds = [fl.equals("uf", "ASIA"), fl.value_min(300000), F.col("status_id") == 2]
    assert sorted(ids(fl.or_branches(tables.bids, preds, "bid_id"))) == sorted(ids(tables.bids.filter(fl.any_of(preds))))


@pytest.mark.parametrize("key, direction", [("deadline", "asc"), ("value", "desc")])
def test_pages_concatenate_to_the_full_order(tables, key, direction):
    df = tables.bid_core.filter("priority")
    keys = ordering.sort_keys(key, direction)
    pages = [i for off in range(0, 800, 200) for i in ids(ordering.page(df, keys, 200, off))]
    assert pages == ids(df.orderBy(*keys))[:800] and len(set(pages)) == len(pages)


def test_keyset_pages_concatenate(tables):
    df, got, cursor = tables.bid_core.filter("priority and bid_id < 400"), [], None
    while True:
        rows = ordering.page_keyset(df.select("bid_id", "closes_at"), "closes_at", "bid_id", cursor, 40).orderBy("rank").collect()
        kept = [r for r in rows if not r["ahead"]]
        got += [r["bid_id"] for r in kept]
        if len(kept) == len(rows):
            break
        last = kept[-1]
        cursor = (last["closes_at"], last["bid_id"])
    assert got == ids(df.orderBy(*ordering.sort_keys("deadline", "asc")))


def test_page_limits():
    assert ordering.clamp(5000, -3) == (200, 0) and ordering.clamp(0, None) == (1, 0) and ordering.clamp(None, 7) == (25, 7)
    assert ordering.total_pages(0, 25) == 1 and ordering.total_pages(26, 25) == 2
    with pytest.raises(ValueError):
        ordering.sort_keys("nome", "asc")


def test_degrade_rules():
    c = se.HybridConfig()
    assert se.search_mode(c, True, "obra") == "hibrido"
    assert {se.search_mode(c, False, "obra"), se.search_mode(c, True, None), se.search_mode(c, True, "abc"), se.search_mode(se.HybridConfig(active=False), True, "obra")} == {"lexical"}
    assert se.search_fallback(c, True, "obra") == {"mode": "lexical", "degraded": True}
    assert se.search_fallback(c, True, "ab")["degraded"] is False


def test_hybrid_ranks_everything_in_reach(tables):
    rows = s8.hybrid(tables, s8.CONFIG).collect()
    scores = [r["rrf_score"] for r in rows]
    assert scores == sorted(scores, reverse=True) and {r["strategy"] for r in rows} == {"exata"}
    total = rows[0]["total"]
    assert total > len(rows)
    wide = s8.hybrid(tables, se.HybridConfig(model=MODEL, distance_limit=3.0)).first()
    assert wide["total"] >= total  # no ranking is cut


def test_shortlisted_bids_leave_count_and_page(tables):
    args = (tables.bids, tables.docs, tables.cities, {"uf": "ASIA"}, fl.Context(now=tables.now))
    before = se.search_lexical(*args).collect()
    gone = tables.bids.sparkSession.createDataFrame([(before[0]["bid_id"],)], "bid_id long")
    after = se.search_lexical(*args, shortlist=gone, doc_state=tables.doc_state).collect()
    assert after[0]["total"] == before[0]["total"] - 1 and before[0]["bid_id"] not in {r["bid_id"] for r in after}
    assert all(r["docs_total"] >= 0 and r["docs_state"] for r in after)


def test_many_chunks_of_one_bid_crowd_nobody_out(spark):
    rows = [(i, 1, [1.0, 0.001 * i], f"a{i}") for i in range(700)] + [(1000, 2, [1.0, 1.0], "b"), (1001, 3, [0.0, 1.0], "c")]
    chunks = spark.createDataFrame(rows, "chunk_id long, bid_id long, embedding array<double>, text string").repartition(5)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, embedding array<double>")
    best = vx.excerpts(vx.knn_chunks(chunks, q), chunks).orderBy("rank").collect()
    assert [(r["bid_id"], r["rank"], r["excerpt"]) for r in best] == [(1, 1, "a0"), (2, 2, "b"), (3, 3, "c")]


def test_hybrid_with_a_short_term_is_lexical(tables):
    page = s8.hybrid(tables, s8.CONFIG, {"term": "obr"})
    assert page.select("mode").distinct().first()["mode"] == "lexical"


def random_vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    data = centers[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, dim))
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "item_id long, embedding array<float>").repartition(6)


def brute(data, queries, k, limit=None):
    v = data.astype(np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = queries.astype(np.float32).astype(np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    d = 1 - v @ q.T
    return {j: [i for i in sorted(range(len(v)), key=lambda i: (d[i, j], i)) if limit is None or d[i, j] < limit][:k] for j in range(len(q))}


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


def test_exact_knn_equals_brute_force_over_blocks(spark, monkeypatch):
    data, items = random_vectors(spark, 900, 16, 1)
    qdata, q = random_vectors(spark, 11, 16, 2)
    queries = q.withColumnRenamed("item_id", "query_id")
    want = brute(data, qdata, 12)
    assert as_lists(vx.knn_exact(items, queries, 12)) == want
    monkeypatch.setattr(vx, "QUERIES_PER_PASS", 4)  # several exact passes instead of one
    assert as_lists(vx.knn_exact(items, queries, 12)) == want


def test_cells(spark, tmp_path):
    data, items = random_vectors(spark, 2000, 32, 3)
    qdata, q = random_vectors(spark, 20, 32, 3)
    queries = q.withColumnRenamed("item_id", "query_id")
    centroids = vx.fit_centroids(items, 24, sample=500)
    vx.write_cells(items, centroids, f"{tmp_path}/cells")
    want = brute(data, qdata, 10, 0.4)
    everywhere = as_lists(vx.knn_cells(spark, f"{tmp_path}/cells", queries, 10, 0.4, probe=24))
    assert everywhere == {j: w for j, w in want.items() if w}
    got = as_lists(vx.knn_cells(spark, f"{tmp_path}/cells", queries, 10, 0.4, probe=6))
    recalls = [len(set(got.get(j, [])) & set(want[j])) / len(want[j]) for j in want if want[j]]
    assert np.mean(recalls) >= 0.9 and all(len(v) <= 10 for v in got.values())


def test_cells_lose_nothing_unless_told(spark, tmp_path):
    data, items = random_vectors(spark, 1000, 64, 11)
    qdata, q = random_vectors(spark, 20, 64, 12)
    centroids = vx.fit_centroids(items, 40)
    vx.write_cells(items, centroids, f"{tmp_path}/cells")
    got = as_lists(vx.knn_cells(spark, f"{tmp_path}/cells", q.withColumnRenamed("item_id", "query_id"), 10))
    assert got == as_lists(vx.knn_exact(items, q.withColumnRenamed("item_id", "query_id"), 10))


def test_clustered_vectors_are_answered_exactly_from_a_part_of_the_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(30, 16))
    data = middles[np.arange(3000) % 30] + 0.05 * rng.normal(size=(3000, 16))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item_id long, embedding array<float>").repartition(6)
    asked = middles[:9] + 0.05 * rng.normal(size=(9, 16))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    vx.write_cells(items, vx.fit_centroids(items, 30), f"{tmp_path}/cells")
    read = []
    assert as_lists(vx.knn_cells(spark, f"{tmp_path}/cells", queries, 10, read=read)) == brute(data, asked, 10)
    assert 9 <= sum(read) < 9 * 30 / 3  # of 9 queries times 30 cells
    assert as_lists(vx.knn_cells(spark, f"{tmp_path}/cells", queries, 200, read=read)) == brute(data, asked, 200)  # more than a cell holds


def test_zero_and_null_vectors_are_left_out(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "item_id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert as_lists(vx.knn_exact(items, q, 5)) == {9: [3]}


def test_model_guard_refuses_a_wrong_dimension(tables):
    with pytest.raises(Exception, match="vector of 10 numbers"):
        vx.model_guard(tables.vectors, MODEL, 10).collect()


def test_embed_with_a_supplied_function(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    got = vx.embed(df, "t", vx.fake_vectoriser(8), batch=2).collect()
    vec = {(r["t"]): r["embedding"] for r in got}
    assert vec["a"] != vec["b"] and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in vec.values())


def test_radius_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(900, 89.9, 10.0), (901, 89.9, -170.0), (902, 0.0, 179.9), (903, 0.0, -179.9), (904, -23.5, -46.6), (905, -23.5, -46.6)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    a, b = df.withColumnRenamed("id", "left_id"), df.withColumnRenamed("id", "right_id")
    from math import asin, cos, radians, sin, sqrt

    def km(p, q):
        h = sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * asin(min(1, sqrt(h)))

    for radius in (40.0, 800.0):
        want = sorted((p[0], q[0]) for p in pts for q in pts if km(p, q) <= radius)
        for salts in (1, 3):
            got = sorted((r["left_id"], r["right_id"]) for r in joins.radius_pairs(a, b, radius, salts).collect())
            assert got == want


QUOTES = [
    "prazo de entrega de cinco dias uteis apos o pedido", "entrega [...] pagamento em trinta dias", "dias uteis apos", "ega de cinco dias", "curto",
    "abc … def … ghijk", "texto que nao existe em nenhum lugar do edital", "", "rinta dias corrid", "a … b", "não Há; garantia contratual (...) cinco dias",
]
SOURCES = [
    "O prazo de entrega de cinco dias úteis após o pedido. Pagamento em trinta dias corridos.", "abcx defy ghijkz entrega; pagamento em trinta dias", "Não há garantia contratual. Cinco dias.", "curto",
]


def test_quote_matches_equal_brute_force(spark, one):
    quotes = spark.createDataFrame([(i, i % 2, q) for i, q in enumerate(QUOTES)], "quote_id int, bid_id int, quote string")
    sources = spark.createDataFrame([(i, i % 2, s) for i, s in enumerate(SOURCES)], "source_id int, bid_id int, text string")
    parts = {i: one(tx.split_ellipsis, q) for i, q in enumerate(QUOTES)}
    forms = {i: one(tx.compare_form, s) for i, s in enumerate(SOURCES)}
    hit = lambda i, j: parts[i] and len(" ".join(parts[i])) >= 12 and all(p in forms[j] for p in parts[i])
    everywhere = {(i, j) for i in parts for j in forms if hit(i, j)}
    got = {tuple(r) for r in joins.quote_matches(quotes, sources).select("quote_id", "source_id").collect()}
    assert got == everywhere and len(everywhere) >= 5
    own = {tuple(r) for r in joins.quote_matches(quotes, sources, on=["bid_id"]).select("quote_id", "source_id").collect()}
    assert own == {(i, j) for i, j in everywhere if i % 2 == j % 2}


def test_quotes_of_every_length_from_anywhere_are_found(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghij klmno pqrs") for _ in range(r.choice([30, 200, 1500]))) for _ in range(12)]
    texts += [texts[0], "a" * 300, "ab" * 200]
    quotes = [texts[i][at : at + n] for i in range(len(texts)) for n in (12, 13, 23, 24, 25, 60, 95, 96, 97, 180) for at in [r.randint(0, max(0, len(texts[i]) - n))]]
    quotes += [texts[2][5:11] + " ... " + texts[2][40:47], "z" * 40]
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    s = spark.createDataFrame(list(enumerate(texts)), "source_id int, text string")
    forms = {x["source_id"]: x["f"] for x in s.select("source_id", tx.compare_form(F.col("text")).alias("f")).collect()}
    parts = {x["quote_id"]: x["p"] for x in q.select("quote_id", tx.split_ellipsis(F.col("quote")).alias("p")).collect()}
    want = {(i, j) for i, p in parts.items() for j, f in forms.items() if len(" ".join(p)) >= 12 and all(x in f for x in p)}
    assert {tuple(x) for x in joins.quote_matches(q, s).collect()} == want and len(want) > 100


def test_texts_leave_only_the_grams_that_probes_have(spark, monkeypatch):
    from bidspan.functions import winnow

    r = random.Random(9)
    text = "".join(r.choice("abcdefghij klmno pqrs") for _ in range(3000))
    df = spark.createDataFrame([(0, text, text[700:760])], "source_id int, text string, quote string")
    key = df.select(winnow.probe_key(F.col("quote")).alias("h"))
    kept = df.crossJoin(key).withColumn("short", F.array(winnow.short_form(F.col("h"))))
    got = kept.select("h", winnow.text_keys(F.col("text"), [(12, 13)], F.col("short")).alias("k"), winnow.text_keys(F.col("text"), [(12, 13)], F.lit(None).cast("array<int>")).alias("all")).first()
    assert got["h"] in got["k"] and len(got["k"]) <= 2 and len(got["all"]) > 200
    quotes = spark.createDataFrame([(i, i % 2, text[i * 50 : i * 50 + 40]) for i in range(40)], "quote_id int, bid_id int, quote string")
    sources = spark.createDataFrame([(i, i % 2, text[i * 1000 : i * 1000 + 1100]) for i in range(3)], "source_id int, bid_id int, text string")
    sieved = [sorted(map(tuple, joins.quote_matches(quotes, sources, on=on).collect())) for on in ([], ["bid_id"])]
    monkeypatch.setattr(joins, "PROBES", 1)
    assert [sorted(map(tuple, joins.quote_matches(quotes, sources, on=on).collect())) for on in ([], ["bid_id"])] == sieved and all(sieved)


def test_copied_points_are_not_broadcast(spark):
    pts = spark.range(50).select(F.col("id").alias("left_id"), (F.col("id") / 7.0).alias("lat"), (F.col("id") / 5.0).alias("lon"))
    plan = joins.radius_pairs(pts, pts.withColumnRenamed("left_id", "right_id"), 60.0, 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_winnowed_grams_are_few():
    from bidspan.functions import winnow

    data = "".join(random.Random(8).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20000)).encode()
    for _, gram, window in winnow.TIERS:
        assert len(winnow.winnow(data, gram, window)) < 1.2 * 2 / (window + 1) * len(data)
        probe = data[7000 : 7000 + gram + window - 1]
        assert set(winnow.winnow(probe, gram, window)) <= set(winnow.winnow(data, gram, window))


def test_stored_index_ranks_without_reading_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "obra de escola"), (2, "escola escola nova"), (3, ""), (4, None), (5, "ponte")], "doc_id int, text string")
    ranks = {}
    index = ix.TextIndex.write(docs, "doc_id", F.col("text"), f"{tmp_path}/index")
    for name, found in (("stored", index.rank(["escol"])), ("direct", ix.rank_text(ix.postings(docs, "doc_id", F.col("text")), ix.collection_stats(docs, F.col("text")), "doc_id", ["escol"]))):
        ranks[name] = sorted((x["doc_id"], round(x["score"], 9), x["matched"]) for x in found.collect())
    assert ranks["stored"] == ranks["direct"] and [x[0] for x in ranks["stored"]] == [1, 2]
    plan = index.rank(["escol"])
    assert all(f"{tmp_path}/index/" in f for f in plan.inputFiles())
    assert "EqualTo(token,escol)" in plan._jdf.queryExecution().executedPlan().toString()  # the scan looks for the token


def test_citations_prefer_and_correct_sources(spark):
    answers = spark.createDataFrame(
        [(1, 1, "prazos", "5 dias", "entrega em cinco dias", ["s2"]), (2, 1, "prazos", "5 dias", "entrega em cinco dias", ["s9"]), (3, 1, "prazos", "Não exige", "frase inventada pelo modelo", ["s1"]), (4, 1, "prazos", "x", None, []), (5, 1, "habilitacao", "Não exige", "frase inventada pelo modelo", ["s1"])],
        "answer_id int, bid_id int, section string, value string, quote string, source_ids array<string>",
    )
    sources = spark.createDataFrame([(1, "s10", 0, "A entrega em cinco dias."), (1, "s2", 1, "Entrega em CINCO dias úteis"), (2, "s9", 2, "entrega em cinco dias")], "bid_id int, source_id string, ord int, text string")
    got = {r["answer_id"]: r for r in ex.drop_unproven(ex.cite_confirm(answers, sources)).collect()}
    assert got[1]["confirmed"] and got[1]["source_ids"] == ["s2"]
    assert got[2]["confirmed"] and got[2]["source_ids"] == ["s10"]  # the first in source order, not by name
    assert not got[3]["confirmed"] and got[3]["value"] is None and got[3]["source_ids"] == ["s1"]
    assert not got[4]["confirmed"] and got[4]["value"] == "x"
    assert not got[5]["confirmed"] and got[5]["value"] == "Não exige"  # items are never cleared


def test_index_finds_what_the_scan_finds(tables):
    bids, text = tables.bid_core, se.object_text()
    posts = ix.postings(bids, "bid_id", text)
    for term in ("construção de escolas", "praças", "manutencao"):
        scan = sorted(ids(bids.filter(ix.fulltext(text, term))))
        assert sorted(ids(ix.term_semi_join(bids, posts, "bid_id", ix.query_tokens(term)))) == scan and scan


def test_accents_fold_or_not(spark):
    df = spark.createDataFrame([("pavimentação",)], "t string")
    check = lambda fold: df.select(F.size(F.filter(ix.tokens(F.col("t"), fold), lambda x: x.rlike("^[a-z]+$"))).alias("n")).first()["n"]
    assert check(True) == 1 and check(False) == 0


def test_best_row_ignores_partitioning(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50, i) for i in range(200)], "k int, v int, i int")
    got = {tuple(r) for r in wn.best_row(df.repartition(7), ["k"], F.struct("v", "i")).collect()}
    assert got == {tuple(r) for r in wn.best_row(df.coalesce(1), ["k"], F.struct("v", "i")).collect()}


def test_postings_of_odd_texts_without_lambdas(spark, monkeypatch):
    monkeypatch.setattr(ix, "WORDS_AT_ONCE", 2)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "de da o"), (4, "Ação: casas, ações de casa"), (None, "x y x")], "doc_id long, text string").coalesce(1)
    posts = ix.postings(docs, "doc_id", F.col("text"))
    got = {(r.doc_id, r.token, r.length, r.tf, tuple(r.positions)) for r in posts.collect()}
    assert got == {(4, "aca", 4, 1, (0,)), (4, "aco", 4, 1, (2,)), (4, "cas", 4, 2, (1, 4)), (None, "x", 3, 2, (0, 2)), (None, "y", 3, 1, (1,))}
    assert "array_sort" not in posts._jdf.queryExecution().optimizedPlan().toString()


def test_more_postings_are_sorted_by_more_tasks(spark, tmp_path, monkeypatch):
    from bidspan.plans import index as ix

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ix, "POSTINGS_A_TASK", 10)
    docs = spark.createDataFrame([(k, " ".join(f"palavra{k}x{i}" for i in range(20))) for k in range(10 * tasks)] + [(-1, None), (-2, "")], "doc_id long, text string")
    stored = ix.TextIndex.write(docs, "doc_id", F.col("text"), f"{tmp_path}/index").postings
    assert stored.count() == 200 * tasks
    assert stored.select(F.input_file_name()).distinct().count() > 10 * tasks

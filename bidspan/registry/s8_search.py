"""Search, ranking, evaluation and extraction checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.functions import classify
from bidspan.operators import filters as fl
from bidspan.operators import sets
from bidspan.plans import evaluation as ev
from bidspan.plans import extraction as ex
from bidspan.plans import index as ix
from bidspan.plans import search as se
from bidspan.plans import vectors as vx
from bidspan.registry import s2_filters as s2
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.s3_joins import COS, KNOWN, RUNS, parts_of, two_runs
from bidspan.registry.tables import MODEL
from bidspan.session import fresh_path, kept_path, settle

WANTED = {"value_min": 20000, "published_from": "1996-01-01", "has_notice": True, "term": "escola", "origin_code": s2.ORIGIN, "radius_km": 2500}
MATCHED = f"""
SELECT b.*, {s2.KM} AS km FROM bids b JOIN (SELECT city_code, lat, lon FROM cities) c USING (city_code), (SELECT lat, lon FROM cities WHERE city_code = '{s2.ORIGIN}') o
WHERE value >= 20000 AND {s2.sql_day('published_at', '>=', '1996-01-01')} AND bid_id IN (SELECT bid_id FROM docs WHERE active AND doc_type = 'edital') AND {s2.KM} <= 2500
AND (contains({s2.SEARCHED}, 'escola') OR {s2.has_terms(s2.OBJ, ix.query_tokens('escola'))})"""
MATCHED = f"{MATCHED} AND bid_id NOT IN (SELECT bid_id FROM shortlist)"
LISTED = "coalesce((SELECT count(*) FROM docs d WHERE d.active AND d.bid_id = m.bid_id), 0) AS docs_total, coalesce((SELECT any_value(state) FROM doc_state s WHERE s.bid_id = m.bid_id), 'pendente') AS docs_state"
PAGE_COLS = f"bid_id, control_no, object, value::DOUBLE AS value, {w.is_open()} AS open_now, {w.temporal()} AS temporal_state, round(km, 1) AS distance_km, {LISTED}"
PAGE = ["bid_id", "control_no", "object", "CAST(value AS DOUBLE) AS value", "open_now", "temporal_state", "distance_km", "docs_total", "docs_state", "total", "mode"]


@query("search_lexical", f"SELECT {PAGE_COLS}, (SELECT count(*) FROM ({MATCHED})) AS total, 'lexical' AS mode FROM ({MATCHED}) m ORDER BY closes_at NULLS LAST, bid_id LIMIT 25 OFFSET 25")
def _(t):
    page = se.search_lexical(t.bids, t.titled_docs, t.cities, WANTED, fl.Context(now=t.now), "deadline", "asc", 25, 25, shortlist=t.shortlist, doc_state=t.doc_state)
    return page.selectExpr(*PAGE)


_INDEXES: dict[tuple, ix.TextIndex] = {}
_CELLS: dict[tuple, str] = {}


def stored_index(t, name):
    """The text index of the documents or of the bids' objects, written once per session and input."""
    key = (t.spark.sparkContext.applicationId, t.dir, name)
    if key not in _INDEXES:
        source, item, text = (t.raw("documents"), "doc_id", F.col("text")) if name == "documents" else (t.bids, "bid_id", se.object_text())
        _INDEXES[key] = ix.TextIndex.write(source, item, text, kept_path(t.spark, f"index-{name}"))
    return _INDEXES[key]


def bm25(source, key, text, terms):
    """CTE body: BM25 score per key over ``source``, from first principles."""
    toks = w.tokens(text)
    wanted = ", ".join(w.lit(x) for x in sorted(set(terms)))
    return f"""
SELECT {key}, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score, count(*) AS matched FROM (
  SELECT {key}, token, tf, n, mean, ln(1 + (total - count(*) OVER (PARTITION BY token) + 0.5) / (count(*) OVER (PARTITION BY token) + 0.5)) AS idf FROM (
    SELECT {key}, token, count(*) AS tf, any_value(n) AS n, any_value(mean) AS mean, any_value(total) AS total FROM (
      SELECT {key}, unnest(toks) AS token, len(toks) AS n, mean, total FROM (SELECT {key}, {toks} AS toks FROM {source}), (SELECT avg(len({toks}))::DOUBLE AS mean, count(*) AS total FROM {source})
    ) WHERE token IN ({wanted}) GROUP BY {key}, token)) GROUP BY {key}"""


TERMS = ix.query_tokens("thand ention und questa reder")


@query("rank_text", f"SELECT doc_id, round(score, 6) AS score, matched FROM ({bm25('documents', 'doc_id', 'text', TERMS)})")
def _(t):
    ranked = stored_index(t, "documents").rank(TERMS)
    return ranked.select("doc_id", F.round("score", 6).alias("score"), "matched")


@query("index_inverted", f"""
SELECT {w.stem('token')} AS token, count(DISTINCT doc_id) AS documents, count(*) AS occurrences, sum(position)::BIGINT AS positions FROM (
  SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS position FROM (SELECT doc_id, {w.words('text')} AS ws FROM documents)) WHERE token NOT IN ({w.STOPS}) GROUP BY 1""")
def _(t):
    index = ix.TextIndex.write(t.raw("documents"), "doc_id", F.col("text"), fresh_path(t.spark, "index"))
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)
    return index.postings.groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"), F.sum(total).alias("positions"))


CONFIG = se.HybridConfig(model=MODEL, distance_limit=0.97)
THEME = 3
HYBRID_WANTED = {"priority": "sim", "term": "escola"}


def hybrid(t, config, wanted=None):
    bids = t.bids
    index = stored_index(t, "bids")
    theme = t.themes.filter(F.col("query_id") == THEME)
    return se.search_hybrid(bids, t.docs, t.cities, t.vectors, t.chunks, index.postings, index.stats, wanted or HYBRID_WANTED, theme, fl.Context(now=t.now), config, shortlist=t.shortlist, doc_state=t.doc_state)


HYBRID = f"""
WITH pool AS (SELECT * FROM bids WHERE priority AND bid_id NOT IN (SELECT bid_id FROM shortlist)),
bm AS ({bm25('bids', 'bid_id', s2.OBJ, ix.query_tokens('escola'))}),
lex AS (SELECT p.bid_id, row_number() OVER (ORDER BY coalesce(round(bm.score, 9), 0) DESC, p.bid_id) AS rank FROM pool p LEFT JOIN bm USING (bid_id) WHERE contains({s2.SEARCHED}, 'escola') OR {s2.has_terms(s2.OBJ, ix.query_tokens('escola'))}),
q AS (SELECT embedding FROM themes WHERE query_id = {THEME}),
ob AS (SELECT v.bid_id, {COS} AS d FROM q, vectors v JOIN pool USING (bid_id) WHERE v.model = '{MODEL}'),
obj AS (SELECT bid_id, row_number() OVER (ORDER BY d, bid_id) AS rank FROM ob WHERE d < 0.97),
ch AS (SELECT v.bid_id, v.chunk_id, v.text, {COS} AS d FROM q, chunks v JOIN pool USING (bid_id) WHERE v.model = '{MODEL}'),
ck AS (SELECT * FROM ch WHERE d < 0.97),
cb AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY bid_id ORDER BY d, chunk_id) = 1),
chk AS (SELECT bid_id, text, row_number() OVER (ORDER BY d, bid_id) AS rank FROM cb),
fused AS (SELECT bid_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score, bool_or(sem) AS semantic, max(text) AS excerpt FROM (SELECT bid_id, rank, false AS sem, NULL AS text FROM lex UNION ALL SELECT bid_id, rank, true, NULL FROM obj UNION ALL SELECT bid_id, rank, true, text FROM chk) GROUP BY bid_id)"""


@query("search_hybrid", f"""{HYBRID}
SELECT bid_id, rrf_score, semantic, md5(excerpt) AS excerpt, {LISTED}, (SELECT count(*) FROM fused) AS total, (SELECT count(*) FROM pool) AS eligible, 'hibrido' AS mode, 'exata' AS strategy FROM fused m JOIN pool USING (bid_id) ORDER BY rrf_score DESC, closes_at NULLS LAST, bid_id LIMIT 25""")
def _(t):
    return hybrid(t, CONFIG).select("bid_id", "rrf_score", "semantic", F.md5("excerpt").alias("excerpt"), "docs_total", "docs_state", "total", "eligible", "mode", "strategy")


@query("search_degrade", """
SELECT length(term)::INT AS chars, CASE WHEN length(trim(term)) >= 4 THEN 'hibrido' ELSE 'lexical' END AS mode, count(*) AS requests FROM (SELECT p_name[1:(p_partkey % 7)::INT] AS term FROM part) GROUP BY ALL""")
def _(t):
    """Modes of logged requests: the same rule as ``search_mode``, as a column."""
    term = F.substring("p_name", F.lit(1), (F.col("p_partkey") % 7).cast("int"))
    req = t.raw("part").select(term.alias("term"))
    return req.groupBy(F.length("term").alias("chars"), se.search_mode_of(F.col("term"), se.HybridConfig()).alias("mode")).agg(F.count(F.lit(1)).alias("requests"))


@query("search_fallback", f"SELECT {PAGE_COLS}, (SELECT count(*) FROM ({MATCHED})) AS total, 'lexical' AS mode, true AS degraded FROM ({MATCHED}) m ORDER BY value DESC NULLS LAST, bid_id LIMIT 25")
def _(t):
    """The vectoriser failed, so there is no query vector: the lexical page, marked."""
    verdict = se.search_fallback(se.HybridConfig(), True, WANTED["term"])
    page = se.search_hybrid(
        t.bids, t.titled_docs, t.cities, t.vectors, t.chunks, None, None, WANTED, None, fl.Context(now=t.now), key="value", direction="desc", shortlist=t.shortlist, doc_state=t.doc_state
    )
    return page.selectExpr(*PAGE).withColumn("degraded", F.lit(verdict["degraded"]))


@query("search_strategy", """
SELECT uf, count(*) AS eligible, CASE WHEN count(*) <= 3000 THEN 'exata' ELSE 'aproximada' END AS strategy FROM bids WHERE uf IS NOT NULL GROUP BY uf""")
def _(t):
    counts = t.bids.filter(F.col("uf").isNotNull()).groupBy("uf").agg(F.count(F.lit(1)).alias("eligible"))
    return counts.withColumn("strategy", se.strategy(F.col("eligible"), 3000))


PAIRS = f"SELECT q.query_id, v.bid_id, {COS} AS d FROM themes q, vectors v WHERE v.model = '{MODEL}'"


@query("knn_exact", f"SELECT query_id, bid_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, bid_id)::INT AS rank FROM ({PAIRS}) QUALIFY rank <= 25")
def _(t):
    near = vx.knn_exact(t.vectors.filter(F.col("model") == MODEL), t.themes, 25, None, "bid_id")
    return near.select("query_id", "bid_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


APPROX_LIMIT = 0.9


CELLS = 16


def stored_cells(t):
    """Path of the cells of all vectors, written once per session and input."""
    key = (t.spark.sparkContext.applicationId, t.dir, "cells")
    if key not in _CELLS:
        path = kept_path(t.spark, "cells")
        vx.write_cells(t.vectors, vx.fit_centroids(t.vectors, CELLS, "bid_id"), path)
        _CELLS[key] = path
    return _CELLS[key]


def cells(t):
    """The stored cells, searched exactly."""
    return vx.knn_cells(t.spark, stored_cells(t), t.themes, 10, APPROX_LIMIT, "bid_id")


def prepare(t):
    """Write the stored indexes that the searches read; those that are there stay."""
    for name in ("documents", "bids"):
        stored_index(t, name)
    stored_cells(t)


NEAREST = f"SELECT query_id, bid_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, bid_id) AS rank FROM (SELECT q.query_id, v.bid_id, {COS} AS d FROM themes q, vectors v) WHERE d < {APPROX_LIMIT} QUALIFY rank <= 10"


@query("knn_approx", f"SELECT query_id, bid_id, round(d, 6) AS distance, rank::INT AS rank FROM ({NEAREST})")
def _(t):
    """Cells are read best first, the others as far as their bounds reach: exact from a part of the cells where vectors cluster."""
    return cells(t).select("query_id", "bid_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("eval_recall_at_k", f"""
WITH e AS ({NEAREST}), a AS ({NEAREST}) SELECT e.query_id, (count(a.bid_id) / count(*))::DOUBLE AS recall FROM e LEFT JOIN a ON a.query_id = e.query_id AND a.bid_id = e.bid_id GROUP BY e.query_id""")
def _(t):
    """Recall of the stored index as it answers by default, against the scan of all vectors."""
    item = F.col("bid_id").alias("item_id")
    a = cells(t).select("query_id", item, "rank")
    e = vx.knn_exact(t.vectors, t.themes, 10, APPROX_LIMIT, "bid_id").select("query_id", item, "rank")
    return sets.recall_overlap(a, e, 10).select("query_id", F.col("recall").cast("double").alias("recall"))


CHUNK_BEST = f"""
WITH h AS (SELECT q.query_id, v.bid_id, v.chunk_id, v.text, {COS} AS d FROM themes q, chunks v),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, bid_id ORDER BY d, chunk_id) = 1)"""


@query("knn_chunks", f"{CHUNK_BEST} SELECT query_id, bid_id, chunk_id, md5(text) AS excerpt, row_number() OVER (PARTITION BY query_id ORDER BY d, bid_id)::INT AS rank FROM b QUALIFY rank <= 50")
def _(t):
    best = vx.excerpts(vx.knn_chunks(t.chunks, t.themes, k=50), t.chunks)
    return best.select("query_id", "bid_id", "chunk_id", F.md5("excerpt").alias("excerpt"), F.col("rank").cast("int").alias("rank"))


@query("knn_within_bid", f"""
SELECT bid_id, chunk_id, row_number() OVER (PARTITION BY bid_id ORDER BY d, chunk_id)::INT AS rank FROM (SELECT v.bid_id, v.chunk_id, {COS} AS d FROM themes q, chunks v SEMI JOIN (SELECT doc_id FROM files WHERE active) f ON f.doc_id = v.doc_id
WHERE q.query_id = {THEME} AND v.model = '{MODEL}') QUALIFY rank <= 2""")
def _(t):
    out = vx.knn_within(t.chunks, t.files, t.themes.filter(F.col("query_id") == THEME), MODEL, 2)
    return out.select("bid_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


@query("knn_multi_query", f"""
WITH d AS (SELECT q.query_id, v.chunk_id AS evidence_id, v.doc_id, v.ord, {COS} AS d FROM themes q, chunks v), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, evidence_id) <= 8)
SELECT evidence_id, query_id, round(d, 6) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY d, doc_id, ord) = 1""")
def _(t):
    return vx.knn_multi_query(t.chunks, t.themes).select("evidence_id", "query_id", F.round("distance", 6).alias("distance"))


def three_rankings(t):
    from bidspan.registry.s3_joins import rank_lists

    lex, obj, chunk = rank_lists(t)
    return [(lex.select("bid_id", "rank"), 1.0), (obj.withColumn("distance", F.lit(0.5)).select("bid_id", "rank", "distance"), 0.7), (chunk.select("bid_id", "rank"), 0.4)]


RANK3 = """
WITH lex AS (SELECT bid_id, row_number() OVER (ORDER BY score DESC, bid_id) AS rank FROM bids WHERE score >= 60),
obj AS (SELECT bid_id, row_number() OVER (ORDER BY label, bid_id) AS rank FROM vectors), chk AS (SELECT bid_id, row_number() OVER (ORDER BY min(label) DESC, bid_id) AS rank FROM chunks GROUP BY bid_id)"""


@query("fuse_rrf", f"{RANK3} SELECT bid_id, round(sum(p), 9) AS rrf_score FROM (SELECT bid_id, 1.0::DOUBLE / (60 + rank) AS p FROM lex UNION ALL SELECT bid_id, 0.7::DOUBLE / (60 + rank) FROM obj UNION ALL SELECT bid_id, 0.4::DOUBLE / (60 + rank) FROM chk) GROUP BY bid_id")
def _(t):
    return vx.fuse_rrf(three_rankings(t)).select("bid_id", F.round("rrf_score", 9).alias("rrf_score"))


@query("fuse_provenance", f"{HYBRID} SELECT bid_id, semantic, md5(excerpt) AS excerpt FROM fused WHERE semantic")
def _(t):
    ids = fl.not_shortlisted(t.bid_core.filter("priority"), t.shortlist).select("bid_id")
    theme = t.themes.filter(F.col("query_id") == THEME)
    own = t.vectors.filter(F.col("model") == MODEL).join(ids, "bid_id", "left_semi")
    parts = t.chunks.filter(F.col("model") == MODEL).join(ids, "bid_id", "left_semi")
    obj = vx.full_ranking(vx.under_limit(own, theme, CONFIG.distance_limit, "bid_id"), "bid_id")
    fused = vx.fuse_rrf([(obj, 1.0), (vx.knn_chunks(parts, theme, CONFIG.distance_limit), 1.0)])
    return vx.excerpts(fused.filter("semantic"), t.chunks).select("bid_id", "semantic", F.md5("excerpt").alias("excerpt"))


@query("model_guard", f"SELECT bid_id, len(embedding)::INT AS dims FROM vectors WHERE model = '{MODEL}'")
def _(t):
    return vx.model_guard(t.vectors, MODEL, 64).select("bid_id", F.size("embedding").alias("dims"))


# --------------------------------------------------------------------- evaluation


def graded(t):
    """Judgments of the pooled runs where labels exist: own class counts 2, quality 1."""
    a, b = two_runs(t)
    pool = a.select("query_id", "item_id").unionByName(b.select("query_id", "item_id")).distinct()
    judged = pool.join(t.raw("labels").withColumnRenamed("doc_id", "item_id"), "item_id").join(t.raw("embeddings").select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    grade = F.col("quality") + F.when(F.col("label") == F.col("query_id"), 2).otherwise(0)
    return settle(judged.select("query_id", "item_id", grade.alias("grade")), "judgments")


GRADED = f"""{RUNS},
pool AS (SELECT query_id, item_id FROM run_a UNION SELECT query_id, item_id FROM run_b),
j AS (SELECT query_id, item_id, quality + CASE WHEN label = query_id THEN 2 ELSE 0 END AS grade FROM pool JOIN labels ON doc_id = item_id JOIN embeddings ON vec_id = item_id)"""
GAIN = "(pow(2, {g}) - 1) / log2({r} + 1)"


def ndcg_sql(run, out, k=10, condensed=False):
    graded_run = f"SELECT r.query_id, r.item_id, r.rank, j.grade FROM {run} r LEFT JOIN j USING (query_id, item_id)"
    if condensed:
        graded_run = f"SELECT query_id, item_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ({graded_run}) WHERE grade IS NOT NULL"
    return f"""
{out} AS (SELECT i.query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END AS ndcg, coalesce(unjudged, 0) AS unjudged FROM (SELECT query_id, sum({GAIN.format(g='grade', r='pos')}) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS pos FROM j) WHERE pos <= {k} GROUP BY query_id) i
LEFT JOIN (SELECT query_id, sum({GAIN.format(g='coalesce(grade, 0)', r='rank')}) AS dcg FROM ({graded_run}) WHERE rank <= {k} GROUP BY query_id) d USING (query_id)
LEFT JOIN (SELECT r.query_id, count(*) FILTER (j.grade IS NULL) AS unjudged FROM {run} r LEFT JOIN j USING (query_id, item_id) WHERE r.rank <= {k} GROUP BY r.query_id) u USING (query_id))"""


@query("eval_ndcg", f"WITH {GRADED},{ndcg_sql('run_b', 'z')},{ndcg_sql('run_b', 'c', condensed=True)} SELECT z.query_id, round(z.ndcg, 6) AS ndcg, z.unjudged, round(c.ndcg, 6) AS condensed FROM z JOIN c USING (query_id)")
def _(t):
    run, judged = two_runs(t)[1], graded(t)
    z = ev.ndcg(run, judged).withColumn("ndcg", F.round("ndcg", 6))
    c = ev.ndcg(run, judged, unjudged="condensado").select("query_id", F.round("ndcg", 6).alias("condensed"))
    return z.join(c, "query_id")


@query("eval_mrr", f"""WITH {GRADED} SELECT p.query_id, CASE WHEN top >= 2 THEN coalesce(round(1.0 / first, 6), 0) END::DOUBLE AS rr FROM (SELECT query_id, max(grade) AS top FROM j GROUP BY 1) p
LEFT JOIN (SELECT query_id, min(rank) AS first FROM run_a JOIN j USING (query_id, item_id) WHERE rank <= 10 AND grade >= 2 GROUP BY 1) f USING (query_id)""")
def _(t):
    return ev.reciprocal_rank(two_runs(t)[0], graded(t)).withColumn("rr", F.round("rr", 6))


PAIRED = f"WITH {GRADED},{ndcg_sql('run_a', 'za')},{ndcg_sql('run_b', 'zb')}, pr AS (SELECT query_id, za.ndcg AS base, zb.ndcg AS candidate FROM za JOIN zb USING (query_id))"


def paired(t):
    judged = graded(t)
    a, b = two_runs(t)
    base = ev.ndcg(a, judged).select("query_id", F.col("ndcg").alias("base"))
    return base.join(ev.ndcg(b, judged).select("query_id", F.col("ndcg").alias("candidate")), "query_id")


@query("eval_relative_gain", f"{PAIRED} SELECT query_id, round(CASE WHEN base <> 0 THEN (candidate - base) / base END, 6) AS gain FROM pr")
def _(t):
    from bidspan.functions.scoring import relative_gain

    return paired(t).select("query_id", F.round(relative_gain(F.col("base"), F.col("candidate")), 6).alias("gain"))


@query("eval_topk_compare", f"""WITH {RUNS} SELECT query_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM run_a a WHERE a.query_id = b.query_id AND a.item_id = b.item_id AND a.rank <= 10)) AS new_items, count(*) AS returned, count(*) = 10 AS complete FROM run_b b WHERE rank <= 10 GROUP BY query_id""")
def _(t):
    a, b = two_runs(t)
    possible = t.vectors.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))
    return ev.topk_compare(a, b, possible)


@query("eval_kappa", """
WITH r AS (SELECT quality + toxic AS a, quality * 2 + 1 AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n FROM r),
o AS (SELECT i, k, count(*) AS c FROM (SELECT a AS i, b AS k FROM r) GROUP BY ALL), ma AS (SELECT a AS i, count(*) AS c FROM r GROUP BY 1), mb AS (SELECT b AS k, count(*) AS c FROM r GROUP BY 1)
SELECT (SELECT n FROM n)::BIGINT AS pairs, round(1 - (SELECT sum(pow(i - k, 2) / 9.0 * c) FROM o) / (SELECT sum(pow(ma.i - mb.k, 2) / 9.0 * ma.c * mb.c / (SELECT n FROM n)) FROM ma, mb), 6) AS kappa, round((SELECT count(*) FROM r WHERE a = b) / (SELECT n FROM n), 6) AS exact_agreement""")
def _(t):
    pairs = t.raw("labels").select((F.col("quality") + F.col("toxic")).alias("rating_a"), (F.col("quality") * 2 + 1).alias("rating_b"))
    out = ev.kappa(pairs)
    return out.withColumns({"kappa": F.round("kappa", 6), "exact_agreement": F.round("exact_agreement", 6)})


RESAMPLES = 2000


@query("eval_bootstrap", f"""{PAIRED}, p AS (SELECT query_id, base, candidate FROM pr WHERE base IS NOT NULL AND candidate IS NOT NULL),
d AS (SELECT resample, base, candidate, len(list_filter({ev.poisson_edges()}, lambda e: ('0x' || md5('7:' || resample || ':' || query_id)[1:8])::BIGINT >= e)) AS w FROM p, (SELECT unnest(range({RESAMPLES})) AS resample)),
g AS (SELECT resample, (sum(w * candidate) - sum(w * base)) / sum(w * base) AS gain FROM d GROUP BY resample)
SELECT round((SELECT (avg(candidate) - avg(base)) / avg(base) FROM p), 6) AS estimate, round(quantile_disc(gain, 0.025), 6) AS low, round(quantile_disc(gain, 0.975), 6) AS high FROM g""")
def _(t):
    out = ev.bootstrap(paired(t), RESAMPLES, "7")
    return out.select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


SEGMENTED = "SELECT query_id, query_id % 3 AS segment, base, candidate FROM pr"
SEG = f"""SELECT segment, count(*) AS queries, avg(candidate - base) AS delta FROM ({SEGMENTED}) WHERE base IS NOT NULL AND candidate IS NOT NULL GROUP BY segment"""


@query("eval_segments", f"{PAIRED} SELECT segment, queries, round(delta, 6) AS delta, CASE WHEN queries < 4 THEN 'segmento insuficiente' WHEN delta < -0.02 THEN 'regressão no segmento' END AS reason, NOT (queries < 4 OR delta < -0.02) AS pass FROM ({SEG})")
def _(t):
    scores = paired(t).withColumn("segment", F.col("query_id") % 3)
    return ev.segments(scores, 4).withColumn("delta", F.round("delta", 6))


@query("eval_gate", f"""{PAIRED} SELECT n, round(gain, 6) AS gain, array_to_string(list_filter([CASE WHEN n < 100 THEN 'consultas insuficientes' END, CASE WHEN NOT coalesce(gain >= 0.1, false) THEN 'ganho abaixo do mínimo' END], lambda x: x IS NOT NULL), ';') AS reasons, n >= 100 AND coalesce(gain >= 0.1, false) AS pass
FROM (SELECT count(*) AS n, (avg(candidate) - avg(base)) / avg(base) AS gain FROM pr WHERE base IS NOT NULL AND candidate IS NOT NULL)""")
def _(t):
    both = paired(t).filter(F.col("base").isNotNull() & F.col("candidate").isNotNull())
    m = both.agg(F.count(F.lit(1)).alias("n"), ((F.avg("candidate") - F.avg("base")) / F.avg("base")).alias("gain"))
    out = ev.gate(m, [(F.col("n") >= 100, "consultas insuficientes"), (F.col("gain") >= 0.1, "ganho abaixo do mínimo")])
    return out.select("n", F.round("gain", 6).alias("gain"), F.array_join("reasons", ";").alias("reasons"), "pass")


# --------------------------------------------------------------------- extraction

CITED = f"""
WITH a AS (SELECT *, {parts_of('quote')} AS parts FROM answers), s AS (SELECT bid_id, source_id, ord, {w.compare_form('text')} AS form FROM sources),
m AS (SELECT answer_id, s.source_id, ord, list_contains(source_ids, s.source_id) AS cited FROM a JOIN s USING (bid_id) WHERE length(array_to_string(parts, ' ')) >= 12 AND len(list_filter(parts, lambda p: NOT contains(form, p))) = 0),
f AS (SELECT answer_id, arg_min(source_id, (NOT cited, ord)) AS proof FROM m GROUP BY answer_id),
c AS (SELECT a.*, proof, proof IS NOT NULL AS confirmed, CASE WHEN proof IS NOT NULL AND NOT list_contains(source_ids, proof) THEN [proof] ELSE source_ids END AS fixed FROM a LEFT JOIN f USING (answer_id))"""


def confirmed(t):
    return ex.cite_confirm(t.answers, t.sources)


@query("cite_confirm", f"{CITED} SELECT answer_id, confirmed, proof, array_to_string(fixed, ',') AS source_ids FROM c")
def _(t):
    return confirmed(t).select("answer_id", "confirmed", "proof", F.array_join("source_ids", ",").alias("source_ids"))


@query("cite_drop_unproven", f"""{CITED} SELECT answer_id, CASE WHEN section = 'habilitacao' THEN value WHEN starts_with(quote, 'O edital não menciona') THEN NULL WHEN starts_with(value, 'Não') AND NOT confirmed THEN NULL ELSE value END AS value FROM c""")
def _(t):
    return ex.drop_unproven(confirmed(t)).select("answer_id", "value")


@query("cite_known_sources", KNOWN)
def _(t):
    return sets.known_sources(t.answers, t.sources).select("answer_id", F.array_join("source_ids", ",").alias("source_ids"), "dropped")


@query("triage_amounts", """
WITH x AS (SELECT bid_id, CASE WHEN bid_id % 10 <> 0 THEN value::DOUBLE END AS b FROM bids),
y AS (SELECT bid_id, round((b * 1.0 / 100)::DECIMAL(38,6), 2)::DOUBLE AS proposal_guarantee, CASE WHEN bid_id % 2 = 0 THEN round((b * 5.0 / 100)::DECIMAL(38,6), 2)::DOUBLE END AS contract_guarantee,
  round((b * CASE WHEN bid_id % 3 = 0 THEN 70.0 ELSE 75.0 END / 100)::DECIMAL(38,6), 2)::DOUBLE AS min_price, round((b * 85.0 / 100)::DECIMAL(38,6), 2)::DOUBLE AS extra_guarantee_limit FROM x)
SELECT *, CASE WHEN bid_id % 4 = 0 AND proposal_guarantee IS NOT NULL THEN 'divergência de valor: proposal_guarantee' ELSE '' END AS alerts FROM y""")
def _(t):
    k = F.col("bid_id")
    rows = t.bid_core.select(
        "bid_id", "value", (k % 10 == 0).alias("secret"), F.lit(1.0).alias("proposal_pct"), F.when(k % 2 == 0, 5.0).alias("contract_pct"), F.when(k % 3 == 0, 70.0).alias("min_price_pct"),
        F.lit(None).cast("double").alias("stated_proposal"), F.lit(None).cast("double").alias("stated_contract"), F.lit(None).cast("double").alias("stated_min_price"),
    )
    own = ex.triage_amounts(rows).select("bid_id", "proposal_guarantee")
    rows = rows.drop("stated_proposal").join(own, "bid_id").withColumn("stated_proposal", F.col("proposal_guarantee") + F.when(k % 4 == 0, 0.02).otherwise(0.004)).drop("proposal_guarantee")
    out = ex.triage_amounts(rows)
    return out.select("bid_id", "proposal_guarantee", "contract_guarantee", "min_price", "extra_guarantee_limit", F.array_join("alerts", ";").alias("alerts"))


FILTERS7 = [f"CASE WHEN bid_id % {m} = 0 THEN '{bad}' ELSE 'OK' END" for m, bad in ((101, "IMPEDITIVO"), (5, "ATENCAO"), (7, "NAO_ENCONTRADO"), (103, "IMPEDITIVO"), (11, "ATENCAO"), (13, "ATENCAO"), (17, "NAO_ENCONTRADO"))]


@query("triage_verdict", f"SELECT bid_id, CASE WHEN list_contains(s, 'IMPEDITIVO') THEN 'NAO_RECOMENDADO' WHEN len(list_filter(s, lambda x: x <> 'OK')) = 0 THEN 'RECOMENDADO' ELSE 'PARTICIPAR_COM_RESSALVAS' END AS verdict FROM (SELECT bid_id, [{', '.join(FILTERS7)}] AS s FROM bids)")
def _(t):
    statuses = [F.expr(f) for f in FILTERS7]
    return t.bid_core.select("bid_id", ex.triage_verdict(statuses).alias("verdict"))


@query("text_extract_state", f"""
SELECT doc_id, CASE WHEN bytes > 9000 THEN 'grande_demais' WHEN doc_id % 13 = 0 THEN 'erro' WHEN doc_id % 4 = 3 THEN 'erro' WHEN pages > 0 AND chars >= pages * {classify.DENSE_CHARS_PER_PAGE} THEN 'extraido' ELSE 'sem_texto' END AS state FROM files""")
def _(t):
    k = F.col("doc_id")
    mime = F.when(k % 4 != 3, classify.READABLE_MIME).otherwise("application/zip")
    state = classify.text_extract_state(F.col("bytes"), 9000, k % 13 == 0, mime, F.col("chars"), F.col("pages"))
    return t.files.select("doc_id", state.alias("state"))

"""Windows, sorts, limits, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.operators import aggregates as ag
from bidspan.operators import ordering as od
from bidspan.operators import windows as wn
from bidspan.plans import extraction
from bidspan.plans import vectors as vx
from bidspan.registry import s2_filters as s2
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.s3_joins import COS, RUNS, two_runs
from bidspan.registry.s4_aggregates import SHARES
from bidspan.registry.tables import EVENTS_NOW, NOW


@query("win_page_rank", "SELECT bid_id, rank::INT AS rank FROM (SELECT bid_id, row_number() OVER (ORDER BY value DESC NULLS LAST, bid_id) AS rank FROM bids) WHERE rank BETWEEN 26 AND 50")
def _(t):
    return wn.page_rank(t.bid_core, od.sort_keys("value", "desc"), 26, 50).select("bid_id", "rank")


@query("win_lexical_rank", "SELECT bid_id, row_number() OVER (ORDER BY score DESC, bid_id) AS rank FROM bids WHERE contains(lower(object), 'escola')")
def _(t):
    hits = t.bid_core.filter(F.contains(F.lower("object"), F.lit("escola"))).select("bid_id", "score")
    return wn.global_rank(hits, ["score", "bid_id"], [False, True]).select("bid_id", F.col("rank").cast("long").alias("rank"))


@query("win_vector_rank", f"WITH {RUNS} SELECT query_id, item_id, rank::INT AS rank FROM run_b")
def _(t):
    return two_runs(t)[1].select("query_id", "item_id", F.col("rank").cast("int").alias("rank"))


@query("win_best_chunk", f"""
SELECT bid_id, chunk_id, md5(text) AS text_hash, round(distance, 6) AS distance FROM (SELECT v.*, {COS} AS distance FROM themes q, chunks v WHERE q.query_id = 3)
QUALIFY row_number() OVER (PARTITION BY bid_id ORDER BY distance, chunk_id) = 1""")
def _(t):
    hits = vx.under_limit(t.chunks, t.themes.filter("query_id = 3"), 2.1, "chunk_id").join(t.chunks.select("chunk_id", "bid_id", "text"), "chunk_id")
    return wn.best_chunk(hits).select("bid_id", "chunk_id", F.md5("text").alias("text_hash"), F.round("distance", 6).alias("distance"))


@query("win_dedup_batch", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    return wn.dedup_batch(t.raw("events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("win_dedup_hash", "SELECT DISTINCT user_id, md5(props) AS hash FROM events")
def _(t):
    return wn.dedup_hash(t.raw("events").select("user_id", F.md5("props").alias("hash")), "user_id", "hash")


@query("win_dedup_documents", "SELECT bid_id, seq, name, url, active FROM docs")
def _(t):
    return t.docs.select("bid_id", "seq", "name", "url", "active")


@query("win_most_advanced", "SELECT uf, modality_id, strftime(max(to_date), '%Y-%m-%d') AS to_date FROM segments GROUP BY ALL")
def _(t):
    return wn.most_advanced(t.segments, ["uf", "modality_id"], "to_date").withColumn("to_date", F.date_format("to_date", "yyyy-MM-dd"))


@query("win_latest_event", "SELECT bid_id, event_no, added, entry FROM history QUALIFY row_number() OVER (PARTITION BY bid_id ORDER BY event_no DESC) = 1")
def _(t):
    return wn.latest_event(t.history, "bid_id", ["at", "event_no"]).select("bid_id", "event_no", "added", "entry")


@query("win_stage_barrier", """
SELECT segment_id, min(priority) OVER (PARTITION BY job_id)::INT AS min_stage FROM segments WHERE status IN ('pendente', 'executando')""")
def _(t):
    return wn.stage_barrier(t.segments).select("segment_id", "min_stage")


EVIDENCE = f"""
WITH d AS (SELECT q.query_id, v.chunk_id AS evidence_id, v.doc_id, v.ord, v.text, {COS} AS distance FROM themes q, chunks v),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, evidence_id) <= 60)
SELECT evidence_id, query_id, round(distance, 6) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY distance, doc_id, ord, text) = 1"""


@query("win_evidence_dedup", EVIDENCE)
def _(t):
    return vx.knn_multi_query(t.chunks, t.themes, 60).select("evidence_id", "query_id", F.round("distance", 6).alias("distance"))


@query("win_failure_streak", """
SELECT event_id, streak, CASE WHEN streak = 0 THEN 0 WHEN streak <= 2 THEN streak * 15000 ELSE 60000 END AS wait_ms FROM (
  SELECT event_id, sum((NOT ok)::INT) OVER (PARTITION BY job_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM (
    SELECT *, sum(ok::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM calls))""")
def _(t):
    return wn.failure_streak(t.calls).select("event_id", "streak", F.col("wait_ms").cast("long").alias("wait_ms"))


SPANS = """
SELECT user_id AS doc, (epoch(ts) % 86400)::INT AS s, (epoch(ts) % 86400)::INT + 60 * (value::INT % 40) AS e FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)"""


@query("win_interval_merge", f"""
WITH a AS ({SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
i AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY doc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc, min(s) AS s, max(e) AS e FROM i GROUP BY doc, island""")
def _(t):
    sec = (F.unix_seconds(F.col("ts").cast("timestamp")) % 86400).cast("int")
    spans = t.raw("events").select(F.col("user_id").alias("doc"), sec.alias("s"), (sec + 60 * (F.rint("value").cast("int") % 40)).alias("e"))
    return wn.interval_merge(spans, ["doc"], "s", "e")


BUDGET = 6000
BUDGET_SQL = f"""
WITH RECURSIVE p AS (SELECT bid_id, doc_id // 2 AS doc_order, doc_id AS ord, length(text)::INT AS n, row_number() OVER (PARTITION BY bid_id ORDER BY doc_id // 2, doc_id) AS i FROM sources),
walk AS (
  SELECT bid_id, doc_order, ord, n, i, n <= {BUDGET} AS kept, CASE WHEN n <= {BUDGET} THEN n ELSE 0 END AS used, n > {BUDGET} AS closed, false AS spent FROM p WHERE i = 1
  UNION ALL
  SELECT bid_id, doc_order, ord, n, i, fits, used + CASE WHEN fits THEN n ELSE 0 END, NOT fits OR was_closed, spent FROM (
    SELECT *, NOT spent AND NOT was_closed AND used + n <= {BUDGET} AS fits FROM (
      SELECT p.bid_id, p.doc_order, p.ord, p.n, p.i, w.used, w.closed AND p.doc_order = w.doc_order AS was_closed, w.spent OR (p.doc_order <> w.doc_order AND w.used >= {BUDGET}) AS spent
      FROM walk w JOIN p ON p.bid_id = w.bid_id AND p.i = w.i + 1)))
SELECT bid_id, ord, kept FROM walk"""


@query("win_running_budget", BUDGET_SQL)
def _(t):
    parts = t.sources.select("bid_id", F.floor(F.col("doc_id") / 2).alias("doc_order"), F.col("doc_id").alias("ord"), F.length("text").alias("length"))
    return extraction.running_budget(parts, BUDGET).select("bid_id", "ord", "kept")


@query("win_topn_per_group", """
SELECT bid_id, number, total, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY total DESC, number, partkey, suppkey) AS rank FROM items) WHERE rank <= 3""")
def _(t):
    order = [F.desc("total"), F.col("number"), F.col("partkey"), F.col("suppkey")]
    return wn.topn_per_group(t.items, ["bid_id"], order, 3).select("bid_id", "number", "total", "rank")


@query("win_share", SHARES.replace("category", "team_status"))
def _(t):
    return wn.share(t.bid_core.groupBy("team_status").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------- sorts and limits


def _ranked_page(t, key, direction, first, last):
    return wn.page_rank(t.bid_core, od.sort_keys(key, direction), first, last).select(F.lit(f"{key} {direction}").alias("ordering"), "bid_id", "rank")


@query("sort_dynamic", " UNION ALL ".join(
    f"(SELECT '{k} {d}' AS ordering, bid_id, row_number() OVER (ORDER BY {c} {d} NULLS LAST, bid_id)::INT AS rank FROM bids QUALIFY rank <= 40)"
    for k, c in od.SORT_COLUMNS.items() for d in ("asc", "desc")))
def _(t):
    out = None
    for k in od.SORT_COLUMNS:
        for d in ("asc", "desc"):
            part = _ranked_page(t, k, d, 1, 40)
            out = part if out is None else out.unionByName(part)
    return out


@query("page_clamped", "SELECT bid_id FROM bids ORDER BY closes_at NULLS LAST, bid_id LIMIT 200 OFFSET 30")
def _(t):
    return od.page(t.bid_core, od.sort_keys("deadline", "asc"), 5000, 30).select("bid_id")


@query("page_with_total", "SELECT bid_id, (SELECT count(*) FROM bids WHERE score >= 40) AS total FROM bids WHERE score >= 40 ORDER BY score DESC, bid_id LIMIT 25 OFFSET 50")
def _(t):
    return od.page_with_total(t.bid_core.filter("score >= 40"), od.sort_keys("score", "desc"), 25, 50).select("bid_id", "total")


CURSOR_DAY, CURSOR_KEY = "2001-09-20 00:00:00", 7000


@query("page_keyset", f"""
SELECT bid_id, rank::INT AS rank, rank > 30 AS ahead FROM (SELECT bid_id, row_number() OVER (ORDER BY closes_at NULLS LAST, bid_id) AS rank FROM bids
WHERE closes_at > TIMESTAMP '{CURSOR_DAY}' OR (closes_at = TIMESTAMP '{CURSOR_DAY}' AND bid_id > {CURSOR_KEY}) OR closes_at IS NULL) WHERE rank <= 31""")
def _(t):
    import datetime as dt

    cursor = (dt.datetime.fromisoformat(CURSOR_DAY + "+00:00"), CURSOR_KEY)
    return od.page_keyset(t.bid_core, "closes_at", "bid_id", cursor, 30).select("bid_id", "rank", "ahead")


@query("sort_nearest", f"""
SELECT bid_id, row_number() OVER (ORDER BY km NULLS LAST, bid_id)::INT AS rank FROM (SELECT bid_id, {s2.KM} AS km FROM bids LEFT JOIN cities c USING (city_code), (SELECT lat, lon FROM cities WHERE city_code = '{s2.ORIGIN}') o) QUALIFY rank <= 100""")
def _(t):
    from bidspan.operators.filters import within_radius

    return wn.page_rank(within_radius(t.bids, t.cities, s2.ORIGIN, None), od.nearest_keys(), 1, 100).select("bid_id", "rank")


@query("topk_vector", f"""
SELECT query_id, bid_id, rank::INT AS rank FROM (SELECT query_id, bid_id, row_number() OVER (PARTITION BY query_id ORDER BY d, bid_id) AS rank FROM (SELECT q.query_id, v.bid_id, {COS} AS d FROM themes q, vectors v) WHERE d < 1.0) WHERE rank <= 200""")
def _(t):
    return vx.knn_exact(t.vectors, t.themes, 200, 1.0, "bid_id").select("query_id", "bid_id", F.col("rank").cast("int").alias("rank"))


@query("topk_overfetch", f"""
SELECT query_id, bid_id, row_number() OVER (PARTITION BY query_id ORDER BY d, bid_id)::INT AS rank FROM (
  SELECT q.query_id, v.bid_id, {COS} AS d FROM themes q, vectors v JOIN bids USING (bid_id) WHERE priority) WHERE d < 1.0 QUALIFY rank <= 200""")
def _(t):
    """The 200 nearest of the bids that pass the filter: filtered first, so nothing is fetched in vain or missed."""
    kept = t.vectors.join(t.bid_core.filter("priority").select("bid_id"), "bid_id", "left_semi")
    return vx.knn_exact(kept, t.themes, 200, 1.0, "bid_id").select("query_id", "bid_id", F.col("rank").cast("int").alias("rank"))


@query("topk_queue_documents", f"SELECT bid_id FROM ({s2.DUE_BIDS}) ORDER BY CASE WHEN closes_at >= TIMESTAMP '{NOW}' THEN 0 ELSE 1 END, closes_at NULLS LAST, score DESC, bid_id LIMIT 50")
def _(t):
    return od.queue_documents(s2.due_bids(t), 50, t.now).select("bid_id")


@query("topk_queue_files", f"SELECT doc_id FROM ({s2.DUE_FILES}) ORDER BY CASE WHEN doc_type = 'edital' THEN 0 ELSE 1 END, doc_id LIMIT 50")
def _(t):
    return od.queue_files(s2.due_files(t), 50).select("doc_id")


CLASS = f"CASE WHEN priority OR team_status IN ('interessante', 'em_analise') THEN 0 WHEN {w.is_open()} AND score >= 60 THEN 1 WHEN accessed_at IS NOT NULL THEN 2 ELSE 3 END"


@query("topk_queue_embedding", f"SELECT bid_id FROM ({s2.DUE_EMB}) ORDER BY {CLASS}, accessed_at DESC NULLS LAST, closes_at NULLS LAST, bid_id LIMIT 50")
def _(t):
    return od.queue_embeddings(s2.due_embeddings(t), 50, 60, t.now).select("bid_id")


@query("topk_next_segment", f"""
SELECT segment_id FROM (SELECT *, min(priority) OVER (PARTITION BY job_id) AS m FROM segments WHERE status IN ('pendente', 'executando')) WHERE priority = m
AND (retry_at IS NULL OR retry_at <= TIMESTAMP '{EVENTS_NOW}') ORDER BY updated_at, segment_id LIMIT 1""")
def _(t):
    return od.next_segment(t.segments, t.events_now).select("segment_id")


@query("sort_results_relevance", """
WITH f AS (SELECT bid_id, round(1.0 / (60 + 1 + label), 9) AS rrf_score FROM vectors)
SELECT bid_id, row_number() OVER (ORDER BY rrf_score DESC, closes_at NULLS LAST, bid_id)::INT AS rank FROM f JOIN bids USING (bid_id) QUALIFY rank <= 200""")
def _(t):
    fused = t.vectors.select("bid_id", F.round(F.lit(1.0) / (F.lit(61) + F.col("label")), 9).alias("rrf_score"))
    return wn.page_rank(t.bid_core.join(fused, "bid_id"), od.relevance_keys(), 1, 200).select("bid_id", "rank")


@query("topk_slowest", "SELECT job_id, quantile_disc(latency_ms, 0.95) AS p95 FROM calls GROUP BY job_id ORDER BY p95 DESC, job_id LIMIT 3")
def _(t):
    return ag.latency_summary(t.calls, "latency_ms", ["job_id"]).orderBy(F.desc("p95"), "job_id").limit(3).select("job_id", "p95")


def uniform(text):
    return f"(('0x' || sha256({text})[1:8])::BIGINT / 4294967296.0::DOUBLE)"


@query("sort_shuffle_seeded", f"SELECT bid_id, row_number() OVER (ORDER BY {uniform("'s1:' || bid_id")}, bid_id)::INT AS rank FROM bids QUALIFY rank <= 100")
def _(t):
    shuffled = od.shuffle_seeded(t.bid_core.select("bid_id"), "bid_id", "s1")
    return wn.page_rank(shuffled, [F.col("draw"), F.col("bid_id")], 1, 100).select("bid_id", "rank")


@query("split_deterministic", f"SELECT bid_id, CASE WHEN {uniform("'s2:' || bid_id")} < 0.3 THEN 'ajuste' ELSE 'final' END AS part FROM bids")
def _(t):
    return od.split_deterministic(t.bid_core.select("bid_id"), "bid_id", "s2", 0.3).select("bid_id", "part")

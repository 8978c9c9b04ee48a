"""Metrics, coverage, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.functions import scoring
from bidspan.operators import aggregates as ag
from bidspan.operators import incremental, merge, projections
from bidspan.plans import vectors as vx
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.s2_filters import CUT
from bidspan.registry.s3_joins import COS
from bidspan.registry.tables import EVENTS_TODAY, MODEL, NOW, TODAY

OPEN = w.is_open()
LAST = "(SELECT * FROM jobs WHERE status <> 'falhou' AND finished_at IS NOT NULL ORDER BY finished_at DESC, job_id DESC LIMIT 1)"


@query("agg_dashboard", f"""
SELECT count(*) AS total, count(*) FILTER (team_status = 'nova') AS unreviewed, count(*) FILTER (created_at >= {w.to_utc(f"DATE '{TODAY}'")}) AS new_today,
  count(*) FILTER ({OPEN} AND closes_at < {w.to_utc(f"(DATE '{TODAY}' + 2)")}) AS closing_by_tomorrow, count(*) FILTER ({OPEN} AND closes_at <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY) AS due_in_7_days,
  count(*) FILTER ({OPEN}) AS open, sum(value)::DOUBLE AS value_total, count(*) FILTER (value IS NULL) AS undisclosed, count(*) FILTER (priority) AS priority, count(*) FILTER (score >= 60) AS recommended,
  (SELECT total_new FROM {LAST}) AS new_last_sync, (SELECT total_updated FROM {LAST}) AS updated_last_sync FROM bids""")
def _(t):
    return ag.dashboard(t.bid_core, t.jobs, t.now).withColumn("value_total", F.col("value_total").cast("double"))


@query("agg_by_uf_open", f"SELECT coalesce(uf, '—') AS uf, count(*) AS n FROM bids WHERE {OPEN} GROUP BY 1")
def _(t):
    return ag.by_uf_open(t.bids, t.now)


@query("agg_top_places", "SELECT coalesce(city, '—') || ' / ' || coalesce(uf, '—') AS place, count(*) AS n FROM bids GROUP BY 1 ORDER BY n DESC, place LIMIT 6")
def _(t):
    return ag.top_places(t.bids)


@query("agg_by_category", "SELECT category, count(*) AS n FROM bids GROUP BY 1")
def _(t):
    return ag.by_category(t.bid_core)


@query("agg_last_sync", f"SELECT job_id, status, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, total_new, total_updated FROM {LAST}")
def _(t):
    return ag.last_sync(t.jobs).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


SHARES = """
SELECT category, n, greatest(2.0, round(n * 100.0 / max(n) OVER (), 4))::DOUBLE AS bar, round(n * 100.0 / sum(n) OVER (), 4)::DOUBLE AS percent FROM (SELECT category, count(*) AS n FROM bids GROUP BY 1)"""


@query("agg_share_of_max", SHARES)
def _(t):
    from bidspan.operators.windows import share

    return share(ag.by_category(t.bid_core))


@query("agg_facets", """
SELECT DISTINCT facet, value FROM (SELECT 'uf' AS facet, uf AS value FROM bids UNION ALL SELECT 'city', city FROM bids UNION ALL SELECT 'agency', agency FROM bids
UNION ALL SELECT 'category', category FROM bids UNION ALL SELECT 'modality', modality FROM bids) WHERE coalesce(value, '') <> ''""")
def _(t):
    return ag.facets(t.bids)


ELIGIBLE = f"(SELECT bid_id FROM bids WHERE cnpj <> '' AND year IS NOT NULL AND seq IS NOT NULL AND {w.temporal()} IN ('aberta', 'nao_iniciada') AND score >= {CUT})"


@query("agg_doc_coverage", f"""
SELECT (SELECT count(*) FROM bids) AS bids, (SELECT count(*) FROM {ELIGIBLE}) AS eligible, (SELECT count(*) FROM doc_state WHERE state = 'completo' AND bid_id IN {ELIGIBLE}) AS complete,
 (SELECT count(*) FROM doc_state WHERE state = 'erro' AND bid_id IN {ELIGIBLE}) AS failed, (SELECT count(*) FROM doc_state WHERE state = 'coletando') AS collecting,
 (SELECT count(*) FROM docs WHERE active) AS documents, (SELECT count(DISTINCT bid_id) FROM docs WHERE active AND doc_type = 'edital') AS with_notice,
 (SELECT count(DISTINCT bid_id) FROM docs WHERE active AND doc_type = 'projeto') AS with_project, (SELECT count(DISTINCT bid_id) FROM docs WHERE active AND doc_type = 'orcamento') AS with_budget""")
def _(t):
    out = ag.document_coverage(t.bid_core, t.docs, t.doc_state, scoring.due_score(scoring.ScoreConfig()), t.now)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("agg_embedding_coverage", f"""
SELECT (SELECT count(*) FROM bids) AS searchable, (SELECT count(*) FROM vectors) AS vectorised, (SELECT count(*) FROM vectors WHERE model IS DISTINCT FROM '{MODEL}') AS stale_model,
 (SELECT count(*) FROM files WHERE state = 'extraido') AS docs_with_text, (SELECT count(DISTINCT doc_id) FROM chunks) AS docs_vectorised, (SELECT count(*) FROM chunks) AS chunks""")
def _(t):
    out = ag.embedding_coverage(t.bid_core, t.vectors, t.files, t.chunks, MODEL)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("agg_file_coverage", "SELECT coalesce(f.state, 'pendente') AS state, count(*) AS n FROM docs d LEFT JOIN files f USING (bid_id, seq) GROUP BY 1")
def _(t):
    return ag.file_coverage(t.docs, t.files)


@query("agg_frontier", """
SELECT count(*) AS partitions, CASE WHEN count(*) FILTER (last_closed_date IS NULL) = 0 THEN strftime(min(last_closed_date), '%Y-%m-%d') END AS closed_until,
  count(*) FILTER (last_closed_date IS NULL) AS never_covered, (SELECT uf FROM frontier ORDER BY last_closed_date NULLS FIRST, uf, modality_id LIMIT 1) AS behind_uf,
  (SELECT modality_id FROM frontier ORDER BY last_closed_date NULLS FIRST, uf, modality_id LIMIT 1) AS behind_modality FROM frontier""")
def _(t):
    out = ag.frontier_summary(t.frontier)
    return out.drop("behind_date").withColumn("closed_until", F.date_format("closed_until", "yyyy-MM-dd"))


CLOSED = f"""
SELECT uf, modality_id, max(CASE WHEN to_date < DATE '{EVENTS_TODAY}' THEN to_date WHEN from_date <= DATE '{EVENTS_TODAY}' - 1 THEN DATE '{EVENTS_TODAY}' - 1 END) FILTER (status = 'concluido') AS last_closed_date
FROM segments GROUP BY ALL HAVING bool_and(status = 'concluido')"""


def sql_day(x):
    return f"strftime({x}, '%Y-%m-%d')"


@query("agg_partition_closed", f"SELECT uf, modality_id, {sql_day('last_closed_date')} AS last_closed_date FROM ({CLOSED})")
def _(t):
    out = ag.partition_closed(t.segments, F.lit(EVENTS_TODAY).cast("date"))
    return out.withColumn("last_closed_date", F.date_format("last_closed_date", "yyyy-MM-dd"))


@query("agg_segment_progress", """
SELECT job_id, count(*) AS planned, count(*) FILTER (status = 'concluido') AS done, count(*) FILTER (status IN ('pendente', 'executando')) AS pending, count(*) FILTER (status = 'falhou') AS failed,
  sum(pages_applied)::BIGINT AS pages_applied, CASE WHEN count(total_pages) > 0 THEN sum(coalesce(total_pages, pages_applied))::BIGINT END AS pages_estimated FROM segments GROUP BY job_id""")
def _(t):
    return ag.segment_progress(t.segments, ["job_id"])


@query("agg_percent", """
SELECT job_id, CASE WHEN e > 0 THEN least(100, floor(a * 100 / e::DOUBLE + 0.5)::INT) END AS percent FROM (SELECT job_id, sum(pages_applied)::BIGINT AS a,
  CASE WHEN count(total_pages) > 0 THEN sum(coalesce(total_pages, pages_applied))::BIGINT END AS e FROM segments GROUP BY job_id)""")
def _(t):
    p = ag.segment_progress(t.segments, ["job_id"])
    return p.select("job_id", scoring.percent(F.col("pages_applied"), F.col("pages_estimated")).alias("percent"))


@query("agg_sync_state", """
SELECT job_id, CASE WHEN j.status IS NULL THEN 'nunca' WHEN j.status = 'em_andamento' THEN 'coletando' WHEN j.status = 'falhou' THEN 'falhou' WHEN p = 0 AND f = 0 THEN 'completo_no_escopo' ELSE 'parcial' END AS state
FROM jobs j JOIN (SELECT job_id, count(*) FILTER (status IN ('pendente', 'executando')) AS p, count(*) FILTER (status = 'falhou') AS f FROM segments GROUP BY job_id) USING (job_id)""")
def _(t):
    p = ag.segment_progress(t.segments, ["job_id"]).select("job_id", "pending", "failed")
    return t.jobs.join(p, "job_id").select("job_id", ag.sync_state(F.col("status"), F.col("pending"), F.col("failed")).alias("state"))


def merge_case(t):
    """Catalogue of two bids in three; a batch of all bids with newer, older and changed rows by rule."""
    k = F.col("bid_id")
    catalog = t.bids.filter(k % 3 != 0).drop("portal_url", "process", "unit_name", "srp", "year", "seq", "published_at")
    shift = F.when(k % 5 == 0, F.expr("interval -1 day")).otherwise(F.expr("interval 1 day"))
    batch = catalog_like(t).withColumns(
        {
            "source_hash": F.when(k % 4 == 0, F.col("source_hash")).otherwise(F.concat(F.col("source_hash"), F.lit("x"))),
            "updated_at_source": F.col("updated_at_source") + shift,
            "object": F.concat(F.col("object"), F.lit(" (rev)")),
            "seen_at": F.when(k % 6 == 1, t.now),
            "position": k,
        }
    )
    again = batch.filter(k % 7 == 0).withColumns({"updated_at_source": F.col("updated_at_source") - F.expr("interval 9 days"), "object": F.lit("velho"), "position": k - 1})
    return catalog, batch.unionByName(again)


def catalog_like(t):
    return t.bids.drop("portal_url", "process", "unit_name", "srp", "year", "seq", "published_at", "team_status", "priority", "notes", "accessed_at", "created_at", "changed_at", "synced_at")


MERGE = f"""
SELECT bid_id, control_no, bid_id % 3 <> 0 AS held, closes_at, updated_at_source AS old_ts, object, seen_at, team_status, created_at, changed_at, synced_at,
  CASE WHEN updated_at_source IS NOT NULL THEN updated_at_source + CASE WHEN bid_id % 5 = 0 THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END END AS new_ts,
  CASE WHEN bid_id % 7 = 0 AND updated_at_source IS NULL THEN object || ' (rev)' ELSE object || ' (rev)' END AS new_object,
  CASE WHEN bid_id % 6 = 1 THEN TIMESTAMP '{NOW}' END AS new_seen,
  CASE WHEN NOT (bid_id % 3 <> 0 OR closes_at IS NULL OR closes_at > TIMESTAMP '{NOW}') THEN 'recusado' WHEN bid_id % 3 = 0 THEN 'novo'
    WHEN bid_id % 4 <> 0 AND (updated_at_source IS NULL OR bid_id % 5 <> 0) THEN 'atualizado' ELSE 'ignorado' END AS action FROM bids"""


@query("agg_merge_counters", f"""
SELECT count(*) AS received, count(*) FILTER (action <> 'recusado') AS admitted, count(*) FILTER (action = 'recusado') AS refused, count(*) FILTER (action = 'novo') AS new,
  count(*) FILTER (action = 'atualizado') AS updated, count(*) FILTER (action = 'ignorado') AS ignored FROM ({MERGE})""")
def _(t):
    catalog, batch = merge_case(t)
    return ag.merge_counters(merge.merge_catalog(catalog, batch, "abertas", t.now))


@query("agg_job_counters", f"""
SELECT bid_id % 10 AS job_id, count(*) AS received, count(*) FILTER (action = 'novo') AS new, count(*) FILTER (action = 'atualizado') AS updated, count(*) FILTER (action = 'ignorado') AS ignored FROM ({MERGE}) GROUP BY 1""")
def _(t):
    catalog, batch = merge_case(t)
    m = merge.merge_catalog(catalog, batch, "abertas", t.now).withColumn("job_id", F.element_at(F.split("control_no", "-"), -1).cast("long") % 10)
    return ag.merge_counters(m, ["job_id"]).select("job_id", "received", "new", "updated", "ignored")


@query("agg_api_health", """
SELECT job_id, count(*) AS requests, count(*) FILTER (ok) AS succeeded, sum(timeouts)::BIGINT AS timeouts, sum(e429)::BIGINT AS e429, sum(e5xx)::BIGINT AS e5xx, sum(other)::BIGINT AS other,
  sum(latency_ms)::BIGINT AS latency_total_ms, max(latency_ms) AS latency_max_ms,
  count(*) FILTER (last_ok IS NULL OR ts > last_ok) AS consecutive_failures FROM (SELECT *, max(ts) FILTER (ok) OVER (PARTITION BY job_id) AS last_ok FROM calls) GROUP BY job_id""")
def _(t):
    return ag.api_health(t.calls)


METRIC_SUMS = ["latency_ms", "timeouts", "e429"]


@query("agg_idempotent_metrics", "SELECT job_id, sum(latency_ms)::BIGINT AS latency_ms, sum(timeouts)::BIGINT AS timeouts, sum(e429)::BIGINT AS e429 FROM calls GROUP BY job_id")
def _(t):
    replayed = t.calls.unionByName(t.calls.filter("event_type <> 'view'"))
    return ag.idempotent_metrics(replayed, METRIC_SUMS)


@query("agg_items", "SELECT bid_id, count(*) AS items, round(sum(total), 2) AS items_value, max(unit_price) AS max_unit_price FROM items GROUP BY bid_id")
def _(t):
    return ag.items_summary(t.items, ["bid_id"]).withColumn("items_value", F.round("items_value", 2))


FACTS = """
SELECT bid_id, sum(n)::BIGINT AS items, sum(v)::DOUBLE AS items_value, sum(small)::BIGINT AS small_business_items, string_agg(status || '=' || n, ';' ORDER BY status) AS statuses, bool_and(awarded) AS all_awarded
FROM (SELECT bid_id, coalesce(status_name, 'Sem situação informada') AS status, count(*) AS n, sum(total::DECIMAL(18,2)) AS v, count(*) FILTER (benefit_name IS NOT NULL) AS small,
  bool_and(has_result OR coalesce(status_name = 'Homologado', false)) AS awarded FROM items GROUP BY ALL) GROUP BY bid_id"""


def flat_map(c):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")


@query("agg_tender_facts", FACTS)
def _(t):
    return ag.tender_facts(t.items).withColumn("statuses", flat_map(F.col("statuses")))


@query("agg_shortlist_totals", """
SELECT count(*) AS bids, sum(coalesce(n, 0))::BIGINT AS documents, count(*) FILTER (a.state = 'pronta') AS analysed, coalesce(sum(value), 0)::DOUBLE AS value_total
FROM bids JOIN shortlist USING (bid_id) LEFT JOIN (SELECT bid_id, count(*) AS n FROM docs WHERE active GROUP BY bid_id) USING (bid_id) LEFT JOIN analyses a USING (bid_id)""")
def _(t):
    view = projections.shortlist_view(t.bid_core, t.shortlist, t.docs, t.files, t.doc_state, t.analyses)
    return ag.shortlist_totals(view).withColumn("value_total", F.col("value_total").cast("double"))


@query("agg_doc_types_set", "SELECT bid_id, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS types FROM docs WHERE active GROUP BY bid_id")
def _(t):
    return ag.document_types(t.docs).select("bid_id", F.array_join("types", ",").alias("types"))


FLAGS = "(SELECT bid_id, bool_or(doc_type = 'projeto') AS p, bool_or(doc_type = 'orcamento') AS o, bool_or(doc_type = 'edital') AS e FROM docs WHERE active GROUP BY bid_id)"
DOC_SHARE = "(0.0::DOUBLE + CASE WHEN p THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN o THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN e THEN 0.15::DOUBLE ELSE 0 END)"
RESCORE = f"""
SELECT b.bid_id, b.score AS old_score, {w.score('object', 'modality', 'value', 'category', DOC_SHARE)} AS new_score, {w.is_open()} AS open_now FROM bids b LEFT JOIN {FLAGS} f USING (bid_id)"""


@query("agg_rescore_impact", f"""
SELECT count(*) FILTER (old_score <> new_score) AS changed, count(*) FILTER (old_score < 60 AND new_score >= 60) AS now_crossing, count(*) FILTER (old_score >= 60 AND new_score < 60) AS no_longer_crossing,
  count(*) FILTER (old_score < 60 AND new_score >= 60 AND coalesce(open_now, false)) AS crossing_and_open FROM ({RESCORE})""")
def _(t):
    return ag.rescore_impact(incremental.rescore(t.bid_core, t.titled_docs, t.now), 60)


COVERAGE = """
SELECT bid_id, active_docs, available, failed, active_docs - available - failed AS pending,
  CASE WHEN available = active_docs THEN 'completa' WHEN failed > 0 OR available > 0 THEN 'parcial' ELSE 'indisponivel' END AS coverage
FROM (SELECT bid_id, count(*) AS active_docs, count(*) FILTER (state = 'extraido' AND trim(text) <> '') AS available, count(*) FILTER (state = 'erro') AS failed FROM files WHERE active GROUP BY bid_id)"""


@query("agg_text_coverage", COVERAGE)
def _(t):
    return ag.text_coverage(t.files)


@query("agg_completeness", """
SELECT bid_id, count(*) FILTER (section <> 'habilitacao' AND value IS NOT NULL) AS fields_filled, count(*) FILTER (section <> 'habilitacao') AS fields_total,
  count(*) FILTER ((section = 'habilitacao' OR value IS NOT NULL) AND length(quote) > 60) AS quotes_confirmed, count(*) FILTER (section = 'habilitacao') AS documents FROM answers GROUP BY bid_id""")
def _(t):
    return ag.completeness(t.answers.withColumn("confirmed", F.length("quote") > 60))


@query("agg_latency_summary", """
SELECT event_type, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, min(latency_ms) AS min, max(latency_ms) AS max,
  floor(avg(latency_ms) + 0.5)::BIGINT AS mean FROM calls GROUP BY event_type""")
def _(t):
    return ag.latency_summary(t.calls, "latency_ms", ["event_type"])


@query("agg_error_groups", "SELECT CASE WHEN timeouts = 1 THEN 'timeout' ELSE 'http' END AS kind, CASE WHEN e429 = 1 THEN 429 WHEN e5xx = 1 THEN 500 WHEN other = 1 THEN 404 END AS status, count(*) AS n FROM calls WHERE NOT ok GROUP BY ALL")
def _(t):
    status = F.when(F.col("e429") == 1, 429).when(F.col("e5xx") == 1, 500).when(F.col("other") == 1, 404)
    bad = t.calls.filter(~F.col("ok")).select(F.when(F.col("timeouts") == 1, "timeout").otherwise("http").alias("kind"), status.alias("status"))
    return ag.error_groups(bad)


@query("agg_search_gates", """
SELECT 'cobertura' AS gate, (SELECT count(*) FROM vectors) / (SELECT count(*) FROM bids) >= 0.99 AS pass
UNION ALL SELECT 'latencia', count(*) >= 100 AND quantile_disc(latency_ms, 0.95) <= 3000 AND quantile_disc(latency_ms, 0.99) <= 6000 FROM calls
UNION ALL SELECT 'completude', bool_and(ok) FROM calls""")
def _(t):
    runs = t.calls.select("latency_ms", F.col("ok").alias("complete"))
    cov = ag.embedding_coverage(t.bid_core, t.vectors, t.files, t.chunks, MODEL)
    return ag.search_gates(runs, cov, 3000, 6000)


THRESHOLDS = [0.2, 0.3, 0.5, 0.7, 0.9, 1.1]
SWEEP_HITS = f"SELECT q.query_id, v.bid_id, {COS} AS distance, v.label = q.query_id AND v.model = '{MODEL}' AS in_lexical FROM themes q, vectors v"


@query("agg_threshold_sweep", f"""
WITH h AS ({SWEEP_HITS}), l AS (SELECT label::BIGINT AS query_id, count(*) AS total FROM vectors WHERE model = '{MODEL}' GROUP BY 1),
x AS (SELECT t AS threshold, l.query_id, l.total, count(*) FILTER (NOT in_lexical AND distance < t) AS extra FROM l JOIN h USING (query_id), (SELECT unnest({THRESHOLDS})::DOUBLE AS t) GROUP BY ALL)
SELECT threshold, round(median((total + extra) / total), 6) AS median_ratio, count(*) FILTER (extra = 0) AS no_gain, count(*) AS queries FROM x GROUP BY threshold""")
def _(t):
    known = t.vectors.withColumn("known", F.array(F.when(F.col("model") == MODEL, F.col("label")).cast(dict(t.themes.dtypes)["query_id"])))
    extra = vx.counts_under(known, t.themes, THRESHOLDS, "known")
    lexical = t.vectors.filter(F.col("model") == MODEL).groupBy(F.col("label").cast("long").alias("query_id")).agg(F.count(F.lit(1)).alias("lexical_total"))
    return ag.threshold_sweep(extra, lexical, THRESHOLDS).withColumn("median_ratio", F.round("median_ratio", 6))


CHUNK_LIMIT = 0.9


@query("agg_chunk_only", f"""
WITH o AS (SELECT q.query_id, v.bid_id, {COS} AS d FROM themes q, vectors v), c AS (SELECT q.query_id, v.bid_id, min({COS}) AS d FROM themes q, chunks v GROUP BY ALL),
b AS (SELECT coalesce(o.query_id, c.query_id) AS query_id, coalesce(o.bid_id, c.bid_id) AS bid_id, o.d AS od, c.d AS cd FROM o FULL JOIN c ON o.query_id = c.query_id AND o.bid_id = c.bid_id),
f AS (SELECT query_id, coalesce(od < {CHUNK_LIMIT}, false) AS by_o, coalesce(cd < {CHUNK_LIMIT}, false) AS by_c FROM b)
SELECT query_id, count(*) FILTER (by_c AND NOT by_o) AS chunk_only, count(*) FILTER (by_c) AS by_chunk, count(*) FILTER (by_o OR by_c) AS results FROM f GROUP BY query_id HAVING count(*) FILTER (by_o OR by_c) > 0""")
def _(t):
    o = vx.under_limit(t.vectors, t.themes, CHUNK_LIMIT, "bid_id").withColumnRenamed("distance", "obj_distance")
    c = vx.under_limit(t.chunks, t.themes, CHUNK_LIMIT, "chunk_id").join(t.chunks.select("chunk_id", "bid_id"), "chunk_id")
    c = c.groupBy("query_id", "bid_id").agg(F.min("distance").alias("chunk_distance"))
    best = o.join(c, ["query_id", "bid_id"], "full_outer").withColumn("in_lexical", F.lit(False))
    return ag.chunk_only(best, CHUNK_LIMIT)

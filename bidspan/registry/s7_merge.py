"""Merges, incremental windows, state rules and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.operators import incremental as inc
from bidspan.operators import merge as mg
from bidspan.registry import s1_sources as s1
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.s1_sources import sql_stamp, stamp
from bidspan.registry.s4_aggregates import CLOSED, MERGE, RESCORE, merge_case
from bidspan.registry.tables import EVENTS_TODAY, MODEL, NOW
from bidspan.session import fresh_path
from bidspan.sources.sinks import KeyedTable, Snapshot
from bidspan.streaming import jobs as sj

NOWS = f"TIMESTAMP '{NOW}'"
PARTS_OF_TABLE = 16


def stored(t, rows, key):
    """``rows`` as a table by key hash, its first version written."""
    table = KeyedTable(t.spark, fresh_path(t.spark, "table"), key, PARTS_OF_TABLE)
    table.write(rows, 0)
    return table


@query("merge_catalog", f"""
SELECT control_no, action, CASE WHEN action IN ('novo', 'atualizado') THEN new_object ELSE object END AS object, CASE WHEN held THEN team_status ELSE 'nova' END AS team_status,
  {sql_stamp(f"CASE WHEN action IN ('novo', 'atualizado') THEN {NOWS} ELSE changed_at END")} AS changed_at, {sql_stamp(f"CASE WHEN action = 'novo' THEN {NOWS} ELSE created_at END")} AS created_at,
  {sql_stamp(NOWS)} AS synced_at, {sql_stamp("coalesce(new_seen, CASE WHEN held THEN seen_at END)")} AS seen_at FROM ({MERGE}) WHERE action <> 'recusado'""")
def _(t):
    catalog, batch = merge_case(t)
    table = stored(t, catalog, "control_no")
    table.merge(batch, 1, lambda held, b: mg.merge_catalog(held, b, "abertas", t.now).filter("coalesce(action, '') <> 'recusado'"))
    return table.read().filter("action IS NOT NULL").select("control_no", "action", "object", "team_status", *[stamp(c, c) for c in ("changed_at", "created_at", "synced_at", "seen_at")])


@query("merge_version_guard", "SELECT bid_id, updated_at_source IS NULL OR closes_at IS NULL OR closes_at >= updated_at_source + INTERVAL 9 DAY AS wins FROM bids")
def _(t):
    return t.bid_core.select("bid_id", mg.version_guard(F.col("updated_at_source") + F.expr("interval 9 days"), F.col("closes_at")).alias("wins"))


@query("merge_keep_seen", f"SELECT bid_id, {sql_stamp('coalesce(seen_at, accessed_at)')} AS seen_at FROM bids")
def _(t):
    return t.bid_core.select("bid_id", stamp(mg.keep_seen(F.col("seen_at"), F.col("accessed_at")), "seen_at"))


@query("merge_touch_times", f"SELECT bid_id, {sql_stamp(f'CASE WHEN priority THEN {NOWS} ELSE changed_at END')} AS changed_at, {sql_stamp(NOWS)} AS synced_at FROM bids")
def _(t):
    times = mg.touch_times(F.col("priority"), t.now, F.col("changed_at"))
    return t.bid_core.select("bid_id", *[stamp(c, n) for n, c in times.items()])


def refresh_case(t):
    """Two bids in three answered again: active documents listed, titles changed."""
    k = F.col("bid_id")
    cols = t.titled_docs.select("bid_id", "seq", "doc_type", "name", "url", "active")
    fresh = cols.filter((k % 3 != 0) & F.col("active")).withColumns({"name": F.concat("name", F.lit(" v2")), "position": F.col("seq")})
    more = fresh.filter(F.col("seq") == 1).withColumns({"seq": F.lit(99), "position": F.lit(99)})
    return cols, fresh.unionByName(more), t.bid_core.filter(k % 3 != 0).select("bid_id")


MERGED_DOCS = """
SELECT bid_id, seq, CASE WHEN bid_id % 3 <> 0 AND active THEN name || ' v2' ELSE name END AS name, active, CASE WHEN bid_id % 3 <> 0 THEN CASE WHEN active THEN 'gravado' ELSE 'removido' END END AS action FROM docs
UNION ALL SELECT bid_id, 99, name || ' v2', active, 'gravado' FROM docs WHERE bid_id % 3 <> 0 AND active AND seq = 1"""


@query("merge_documents", MERGED_DOCS)
def _(t):
    docs, fresh, refreshed = refresh_case(t)
    table = stored(t, docs, "bid_id")
    table.merge(fresh, 1, lambda held, b: mg.merge_documents(held, b, refreshed), keys=refreshed)
    return table.read().select("bid_id", "seq", "name", "active", "action")


@query("merge_score", """
SELECT bid_id, CASE WHEN bid_id % 2 = 0 THEN greatest(0, least(100, score + 60)) ELSE score END AS score, bid_id % 2 = 0 AND greatest(0, least(100, score + 60)) <> score AS score_changed FROM bids""")
def _(t):
    given = t.bid_core.filter("bid_id % 2 = 0").select("bid_id", (F.col("score") + 60).alias("score"))
    return mg.merge_score(t.bid_core, given).select("bid_id", "score", "score_changed")


@query("merge_chunks_replace", "SELECT chunk_id, doc_id, source_hash FROM chunks WHERE label >= 3 UNION ALL SELECT chunk_id + 1000000, doc_id, 'novo' FROM chunks WHERE label < 3")
def _(t):
    base = t.chunks.select("chunk_id", "doc_id", "source_hash", "label")
    fresh = base.filter("label < 3").withColumns({"chunk_id": F.col("chunk_id") + 1000000, "source_hash": F.lit("novo")})
    return mg.merge_chunks_replace(base, fresh).select("chunk_id", "doc_id", "source_hash")


@query("merge_embedding", f"SELECT bid_id, CASE WHEN model = 'antigo' THEN '{MODEL}' ELSE model END AS model, CASE WHEN model = 'antigo' THEN 'hash novo' ELSE source_hash END AS source_hash FROM vectors")
def _(t):
    fresh = t.vectors.filter("model = 'antigo'").withColumns({"model": F.lit(MODEL), "source_hash": F.lit("hash novo")})
    return mg.merge_embedding(t.vectors, fresh).select("bid_id", "model", "source_hash")


@query("merge_file_state", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'extraido' ELSE state END AS state, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE pages END AS pages, chars, sha256,
  CASE WHEN doc_id % 4 = 0 THEN floor(chars / 7 * 10 + 0.5) / 10 END AS density, {sql_stamp(f'CASE WHEN doc_id % 2 = 0 THEN {NOWS} ELSE updated_at END')} AS updated_at FROM files""")
def _(t):
    files = t.files.withColumn("density", F.lit(None).cast("double")).withColumn("error", F.lit("antigo"))
    k = F.col("doc_id")
    patch = t.files.filter(k % 2 == 0).select(
        "doc_id", F.lit("extraido").alias("state"), F.lit(None).cast("string").alias("error"), F.when(k % 4 == 0, 7).alias("pages"), F.when(k % 4 == 0, F.col("chars")).alias("chars"), F.lit(None).cast("string").alias("sha256")
    )
    return mg.merge_file_state(files, patch, t.now).select("doc_id", "state", "pages", "chars", "sha256", "density", stamp("updated_at", "updated_at"))


@query("merge_team_fields", f"""
SELECT 'licitacao' AS part, bid_id, CASE WHEN bid_id % 4 = 0 THEN 'descartada' ELSE team_status END AS team_status, CASE WHEN bid_id % 8 = 0 THEN true ELSE priority END AS priority, notes, {sql_stamp(f'CASE WHEN bid_id % 4 = 0 THEN {NOWS} ELSE changed_at END')} AS at_time FROM bids
UNION ALL SELECT 'historico', bid_id, NULL, NULL, 'Status alterado', {sql_stamp(NOWS)} FROM bids WHERE bid_id % 16 = 0""")
def _(t):
    k = F.col("bid_id")
    patch = t.bid_core.filter(k % 4 == 0).select(
        "bid_id", F.lit("descartada").alias("team_status"), F.when(k % 8 == 0, True).alias("priority"), F.lit(None).cast("string").alias("notes"), F.when(k % 16 == 0, "Status alterado").alias("entry")
    )
    bids, log = mg.merge_team_fields(t.bid_core.select("bid_id", "team_status", "priority", "notes", "changed_at"), patch, t.now)
    a = bids.select(F.lit("licitacao").alias("part"), "bid_id", "team_status", "priority", "notes", stamp("changed_at", "at_time"))
    b = log.select(F.lit("historico").alias("part"), "bid_id", F.lit(None).cast("string").alias("team_status"), F.lit(None).cast("boolean").alias("priority"), F.col("entry").alias("notes"), stamp("at", "at_time"))
    return a.unionByName(b)


@query("merge_shortlist", f"""
WITH a AS (SELECT DISTINCT user_id AS bid_id FROM events WHERE event_type = 'view'), r AS (SELECT DISTINCT user_id AS bid_id FROM events WHERE user_id % 4 = 0)
SELECT 'lista' AS part, bid_id, NULL AS entry FROM (SELECT bid_id FROM shortlist UNION SELECT bid_id FROM a) WHERE bid_id NOT IN (SELECT bid_id FROM r)
UNION ALL SELECT 'historico', bid_id, '{mg.ADDED}' FROM a UNION ALL SELECT 'historico', bid_id, '{mg.REMOVED}' FROM r""")
def _(t):
    user = F.col("user_id").alias("bid_id")
    add, remove = t.raw("events").filter("event_type = 'view'").select(user).distinct(), t.raw("events").filter("user_id % 4 = 0").select(user).distinct()
    left, log = mg.merge_shortlist(t.shortlist, add, remove, t.now)
    a = left.select(F.lit("lista").alias("part"), "bid_id", F.lit(None).cast("string").alias("entry"))
    return a.unionByName(log.select(F.lit("historico").alias("part"), "bid_id", "entry"))


@query("page_idempotent", """
WITH p AS (SELECT DISTINCT job_id AS s, k + 1 AS page, (job_id % 50 + 1)::INT AS nxt FROM calls), f AS (SELECT * FROM p WHERE page >= nxt),
g AS (SELECT s, min(page) AS gap FROM f a WHERE page <> nxt AND NOT EXISTS (SELECT 1 FROM f b WHERE b.s = a.s AND b.page = a.page - 1) GROUP BY s)
SELECT s AS segment_id, page, CASE WHEN page < nxt THEN 'pular' WHEN gap IS NOT NULL AND page >= gap THEN 'erro' ELSE 'aplicar' END AS decision FROM p LEFT JOIN g USING (s)""")
def _(t):
    pages = t.calls.select(F.col("job_id").alias("segment_id"), (F.col("k") + 1).alias("page"))
    ledger = t.jobs.select(F.col("job_id").alias("segment_id"), (F.col("job_id") % 50 + 1).cast("int").alias("next_page"))
    return mg.page_ledger(pages, ledger)


@query("segment_finish", "SELECT segment_id, coalesce(pages_applied >= total_pages, false) OR pages_applied = 0 AS finished FROM segments")
def _(t):
    return t.segments.select("segment_id", mg.segment_finish(F.col("pages_applied"), F.col("total_pages"), F.col("pages_applied")).alias("finished"))


STALE = f"(state = 'pendente' OR (state = 'erro' AND changed_at < {NOWS} - INTERVAL 6 HOUR) OR (state = 'coletando' AND changed_at < {NOWS} - INTERVAL 15 MINUTE))"


@query("state_expire", f"SELECT bid_id, CASE WHEN {STALE} THEN 'pendente' ELSE state END AS state FROM doc_state")
def _(t):
    return mg.state_expire(t.doc_state, t.now).select("bid_id", "state")


@query("state_fail", """
SELECT bid_id, CASE WHEN bid_id % 7 = 0 THEN CASE WHEN bid_id % 2 = 0 THEN 'erro' ELSE 'pendente' END ELSE s.state END AS state, CASE WHEN bid_id % 7 = 0 THEN 1200 END AS error_chars
FROM (SELECT bid_id FROM bids WHERE bid_id % 7 = 0 UNION SELECT bid_id FROM doc_state) LEFT JOIN doc_state s USING (bid_id)""")
def _(t):
    failures = t.bid_core.filter("bid_id % 7 = 0").select("bid_id", F.repeat(F.lit("falha "), 200).alias("message"), (F.col("bid_id") % 2 == 0).alias("final"))
    return mg.state_fail(t.doc_state, failures, t.now).select("bid_id", "state", F.length("error").alias("error_chars"))


@query("analysis_cache_hit", """
SELECT bid_id, coalesce(state = 'pronta' AND (a.fingerprint = 'f' || (bid_id % 2) OR final_format), false) AS reuse FROM bids LEFT JOIN (SELECT bid_id AS b, * EXCLUDE (bid_id, state), CASE WHEN bid_id % 2 = 1 THEN 'pronta' ELSE state END AS state FROM analyses) a ON a.b = bid_id""")
def _(t):
    cache = t.analyses.withColumn("state", F.when(F.col("bid_id") % 2 == 1, "pronta").otherwise(F.col("state")))
    bids = t.bid_core.select("bid_id", F.concat(F.lit("f"), (F.col("bid_id") % 2).cast("string")).alias("fingerprint"))
    return mg.analysis_reuse(bids, cache).select("bid_id", "reuse")


# -------------------------------------------------------------------- incremental


def parts(t):
    return inc.partitions(t.segments.select("uf").distinct(), t.segments.select("modality_id").distinct())


def day(c, name):
    return F.date_format(c, "yyyy-MM-dd").alias(name)


def sql_day(x):
    return f"strftime({x}, '%Y-%m-%d')"


PARTS = "(SELECT uf, modality_id FROM (SELECT DISTINCT uf FROM segments), (SELECT DISTINCT modality_id FROM segments))"


@query("incr_window_plan", f"""
WITH s AS (SELECT uf, modality_id, least(coalesce(last_closed_date + 1, DATE '2023-12-20') - 2, DATE '{EVENTS_TODAY}') AS first FROM {PARTS} p LEFT JOIN frontier USING (uf, modality_id)),
x AS (SELECT uf, modality_id, unnest(generate_series(first::TIMESTAMP, TIMESTAMP '{EVENTS_TODAY}', INTERVAL 7 DAY))::DATE AS d FROM s)
SELECT uf, modality_id, {sql_day('d')} AS from_date, {sql_day(f"least(d + 6, DATE '{EVENTS_TODAY}')")} AS to_date FROM x""")
def _(t):
    plan = inc.window_plan(parts(t), t.frontier, "2023-12-20", EVENTS_TODAY)
    return plan.select("uf", "modality_id", day("from_date", "from_date"), day("to_date", "to_date"))


@query("incr_stage_plan", f"""
SELECT uf, modality_id, (CASE d WHEN 5 THEN 0 WHEN 15 THEN 1 ELSE 2 END)::INT AS priority, d::INT AS stage_days, {sql_day(f"(DATE '{EVENTS_TODAY}' + d::INT)")} AS until,
  md5('proposta|' || d || '|' || strftime(DATE '{EVENTS_TODAY}' + d::INT, '%Y%m%d') || '|' || uf || '|' || modality_id) AS signature FROM {PARTS}, (SELECT unnest([5, 15, 30]) AS d)""")
def _(t):
    return inc.stage_plan(parts(t), 30, EVENTS_TODAY).withColumn("until", F.date_format("until", "yyyy-MM-dd"))


@query("incr_frontier_advance", f"""
SELECT coalesce(f.uf, c.uf) AS uf, coalesce(f.modality_id, c.modality_id) AS modality_id, {sql_day('greatest(f.last_closed_date, c.last_closed_date)')} AS last_closed_date
FROM frontier f FULL JOIN ({CLOSED}) c ON c.uf = f.uf AND c.modality_id = f.modality_id""")
def _(t):
    out = inc.frontier_advance(t.frontier, t.segments, F.lit(EVENTS_TODAY).cast("date"))
    return out.withColumn("last_closed_date", F.date_format("last_closed_date", "yyyy-MM-dd"))


@query("incr_bootstrap_start", f"SELECT {sql_day(w.to_local('min(started_at)') + '::DATE')} AS start_day FROM jobs WHERE kind = 'descoberta'")
def _(t):
    return inc.bootstrap_start(t.jobs).withColumn("start_day", F.date_format("start_day", "yyyy-MM-dd"))


@query("incr_rescore", RESCORE)
def _(t):
    return inc.rescore(t.bid_core, t.docs, t.now)


@query("incr_reconcile", f"""
SELECT bid_id, coalesce({w.is_open()}, false) AND bid_id % 4 = 0 AS recheck, {sql_stamp(f'CASE WHEN bid_id % 4 <> 0 THEN {NOWS} ELSE seen_at END')} AS seen_at FROM bids""")
def _(t):
    observed = t.bid_core.filter("bid_id % 4 <> 0").select("control_no", t.now.alias("seen_at"))
    return inc.reconcile(t.bid_core, observed, t.now).select("bid_id", "recheck", stamp("seen_at", "seen_at"))


# ---------------------------------------------------------------------- streaming


def empty_catalog(t):
    """An empty catalogue with every column the merge keeps."""
    shape = s1.mapped(t).drop("position")
    for c, kind in {"team_status": "string", "priority": "boolean", "notes": "string", "accessed_at": "timestamp", "created_at": "timestamp", "changed_at": "timestamp", "synced_at": "timestamp", "action": "string"}.items():
        shape = shape.withColumn(c, F.lit(None).cast(kind))
    return t.spark.createDataFrame([], shape.schema)


@query("stream_pages", """
SELECT control_no, object, score, category, 'nova' AS team_status, 'novo' AS action FROM bids WHERE bid_id % 17 <> 0""")
def _(t):
    pages, base = fresh_path(t.spark, "pages"), fresh_path(t.spark, "stream")
    s1.envelopes(t, pages, damage=False)
    catalog, ledger = KeyedTable(t.spark, f"{base}/catalog", "control_no", PARTS_OF_TABLE), Snapshot(t.spark, f"{base}/ledger")
    catalog.write(empty_catalog(t), -1)
    ledger.write(t.spark.createDataFrame([], "segment_id bigint, next_page int"), -1)
    sj.stream_pages(t.spark, pages, catalog, ledger, f"{base}/log", t.now, f"{base}/checkpoint")
    return catalog.read().select("control_no", "object", "score", "category", "team_status", "action")


DELAY = "2 days"  # far below the month that the events span


def arriving(t, df, again, run):
    """``run(stream, checkpoint)`` over the table in two arrivals: every third event comes in the second, and part of the first again."""
    path, checkpoint = fresh_path(t.spark, "events"), fresh_path(t.spark, "ckpt")
    k = F.col("event_id") % 3
    for part in (df.filter(k != 2), df.filter(k == 2).unionByName(df.filter(again))):
        part.write.mode("append").parquet(path)
        run(sj.file_stream(t.spark, path, df.schema), checkpoint)


def update_run(t, stream, keys):
    out = fresh_path(t.spark, "out")
    sj.run_available(stream, sj.write_batches(out), fresh_path(t.spark, "ckpt"), "update")
    return sj.latest_batch(t.spark, out, keys)


@query("stream_dedup", "SELECT event_id, job_id, event_type FROM calls")
def _(t):
    events = t.calls.select("event_id", "job_id", "event_type", "ts")
    out = fresh_path(t.spark, "out")
    arriving(t, events, "event_type <> 'view'", lambda stream, checkpoint: sj.stream_dedup(stream, out, checkpoint, "event_id", "ts", DELAY))
    return sj.deduplicated(t.spark, out, sj.ddl(events), "event_id", DELAY).select("event_id", "job_id", "event_type")


@query("stream_late_data", """
SELECT control_no, CASE WHEN bid_id % 2 = 0 OR updated_at_source IS NULL THEN object || ' (tarde)' ELSE object END AS object FROM bids""")
def _(t):
    cols = ["control_no", "object", "status_id", "closes_at", "updated_at_source", "source_hash", "seen_at", "team_status", "priority", "notes", "accessed_at", "created_at", "changed_at", "synced_at"]
    catalog = t.bids.select(*cols)
    moved = F.col("updated_at_source") + F.when(F.col("bid_id") % 2 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))
    late = t.bids.withColumns({"updated_at_source": moved, "object": F.concat("object", F.lit(" (tarde)")), "source_hash": F.concat("source_hash", F.lit("t")), "position": F.col("bid_id")})
    late = late.select("control_no", "object", "status_id", "closes_at", "updated_at_source", "source_hash", "seen_at", "position")
    path = fresh_path(t.spark, "late")
    late.write.parquet(path)
    store = KeyedTable(t.spark, fresh_path(t.spark, "catalog"), "control_no", PARTS_OF_TABLE)
    store.write(catalog, -1)

    def on_batch(df, batch):
        store.merge(df, batch, lambda held, late: sj.merge_late(held, late, t.now))

    sj.run_available(sj.file_stream(t.spark, path, late.schema), on_batch, fresh_path(t.spark, "ckpt"))
    return store.read().select("control_no", "object")


@query("stream_latest_state", "SELECT bid_id, arg_max(added, event_no) AS member FROM history GROUP BY bid_id")
def _(t):
    log = t.history.select("bid_id", "event_no", "added", "at")
    path = fresh_path(t.spark, "history")
    log.write.parquet(path)
    stream = sj.file_stream(t.spark, path, log.schema)
    return update_run(t, sj.stream_latest_state(stream, "bid_id", ["at", "event_no"], F.col("added")), ["bid_id"])


@query("stream_metrics", "SELECT job_id, sum(latency_ms)::BIGINT AS latency_ms, sum(timeouts)::BIGINT AS timeouts, count(*) AS requests FROM calls GROUP BY job_id")
def _(t):
    events = t.calls.select("event_id", "job_id", "latency_ms", "timeouts", "ts")
    sums = {"latency_ms": F.col("latency_ms"), "timeouts": F.col("timeouts"), "requests": F.lit(1)}
    out = fresh_path(t.spark, "out")
    arriving(t, events, "timeouts = 0", lambda stream, checkpoint: sj.stream_metrics(stream, out, checkpoint, "job_id", "event_id", sums, "ts", DELAY))
    return sj.metrics(t.spark, out, sj.ddl(events), "job_id", "event_id", sums, DELAY)


@query("stream_day_counts", f"SELECT {sql_day('(ts - INTERVAL 3 HOUR)::DATE')} AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    events = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = fresh_path(t.spark, "out")
    arriving(t, events, "false", lambda stream, checkpoint: sj.stream_day_counts(stream, out, checkpoint, "ts", DELAY))
    counted = sj.day_counts(t.spark, out, sj.ddl(events), "ts")
    return counted.select(F.date_format("local_day", "yyyy-MM-dd").alias("day"), "n")

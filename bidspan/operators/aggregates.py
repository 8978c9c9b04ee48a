"""Metrics, coverage and progress. One pass each; distinct counts are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspan.functions import classify, dates, scoring
from bidspan.functions import text as tx
from bidspan.session import LOCAL_ZONE


def _open(now: Column) -> Column:
    return dates.is_open(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)


def last_sync(jobs: DataFrame) -> DataFrame:
    """Latest finished job that did not fail, as one row (NULLs when there is none)."""
    done = jobs.filter((F.col("status") != "falhou") & F.col("finished_at").isNotNull())
    row = F.max_by(F.struct("job_id", "status", "finished_at", "total_new", "total_updated"), F.struct("finished_at", "job_id"))
    return done.agg(row.alias("_r")).select("_r.*")


def dashboard(bids: DataFrame, jobs: DataFrame, now: Column, min_score: int = 60, zone: str = LOCAL_ZONE) -> DataFrame:
    """Twelve numbers in one scan; the last job joins in as scalar subqueries."""
    open_now = _open(now)
    today = dates.local_day(now, 0, zone)
    last = last_sync(jobs)
    return bids.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("team_status") == "nova").alias("unreviewed"),
        F.count_if(F.col("created_at") >= dates.day_start(today, 0, zone)).alias("new_today"),
        F.count_if(open_now & (F.col("closes_at") < dates.day_start(today, 2, zone))).alias("closing_by_tomorrow"),
        F.count_if(open_now & (F.col("closes_at") <= now + F.expr("interval 7 days"))).alias("due_in_7_days"),
        F.count_if(open_now).alias("open"),
        F.coalesce(F.sum("value"), F.lit(0)).alias("value_total"),
        F.count_if(F.col("value").isNull()).alias("undisclosed"),
        F.count_if(F.col("priority")).alias("priority"),
        F.count_if(F.col("score") >= min_score).alias("recommended"),
    ).withColumns(
        {
            "new_last_sync": F.coalesce(last.select("total_new").scalar(), F.lit(0)),
            "updated_last_sync": F.coalesce(last.select("total_updated").scalar(), F.lit(0)),
        }
    )


def by_uf_open(bids: DataFrame, now: Column) -> DataFrame:
    uf = F.coalesce("uf", F.lit("—")).alias("uf")
    return bids.filter(_open(now)).groupBy(uf).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "uf")


def top_places(bids: DataFrame, n: int = 6) -> DataFrame:
    place = F.concat_ws(" / ", F.coalesce("city", F.lit("—")), F.coalesce("uf", F.lit("—"))).alias("place")
    return bids.groupBy(place).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "place").limit(n)


def by_category(bids: DataFrame) -> DataFrame:
    return bids.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


FACETS = ["uf", "city", "agency", "category", "modality"]


def facets(bids: DataFrame) -> DataFrame:
    """Distinct (facet, value) rows. Rows, not arrays: a catalogue has very many agencies."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in FACETS]))
    return bids.select(pairs.alias("p")).select("p.*").filter(F.coalesce("value", F.lit("")) != "").distinct()


def document_coverage(bids: DataFrame, docs: DataFrame, state: DataFrame, cut: Column, now: Column) -> DataFrame:
    """Eligible bids and how far their documents are; one row.

    Documents are reduced to flags per bid first, so "distinct bids by type"
    becomes a plain count and no distinct aggregation shuffles raw documents.
    """
    from bidspan.operators.filters import worth_collecting

    eligible = bids.select("bid_id", F.coalesce(worth_collecting(now, cut), F.lit(False)).alias("_eligible"))
    slim = state.select("bid_id", F.col("state").alias("_s"))
    left = eligible.join(slim, "bid_id", "left").agg(
        F.count(F.lit(1)).alias("bids"),
        F.count_if("_eligible").alias("eligible"),
        F.count_if(F.col("_eligible") & (F.col("_s") == "completo")).alias("complete"),
        F.count_if(F.col("_eligible") & (F.col("_s") == "erro")).alias("failed"),
    )
    collecting = state.agg(F.count_if(F.col("state") == "coletando").alias("n")).scalar()
    types = {"with_notice": "edital", "with_project": "projeto", "with_budget": "orcamento"}
    per_bid = docs.filter("active").groupBy("bid_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.bool_or(F.col("doc_type") == t).alias(k) for k, t in types.items()]
    )
    right = per_bid.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("documents"), *[F.count_if(k).alias(k) for k in types])
    return left.withColumns(
        {"collecting": collecting, **{k: right.select(k).scalar() for k in ["documents", *types]}}
    )


def embedding_coverage(bids: DataFrame, vectors: DataFrame, files: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    v = vectors.agg(F.count(F.lit(1)).alias("vectorised"), F.count_if(~F.col("model").eqNullSafe(F.lit(model))).alias("stale_model"))
    c = per_doc.agg(F.count(F.lit(1)).alias("docs_vectorised"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"))
    f = files.agg(F.count_if(F.col("state") == "extraido").alias("docs_with_text"))
    return bids.agg(F.count(F.lit(1)).alias("searchable")).withColumns(
        {n: df.select(n).scalar() for df in (v, f, c) for n in df.columns}
    )


def file_coverage(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents by extraction state; no file row counts as ``pendente``."""
    slim = files.select("bid_id", "seq", F.col("state").alias("_s"))
    state = F.coalesce("_s", F.lit("pendente")).alias("state")
    return docs.join(slim, ["bid_id", "seq"], "left").groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def frontier_summary(frontier: DataFrame) -> DataFrame:
    """The catalogue is as fresh as its most behind partition; one never covered makes it unknown."""
    never = F.count_if(F.col("last_closed_date").isNull())
    # nulls first: NULL sorts below every date inside a struct
    behind = F.min_by(F.struct("uf", "modality_id", "last_closed_date"), F.struct("last_closed_date", "uf", "modality_id"))
    return frontier.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.when(never == 0, F.min("last_closed_date")).alias("closed_until"),
        never.alias("never_covered"),
        behind.alias("_b"),
    ).select(
        "partitions", "closed_until", "never_covered", F.col("_b.uf").alias("behind_uf"),
        F.col("_b.modality_id").alias("behind_modality"), F.col("_b.last_closed_date").alias("behind_date"),
    )


def partition_closed(segments: DataFrame, today: Column) -> DataFrame:
    """Partitions whose segments all finished, with the last day they may close."""
    day = dates.closable_date(F.col("from_date"), F.col("to_date"), today)
    done = F.col("status") == "concluido"
    return (
        segments.groupBy("uf", "modality_id")
        .agg(F.bool_and(done).alias("_all"), F.max(F.when(done, day)).alias("last_closed_date"))
        .filter("_all")
        .drop("_all")
    )


def segment_progress(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by state and pages; the estimate is NULL only when every total is unknown."""
    status = F.col("status")
    known = F.count("total_pages")
    estimate = F.sum(F.coalesce("total_pages", "pages_applied"))
    return segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(status == "concluido").alias("done"),
        F.count_if(status.isin("pendente", "executando")).alias("pending"),
        F.count_if(status == "falhou").alias("failed"),
        F.coalesce(F.sum("pages_applied"), F.lit(0)).alias("pages_applied"),
        F.when(known > 0, estimate).alias("pages_estimated"),
    )


def sync_state(job_status: Column, pending: Column, failed: Column) -> Column:
    complete = (pending == 0) & (failed == 0) & job_status.isin("concluido", "concluido_com_erros")
    return (
        F.when(job_status.isNull(), "nunca")
        .when(job_status == "em_andamento", "coletando")
        .when(job_status == "falhou", "falhou")
        .when(complete, "completo_no_escopo")
        .otherwise("parcial")
    )


def merge_counters(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of merge results; ``action`` is novo, atualizado, ignorado or recusado."""
    a = F.col("action")
    return actions.filter(a.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(a != "recusado").alias("admitted"),
        F.count_if(a == "recusado").alias("refused"),
        F.count_if(a == "novo").alias("new"),
        F.count_if(a == "atualizado").alias("updated"),
        F.count_if(a == "ignorado").alias("ignored"),
    )


CALL_KINDS = ["timeouts", "e429", "e5xx", "other"]


def api_health(calls: DataFrame, key: str = "job_id") -> DataFrame:
    """Additive counters, worst latency and the open failure streak per job.

    Calls are summed up in (key, day) slices, so one busy job spreads over tasks; a
    slice also tells whether it has a success and how many calls follow its last
    one. The open streak of a job is what follows in the last slice with a success
    and all calls of the slices after it: one row a slice, added up along them.
    """
    order = F.struct("ts", "event_id")
    slices = [key, "_slice"]
    sliced = calls.withColumn("_slice", F.to_date("ts"))
    sliced = sliced.withColumn("_last_ok", F.max(F.when(F.col("ok"), order)).over(Window.partitionBy(*slices)))
    sums = sliced.groupBy(*slices).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("ok").alias("succeeded"),
        *[F.sum(F.greatest(F.coalesce(F.col(k), F.lit(0)), F.lit(0))).alias(k) for k in CALL_KINDS],
        F.sum("latency_ms").alias("latency_total_ms"),
        F.max("latency_ms").alias("latency_max_ms"),
        F.count_if(F.col("_last_ok").isNull() | (order > F.col("_last_ok"))).alias("_after"),
    )
    later = Window.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("_settled", F.coalesce(F.max(F.col("succeeded") > 0).over(later), F.lit(False)))
    return known.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("requests", "succeeded", *CALL_KINDS, "latency_total_ms")],
        F.max("latency_max_ms").alias("latency_max_ms"),
        F.sum(F.when(~F.col("_settled"), F.col("_after")).otherwise(0)).alias("consecutive_failures"),
    )


def idempotent_metrics(batches: DataFrame, sums: Sequence[str], key: str = "job_id", event: str = "event_id") -> DataFrame:
    """Additive counters per job, each event id counted once."""
    once = batches.dropDuplicates([event])
    return once.groupBy(key).agg(*[F.sum(F.greatest(F.coalesce(F.col(s), F.lit(0)), F.lit(0))).alias(s) for s in sums])


def items_summary(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("items_value"),
        F.coalesce(F.max("unit_price"), F.lit(0.0)).alias("max_unit_price"),
    )


SMALL_BUSINESS = r"(?i)exclusiv|cota reservada"  # fixed value
UNKNOWN_ITEM_STATUS = "Sem situação informada"  # fixed value


def tender_facts(items: DataFrame) -> DataFrame:
    """Facts per bid: items, value, small-business items, status histogram, all awarded.

    Items are first counted per (bid, status), so the histogram array holds one
    entry per status however many items a bid has.
    """
    status = F.coalesce("status_name", F.lit(UNKNOWN_ITEM_STATUS)).alias("status")
    awarded = F.coalesce(F.col("has_result"), F.lit(False)) | F.coalesce(F.col("status_name").rlike("(?i)homologad"), F.lit(False))
    per_status = items.groupBy("bid_id", status).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce("total", F.lit(0.0)).cast("decimal(18,2)")).alias("_value"),
        F.count_if(F.coalesce(F.col("benefit_name").rlike(SMALL_BUSINESS), F.lit(False))).alias("_small"),
        F.bool_and(awarded).alias("_awarded"),
    )
    return per_status.groupBy("bid_id").agg(
        F.sum("_n").alias("items"),
        F.round(F.sum("_value"), 2).cast("double").alias("items_value"),
        F.sum("_small").alias("small_business_items"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "_n")))).alias("statuses"),
        F.bool_and("_awarded").alias("all_awarded"),
    )


def tender_facts_with_state(bids: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    facts = tender_facts(items)
    joined = bids.join(facts, "bid_id", "left")
    state = classify.tender_state(F.col("status_id"), F.col("items"), F.col("all_awarded"), F.col("closes_at"), now)
    return joined.withColumn("tender_state", state)


def status_histogram(items: DataFrame) -> DataFrame:
    status = F.coalesce("status_name", F.lit(UNKNOWN_ITEM_STATUS)).alias("status")
    counts = items.groupBy("bid_id", status).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("bid_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def shortlist_totals(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count(F.lit(1)).alias("bids"),
        F.coalesce(F.sum("docs_total"), F.lit(0)).alias("documents"),
        F.count_if(F.col("analysis_state") == "pronta").alias("analysed"),
        F.coalesce(F.sum("value"), F.lit(0)).alias("value_total"),
    )


def document_types(docs: DataFrame) -> DataFrame:
    """Set of active types per bid; at most the handful of known types per row."""
    return docs.filter("active").groupBy("bid_id").agg(F.array_sort(F.collect_set("doc_type")).alias("types"))


def type_flags(docs: DataFrame) -> DataFrame:
    """The same set as boolean columns, the form the score needs."""
    return docs.filter("active").groupBy("bid_id").agg(
        *[F.bool_or(F.col("doc_type") == t).alias(f"has_{t}") for t in scoring.DOCUMENT_SHARES]
    )


def rescore_impact(diff: DataFrame, min_score: int) -> DataFrame:
    """How a rescoring moves the recommended set; ``diff(old_score, new_score, open_now)``."""
    before, after = F.col("old_score") >= min_score, F.col("new_score") >= min_score
    return diff.agg(
        F.count_if(F.col("old_score") != F.col("new_score")).alias("changed"),
        F.count_if(~before & after).alias("now_crossing"),
        F.count_if(before & ~after).alias("no_longer_crossing"),
        F.count_if(~before & after & F.coalesce("open_now", F.lit(False))).alias("crossing_and_open"),
    )


READY_STATES = ["extraido", "extraída", "extraida", "pronto", "concluido"]  # fixed values
FAILED_STATES = ["erro", "falha", "falhou"]  # fixed values


def text_coverage(docs: DataFrame) -> DataFrame:
    """Readable, failed and pending active documents per bid, and the overall verdict."""
    state = F.lower(F.coalesce("state", F.lit("")))
    has_text = F.coalesce(F.length(tx.strip(F.col("text"))) > 0, F.lit(False))
    ready = has_text & state.isin(READY_STATES)
    failed = ~ready & state.isin(FAILED_STATES)
    counts = docs.filter(F.coalesce("active", F.lit(True))).groupBy("bid_id").agg(
        F.count(F.lit(1)).alias("active_docs"), F.count_if(ready).alias("available"), F.count_if(failed).alias("failed")
    )
    counts = counts.withColumn("pending", F.col("active_docs") - F.col("available") - F.col("failed"))
    verdict = (
        F.when(F.col("available") == F.col("active_docs"), "completa")
        .when((F.col("failed") > 0) | (F.col("available") > 0), "parcial")
        .otherwise("indisponivel")
    )
    return counts.withColumn("coverage", verdict)


def completeness(answers: DataFrame) -> DataFrame:
    """Filled fields, all fields, proven quotes and listed documents per bid.

    ``answers(bid_id, section, value, confirmed)``; section ``habilitacao`` holds documents.
    """
    is_doc = F.col("section") == "habilitacao"
    filled = F.col("value").isNotNull()
    return answers.groupBy("bid_id").agg(
        F.count_if(~is_doc & filled).alias("fields_filled"),
        F.count_if(~is_doc).alias("fields_total"),
        F.count_if((is_doc | filled) & F.coalesce("confirmed", F.lit(False))).alias("quotes_confirmed"),
        F.count_if(is_doc).alias("documents"),
    )


def latency_summary(samples: DataFrame, value: str, by: Sequence[str] = (), approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """n, nearest-rank percentiles, min, max and rounded mean; NULLs on no samples.

    Nearest rank needs every value of a group. Values are first counted per
    distinct value (map-side), and the percentile is taken over weighted values,
    so repeated measurements shuffle once. ``approximate`` trades exactness for
    a fixed-size sketch.
    """
    v = F.col(value)
    if approximate:
        quantile = lambda p: F.percentile_approx(v, p, accuracy)
        return samples.groupBy(*by).agg(
            F.count(v).alias("n"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), quantile(0.99).alias("p99"),
            F.min(v).alias("min"), F.max(v).alias("max"), scoring.round_half_up(F.avg(v)).cast("long").alias("mean"),
        )
    weighted = samples.filter(v.isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_w"))
    picks = nearest_rank(weighted, value, "_w", by, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    basics = weighted.groupBy(*by).agg(
        F.sum("_w").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
        scoring.round_half_up(F.sum(v * F.col("_w")) / F.sum("_w")).cast("long").alias("mean"),
    )
    return basics.join(picks, list(by)) if by else _pair(basics, picks)


def _pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two single-row results side by side, without a join."""
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


def nearest_rank(weighted: DataFrame, value: str, weight: str, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of weighted values.

    Values are range-bucketed by magnitude first: bucket totals (a few dozen rows
    per group) locate the bucket of each rank, then only inside buckets are
    values ordered, so one large group is split over many tasks.
    """
    v = F.col(value)
    magnitude = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))  # order-preserving
    bucket = F.floor(magnitude * 32).cast("long")
    data = weighted.withColumn("_bucket", bucket)
    sums = data.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_bw"))
    order = Window.partitionBy(*by).orderBy("_bucket")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_bw").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("_total", F.sum("_bw").over(Window.partitionBy(*by)))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = data.join(sums.drop("_bw"), [*by, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum(weight).over(inside))
    picks = [
        F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_total") * share)), v)).alias(name)
        for name, share in shares.items()
    ]
    return placed.groupBy(*by).agg(*picks)


def error_groups(samples: DataFrame) -> DataFrame:
    return samples.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(extra: DataFrame, lexical: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: median hybrid/lexical total ratio and queries without gain.

    ``extra(query_id, threshold, extra)`` counts semantic candidates under each
    threshold that the lexical search missed (none: no row), as
    ``vectors.counts_under`` gives them; ``lexical(query_id, lexical_total)`` are
    the lexical totals. One row per query and threshold is all that is looked at.
    """
    asked = lexical.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    flat = asked.join(extra, ["query_id", "threshold"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    ratio = F.try_divide(F.col("lexical_total") + F.col("extra"), F.col("lexical_total"))
    return flat.groupBy("threshold").agg(
        F.median(ratio).alias("median_ratio"), F.count_if(F.col("extra") == 0).alias("no_gain"), F.count(F.lit(1)).alias("queries")
    )


def chunk_only(best: DataFrame, threshold: float) -> DataFrame:
    """Results only a chunk could find; ``best(query_id, bid_id, obj_distance?, chunk_distance?, in_lexical)``."""
    by_object = F.coalesce(F.col("obj_distance") < threshold, F.lit(False)) | F.col("in_lexical")
    by_chunk = F.coalesce(F.col("chunk_distance") < threshold, F.lit(False))
    return best.groupBy("query_id").agg(
        F.count_if(by_chunk & ~by_object).alias("chunk_only"), F.count_if(by_chunk).alias("by_chunk"), F.count_if(by_object | by_chunk).alias("results")
    )


def search_gates(runs: DataFrame, coverage: DataFrame, p95_max: float = 300.0, p99_max: float = 600.0, min_runs: int = 100, min_coverage: float = 0.99) -> DataFrame:
    """Gate rows (gate, pass): vector coverage, latency, completeness.

    ``runs(latency_ms, complete)``, ``coverage(searchable, vectorised)`` one row.
    """
    s = latency_summary(runs, "latency_ms")
    one = s.select("n", "p95", "p99").withColumns(
        {
            "_complete": runs.agg(F.bool_and("complete")).scalar(),
            "_cov": coverage.select(F.try_divide(F.col("vectorised"), F.col("searchable"))).scalar(),
        }
    )
    row = lambda name, ok: F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("pass"))
    fast = (F.col("n") >= min_runs) & (F.col("p95") <= p95_max) & (F.col("p99") <= p99_max)
    gates = F.array(row("cobertura", F.col("_cov") >= min_coverage), row("latencia", fast), row("completude", F.col("_complete")))
    return one.select(F.explode(gates).alias("g")).select("g.gate", "g.pass")



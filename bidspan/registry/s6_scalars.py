"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.functions import classify, dates, geo, hashing, jsonx, pieces, scoring
from bidspan.functions import text as tx
from bidspan.functions import vectors as vv
from bidspan.operators import aggregates as ag
from bidspan.operators import merge
from bidspan.plans import extraction
from bidspan.registry import s2_filters as s2
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.s1_sources import sql_stamp, stamp
from bidspan.registry.s4_aggregates import FACTS, flat_map
from bidspan.registry.tables import NOW, pick



def documents(t):
    return t.raw("documents")


# ----------------------------------------------------------------------- strings


@query("str_fold", f"SELECT doc_id, md5({w.fold('text')}) AS folded FROM documents")
def _(t):
    return documents(t).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("str_trim_null", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def _(t):
    padded = F.when(F.col("c_custkey") % 5 == 0, F.lit(" \t \n")).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("\t\r\n")))
    return t.raw("customer").select("c_custkey", tx.trim_null(padded).alias("name"))


@query("str_squash_space", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g'))) AS squashed FROM documents")
def _(t):
    noisy = F.concat(F.lit("\u0000 "), F.regexp_replace("text", " ", "  "))
    return documents(t).select("doc_id", F.md5(tx.squash_space(noisy)).alias("squashed"))


@query("str_compact", f"SELECT doc_id, md5(regexp_replace({w.fold('text')}, '[^a-z0-9]', '', 'g')) AS compact FROM documents")
def _(t):
    return documents(t).select("doc_id", F.md5(tx.compact(tx.fold(F.col("text")))).alias("compact"))


@query("str_compare_form", f"SELECT doc_id, md5({w.compare_form('text')}) AS form FROM documents")
def _(t):
    return documents(t).select("doc_id", F.md5(tx.compare_form(F.col("text"))).alias("form"))


@query("str_fix_mojibake", "SELECT doc_id, md5(text) AS fixed FROM documents")
def _(t):
    """Texts are damaged the way the source damages them, then repaired whole."""
    wide = F.col("text").rlike("(?s)[^\\u0000-\\u00ff]")
    damaged = F.when(wide, F.col("text")).otherwise(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    ascii_only = F.col("text").rlike("(?s)^[\\u0000-\\u007f]*$")
    return documents(t).select("doc_id", F.md5(F.when(ascii_only, F.col("text")).otherwise(tx.fix_mojibake(damaged))).alias("fixed"))


@query("str_clean_title", f"SELECT l_orderkey, l_linenumber, {w.clean('title')} AS title, count(*) AS n FROM (SELECT bid_id AS l_orderkey, seq AS l_linenumber, title FROM raw_docs) GROUP BY ALL")
def _(t):
    title = tx.clean_title(F.concat(F.lit("  "), F.col("title"), F.lit("\n")))
    return t.raw_docs.groupBy(F.col("bid_id").alias("l_orderkey"), F.col("seq").alias("l_linenumber"), title.alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("str_strip_port", "SELECT bid_id, seq, replace(url, ':1401/', '/') AS url, count(*) AS n FROM raw_docs GROUP BY ALL")
def _(t):
    return t.raw_docs.select("bid_id", "seq", tx.strip_port(F.col("url")).alias("url")).groupBy("bid_id", "seq", "url").agg(F.count(F.lit(1)).alias("n"))


@query("str_filename_from_header", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ç+1.pdf' WHEN 1 THEN replace(p_name, ' ', ' ') || '.doc' END AS name FROM part""")
def _(t):
    k = F.col("p_partkey")
    header = (
        F.when(k % 3 == 0, F.concat(F.lit("attachment; filename=\"x.pdf\"; filename*=UTF-8''"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%20%C3%A7+1.pdf")))
        .when(k % 3 == 1, F.concat(F.lit('attachment; filename="'), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit('.doc"')))
        .otherwise("attachment")
    )
    return t.raw("part").select("p_partkey", tx.filename_from_header(header).alias("name"))


@query("str_extension", "SELECT doc_id, CASE WHEN contains(name, '.') THEN nullif(lower(string_split(name, '.')[-1]), '') END AS ext FROM docs")
def _(t):
    return t.docs.select("doc_id", tx.extension(F.col("name")).alias("ext"))


ANCHOR_WORDS = [r"\bthe\b", r"[0-9]{2,}", r"e-?mail|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"]


@query("str_count_anchor_hits", "SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, {w.lit('(?i)' + p)})) AS n{i}, coalesce(list_sum(list_transform(regexp_extract_all(text, {w.lit('(?i)' + p)}), lambda m: length(m))), 0)::BIGINT AS c{i}"
    for i, p in enumerate(ANCHOR_WORDS)) + " FROM documents")
def _(t):
    spans = documents(t).select("doc_id", F.explode_outer(pieces.anchor_spans(F.col("text"), ANCHOR_WORDS)).alias("s"))
    cols = []
    for i in range(len(ANCHOR_WORDS)):
        hit = F.col("s.pattern") == i
        cols += [F.count_if(hit).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, F.col("s.end") - F.col("s.start"))), F.lit(0)).alias(f"c{i}")]
    return spans.groupBy("doc_id").agg(*cols)


@query("str_null_words", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN NULL ELSE o_orderpriority END AS word FROM orders")
def _(t):
    word = F.when(F.col("o_orderkey") % 5 == 4, F.col("o_orderpriority")).otherwise(pick(["--", " N/A", "Null", "NÃO INFORMADO "], F.col("o_orderkey") % 5))
    return t.raw("orders").select("o_orderkey", tx.null_words(word).alias("word"))


@query("str_money_parse", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 3 THEN round(o_totalprice)::BIGINT::DOUBLE WHEN 4 THEN floor(o_totalprice) ELSE o_totalprice END AS value FROM orders")
def _(t):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    plain = F.format_string("%.2f", v)
    brl = F.translate(F.format_number(v, 2), ",.", ".,")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("R$ "), brl)).when(k % 6 == 1, plain).when(k % 6 == 2, F.replace(plain, F.lit("."), F.lit(",")))
        .when(k % 6 == 3, F.replace(F.format_number(F.round(v), 0), F.lit(","), F.lit("."))).when(k % 6 == 4, F.floor(v).cast("string")).otherwise("sigiloso")
    )
    return t.raw("orders").select("o_orderkey", tx.money_parse(text).alias("value"))


@query("str_money_format", "SELECT bid_id, CASE WHEN value IS NULL THEN 'Não informado' ELSE 'R$ ' || translate(format('{:,.2f}', value::DOUBLE), ',.', '.,') END AS text FROM bids")
def _(t):
    return t.bid_core.select("bid_id", tx.money_format(F.col("value")).alias("text"))


@query("str_distance_format", f"""
SELECT bid_id, coalesce(translate(format('{{:,.1f}}', round(km::DECIMAL(20,6), 1)::DOUBLE), ',.', '.,') || ' km', '—') AS text FROM (SELECT bid_id, {s2.KM} AS km FROM bids LEFT JOIN cities c USING (city_code), (SELECT lat, lon FROM cities WHERE city_code = '{s2.ORIGIN}') o)""")
def _(t):
    from bidspan.operators.filters import within_radius

    return within_radius(t.bids, t.cities, s2.ORIGIN, None).select("bid_id", tx.distance_format(F.col("km")).alias("text"))


@query("str_duration", """
SELECT event_id, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM (SELECT event_id, greatest(0, floor((latency_ms * 97 - 500) / 1000.0))::BIGINT AS s FROM calls)""")
def _(t):
    return t.calls.select("event_id", tx.duration(F.col("latency_ms") * 97 - 500).alias("text"))


@query("str_escape_markup", "SELECT page_id, md5(replace(replace(html, '<', '\\u003c'), '>', '\\u003e')) AS escaped FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.md5(tx.escape_markup(F.col("html"))).alias("escaped"))


PARTS = "regexp_split_to_array(replace(text, chr(10), ' [..] '), '\\[[^\\]]*\\]|\\(\\.\\.\\.\\)|\\.{3}|…')"


@query("str_split_ellipsis", f"""
SELECT doc_id, len(p)::INT AS parts, md5(array_to_string(p, '|')) AS hash FROM (SELECT doc_id, list_filter(list_transform({PARTS}, lambda x: {w.compare_form('x')}), lambda x: x <> '') AS p FROM documents)""")
def _(t):
    p = tx.split_ellipsis(F.replace("text", F.lit("\n"), F.lit(" [..] ")))
    return documents(t).select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("parts"), F.md5(F.array_join("p", "|")).alias("hash"))


@query("str_url_build", "SELECT bid_id, portal_url FROM bids")
def _(t):
    return t.bid_core.select("bid_id", tx.portal_url(F.col("cnpj"), F.col("year"), F.col("seq")).alias("portal_url"))


# ---------------------------------------------------------------- classification


@query("cls_category", f"SELECT doc_id, {w.category('text')} AS from_text, {w.category('object')} AS from_object FROM documents LEFT JOIN bids ON bid_id = doc_id")
def _(t):
    joined = documents(t).join(t.bid_core.select(F.col("bid_id").alias("doc_id"), "object"), "doc_id", "left")
    return joined.select("doc_id", classify.category(F.col("text")).alias("from_text"), classify.category(F.col("object")).alias("from_object"))


@query("cls_document_type", f"SELECT source_type, title, {w.document_type('source_type', 'title')} AS doc_type, count(*) AS n FROM raw_docs GROUP BY ALL")
def _(t):
    kinds = t.raw_docs.groupBy("source_type", "title").agg(F.count(F.lit(1)).alias("n"))  # the type depends on these two alone
    return kinds.select("source_type", "title", classify.document_type(F.col("source_type"), F.col("title")).alias("doc_type"), "n")


@query("cls_document_relevance", f"SELECT doc_id, {s2.RELEVANCE} AS relevance FROM docs")
def _(t):
    rel = classify.document_relevance(F.col("name"), F.col("source_type"), F.col("doc_type"), F.col("active"), F.col("url"))
    return t.titled_docs.select("doc_id", rel.alias("relevance"))


@query("cls_file_type", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'doc' ELSE 'txt' END AS ext, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'application/msword' END AS mime,
  doc_id % 4 = 0 AS ok, CASE WHEN doc_id % 2 = 0 THEN 'um nome.TXT' ELSE 'arquivo ' || doc_id || '.txt' END AS name FROM documents""")
def _(t):
    k = F.col("doc_id")
    magic = F.when(k % 4 == 0, "25504446").when(k % 4 == 1, "504B0304").when(k % 4 == 2, "D0CF11E0").otherwise("00112233")
    content = F.concat(F.unhex(magic), F.encode("text", "UTF-8"))
    header = F.when(k % 2 == 0, F.lit('attachment; filename="um+nome.TXT"'))
    kind = classify.file_type(header, F.concat(F.lit("arquivo "), k.cast("string"), F.lit(".txt")), content)
    return documents(t).select("doc_id", kind.alias("k")).select("doc_id", "k.ext", "k.mime", "k.ok", "k.name")


CHECK = {flag: (types, terms) for flag, (types, terms) in classify.CHECKLIST.items()}
CHECK_SQL = ", ".join(
    f"bool_or({'doc_type IN (' + ', '.join(w.lit(x) for x in types) + ') OR ' if types else ''}{w.any_of(w.fold('name'), terms)}) AS {flag}" for flag, (types, terms) in CHECK.items()
)


@query("cls_checklist", f"SELECT bid_id, {', '.join(CHECK)}, ({' + '.join(f + '::INT' for f in CHECK)})::INT AS ready FROM (SELECT bid_id, {CHECK_SQL} FROM docs GROUP BY bid_id)")
def _(t):
    flags = classify.checklist_row_flags(F.col("doc_type"), F.col("name"))
    per_bid = t.titled_docs.groupBy("bid_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    return per_bid.withColumn("ready", sum((F.col(n).cast("int") for n in flags), F.lit(0)))


@query("cls_proximity", f"""
SELECT bid_id, CASE WHEN km IS NULL THEN 'desconhecido' WHEN km <= 100 THEN 'muito_perto' WHEN km <= 250 THEN 'media' ELSE 'longe' END AS band FROM (SELECT bid_id, {s2.KM} AS km FROM bids LEFT JOIN cities c USING (city_code), (SELECT lat, lon FROM cities WHERE city_code = '{s2.ORIGIN}') o)""")
def _(t):
    from bidspan.operators.filters import within_radius

    return within_radius(t.bids, t.cities, s2.ORIGIN, None).select("bid_id", classify.proximity(F.col("km")).alias("band"))


@query("cls_score_band", "SELECT bid_id, CASE WHEN score >= 70 THEN 'alta' WHEN score >= 40 THEN 'media' ELSE 'baixa' END AS band FROM bids")
def _(t):
    return t.bid_core.select("bid_id", classify.score_band(F.col("score")).alias("band"))


LEFT = f"ceil((epoch_us(closes_at) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0)::INT"


@query("cls_urgency", f"""
SELECT bid_id, CASE WHEN d IS NULL THEN 'sem_prazo' WHEN d < 0 THEN 'encerrada' WHEN d = 0 THEN 'hoje' WHEN d <= 2 THEN 'ate_2' WHEN d <= 5 THEN 'ate_5' WHEN d <= 15 THEN 'ate_15' ELSE 'depois' END AS band FROM (SELECT bid_id, {LEFT} AS d FROM bids)""")
def _(t):
    return t.bid_core.select("bid_id", classify.urgency(dates.days_left(F.col("closes_at"), t.now)).alias("band"))


PROBE = "CASE k % 6 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 204 ELSE 200 END"


@query("cls_probe_state", f"""
SELECT event_id, CASE WHEN timeouts = 1 OR other = 1 THEN 'fora_do_ar' WHEN s >= 500 THEN 'fora_do_ar' WHEN s = 429 THEN 'instavel' WHEN s NOT IN (200, 204) THEN 'instavel' WHEN k % 10 = 0 THEN 'fora_do_ar' WHEN latency_ms * 10 > 5000 THEN 'lenta' ELSE 'online' END AS state
FROM (SELECT *, {PROBE} AS s FROM calls)""")
def _(t):
    k = F.col("k")
    status = F.when(k % 6 == 0, 500).when(k % 6 == 1, 429).when(k % 6 == 2, 404).when(k % 6 == 3, 204).otherwise(200)
    error = F.when(F.col("timeouts") == 1, "timeout").when(F.col("other") == 1, "rede")
    return t.calls.select("event_id", classify.probe_state(status, F.col("latency_ms") * 10, error, k % 10 != 0).alias("state"))


@query("cls_error", """
SELECT event_id, CASE WHEN timeouts = 1 THEN 'timeout' WHEN k % 7 = 0 THEN 'configuracao_rpc' WHEN e5xx = 1 THEN 'http' WHEN k % 5 = 0 THEN 'contrato' ELSE 'transporte' END AS kind FROM calls""")
def _(t):
    name = F.when(F.col("timeouts") == 1, "TimeoutError").when(F.col("k") % 5 == 0, "ErroContratoResposta").otherwise("Error")
    code, status = F.when(F.col("k") % 7 == 0, "PGRST203"), F.when(F.col("e5xx") == 1, 503)
    return t.calls.select("event_id", classify.error_kind(name, status, code).alias("kind"))


@query("cls_certame", f"""
SELECT bid_id, CASE WHEN status_id = 2 THEN 'revogado' WHEN status_id = 3 THEN 'anulado' WHEN status_id = 4 THEN 'suspenso' WHEN coalesce(items, 0) > 0 AND all_awarded THEN 'homologado'
  WHEN closes_at IS NULL THEN 'indeterminado' WHEN closes_at < TIMESTAMP '{NOW}' THEN 'proposta_encerrada' ELSE 'aberto' END AS state FROM bids LEFT JOIN ({FACTS}) f USING (bid_id)""")
def _(t):
    return ag.tender_facts_with_state(t.bid_core, t.items, t.now).select("bid_id", F.col("tender_state").alias("state"))


@query("cls_analysis_view", """
SELECT bid_id, CASE WHEN state IS NULL OR state = 'nunca' THEN 'nunca' WHEN bid_id % 5 = 0 THEN 'indisponivel' WHEN state = 'processando' THEN 'processando' WHEN state = 'erro' THEN 'erro'
  WHEN NOT coalesce(final_format, true) THEN 'desatualizada' WHEN bid_id % 5 = 1 THEN 'parcial' ELSE 'pronta' END AS view FROM bids LEFT JOIN analyses USING (bid_id)""")
def _(t):
    joined = t.bid_core.select("bid_id").join(t.analyses, "bid_id", "left")
    coverage = pick(["indisponivel", "parcial", "completa", "completa", "completa"], F.col("bid_id") % 5)
    return joined.select("bid_id", classify.analysis_view(F.col("state"), coverage, F.col("final_format")).alias("view"))


@query("cls_negative_answer", """
SELECT answer_id, CASE WHEN answer_id % 11 = 0 THEN NULL WHEN answer_id % 5 = 0 AND answer_id % 2 = 1 THEN NULL ELSE value END AS kept FROM answers""")
def _(t):
    confirmed = F.col("answer_id") % 2 == 0
    return t.answers.select("answer_id", classify.keep_answer(F.col("value"), F.col("quote"), confirmed).alias("kept"))


# ------------------------------------------------------------------------- dates


@query("dt_local_to_utc", f"""
SELECT bid_id, CASE bid_id % 4 WHEN 0 THEN {sql_stamp(w.to_utc('published_at'))} WHEN 1 THEN {sql_stamp('published_at')} WHEN 2 THEN {sql_stamp("published_at + INTERVAL 3 HOUR")} END AS instant FROM bids""")
def _(t):
    k = F.col("bid_id") % 4
    base = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, base).when(k == 1, F.concat(base, F.lit("Z"))).when(k == 2, F.concat(base, F.lit("-0300"))).otherwise(F.concat(F.lit("x"), base))
    return t.bid_core.select("bid_id", stamp(dates.local_to_utc(text), "instant"))


@query("dt_local_day", f"SELECT bid_id, strftime({w.to_local('closes_at')}::DATE + 2, '%Y-%m-%d') AS day FROM bids")
def _(t):
    return t.bid_core.select("bid_id", F.date_format(dates.local_day(F.col("closes_at"), 2), "yyyy-MM-dd").alias("day"))


@query("dt_day_bounds", f"SELECT bid_id, {sql_stamp(w.to_utc('published_at::DATE'))} AS first_instant, {sql_stamp(w.to_utc('(published_at::DATE + 7)'))} AS end_instant FROM bids")
def _(t):
    day = F.to_date("published_at")
    return t.bid_core.select("bid_id", stamp(dates.day_start(day), "first_instant"), stamp(dates.day_start(day, 7), "end_instant"))


@query("dt_is_open", f"SELECT bid_id, {w.is_open()} AS open_now FROM bids")
def _(t):
    return t.bid_core.select("bid_id", dates.is_open(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), t.now).alias("open_now"))


@query("dt_temporal_state", f"SELECT bid_id, {w.temporal()} AS state FROM bids")
def _(t):
    return t.bid_core.select("bid_id", dates.temporal_state(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), t.now).alias("state"))


@query("dt_days_left", f"SELECT bid_id, {LEFT} AS days FROM bids")
def _(t):
    return t.bid_core.select("bid_id", dates.days_left(F.col("closes_at"), t.now).alias("days"))


@query("dt_business_days_back", f"""
SELECT bid_id, CASE WHEN closes_at IS NOT NULL THEN {sql_stamp(w.to_utc("(list_filter(list_transform(range(1, 8), lambda i: d - i::INT), lambda x: isodow(x) < 6)[3] + INTERVAL 18 HOUR)"))} END AS at_time
FROM (SELECT bid_id, closes_at, {w.to_local('closes_at')}::DATE AS d FROM bids)""")
def _(t):
    return t.bid_core.select("bid_id", stamp(dates.business_days_back(F.col("closes_at")), "at_time"))


@query("dt_sync_fresh", "SELECT job_id, coalesce(status = 'concluido' AND TIMESTAMP '2024-01-30 23:00:00' - finished_at <= INTERVAL 6 HOUR, false) AS fresh FROM jobs")
def _(t):
    now = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return t.jobs.select("job_id", dates.sync_fresh(F.col("status"), F.col("finished_at"), now).alias("fresh"))


@query("dt_closable_date", """
SELECT segment_id, strftime(CASE WHEN to_date < DATE '2024-01-20' THEN to_date WHEN from_date <= DATE '2024-01-19' THEN DATE '2024-01-19' END, '%Y-%m-%d') AS day FROM segments""")
def _(t):
    day = dates.closable_date(F.col("from_date"), F.col("to_date"), F.lit("2024-01-20").cast("date"))
    return t.segments.select("segment_id", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("dt_validate_yyyymmdd", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '20010230' ELSE strftime(o_orderdate, '%Y%m%d') END AS a, CASE WHEN o_orderkey % 8 = 0 THEN 'amanhã' ELSE strftime(o_orderdate + to_days((o_orderkey % 500 - 50)::INT), '%Y%m%d') END AS b FROM orders),
y AS (SELECT o_orderkey, try_strptime(a, '%Y%m%d')::DATE AS a, try_strptime(b, '%Y%m%d')::DATE AS b FROM x)
SELECT o_orderkey, CASE WHEN a IS NULL THEN 'data inicial inválida' WHEN b IS NULL THEN 'data final inválida' WHEN a > b THEN 'datas fora de ordem' WHEN b - a > 365 THEN 'intervalo maior que o permitido' END AS reason FROM y""")
def _(t):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    a = F.when(k % 9 == 0, "20010230").otherwise(F.date_format(d, "yyyyMMdd"))
    b = F.when(k % 8 == 0, "amanhã").otherwise(F.date_format(F.date_add(d, (k % 500 - 50).cast("int")), "yyyyMMdd"))
    return t.raw("orders").select("o_orderkey", dates.validate_range(a, b).alias("reason"))


@query("dt_format_local", f"""
SELECT bid_id, coalesce(strftime({w.to_local('closes_at')}, '%d/%m/%Y'), '—') AS day, coalesce(strftime({w.to_local('closes_at')}, '%d/%m/%Y às %H:%M'), '—') AS long_form FROM bids""")
def _(t):
    return t.bid_core.select("bid_id", dates.format_day(F.col("closes_at")).alias("day"), dates.format_long(F.col("closes_at")).alias("long_form"))


# -------------------------------------------------------------- math, geo, hashes


@query("geo_haversine", f"SELECT a.s_suppkey AS a, b.n_nationkey AS b, round({w.haversine('la', 'lo', 'lat', 'lon')}, 6) AS km FROM (SELECT s_suppkey, (s_suppkey % 181) - 90.0::DOUBLE AS la, (s_suppkey % 361) - 180.0::DOUBLE AS lo, s_nationkey FROM supplier) a JOIN (SELECT n_nationkey, n_nationkey * 1.5::DOUBLE - 33.0 AS lat, ((n_nationkey * 7) % 35)::DOUBLE - 70.0 AS lon FROM nation) b ON b.n_nationkey = a.s_nationkey")
def _(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b"), (F.col("s_suppkey") % 181 - 90.0).alias("la"), (F.col("s_suppkey") % 361 - 180.0).alias("lo"))
    n = t.raw("nation").select(F.col("n_nationkey").alias("b"), (F.col("n_nationkey") * 1.5 - 33.0).alias("lat"), ((F.col("n_nationkey") * 7) % 35 - 70.0).alias("lon"))
    return s.join(n, "b").select("a", "b", F.round(geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("geo_distance_col", f"SELECT bid_id, round({s2.KM}, 1) AS distance_km FROM bids LEFT JOIN cities c USING (city_code), (SELECT lat, lon FROM cities WHERE city_code = '{s2.ORIGIN}') o")
def _(t):
    from bidspan.operators.filters import within_radius

    return within_radius(t.bids, t.cities, s2.ORIGIN, None).select("bid_id", geo.rounded(F.col("km")).alias("distance_km"))


DOC_SHARE = "(0.0::DOUBLE + CASE WHEN p THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN o THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN e THEN 0.15::DOUBLE ELSE 0 END)"


@query("math_score", f"""
SELECT bid_id, {w.score('object', "CASE WHEN bid_id % 3 = 0 THEN 'RDC' ELSE modality END", 'value', 'category', DOC_SHARE)} AS score FROM (SELECT *, bid_id % 2 = 0 AS p, bid_id % 5 = 0 AS o, bid_id % 7 = 0 AS e FROM bids)""")
def _(t):
    k = F.col("bid_id")
    flags = {"projeto": k % 2 == 0, "orcamento": k % 5 == 0, "edital": k % 7 == 0}
    modality = F.when(k % 3 == 0, "RDC").otherwise(F.col("modality"))
    return t.bid_core.select("bid_id", scoring.score(F.col("object"), modality, F.col("value"), F.col("category"), flags).alias("score"))


@query("math_value_band", f"SELECT bid_id, ({w.band('value * 3')})::DOUBLE AS band FROM bids")
def _(t):
    return t.bid_core.select("bid_id", scoring.value_band(F.col("value") * 3).alias("band"))


@query("math_score_cut", "SELECT bid_id, greatest(score - 30, 0) AS cut FROM bids")
def _(t):
    return t.bid_core.select("bid_id", scoring.score_cut(F.col("score"), 30).alias("cut"))


@query("math_priority_class", f"SELECT bid_id, CASE WHEN priority OR team_status IN ('interessante', 'em_analise') THEN 0 WHEN {w.is_open()} AND score >= 60 THEN 1 WHEN accessed_at IS NOT NULL THEN 2 ELSE 3 END AS class FROM bids")
def _(t):
    return t.bid_core.select("bid_id", scoring.bid_priority(t.now, 60).alias("class"))


@query("math_density", "SELECT doc_id, CASE WHEN pages > 0 THEN floor(chars / pages * 10 + 0.5) / 10 END AS density FROM files")
def _(t):
    return t.files.select("doc_id", scoring.density(F.col("chars"), F.col("pages")).alias("density"))


@query("math_rrf", "SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN 0.5 ELSE 1.0 END::DOUBLE / (60 + k)), 6) AS score FROM (SELECT *, json_extract_string(props, '$.k')::INT + 1 AS k FROM events) GROUP BY user_id")
def _(t):
    rank = F.col("k") + 1
    part = F.when(F.col("event_type") == "view", scoring.rrf(rank, 0.5)).otherwise(scoring.rrf(rank))
    return t.calls.groupBy(F.col("job_id").alias("user_id")).agg(F.round(F.sum(part), 6).alias("score"))


@query("math_cosine_distance", "SELECT v.vec_id, round(1 - list_dot_product(v.embedding::DOUBLE[], q.embedding) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding, q.embedding)), 6) AS distance FROM embeddings v JOIN themes q ON q.query_id = v.label")
def _(t):
    joined = t.raw("embeddings").join(t.themes.withColumnRenamed("embedding", "center"), F.col("label") == F.col("query_id"))
    return joined.select("vec_id", F.round(vv.cosine_distance(F.col("embedding"), F.col("center")), 6).alias("distance"))


@query("math_backoff", "SELECT event_id, CASE WHEN k % 5 + 1 <= 2 THEN (k % 5 + 1) * 15000 ELSE 60000 END AS wait_ms FROM calls")
def _(t):
    return t.calls.select("event_id", scoring.backoff_ms(F.col("k") % 5 + 1).alias("wait_ms"))


HASHED = ["control_no", "cnpj", "object", "status_id", "uf", "city"]


@query("hash_content", f"SELECT bid_id, sha256(json_object({', '.join(w.lit(f) + ', ' + f + '::VARCHAR' for f in HASHED)})::VARCHAR) AS hash FROM bids")
def _(t):
    return t.bids.select("bid_id", hashing.content_hash(HASHED).alias("hash"))


@query("hash_text", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(t):
    return documents(t).select("doc_id", hashing.text_hash(F.col("text")).alias("hash"))


FP_DOC = "md5(json_object('seq', seq::VARCHAR, 'active', active::VARCHAR, 'state', state, 'sha256', sha256, 'name', name, 'doc_type', doc_type)::VARCHAR)"
WORDS = ", ".join(f"sum(('0x' || {FP_DOC}[{1 + 8 * i}:{8 + 8 * i}])::BIGINT)::BIGINT AS w{i}" for i in range(4))


@query("hash_fingerprint", f"""
SELECT b.bid_id, sha256(json_object('control_no', control_no, 'object', object)::VARCHAR || '|' || coalesce(n, 0) || ':' || coalesce(w0, 0) || ':' || coalesce(w1, 0) || ':' || coalesce(w2, 0) || ':' || coalesce(w3, 0) || '|m1|p3|a2') AS fingerprint
FROM bids b LEFT JOIN (SELECT bid_id, count(*) AS n, {WORDS} FROM files GROUP BY bid_id) d USING (bid_id)""")
def _(t):
    return merge.fingerprint(t.bid_core, t.files, ["object", "control_no"], ["m1", "p3", "a2"]).select("bid_id", "fingerprint")


@query("hash_file", "SELECT page_id, sha256(html) AS hash FROM pages")
def _(t):
    return t.raw("pages").select("page_id", hashing.file_hash(F.encode("html", "UTF-8")).alias("hash"))


# ---------------------------------------------------------- arrays, maps, JSON


@query("arr_keyword_hits", f"SELECT bid_id, {w.hits('object')} AS hits FROM bids")
def _(t):
    return t.bid_core.select("bid_id", scoring.keyword_hits(F.col("object"), scoring.KEYWORDS).alias("hits"))


def chunk_sql(size, lap):
    # last space at or before the full length, when it lies in the last fifth; otherwise the full length
    stop = f"""CASE WHEN {{a}} + {size} >= n THEN n ELSE (SELECT CASE WHEN sp > {{a}} + {size} * 0.8 THEN sp ELSE {{a}} + {size} END FROM (SELECT {{a}} + {size} + 1 - instr(reverse(s[{{a}} + 1:{{a}} + {size} + 1]), ' ') AS sp0,
      CASE WHEN instr(reverse(s[{{a}} + 1:{{a}} + {size} + 1]), ' ') = 0 THEN -1 ELSE sp0 END AS sp)) END"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS s FROM documents), e AS (SELECT doc_id, s, length(s)::INT AS n FROM d WHERE s <> ''),
c AS (SELECT doc_id, 0 AS ord, 0 AS a, ({stop.format(a='0')})::INT AS b, s, n FROM e
  UNION ALL SELECT doc_id, ord + 1, na, ({stop.format(a='na')})::INT, s, n FROM (SELECT *, greatest(a + 1, b - {lap}) AS na FROM c WHERE b < n))
SELECT doc_id, ord, md5(trim(s[a + 1:b], ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS hash FROM c"""


@query("arr_chunk_overlap", chunk_sql(1500, 200))
def _(t):
    return documents(t).select("doc_id", F.posexplode(pieces.chunk_overlap(F.col("text"))).alias("ord", "piece")).select("doc_id", "ord", F.md5("piece").alias("hash"))


def split_sql(cap):
    stop = f"""CASE WHEN {{a}} + {cap} >= n THEN n ELSE (SELECT CASE WHEN edge >= {{a}} + floor({cap} * 0.6) THEN edge + 1 ELSE {{a}} + {cap} END FROM (SELECT
      CASE WHEN strpos(reverse(translate(s[{{a}} + 1:{{a}} + {cap}], chr(10), ' ')), ' ') = 0 THEN -1 ELSE {{a}} + {cap} - strpos(reverse(translate(s[{{a}} + 1:{{a}} + {cap}], chr(10), ' ')), ' ') END AS edge)) END"""
    return f"""
WITH RECURSIVE e AS (SELECT doc_id, text AS s, length(text)::INT AS n FROM documents WHERE text <> ''),
c AS (SELECT doc_id, 0 AS ord, 0 AS a, ({stop.format(a='0')})::INT AS b, s, n FROM e UNION ALL SELECT doc_id, ord + 1, b, ({stop.format(a='b')})::INT, s, n FROM c WHERE b < n)
SELECT doc_id, ord, b - a AS length, md5(s[a + 1:b]) AS hash FROM c"""


BLOCK = 2000


@query("arr_split_lossless", split_sql(BLOCK))
def _(t):
    blocks = documents(t).select("doc_id", F.posexplode(pieces.split_lossless(F.col("text"), BLOCK)).alias("ord", "b"))
    return blocks.select("doc_id", "ord", F.length("b").alias("length"), F.md5("b").alias("hash"))


PACK = 8000


@query("arr_pack_batches", f"""
WITH RECURSIVE p AS (SELECT bid_id, doc_id AS ord, least(length(text), {PACK})::INT AS n, row_number() OVER (PARTITION BY bid_id ORDER BY doc_id) AS i FROM sources),
walk AS (SELECT bid_id, ord, n, i, n AS used, 0 AS batch FROM p WHERE i = 1
  UNION ALL SELECT p.bid_id, p.ord, p.n, p.i, CASE WHEN used + p.n > {PACK} THEN p.n ELSE used + p.n END, CASE WHEN used + p.n > {PACK} THEN batch + 1 ELSE batch END FROM walk w JOIN p ON p.bid_id = w.bid_id AND p.i = w.i + 1)
SELECT bid_id, ord, batch FROM walk""")
def _(t):
    blocks = t.sources.select("bid_id", F.col("doc_id").alias("ord"), F.least(F.length("text"), F.lit(PACK)).alias("length"))
    return extraction.pack_batches(blocks, PACK).select("bid_id", "ord", "batch")


RADIUS, PREAMBLE, EXCERPT = 100, 300, 3000
ANCHOR = r"[0-9]{3,}"
SQUEEZED = "regexp_replace(text, '[ \\t]+', ' ', 'g')"


def anchor_excerpts(t):
    docs = t.files.select("bid_id", "doc_id", "doc_type", "text")
    return extraction.anchor_windows(docs, [ANCHOR], RADIUS, PREAMBLE, EXCERPT)


@query("arr_anchor_windows", f"""
WITH RECURSIVE c AS (SELECT bid_id, doc_id, CASE doc_type WHEN 'edital' THEN 0 WHEN 'anexo' THEN 1 WHEN 'outro' THEN 2 WHEN 'projeto' THEN 3 ELSE 4 END || '-' || lpad(doc_id::VARCHAR, 20, '0') AS doc_order, {SQUEEZED} AS t FROM files),
-- starts of matches: total length of what precedes the i-th match
m AS (SELECT doc_id, t, regexp_split_to_array(t, '{ANCHOR}') AS gaps, regexp_extract_all(t, '{ANCHOR}') AS found FROM c),
s AS (SELECT doc_id, length(t)::INT AS n, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0))::INT AS p FROM m, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)),
a AS (SELECT doc_id, greatest(0, p - {RADIUS}) AS s, least(n, p + {RADIUS}) AS e FROM s UNION ALL SELECT doc_id, 0, least({PREAMBLE}, length(t))::INT FROM c),
r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
i AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
u AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island),
p AS (SELECT bid_id, doc_order, c.doc_id, u.s AS ord, trim(t[u.s + 1:u.e], ' ' || chr(10) || chr(13) || chr(9) || chr(160)) AS x, row_number() OVER (PARTITION BY bid_id ORDER BY doc_order, u.s) AS k FROM u JOIN c USING (doc_id)),
walk AS (
  SELECT bid_id, doc_order, doc_id, ord, k, length(x) <= {EXCERPT} AS kept, CASE WHEN length(x) <= {EXCERPT} THEN length(x) ELSE 0 END AS used, length(x) > {EXCERPT} AS closed, false AS spent FROM p WHERE k = 1
  UNION ALL SELECT bid_id, doc_order, doc_id, ord, k, fits, used + CASE WHEN fits THEN ln ELSE 0 END, NOT fits OR was, spent FROM (SELECT *, NOT spent AND NOT was AND used + ln <= {EXCERPT} AS fits FROM (
    SELECT p.bid_id, p.doc_order, p.doc_id, p.ord, p.k, length(p.x) AS ln, w.used, w.closed AND p.doc_order = w.doc_order AS was, w.spent OR (p.doc_order <> w.doc_order AND w.used >= {EXCERPT}) AS spent FROM walk w JOIN p ON p.bid_id = w.bid_id AND p.k = w.k + 1)))
SELECT w.doc_id, w.ord, md5(x) AS hash FROM walk w JOIN p USING (doc_id, ord) WHERE kept""")
def _(t):
    return anchor_excerpts(t).select("doc_id", "ord", F.md5("excerpt").alias("hash"))


@query("json_rows_typed", "SELECT event_id, k, 'v' || event_id AS v FROM calls UNION ALL SELECT event_id, NULL, NULL FROM calls")
def _(t):
    text = F.concat(F.lit('[{"k": '), F.col("k").cast("string"), F.lit(', "v": "v'), F.col("event_id").cast("string"), F.lit('", "x": [1]}, {}]'))
    rows = t.calls.select("event_id", F.inline(jsonx.typed(text, "array<struct<k:int,v:string>>")))
    return rows.select("event_id", "k", "v")


@query("json_envelope_unwrap", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN props ELSE replace(props, ' ', '') END AS body FROM events")
def _(t):
    k = F.col("event_id") % 3
    wrapped = F.when(k == 0, F.concat(F.lit('{"resultado": '), F.col("props"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"analise": '), F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    return t.raw("events").select("event_id", jsonx.unwrap(wrapped).alias("body"))


@query("json_result_validate", """
SELECT event_id, CASE WHEN event_id % 10 > 1 THEN k END AS k, CASE WHEN event_id % 10 <> 0 AND event_type IN ('view', 'click') THEN event_type ELSE 'outro' END AS kind, CASE WHEN event_id % 10 NOT IN (0, 2) THEN 'nota ' || k END AS note,
  CASE event_id % 10 WHEN 0 THEN 'não é JSON de objeto' WHEN 1 THEN 'campo obrigatório ausente: k' ELSE '' END AS reason FROM calls""")
def _(t):
    kind, k, n = F.col("event_type"), F.col("k").cast("string"), F.col("event_id") % 10
    note = F.when(n == 2, F.lit("  ")).otherwise(F.concat(F.lit(" nota "), k))
    body = F.concat(F.lit('{"kind": "'), kind, F.lit('", "note": "'), note, F.lit('"'), F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(', "k": '), k)), F.lit("}"))
    text = F.when(n == 0, F.lit("não é json")).when(n == 3, F.concat(F.lit('{"resultado": '), body, F.lit("}"))).otherwise(body)
    answer = jsonx.validated(text, "k int, kind string, note string", ["k"], {"kind": (["view", "click"], "outro")})
    return t.calls.select("event_id", answer.alias("a")).select("event_id", "a.value.*", F.coalesce("a.reason", F.lit("")).alias("reason"))


@query("json_build_item", "SELECT bid_id, json_object('bid_id', bid_id, 'object', object, 'score', score)::VARCHAR AS json FROM bids")
def _(t):
    return t.bid_core.select("bid_id", jsonx.item(["bid_id", "object", "score", "notes"], ["notes"]).alias("json"))


@query("json_canonical", "SELECT bid_id, CASE WHEN process IS NULL THEN json_object('object', object, 'score', score) ELSE json_object('object', object, 'process', process, 'score', score) END::VARCHAR AS json FROM bids")
def _(t):
    return t.bid_core.select("bid_id", jsonx.canonical(["score", "process", "object"]).alias("json"))


@query("map_status_histogram", "SELECT bid_id, string_agg(status || '=' || n, ';' ORDER BY status) AS statuses FROM (SELECT bid_id, coalesce(status_name, 'Sem situação informada') AS status, count(*) AS n FROM items GROUP BY ALL) GROUP BY bid_id")
def _(t):
    return ag.status_histogram(t.items).withColumn("statuses", flat_map(F.col("statuses")))

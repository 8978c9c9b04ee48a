"""Sources, sinks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.functions import classify, hashing, scoring
from bidspan.functions import text as tx
from bidspan.operators import joins, merge, projections, windows
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.tables import NOW, Dealt
from bidspan.session import fresh_path
from bidspan.sources import readers, schemas, sinks

PAGE = 50


def stamp(c, name):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_stamp(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def listing_rows(t):
    """Orders as nested listing rows, with dirty edges by rule on the key."""
    b, k = F.col, F.col("bid_id")
    text = lambda c: c.cast("string")
    local = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return t.bid_core.select(
        k,
        F.struct(
            F.when(k % 17 != 0, F.concat(F.lit("  "), b("control_no"))).otherwise("  ").alias("numeroControlePNCP"),
            text(b("year")).alias("anoCompra"), text(b("seq")).alias("sequencialCompra"), b("process").alias("processo"),
            b("object").alias("objetoCompra"), b("srp").alias("srp"), text(b("modality_id")).alias("modalidadeId"),
            b("modality").alias("modalidadeNome"), F.when(k % 19 == 0, "texto").otherwise(text(b("status_id"))).alias("situacaoCompraId"),
            b("status_name").alias("situacaoCompraNome"), text(b("value")).alias("valorTotalEstimado"),
            local(b("published_at")).alias("dataPublicacaoPncp"), local(b("opens_at")).alias("dataAberturaProposta"),
            F.when(k % 23 == 0, "sem data").otherwise(local(b("closes_at"))).alias("dataEncerramentoProposta"),
            F.concat(local(b("updated_at_source")), F.lit("Z")).alias("dataAtualizacaoGlobal"),
            F.struct(b("cnpj"), b("agency").alias("razaoSocial")).alias("orgaoEntidade"),
        ).alias("row"),
    )


def envelopes(t, path, damage=True):
    """Write one envelope per line, 50 rows to a page, as the fetcher would; some pages arrive damaged."""
    page = (F.floor(F.col("bid_id") / PAGE) + 1).cast("int")
    # orders are dealt by page before they are made listing rows, which are several times as wide
    dealt = Dealt(t.spark, t.dir, "orders", (F.floor(F.col("o_orderkey") / PAGE) + 1).cast("int"))
    pages = listing_rows(dealt).groupBy(page.alias("numeroPagina")).agg(F.array_sort(F.collect_list(F.struct("bid_id", "row"))).alias("rows"))
    total = t.raw("orders").agg(F.count(F.lit(1))).scalar()
    out = pages.select(
        F.transform("rows", lambda r: r["row"]).alias("data"), "numeroPagina", F.lit(1).cast("long").alias("segment_id"),
        F.when(F.lit(damage) & (F.col("numeroPagina") % 40 == 0), F.col("numeroPagina") + 1).otherwise(F.col("numeroPagina")).alias("requestedPage"),
        F.ceil(total / PAGE).cast("int").alias("totalPaginas"), total.alias("totalRegistros"), F.lit(False).alias("empty"),
    )
    body = F.to_json(F.struct(*out.columns))
    damaged = F.when(F.lit(damage) & (F.col("numeroPagina") % 60 == 0), F.lit("<html>proxy</html>")).otherwise(body)
    out.select(damaged.alias("value")).write.option("compression", "gzip").text(path)
    return readers.page_envelopes(t.spark, path)


@query("src_page_envelope", f"""
SELECT 1 + bid_id // {PAGE} AS page, count(*) AS n, sum(seq)::BIGINT AS seqs, count(*) FILTER (year IS NULL) AS no_year FROM bids
WHERE (1 + bid_id // {PAGE}) % 60 <> 0 GROUP BY ALL""")
def _(t):
    rows = readers.page_rows(envelopes(t, fresh_path(t.spark, "pages")))
    return rows.groupBy(F.col("page").cast("long").alias("page")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("sequencialCompra").cast("long")).alias("seqs"), F.count_if(F.col("anoCompra").isNull()).alias("no_year")
    )


@query("page_quality", f"""
SELECT CASE WHEN p % 60 = 0 THEN 'invalida' WHEN p % 40 = 0 THEN 'invalida' ELSE 'ok' END AS quality,
  CASE WHEN p % 60 = 0 THEN 'corpo não é JSON de envelope' WHEN p % 40 = 0 THEN 'página recebida não é a pedida' ELSE '' END AS reason, count(*) AS n
FROM (SELECT DISTINCT 1 + o_orderkey // {PAGE} AS p FROM orders) GROUP BY ALL""")
def _(t):
    pages = readers.page_quality(envelopes(t, fresh_path(t.spark, "pages")))
    return pages.groupBy("quality", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def mapped(t):
    rows = listing_rows(t).select("bid_id", "row.*")
    missing = [c for c in _header_fields(t) if c not in rows.columns]
    empty = t.spark.createDataFrame([], schemas.HEADER).schema
    for c in missing:
        rows = rows.withColumn(c, F.lit(None).cast(empty[c].dataType))
    wanted = empty["orgaoEntidade"].dataType
    rows = rows.withColumn("orgaoEntidade", F.struct(*[F.col(f"orgaoEntidade.{f.name}").alias(f.name) if f.name in ("cnpj", "razaoSocial") else F.lit(None).cast("string").alias(f.name) for f in wanted]))
    return projections.map_header(rows.withColumn("position", F.col("bid_id")), t.now, True, scoring.ScoreConfig())


def _header_fields(t):
    return t.spark.createDataFrame([], schemas.HEADER).columns


@query("row_quarantine", """
SELECT bid_id % 17 = 0 AS rejected, count(*) AS n, min(bid_id) AS first_bid FROM bids GROUP BY ALL""")
def _(t):
    good, bad = readers.quarantine(mapped(t), F.col("control_no"), "numeroControlePNCP ausente")
    tag = lambda df, v: df.select(F.lit(v).alias("rejected"), F.col("position").alias("bid_id"))
    both = tag(good, False).unionByName(tag(bad, True))
    return both.groupBy("rejected").agg(F.count(F.lit(1)).alias("n"), F.min("bid_id").alias("first_bid"))


@query("map_header", f"""
SELECT control_no, cnpj, agency, year, seq, process, object, modality_id, modality, srp, value::DOUBLE AS value, category, score,
  CASE WHEN bid_id % 19 <> 0 THEN status_id END AS status_id, portal_url, {sql_stamp(w.to_utc('published_at'))} AS published_at,
  {sql_stamp(w.to_utc('opens_at'))} AS opens_at, CASE WHEN bid_id % 23 <> 0 THEN {sql_stamp(w.to_utc('closes_at'))} END AS closes_at,
  {sql_stamp('updated_at_source')} AS updated_at_source FROM bids WHERE bid_id % 17 <> 0""")
def _(t):
    good, _ = readers.quarantine(mapped(t), F.col("control_no"), "numeroControlePNCP ausente")
    plain = ["control_no", "cnpj", "agency", "year", "seq", "process", "object", "modality_id", "modality", "srp", "category", "score", "status_id", "portal_url"]
    return good.select(*plain, F.col("value").cast("double").alias("value"), *[stamp(c, c) for c in ("published_at", "opens_at", "closes_at", "updated_at_source")])


def document_rows(t):
    """Line items as document metadata in the source's own field names."""
    return t.raw_docs.select(
        "bid_id", F.when(F.col("seq") == 5, "x").otherwise(F.col("seq").cast("string")).alias("sequencialDocumento"), F.col("title").alias("titulo"),
        F.col("source_type").alias("tipoDocumentoNome"), F.when(F.col("active"), F.lit(None)).otherwise(F.lit(False)).alias("statusAtivo"),
        F.col("url").alias("url"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("dataPublicacaoPncp"), "version",
    )


def document_lines(t, path):
    # position comes from the version order, as a fetcher would number the list
    v = F.col("version")
    pos = F.unix_seconds(v["d"]) * 1000 + F.pmod(v["l_partkey"], F.lit(1000))
    document_rows(t).withColumn("position", pos).drop("version").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.documents_array(t.spark, path)


@query("src_documents_array", f"""
SELECT title, coalesce(source_type, '-') AS label, count(*) AS n, count(url) AS with_url, count(*) FILTER (active) AS active_docs FROM raw_docs GROUP BY ALL""")
def _(t):
    docs = document_lines(t, fresh_path(t.spark, "documents"))
    return docs.groupBy(F.col("titulo").alias("title"), F.coalesce("tipoDocumentoNome", F.lit("-")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("url").alias("with_url"), F.count_if(F.coalesce("statusAtivo", F.lit(True))).alias("active_docs")
    )


@query("map_document", f"""
SELECT bid_id, seq, doc_type, source_type, name, url, active, {sql_stamp(w.to_utc('published_at'))} AS published_at FROM docs WHERE seq <> 5""")
def _(t):
    rows = document_rows(t)
    m = projections.map_document(rows.withColumns({"tipoDocumentoDescricao": F.lit(None).cast("string"), "uri": F.lit(None).cast("string"), "position": F.col("version")}))
    m = windows.dedup_documents(m.filter(F.col("seq").isNotNull()), F.col("position"))
    return m.select("bid_id", "seq", "doc_type", "source_type", "name", "url", "active", stamp("published_at", "published_at"))


def item_rows(t):
    return t.items.select(
        "bid_id", F.col("number").alias("numeroItem"), F.col("description").alias("descricao"), F.col("kind").alias("materialOuServico"),
        F.col("unit_price").alias("valorUnitarioEstimado"), F.col("total").alias("valorTotal"), F.col("quantity").alias("quantidade"),
        F.col("item_category").alias("itemCategoriaNome"), F.col("status_name").alias("situacaoCompraItemNome"), F.col("benefit_name").alias("tipoBeneficioNome"),
        F.col("has_result").alias("temResultado"), F.col("code").alias("ncmNbsCodigo"), (F.floor((F.col("number") - 1) / 4) + 1).cast("int").alias("page"),
    )


def item_lines(t, path):
    item_rows(t).select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    return readers.items_array(t.spark, path)


@query("src_items_array", """
SELECT bid_id, sum(n)::BIGINT AS items, (arg_max(n, page) < 4 OR max(page) < 2) AS complete
FROM (SELECT bid_id, (number - 1) // 4 + 1 AS page, count(*) AS n FROM items GROUP BY ALL) GROUP BY bid_id""")
def _(t):
    return readers.items_complete(item_lines(t, fresh_path(t.spark, "items")), 4, 2)


@query("map_item", """
SELECT bid_id, number AS item_no, description, 'un' AS unit, kind, item_category, coalesce(status_name, '-') AS status_name, unit_price, total, quantity, has_result, false AS secret, count(*) AS n
FROM items GROUP BY ALL""")
def _(t):
    rows = item_rows(t).drop("page")
    full = t.spark.createDataFrame([], schemas.ITEM)
    for f in full.schema.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    m = projections.map_item(rows)
    return m.groupBy(
        "bid_id", F.col("numeroItem").alias("item_no"), F.col("descricao").alias("description"), F.col("unidadeMedida").alias("unit"), F.col("materialOuServico").alias("kind"),
        F.col("itemCategoriaNome").alias("item_category"), F.coalesce("situacaoCompraItemNome", F.lit("-")).alias("status_name"), F.col("valorUnitarioEstimado").alias("unit_price"),
        F.col("valorTotal").alias("total"), F.col("quantidade").alias("quantity"), F.col("temResultado").alias("has_result"), F.col("orcamentoSigiloso").alias("secret"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("src_dim_modality", f"""
SELECT m.modality_id, m.modality, count(bid_id) AS bids FROM (SELECT unnest(range(1, 20))::INT AS modality_id, unnest({w.array(classify.MODALITIES)}) AS modality) m
LEFT JOIN bids b ON b.modality_id = m.modality_id GROUP BY ALL""")
def _(t):
    used = t.bid_core.groupBy("modality_id").agg(F.count(F.lit(1)).alias("_n"))
    return readers.modalities(t.spark).filter("active").join(used, "modality_id", "left").select("modality_id", "modality", F.coalesce("_n", F.lit(0)).alias("bids"))


@query("src_dim_city", "SELECT city_code, city, uf, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cities")
def _(t):
    path = fresh_path(t.spark, "cities")
    t.cities.write.option("header", True).csv(path)
    return readers.cities(t.spark, path).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("src_dim_upsert", """
SELECT city_code, CASE WHEN uf = 'ASIA' THEN upper(city) || ' 2' ELSE city END AS city FROM cities
UNION ALL SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0'), s_name FROM supplier""")
def _(t):
    base = t.cities.select("city_code", "city")
    changed = t.cities.filter("uf = 'ASIA'").select("city_code", F.concat(F.upper("city"), F.lit(" 2")).alias("city"))
    added = t.raw("supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("city_code"), F.col("s_name").alias("city"))
    return merge.upsert_latest(base, changed.unionByName(added), ["city_code"])


@query("payload_archive", """
SELECT DISTINCT user_id AS key, md5(props) AS hash FROM events WHERE event_type <> 'view'
AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = events.user_id AND v.props = events.props)""")
def _(t):
    rows = t.raw("events").select(F.col("user_id").alias("key"), F.md5("props").alias("hash"), "props", "event_type")
    return readers.payload_archive(rows.filter("event_type <> 'view'"), rows.filter("event_type = 'view'")).select("key", "hash")


@query("snapshot_io", "SELECT uf, count(*) AS n, sum(score)::BIGINT AS score, sum(value)::DOUBLE AS value FROM bids GROUP BY uf")
def _(t):
    """A first version without scores; the second rewrites the partitions whose rows have some."""
    kept = t.bids.select("bid_id", "uf", "score", "value")
    table = sinks.KeyedTable(t.spark, fresh_path(t.spark, "snapshot"), "bid_id", 16)
    table.write(kept.withColumn("score", F.lit(0)), 1)
    table.merge(kept.filter("score <> 0"), 2, lambda held, fresh: merge.upsert_latest(held, fresh, ["bid_id"]))
    return table.read().groupBy("uf").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum("value").cast("double").alias("value"))


def csv_money(v):
    return f"'R$ ' || translate(format('{{:,.2f}}', round({v}, 2)::DOUBLE), ',.', '.,')"


LABELS = "CASE team_status " + " ".join(f"WHEN {w.lit(k)} THEN {w.lit(v)}" for k, v in projections.STATUS_LABELS.items()) + " ELSE team_status END"
LEFT = f"ceil((epoch_us(closes_at) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0)::INT"


def cell(x):
    return f"""'"' || replace(coalesce({x}, ''), '"', '""') || '"'"""


HEADER = (
    "PNCP ID;Órgão;CNPJ Órgão;Município;UF;Objeto;Valor Estimado (R$);Modalidade;Categoria;Publicação;Limite Proposta;"
    "Dias Restantes;Status PNCP;Status Interno;Prioridade;Score Aderência;Total Documentos;Link PNCP"
)
CSV = " || ';' || ".join(
    cell(x)
    for x in [
        "control_no", "agency", "cnpj", "city", "uf", "object", f"CASE WHEN coalesce(value, 0) <> 0 THEN {csv_money('value')} ELSE 'Não divulgado' END", "modality", "category",
        f"coalesce(strftime({w.to_local('published_at')}, '%d/%m/%Y'), '—')", f"coalesce(strftime({w.to_local('closes_at')}, '%d/%m/%Y, %H:%M'), '—')",
        f"CASE WHEN closes_at IS NULL THEN 'Sem prazo' WHEN {LEFT} < 0 THEN 'Encerrada' ELSE {LEFT}::VARCHAR END", "status_name", LABELS,
        "CASE WHEN priority THEN 'Sim' ELSE 'Não' END", "score::VARCHAR", "coalesce(n, 0)::VARCHAR", "portal_url",
    ]
)


def export_bids(t):
    """Bids with the number of their active documents; no titles go through the shuffle."""
    flags = windows.dedup_documents(t.raw_docs.select("bid_id", "seq", "active", "version"), F.col("version"))
    return joins.scalar_count(t.bids, flags.filter("active"))


@query("csv_export", f"""
SELECT {CSV} || chr(13) AS line FROM bids LEFT JOIN (SELECT bid_id, count(*) AS n FROM docs WHERE active GROUP BY bid_id) USING (bid_id)
UNION ALL SELECT '{HEADER}' || chr(13)""")
def _(t):
    path = fresh_path(t.spark, "csv")
    sinks.write_csv(export_bids(t).orderBy("bid_id"), t.now, path)
    return t.spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


@query("binary_ingest", """
SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256, CASE WHEN html = '' THEN 'vazio' WHEN octet_length(encode(html)) > 2500 THEN 'grande_demais' ELSE 'ok' END AS verdict,
  upper(hex(encode(html)[1:8])) AS head FROM pages""")
def _(t):
    files = t.raw("pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return readers.binary_meta(files, 2500).withColumn("head", F.hex("head"))


@query("report_json", """
SELECT json_object('bids', count(*), 'agencies', count(DISTINCT agency), 'open_score', sum(score)::BIGINT)::VARCHAR AS value FROM bids""")
def _(t):
    return sinks.report(t.bid_core.agg(F.count(F.lit(1)).alias("bids"), F.count_distinct("agency").alias("agencies"), F.sum("score").alias("open_score")))


@query("config_row", "SELECT 60 AS min_recommended, count(*)::INT AS weight_documents, 45 AS weight_words FROM region")
def _(t):
    config = t.spark.range(1).select(F.lit(60).alias("min_recommended"), F.lit(30).alias("weight_documents"), F.lit(45).alias("weight_words"))
    patch = t.raw("region").agg(F.count(F.lit(1)).cast("int").alias("weight_documents"), F.max(F.lit(None).cast("int")).alias("weight_words"))
    return merge.patch_config(config, patch)


# ------------------------------------------------------------------ projections


@query("purchase_identity", """
SELECT bid_id, CASE WHEN year IS NOT NULL THEN lpad(upper(regexp_replace(left(cnpj, 9) || '/a-' || right(cnpj, 3), '[^A-Za-z0-9]', '', 'g')), 14, '0') END AS cnpj, year, CASE WHEN year IS NOT NULL THEN seq END AS seq FROM bids""")
def _(t):
    dirty = F.concat(F.left("cnpj", F.lit(9)), F.lit("/a-"), F.right("cnpj", F.lit(3)))
    return t.bid_core.select("bid_id", projections.purchase_identity(dirty, F.col("year"), F.col("seq")).alias("i")).select("bid_id", "i.cnpj", "i.year", "i.seq")


@query("dto_projection", f"""
SELECT bid_id::VARCHAR AS id, control_no AS portal_id, agency, unit_name, city, uf, object, value::DOUBLE AS estimated_value, {sql_stamp('closes_at')} AS deadline, modality,
  coalesce({w.is_open()}, false) AS open_now, {w.temporal()} AS temporal_state, category, score, team_status, notes, priority, coalesce(n, 0) AS docs_total, coalesce(state, 'pendente') AS docs_state
FROM bids LEFT JOIN (SELECT bid_id, count(*) AS n FROM docs WHERE active GROUP BY bid_id) USING (bid_id) LEFT JOIN doc_state USING (bid_id)""")
def _(t):
    full = projections.with_document_totals(projections.computed(t.bids, t.now), t.docs, t.doc_state)
    return projections.public_view(full).withColumn("deadline", F.date_format("deadline", "yyyy-MM-dd HH:mm:ss"))


@query("computed_columns", f"SELECT bid_id, {w.is_open()} AS open_now, {w.temporal()} AS temporal_state FROM bids")
def _(t):
    return projections.computed(t.bid_core, t.now).select("bid_id", "open_now", "temporal_state")


@query("search_text", "SELECT bid_id, agency || ' ' || object || ' ' || city AS search_text FROM bids")
def _(t):
    return t.bids.select("bid_id", tx.search_text(F.col("agency"), F.col("object"), F.col("city")).alias("search_text"))


@query("embed_text", "SELECT bid_id, trim(object || ' ' || agency || ' ' || city) AS text, md5(trim(object || ' ' || agency || ' ' || city)) AS hash FROM bids")
def _(t):
    text = tx.embed_text(F.col("object"), F.col("agency"), F.col("city"))
    return t.bids.select("bid_id", text.alias("text"), hashing.text_hash(text).alias("hash"))


@query("detail_view", """
WITH entries AS (
  SELECT bid_id, 'documento' AS section, row_number() OVER (PARTITION BY bid_id ORDER BY doc_type, seq)::INT AS place, name AS entry FROM docs
  UNION ALL SELECT bid_id, 'historico', row_number() OVER (PARTITION BY bid_id ORDER BY "at" DESC, entry)::INT, entry FROM history)
SELECT b.bid_id, coalesce(state, 'pendente') AS docs_state, coalesce(state, 'pendente') <> 'completo' AS docs_pending, section, place, entry
FROM bids b LEFT JOIN doc_state USING (bid_id) LEFT JOIN entries USING (bid_id)""")
def _(t):
    return projections.detail_view(t.bid_core, t.titled_docs, t.history, t.doc_state)


@query("shortlist_view", """
SELECT b.bid_id, coalesce(n, 0) AS docs_total, coalesce(chars, 0)::BIGINT AS chars, coalesce(pages, 0)::BIGINT AS pages,
  CASE WHEN coalesce(n, 0) > 0 THEN 'completo' ELSE coalesce(s.state, 'pendente') END AS docs_state, coalesce(a.state, 'nao_analisada') AS analysis_state, a.summary AS analysis_summary
FROM bids b JOIN shortlist USING (bid_id) LEFT JOIN (SELECT bid_id, count(*) AS n, sum(coalesce(f.chars, 0)) AS chars, sum(coalesce(f.pages, 1)) AS pages
  FROM docs d LEFT JOIN files f USING (bid_id, seq) WHERE d.active GROUP BY bid_id) USING (bid_id)
LEFT JOIN doc_state s USING (bid_id) LEFT JOIN analyses a USING (bid_id)""")
def _(t):
    view = projections.shortlist_view(t.bid_core, t.shortlist, t.docs, t.files, t.doc_state, t.analyses)
    return view.select("bid_id", "docs_total", "chars", "pages", "docs_state", "analysis_state", "analysis_summary")


@query("card_title", """
SELECT bid_id, modality || CASE WHEN process IS NULL OR process = 'null' THEN '' ELSE ' · ' || process END || ' · ' || unit_name AS title FROM bids""")
def _(t):
    return t.bids.select("bid_id", tx.card_title(F.col("modality"), F.col("process"), F.col("unit_name"), F.col("agency")).alias("title"))


@query("sources_preview", """
SELECT bid_id, source_id, doc_id, 'bloco_integral' AS kind, 0 AS ord, md5(text) AS excerpt FROM sources
UNION ALL SELECT bid_id, 'chunk-' || chunk_id, doc_id, 'evidencia', ord, md5(text) FROM chunks""")
def _(t):
    blocks = t.sources.withColumn("ord", F.lit(0))
    ev = t.chunks.select("bid_id", F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("source_id"), "doc_id", F.lit("evidencia").alias("kind"), "ord", F.col("text").alias("excerpt"))
    return projections.sources_preview(blocks, ev).withColumn("excerpt", F.md5("excerpt"))


@query("prompt_items", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY number, partkey, suppkey, total) AS place FROM items)
SELECT bid_id, (SELECT count(*) FROM items i WHERE i.bid_id = r.bid_id) AS items_total, ((place - 1) // 4)::INT AS part, count(*)::INT AS kept, string_agg(number || ':' || description, '|' ORDER BY place) AS lines FROM r GROUP BY bid_id, part""")
def _(t):
    p = projections.prompt_items(t.items, ["partkey", "suppkey", "total"], 4)
    line = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["number"].cast("string"), i["description"])), "|")
    return p.select("bid_id", "items_total", "part", F.size("items").alias("kept"), line.alias("lines"))

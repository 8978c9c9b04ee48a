"""Row mappings: source JSON structs to catalogue rows, and public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import classify, dates, hashing, jsonx, scoring
from bidspan.functions import text as tx
from bidspan.operators import windows
from bidspan.session import settle


def whole(value: Column) -> Column:
    """Number or text to an integer, truncated; anything else is NULL."""
    return value.cast("string").try_cast("double").try_cast("int")


def money(value: Column) -> Column:
    return value.cast("string").try_cast("decimal(18,4)")


def map_header(rows: DataFrame, fetched_at: Column, seen_in_proposals: bool, config: scoring.ScoreConfig) -> DataFrame:
    """Nested listing row to the flat catalogue row. Nothing absent is invented."""
    c = F.col
    flat = rows.select(
        tx.trim_null(c("numeroControlePNCP")).alias("control_no"),
        F.coalesce(tx.trim_null(c("orgaoEntidade.cnpj")), F.lit("")).alias("cnpj"),
        F.coalesce(tx.trim_null(c("orgaoEntidade.razaoSocial")), F.lit("")).alias("agency"),
        tx.trim_null(c("orgaoSubRogado.cnpj")).alias("delegate_cnpj"),
        tx.trim_null(c("orgaoSubRogado.razaoSocial")).alias("delegate_name"),
        whole(c("anoCompra")).alias("year"),
        whole(c("sequencialCompra")).alias("seq"),
        tx.trim_null(c("numeroCompra")).alias("number"),
        tx.trim_null(c("processo")).alias("process"),
        tx.trim_null(c("unidadeOrgao.nomeUnidade")).alias("unit_name"),
        tx.trim_null(c("unidadeOrgao.codigoUnidade")).alias("unit_code"),
        tx.trim_null(c("unidadeOrgao.ufSigla")).alias("uf"),
        tx.trim_null(c("unidadeOrgao.municipioNome")).alias("city"),
        tx.trim_null(c("unidadeOrgao.codigoIbge")).alias("city_code"),
        F.coalesce(tx.trim_null(c("objetoCompra")), F.lit("")).alias("object"),
        tx.trim_null(c("informacaoComplementar")).alias("extra_info"),
        whole(c("modalidadeId")).alias("modality_id"),
        tx.trim_null(c("modalidadeNome")).alias("modality"),
        whole(c("modoDisputaId")).alias("dispute_mode_id"),
        whole(c("situacaoCompraId")).alias("status_id"),
        tx.trim_null(c("situacaoCompraNome")).alias("status_name"),
        c("srp"),
        money(c("valorTotalEstimado")).alias("value"),
        dates.local_to_utc(c("dataPublicacaoPncp")).alias("published_at"),
        dates.local_to_utc(c("dataAberturaProposta")).alias("opens_at"),
        dates.local_to_utc(c("dataEncerramentoProposta")).alias("closes_at"),
        dates.local_to_utc(F.coalesce(c("dataAtualizacaoGlobal"), c("dataAtualizacao"))).alias("updated_at_source"),
        tx.trim_null(c("linkSistemaOrigem")).alias("origin_link"),
        *[c(x) for x in rows.columns if x == "position"],
    )
    return flat.withColumns(
        {
            "portal_url": tx.portal_url(c("cnpj"), c("year"), c("seq")),
            "category": classify.category(c("object")),
            "source_hash": hashing.content_hash(hashing.CONTENT_FIELDS),
            "fetched_at": fetched_at,
            "seen_at": fetched_at if seen_in_proposals else F.lit(None).cast("timestamp"),
        }
    ).withColumn(
        "score",
        scoring.score(c("object"), F.coalesce(c("modality"), F.lit("")), c("value"), c("category"), None, config),
    )


def document_seq(value: Column) -> Column:
    """Usable sequence: a whole number of at least 1."""
    number = value.cast("string").try_cast("double")
    return F.when((number == F.floor(number)) & (number >= 1), number.cast("int"))


def map_document(rows: DataFrame) -> DataFrame:
    """Document metadata row; ``bid_id`` and ``position`` pass through."""
    c = F.col
    url = F.coalesce(tx.trim_null(c("url")), tx.trim_null(c("uri")))
    return rows.select(
        "bid_id",
        document_seq(c("sequencialDocumento")).alias("seq"),
        classify.document_type(F.coalesce(c("tipoDocumentoNome"), c("tipoDocumentoDescricao")), c("titulo")).alias("doc_type"),
        F.nullif(tx.clean_title(c("tipoDocumentoNome")), F.lit("")).alias("source_type"),
        tx.clean_title(c("titulo")).alias("name"),
        F.nullif(tx.strip_port(url), F.lit("")).alias("url"),
        dates.local_to_utc(c("dataPublicacaoPncp")).alias("published_at"),
        F.coalesce(c("statusAtivo"), F.lit(True)).alias("active"),
        "position",
    )


# --- fixed values: the 27 fields of a line item, by kind ------------------------
ITEM_TEXT_FIELDS = [
    "materialOuServico", "materialOuServicoNome", "itemCategoriaNome", "patrimonio", "codigoRegistroImobiliario",
    "criterioJulgamentoNome", "situacaoCompraItemNome", "tipoBeneficioNome", "dataInclusao", "dataAtualizacao",
    "ncmNbsCodigo", "ncmNbsDescricao", "informacaoComplementar",
]
ITEM_ID_FIELDS = ["itemCategoriaId", "criterioJulgamentoId", "situacaoCompraItem", "tipoBeneficio", "imagem"]
ITEM_AMOUNT_FIELDS = ["valorUnitarioEstimado", "valorTotal", "quantidade"]
ITEM_FLAG_FIELDS = ["orcamentoSigiloso", "incentivoProdutivoBasico", "temResultado"]


def map_item(rows: DataFrame) -> DataFrame:
    """Line item: blank text is NULL, absent amounts are 0, absent flags are false."""
    c = F.col
    return rows.select(
        "bid_id",
        F.coalesce(c("numeroItem"), F.lit(0)).alias("numeroItem"),
        F.coalesce(tx.strip(c("descricao")), F.lit("")).alias("descricao"),
        F.coalesce(tx.trim_null(c("unidadeMedida")), F.lit("un")).alias("unidadeMedida"),
        *[F.nullif(c(n), F.lit("")).alias(n) for n in ITEM_TEXT_FIELDS],
        *[c(n) for n in ITEM_ID_FIELDS],
        *[F.coalesce(c(n), F.lit(0.0)).alias(n) for n in ITEM_AMOUNT_FIELDS],
        *[F.coalesce(c(n), F.lit(False)).alias(n) for n in ITEM_FLAG_FIELDS],
    )


def purchase_identity(cnpj: Column, year: Column, seq: Column) -> Column:
    """struct(cnpj, year, seq) ready for an address, NULL when a part is missing."""
    clean = F.upper(F.regexp_replace(cnpj, "[^A-Za-z0-9]", ""))
    padded = F.when(F.length(clean) < 14, F.lpad(clean, 14, "0")).otherwise(clean)
    known = (F.coalesce(cnpj, F.lit("")) != "") & (F.coalesce(year, F.lit(0)) != 0) & (F.coalesce(seq, F.lit(0)) != 0)
    return F.when(known, F.struct(padded.alias("cnpj"), year.alias("year"), seq.alias("seq")))


def computed(bids: DataFrame, now: Column) -> DataFrame:
    args = (F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)
    return bids.withColumns({"open_now": dates.is_open(*args), "temporal_state": dates.temporal_state(*args)})


def public_view(bids: DataFrame) -> DataFrame:
    """Public row: renamed, with the defaults a screen relies on."""
    c, empty = F.col, F.lit("")
    blank = lambda name: F.nullif(c(name), empty)
    return bids.select(
        c("bid_id").cast("string").alias("id"),
        c("control_no").alias("portal_id"),
        F.coalesce(c("agency"), empty).alias("agency"),
        blank("unit_name").alias("unit_name"),
        blank("city").alias("city"),
        blank("uf").alias("uf"),
        F.coalesce(c("object"), empty).alias("object"),
        c("value").cast("double").alias("estimated_value"),
        c("closes_at").alias("deadline"),
        blank("modality").alias("modality"),
        F.coalesce(c("open_now"), F.lit(False)).alias("open_now"),
        F.coalesce(c("temporal_state"), F.lit("indeterminada")).alias("temporal_state"),
        F.coalesce(c("category"), F.lit(classify.OTHER_CATEGORY)).alias("category"),
        F.coalesce(c("score"), F.lit(0)).alias("score"),
        F.coalesce(c("team_status"), F.lit("nova")).alias("team_status"),
        F.coalesce(c("notes"), empty).alias("notes"),
        F.coalesce(c("priority"), F.lit(False)).alias("priority"),
        F.coalesce(c("docs_total"), F.lit(0)).alias("docs_total"),
        F.coalesce(c("docs_state"), F.lit("pendente")).alias("docs_state"),
    )


def with_document_totals(bids: DataFrame, docs: DataFrame, state: DataFrame) -> DataFrame:
    """Attach ``docs_total`` (active documents) and ``docs_state`` in one aggregation."""
    totals = docs.filter("active").groupBy("bid_id").agg(F.count(F.lit(1)).alias("_n"))
    slim = state.select("bid_id", F.col("state").alias("_s"))
    return (
        bids.join(totals, "bid_id", "left")
        .join(slim, "bid_id", "left")
        .withColumn("docs_total", F.coalesce("_n", F.lit(0)))
        .withColumn("docs_state", F.coalesce("_s", F.lit("pendente")))
        .drop("_n", "_s")
    )


def detail_view(bids: DataFrame, docs: DataFrame, history: DataFrame, state: DataFrame) -> DataFrame:
    """Detail of the given bids as rows: one per document or history entry.

    ``section`` is ``documento`` (by type, then sequence) or ``historico``
    (newest first); ``place`` numbers rows inside the section. A bid without
    either keeps one row, so "nothing collected" stays visible.
    """
    head = bids.join(state.select("bid_id", F.col("state").alias("_s")), "bid_id", "left")
    head = head.select("bid_id", F.coalesce("_s", F.lit("pendente")).alias("docs_state"))
    head = head.withColumn("docs_pending", F.col("docs_state") != "completo")
    d = docs.select("bid_id", F.lit("documento").alias("section"), F.concat_ws("|", "doc_type", F.lpad(F.col("seq").cast("string"), 6, "0")).alias("_o"), F.col("name").alias("entry"))
    order = F.lpad((F.lit(10**17) - F.unix_micros("at")).cast("string"), 18, "0")
    h = history.select("bid_id", F.lit("historico").alias("section"), F.concat_ws("|", order, F.col("entry")).alias("_o"), "entry")
    rows = windows.rank_in_group(d.unionByName(h), ["bid_id", "section"], ["_o", "entry"], "place")
    return head.join(rows.drop("_o"), "bid_id", "left")


def shortlist_view(bids: DataFrame, shortlist: DataFrame, docs: DataFrame, files: DataFrame, state: DataFrame, analyses: DataFrame) -> DataFrame:
    """Shortlisted bids with active-document totals and analysis state."""
    mine = bids.join(shortlist.select("bid_id").distinct(), "bid_id", "left_semi")
    slim = files.select("bid_id", "seq", "chars", "pages")
    totals = (
        docs.filter("active")
        .join(slim, ["bid_id", "seq"], "left")
        .groupBy("bid_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.coalesce("chars", F.lit(0))).alias("_chars"),
            F.sum(F.coalesce("pages", F.lit(1))).alias("_pages"),
        )
    )
    joined = (
        mine.join(totals, "bid_id", "left")
        .join(state.select("bid_id", F.col("state").alias("_s")), "bid_id", "left")
        .join(analyses.select("bid_id", F.col("state").alias("_a"), F.col("summary").alias("analysis_summary")), "bid_id", "left")
    )
    n = F.coalesce("_n", F.lit(0))
    return joined.select(
        *bids.columns,
        n.alias("docs_total"),
        F.coalesce("_chars", F.lit(0)).alias("chars"),
        F.coalesce("_pages", F.lit(0)).alias("pages"),
        F.when(n > 0, "completo").otherwise(F.coalesce("_s", F.lit("pendente"))).alias("docs_state"),
        F.coalesce("_a", F.lit("nao_analisada")).alias("analysis_state"),
        "analysis_summary",
    )


def sources_preview(blocks: DataFrame, evidence: DataFrame, chars: int | None = None) -> DataFrame:
    """Saved source list: integral blocks and evidence excerpts; ``chars`` cuts what is shown of a block."""
    shown = F.col("text") if chars is None else F.substring("text", 1, chars)
    b = blocks.select("bid_id", "source_id", "doc_id", F.lit("bloco_integral").alias("kind"), "ord", shown.alias("excerpt"))
    e = evidence.select("bid_id", "source_id", "doc_id", "kind", "ord", "excerpt")
    return b.unionByName(e)


def per_distinct(rows: DataFrame, values: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """``rows`` with ``columns`` that depend on ``keys`` alone, computed once per distinct value of these.

    For rules over texts that repeat, such as titles and labels. ``values`` holds
    all the keys' values, with others or not. They are settled once each, so Spark broadcasts them where they are few and shuffles
    where they are many.
    """
    found = settle(values.select(*keys).distinct().withColumns(columns), "distinct")
    found = found.select(*[F.col(k).alias(f"_d_{k}") for k in keys], *columns)
    same = [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys]
    return rows.join(found, same, "left").drop(*[f"_d_{k}" for k in keys])


def prompt_items(items: DataFrame, tie: list[str], part_size: int = 150, chars: int | None = None) -> DataFrame:
    """Items of each bid in order, compact, in parts of ``part_size``, with how many there are in all.

    Every item is in a part: one prompt takes one part. ``chars`` cuts
    descriptions where a prompt needs it.
    """
    text = F.col("description") if chars is None else F.substring("description", 1, chars)
    line = F.struct("place", "number", text.alias("description"), "quantity", "unit", "unit_price", "total", "benefit_name", "status_name")
    ranked = windows.global_rank(items.filter("bid_id is not null"), ["bid_id", "number", *tie], [True] * (2 + len(tie)), "_rank")
    bids = ranked.groupBy("bid_id").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("items_total"))
    numbered = ranked.join(bids, "bid_id").withColumn("place", (F.col("_rank") - F.col("_first") + 1).cast("int"))
    numbered = numbered.withColumn("part", F.floor((F.col("place") - 1) / part_size).cast("int"))
    lists = numbered.groupBy("bid_id", "part").agg(F.max("items_total").alias("items_total"), F.array_sort(F.collect_list(line)).alias("items"))
    return lists.select("bid_id", "items_total", "part", "items")


def csv_cells(now: Column) -> list[tuple[str, Column]]:
    """The 18 export columns, in order, as display text."""
    c, empty = F.col, F.lit("")
    left = dates.days_left(c("closes_at"), now)
    remaining = F.when(left.isNull(), "Sem prazo").when(left < 0, "Encerrada").otherwise(left.cast("string"))
    status = c("team_status")
    for key, label in STATUS_LABELS.items():
        status = F.when(c("team_status") == key, label).otherwise(status)
    return [
        ("PNCP ID", c("control_no")),
        ("Órgão", c("agency")),
        ("CNPJ Órgão", c("cnpj")),
        ("Município", F.coalesce(c("city"), empty)),
        ("UF", F.coalesce(c("uf"), empty)),
        ("Objeto", F.coalesce(c("object"), empty)),
        ("Valor Estimado (R$)", F.when(F.coalesce(c("value"), F.lit(0)) != 0, tx.money_format(c("value"))).otherwise("Não divulgado")),
        ("Modalidade", F.coalesce(c("modality"), empty)),
        ("Categoria", F.coalesce(c("category"), empty)),
        ("Publicação", dates.format_day(c("published_at"))),
        ("Limite Proposta", dates.format_day_time(c("closes_at"))),
        ("Dias Restantes", remaining),
        ("Status PNCP", F.coalesce(c("status_name"), empty)),
        ("Status Interno", status),
        ("Prioridade", F.when(c("priority"), "Sim").otherwise("Não")),
        ("Score Aderência", F.coalesce(c("score"), F.lit(0)).cast("string")),
        ("Total Documentos", F.coalesce(c("docs_total"), F.lit(0)).cast("string")),
        ("Link PNCP", F.coalesce(c("portal_url"), empty)),
    ]


# --- fixed values: labels of the team status -------------------------------------
STATUS_LABELS = {
    "nova": "Nova",
    "em_analise": "Em análise",
    "interessante": "Interessante",
    "descartada": "Descartada",
    "proposta_enviada": "Proposta enviada",
}


def csv_line(bids: DataFrame, now: Column) -> DataFrame:
    """One fully quoted, semicolon-separated line per row, in column ``value``."""
    cells = []
    for _, cell in csv_cells(now):
        flat = F.regexp_replace(F.replace(F.coalesce(cell, F.lit("")), F.lit('"'), F.lit('""')), r"\r?\n", " ")
        cells.append(F.concat(F.lit('"'), flat, F.lit('"')))
    return bids.withColumn("value", F.concat_ws(";", *cells))


def json_item(bids: DataFrame, columns: list[str], internal: list[str]) -> DataFrame:
    return bids.withColumn("json", jsonx.item(columns, internal))

"""Rule tables and the classifiers built on them.

The lists below are fixed values: labels, terms and limits decide results and
must match the catalogue's published rules exactly.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidspan.functions import text as tx

# --- fixed values: category rules, most specific first -----------------------
CATEGORY_RULES: dict[str, list[str]] = {
    "Pavimentação": ["pavimenta", "asfalt", "recapeamento", "tapa-buraco", "cbuq", "fresagem"],
    "Drenagem": ["drenagem", "galeria de agua", "galeria pluvial", "bueiro", "contencao de encosta"],
    "Infraestrutura urbana": [
        "urbaniza", "praca", "calcadao", "paisagismo", "iluminacao publica", "saneamento",
        "abastecimento de agua", "esgoto", "orla",
    ],
    "Manutenção predial": [
        "manutencao predial", "manutencao preventiva", "manutencao corretiva", "conservacao predial",
    ],
    "Serviços de engenharia": [
        "projeto executivo", "projeto basico", "elaboracao de projeto", "supervisao de obra",
        "gerenciamento de obra", "laudo tecnico", "estudo tecnico",
    ],
    "Reforma": ["reforma", "ampliacao", "readequacao", "revitalizacao", "restauracao", "retrofit"],
    "Obra nova": [
        "construcao", "edificacao", "implantacao de", "terraplenagem", "obra de", "execucao de obra",
    ],
}
OTHER_CATEGORY = "Outros"

# --- fixed values: document type rules, most specific first ------------------
DOCUMENT_RULES: dict[str, list[str]] = {
    "orcamento": [
        "orcament", "planilha", "bdi", "composicao de custo", "composicao de preco", "curva abc",
        "cronograma fisico", "memoria de calculo", "sinapi", "sicro", "quantitativ",
    ],
    "projeto": [
        "projeto", "proj_", "proj-", "memorial descritivo", "caderno de encargos", "planta baixa",
        "prancha", "croqui", "levantamento topografic", "sondagem",
    ],
    "anexo": [
        "termo de referencia", "minuta", "anexo", "contrato", "ata de registro",
        "estudo tecnico preliminar", "matriz de risco", "mapa de risco",
    ],
    "edital": ["edital", "aviso de licitacao", "aviso de contratacao"],
}
UNCOMMITTED_LABEL = "outros documentos"
OTHER_DOCUMENT = "outro"

# --- fixed values: document relevance ----------------------------------------
FORMALITY_TERMS = [
    "recibo", "comprovante", "publicacao em jornal", "publicacao diario", "extrato diario", "certidao",
    "ata de sessao", "declaracao de idoneidade", "termo de encerramento", "relatorio de sessao",
    "despacho de homologacao",
]
KEY_DOCUMENT_TERMS = [
    "edital", "termo de referencia", "projeto basico", "projeto executivo", "especificacao tecnica",
    "memorial descritivo", "planilha orcamentaria", "chamada publica", "aviso de contratacao", "tr",
]
TYPE_RELEVANCE = {"edital": 90, "projeto": 80, "orcamento": 70, "anexo": 50}

# --- fixed values: file signatures -------------------------------------------
SIGNATURES = [
    ("25504446", "application/pdf", "pdf"),
    ("504B0304", "application/zip", "zip"),
    ("D0CF11E0", "application/msword", "doc"),
]
READABLE_MIME = "application/pdf"

# --- fixed values: checklist of the four technical pieces --------------------
CHECKLIST = {
    "has_notice": (["edital"], ["edital", "aviso", "minuta"]),
    "has_budget": (["orcamento"], ["planilha", "orcamento", "bdi", "quantitativo", "sinapi", "cronograma"]),
    "has_project": (
        ["projeto"], ["projeto", "planta", "arquitet", "estrutur", "eletric", "hidraul", ".dwg"],
    ),
    "has_memorial": ([], ["memorial", "especificacao", "termo de referencia", "caderno de encargo"]),
}

# --- fixed values: modalities, by id 1..19 -----------------------------------
MODALITIES = [
    "Leilão - Eletrônico", "Diálogo Competitivo", "Concurso", "Concorrência - Eletrônica",
    "Concorrência - Presencial", "Pregão - Eletrônico", "Pregão - Presencial", "Dispensa",
    "Inexigibilidade", "Manifestação de Interesse", "Pré-qualificação", "Credenciamento",
    "Leilão - Presencial", "Inaplicabilidade da Licitação", "Chamada pública",
    "Concorrência – Eletrônica Internacional", "Concorrência – Presencial Internacional",
    "Pregão – Eletrônico Internacional", "Pregão – Presencial Internacional",
]

# --- fixed values: purchase states that end or pause a tender ----------------
ENDED_STATUS = {2: "revogado", 3: "anulado", 4: "suspenso"}

SLOW_MS = 5000  # fixed value: a probe slower than this is "lenta"
DENSE_CHARS_PER_PAGE = 200  # fixed value: below this a file counts as scanned


def category(object_: Column) -> Column:
    """First rule with a matching term wins; none means "Outros"."""

    def rules(folded: Column) -> Column:
        found = [F.when(tx.any_contains(folded, terms), F.lit(label)) for label, terms in CATEGORY_RULES.items()]
        return F.coalesce(*found, F.lit(OTHER_CATEGORY))

    return tx.let(tx.fold(object_), rules)


def _document_rules(spaced: Column, glued: Column) -> Column:
    found = []
    for label, terms in DOCUMENT_RULES.items():
        glued_terms = [t.replace(" ", "") for t in terms if " " in t]
        found.append(F.when(tx.any_contains(spaced, terms) | tx.any_contains(glued, glued_terms), F.lit(label)))
    return F.coalesce(*found)


def _rules_on(folded: Column) -> Column:
    """Rules over a folded title and its form without separators."""
    both = F.struct(folded.alias("spaced"), tx.compact(folded).alias("glued"))
    return tx.let(both, lambda t: _document_rules(t["spaced"], t["glued"]))


def document_type(source_label: Column, title: Column) -> Column:
    """The source's label decides unless it says "outros documentos"; then the title."""
    by_label = tx.let(
        tx.fold(tx.clean_title(source_label)),
        lambda f: F.when(~F.contains(f, F.lit(UNCOMMITTED_LABEL)), _rules_on(f)),
    )
    by_title = _rules_on(tx.fold(tx.clean_title(title)))
    return F.coalesce(by_label, by_title, F.lit(OTHER_DOCUMENT))


def document_relevance(name: Column, source_label: Column, doc_type: Column, active: Column, url: Column) -> Column:
    empty = F.lit("")
    unusable = (active.isNotNull() & ~active) | (F.coalesce(url, empty) == "")

    def ladder(both: Column) -> Column:
        steps = F.when(unusable, -100).when(tx.any_contains(both, FORMALITY_TERMS), 1)
        steps = steps.when(tx.any_contains(both, KEY_DOCUMENT_TERMS), 100)
        for label, points in TYPE_RELEVANCE.items():
            steps = steps.when(doc_type == label, points)
        return steps.otherwise(10)

    return tx.let(tx.fold(F.concat_ws(" ", F.coalesce(name, empty), F.coalesce(source_label, empty))), ladder)


def file_type(header_name: Column, catalogue_name: Column, first_bytes: Column) -> Column:
    """struct(name, ext, mime, ok): content signature first, name only for the extension."""
    head = F.hex(F.substring(first_bytes, 1, 4))
    name = F.when(F.coalesce(header_name, F.lit("")) != "", tx.filename_from_header(header_name)).otherwise(catalogue_name)
    mime = F.coalesce(*[F.when(head == sig, F.lit(m)) for sig, m, _ in SIGNATURES])
    ext = F.coalesce(*[F.when(head == sig, F.lit(e)) for sig, _, e in SIGNATURES], tx.extension(name))
    ok = F.coalesce(mime == READABLE_MIME, F.lit(False))
    return F.struct(name.alias("name"), ext.alias("ext"), mime.alias("mime"), ok.alias("ok"))


def _holds(terms: list[str]):
    return lambda name: tx.any_contains(name, terms)


def checklist(types: Column, names: Column) -> Column:
    """struct of four presence flags and their count, from a bid's types and names."""
    folded = F.transform(names, lambda n: tx.fold(F.coalesce(n, F.lit(""))))
    flags = {}
    for flag, (wanted, terms) in CHECKLIST.items():
        by_type = F.lit(False)
        for t in wanted:
            by_type = by_type | F.coalesce(F.array_contains(types, t), F.lit(False))
        flags[flag] = by_type | F.exists(folded, _holds(terms))
    count = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return F.struct(*[f.alias(n) for n, f in flags.items()], count.alias("ready"))


def checklist_row_flags(doc_type: Column, name: Column) -> dict[str, Column]:
    """The same four flags for one document row; combine rows with ``bool_or``.

    This is the form for large data: flags are aggregated map-side, so a bid
    with very many documents never becomes one array.
    """
    folded = tx.fold(F.coalesce(name, F.lit("")))
    return {
        flag: F.coalesce(doc_type.isin(wanted), F.lit(False)) | tx.any_contains(folded, terms)
        if wanted
        else tx.any_contains(folded, terms)
        for flag, (wanted, terms) in CHECKLIST.items()
    }


def proximity(km: Column) -> Column:
    return (
        F.when(km.isNull() | F.isnan(km.cast("double")), "desconhecido")
        .when(km <= 100, "muito_perto")
        .when(km <= 250, "media")
        .otherwise("longe")
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "alta").when(score >= 40, "media").otherwise("baixa")


def urgency(days: Column) -> Column:
    return (
        F.when(days.isNull(), "sem_prazo")
        .when(days < 0, "encerrada")
        .when(days == 0, "hoje")
        .when(days <= 2, "ate_2")
        .when(days <= 5, "ate_5")
        .when(days <= 15, "ate_15")
        .otherwise("depois")
    )


def probe_state(status: Column, latency_ms: Column, error: Column, valid: Column) -> Column:
    code = F.coalesce(status, F.lit(0))
    return (
        F.when(error.isin("timeout", "rede"), "fora_do_ar")
        .when(code >= 500, "fora_do_ar")
        .when(code == 429, "instavel")
        .when(~code.isin(200, 204), "instavel")
        .when(~F.coalesce(valid, F.lit(False)), "fora_do_ar")
        .when(latency_ms > SLOW_MS, "lenta")
        .otherwise("online")
    )


RPC_CODE = "PGRST203"  # fixed value: ambiguous remote function


def error_kind(name: Column, status: Column, code: Column) -> Column:
    """timeout, rpc, http, contract or transport, tested in that order."""
    return (
        F.when(name.isin("TimeoutError", "AbortError"), "timeout")
        .when(code == RPC_CODE, "configuracao_rpc")
        .when(status.isNotNull(), "http")
        .when(name == "ErroContratoResposta", "contrato")
        .otherwise("transporte")
    )


def tender_state(status_id: Column, items: Column, all_awarded: Column, closes_at: Column, now: Column) -> Column:
    """State of the procedure from source facts, not from document text."""
    state = None
    for code, label in ENDED_STATUS.items():
        cond = status_id == code
        state = F.when(cond, label) if state is None else state.when(cond, label)
    return (
        state.when((F.coalesce(items, F.lit(0)) > 0) & F.coalesce(all_awarded, F.lit(False)), "homologado")
        .when(closes_at.isNull(), "indeterminado")
        .when(closes_at < now, "proposta_encerrada")
        .otherwise("aberto")
    )


def analysis_view(state: Column, coverage: Column, current_format: Column) -> Column:
    return (
        F.when(state.isNull() | (state == "nunca"), "nunca")
        .when(coverage == "indisponivel", "indisponivel")
        .when(state == "processando", "processando")
        .when(state == "erro", "erro")
        .when(current_format.isNotNull() & ~current_format, "desatualizada")
        .when(coverage == "parcial", "parcial")
        .otherwise("pronta")
    )


# --- fixed values: negative answers, and quotes admitting the text is silent --
NEGATIVE_ANSWER = r"(?iu)^(não|nao|nenhum|nenhuma|sem |inexist|dispensad|isent)"
SILENT_QUOTE = (
    r"(?iu)^(não|nao) (se menciona|há menção|ha mencao|consta|é mencionad|e mencionad|foi mencionad|"
    r"foram mencionad)|^o edital não (menciona|informa|prevê|preve)"
)


def keep_answer(value: Column, quote: Column, confirmed: Column) -> Column:
    """The value, or NULL for a negative without proof or a quote admitting silence."""
    silent = F.coalesce(tx.strip(quote).rlike(SILENT_QUOTE), F.lit(False))
    unproven = F.coalesce(tx.strip(value).rlike(NEGATIVE_ANSWER), F.lit(False)) & ~F.coalesce(confirmed, F.lit(False))
    return F.when(~silent & ~unproven, value)


def text_density_state(chars: Column, pages: Column) -> Column:
    dense = (pages > 0) & (chars >= pages * DENSE_CHARS_PER_PAGE)
    return F.when(F.coalesce(dense, F.lit(False)), "extraido").otherwise("sem_texto")


def text_extract_state(
    bytes_: Column, max_bytes: int, failed: Column, mime: Column, chars: Column, pages: Column
) -> Column:
    """State of a downloaded file, in the order the checks are made."""
    return (
        F.when(bytes_ > max_bytes, "grande_demais")
        .when(F.coalesce(failed, F.lit(False)) | (F.coalesce(bytes_, F.lit(0)) == 0), "erro")
        .when(F.coalesce(mime, F.lit("")) != READABLE_MIME, "erro")
        .otherwise(text_density_state(chars, pages))
    )


def plain_fold(value: str) -> str:
    """Driver-side fold of a parameter, the same rule as ``text.fold``."""
    return "".join(c for c in unicodedata.normalize("NFD", value.lower()) if not 0x300 <= ord(c) <= 0x36F)

"""DuckDB forms of the derived tables and of the reusable expressions."""

from __future__ import annotations

from bidspan.functions import classify, scoring
from bidspan.plans import index
from bidspan.registry.tables import DOC_LABELS, DOC_NAMES, MODEL, NOW, OBJECTS, STATUS_NAMES, TEAM_STATUSES

ZONE = "America/Sao_Paulo"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")" if terms else "false"


def category(x: str) -> str:
    f = fold(x)
    return "CASE " + " ".join(f"WHEN {any_of(f, t)} THEN {lit(c)}" for c, t in classify.CATEGORY_RULES.items()) + f" ELSE {lit(classify.OTHER_CATEGORY)} END"


def clean(x: str) -> str:
    fixed = x
    for bad, good in {"Ã§": "ç", "Ã©": "é"}.items():
        fixed = f"replace({fixed}, {lit(bad)}, {lit(good)})"
    return f"trim(regexp_replace(trim({fixed}, ' \"'), '\\s+', ' ', 'g'))"


def document_rules(x: str) -> str:
    f = fold(clean(x))
    glued = f"regexp_replace({f}, '[^a-z0-9]', '', 'g')"
    whens = []
    for label, terms in classify.DOCUMENT_RULES.items():
        joined = [t.replace(" ", "") for t in terms if " " in t]
        whens.append(f"WHEN {any_of(f, terms)} OR {any_of(glued, joined)} THEN {lit(label)}")
    return "CASE " + " ".join(whens) + " END"


def document_type(label: str, title: str) -> str:
    known = f"CASE WHEN NOT contains({fold(clean(label))}, 'outros documentos') THEN {document_rules(label)} END"
    return f"coalesce({known}, {document_rules(title)}, 'outro')"


def band(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 0.25 WHEN {v} >= 1000000 THEN 1.0 WHEN {v} >= 300000 THEN 0.75 WHEN {v} >= 100000 THEN 0.5 ELSE 0.25 END"


def hits(x: str) -> str:
    f = fold(x)
    return "(" + " + ".join(f"contains({f}, {lit(classify.plain_fold(w))})::INT" for w in scoring.KEYWORDS) + ")"


def score(obj: str, modality: str, value: str, cat: str, docs: str = "0.0") -> str:
    bonus = f"(CASE WHEN {modality} IN ({', '.join(lit(m) for m in scoring.BONUS_MODALITIES)}) THEN 4 ELSE 0 END + CASE WHEN {cat} <> 'Outros' THEN 4 ELSE 0 END)"
    total = f"least(1.0::DOUBLE, {hits(obj)} / 3::DOUBLE) * 45 + least(1.0::DOUBLE, ({docs})::DOUBLE) * 30 + ({band(value)})::DOUBLE * 17 + {bonus}"
    return f"greatest(0, least(100, floor({total} + 0.5)::INT))"


def to_utc(local: str) -> str:
    """A local wall-clock expression as a naive UTC timestamp; the earlier of two equal clocks."""
    wall = f"CAST({local} AS TIMESTAMP)"
    late = f"timezone('UTC', timezone('{ZONE}', {wall}))"
    early = f"({late} - INTERVAL 1 HOUR)"
    return f"(CASE WHEN {to_local(early)} = {wall} THEN {early} ELSE {late} END)"


def to_local(utc: str) -> str:
    return f"timezone('{ZONE}', timezone('UTC', {utc}))"


def is_open(now: str = f"TIMESTAMP '{NOW}'", p: str = "") -> str:
    return (
        f"({p}status_id = 1 AND {p}opens_at IS NOT NULL AND {p}closes_at IS NOT NULL AND coalesce({p}opens_at <= {now} AND {now} < {p}closes_at, false))"
    )


def temporal(now: str = f"TIMESTAMP '{NOW}'") -> str:
    return (
        "CASE WHEN opens_at IS NULL OR closes_at IS NULL THEN 'indeterminada' WHEN opens_at > closes_at THEN 'inconsistente' "
        "WHEN status_id IS DISTINCT FROM 1 THEN 'nao_divulgada' "
        f"WHEN {now} < opens_at THEN 'nao_iniciada' WHEN {now} >= closes_at THEN 'encerrada' ELSE 'aberta' END"
    )


def haversine(a: str, b: str, c: str, d: str) -> str:
    half = f"sqrt(pow(sin(radians({c}-({a}))/2),2) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2))"
    return f"2*6371.0*asin(CASE WHEN {half} > 1 THEN 1.0 ELSE {half} END)"


STOPS = ", ".join(lit(w) for w in index.STOP_WORDS)


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '[^a-z0-9]+'), lambda t: t <> '')"


def stem(x: str) -> str:
    return f"regexp_replace({x}, {lit(index.STEM_PATTERN)}, '\\1')"


def tokens(x: str) -> str:
    return f"list_transform(list_filter({words(x)}, lambda t: t NOT IN ({STOPS})), lambda t: {stem('t')})"


def compare_form(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({fold(x)}, '(\\w)-\\s+(\\w)', '\\1\\2', 'g'), '[^a-z0-9%$]+', ' ', 'g'))"


def pick(values: list[str], i: str) -> str:
    return f"{array(values)}[({i}) + 1]"


def days(n: str) -> str:
    return f"to_days(({n})::INT)"


def hours(n: str) -> str:
    return f"to_hours(({n})::INT)"


_K = "o_orderkey"
_PUB = f"(o_orderdate + {hours(_K + ' % 24')})"
_OPEN = f"({_PUB} + {days(_K + ' % 10')})"

COMMON: dict[str, str] = {
    "bid_base": f"""
SELECT {_K} AS bid_id, o_custkey AS custkey, lpad(o_custkey::VARCHAR, 14, '0') AS cnpj,
  CASE WHEN {_K} % 29 <> 0 THEN year(o_orderdate)::INT END AS year, ({_K} % 1000 + 1)::INT AS seq,
  'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS agency,
  {pick(OBJECTS, _K + ' % 16')} || ' - lote ' || ({_K} % 97) || ' ' || o_orderpriority AS object,
  CASE WHEN {_K} % 33 = 0 THEN NULL WHEN {_K} % 31 = 0 THEN 'null' ELSE 'PROC-' || ({_K} % 500) END AS process,
  ({_K} % 15 + 1)::INT AS modality_id,
  (CASE WHEN {_K} % 97 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 2 + {_K} % 3
    WHEN o_orderstatus = 'F' AND {_K} % 4 = 0 THEN 4 ELSE 1 END)::INT AS status_id,
  CASE WHEN {_K} % 3 = 0 THEN true WHEN {_K} % 3 = 1 THEN false END AS srp,
  CASE WHEN {_K} % 11 <> 0 THEN o_totalprice::DECIMAL(18,4) END AS value,
  {_PUB} AS published_at, CASE WHEN {_K} % 53 <> 0 THEN {_OPEN} END AS opens_at,
  CASE WHEN {_K} % 37 <> 0 THEN CASE WHEN {_K} % 71 = 0 THEN {_PUB} - INTERVAL 5 DAY ELSE {_OPEN} + {days('1 + ' + _K + ' % 45')} END END AS closes_at,
  CASE WHEN {_K} % 41 <> 0 THEN {_PUB} + {days(_K + ' % 7')} END AS updated_at_source,
  {pick(TEAM_STATUSES, _K + ' % 5')} AS team_status, (o_orderpriority[1] IN ('1', '2')) AS priority,
  CASE WHEN {_K} % 13 = 0 THEN 'nota ' || {_K} ELSE '' END AS notes,
  {_PUB} + INTERVAL 1 HOUR AS created_at, {_PUB} + INTERVAL 1 HOUR AS changed_at, {_PUB} + INTERVAL 3 HOUR AS synced_at,
  CASE WHEN {_K} % 2 = 0 THEN {_PUB} + INTERVAL 1 HOUR END AS seen_at,
  CASE WHEN {_K} % 7 = 0 THEN {_PUB} + INTERVAL 3 DAY END AS accessed_at
FROM orders""",
    "bid_named": f"""
SELECT *, cnpj || '-1-' || bid_id AS control_no, {pick(classify.MODALITIES, 'modality_id - 1')} AS modality,
  CASE WHEN status_id IS NOT NULL THEN {pick(STATUS_NAMES, 'status_id - 1')} END AS status_name,
  {category('object')} AS category,
  CASE WHEN cnpj <> '' AND year IS NOT NULL AND seq IS NOT NULL THEN 'https://pncp.gov.br/app/editais/' || cnpj || '/' || year || '/' || seq END AS portal_url
FROM bid_base""",
    "bids": f"""
SELECT b.* EXCLUDE (custkey), {score('object', 'modality', 'value', 'category')} AS score, c_mktsegment AS unit_name, n_name AS city,
  CASE WHEN bid_id % 43 <> 0 THEN r_name END AS uf, CASE WHEN bid_id % 47 <> 0 THEN lpad(n_nationkey::VARCHAR, 7, '0') END AS city_code,
  md5(control_no || '|' || object || '|' || coalesce(status_id::VARCHAR, '-')) AS source_hash
FROM bid_named b JOIN customer ON c_custkey = b.custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "cities": """
SELECT lpad(n_nationkey::VARCHAR, 7, '0') AS city_code, n_name AS city, r_name AS uf, n_nationkey * 1.5::DOUBLE - 33.0 AS lat,
  ((n_nationkey * 7) % 35)::DOUBLE - 70.0 AS lon FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "raw_docs": f"""
SELECT l_orderkey AS bid_id, l_linenumber AS seq, CASE WHEN l_suppkey % 5 <> 4 THEN {pick(DOC_LABELS, 'l_suppkey % 5')} END AS source_type,
  {pick(DOC_NAMES, 'l_partkey % 12')} AS title,
  CASE WHEN l_quantity::BIGINT % 13 <> 0 THEN 'https://files.example:1401/' || l_orderkey || '/' || l_linenumber END AS url,
  l_shipdate AS published_at, l_quantity::BIGINT % 10 <> 0 AS active, l_partkey, l_suppkey, l_extendedprice FROM lineitem""",
    "docs": f"""
SELECT bid_id, seq, bid_id * 100 + seq AS doc_id, {document_type('source_type', 'title')} AS doc_type, source_type, {clean('title')} AS name,
  replace(url, ':1401/', '/') AS url, published_at, active FROM raw_docs
QUALIFY row_number() OVER (PARTITION BY bid_id, seq ORDER BY published_at DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "items": """
SELECT l_orderkey AS bid_id, l_linenumber AS number, p_name AS description, CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'S' END AS kind,
  p_type AS item_category, p_brand AS code, l_quantity AS quantity, 'un' AS unit, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS unit_price,
  l_extendedprice AS total, CASE WHEN l_suppkey % 3 = 0 THEN 'Participação exclusiva ME/EPP' WHEN l_suppkey % 3 = 1 THEN 'Cota reservada ME/EPP' END AS benefit_name,
  CASE l_returnflag WHEN 'A' THEN 'Homologado' WHEN 'N' THEN 'Em andamento' END AS status_name, l_linestatus = 'F' AS has_result,
  l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "doc_state": f"""
SELECT o_orderkey AS bid_id, {pick(['pendente', 'coletando', 'completo', 'erro', 'completo'], 'o_orderkey % 5')} AS state,
  TIMESTAMP '{NOW}' - {hours('o_orderkey % 12')} AS changed_at, NULL::VARCHAR AS error FROM orders WHERE o_orderkey % 6 <> 0""",
    "files": f"""
SELECT doc_id, doc_id // 3 AS bid_id, (doc_id % 3 + 1)::INT AS seq,
  {pick(['pendente', 'erro', 'extraido', 'extraido', 'extraido', 'sem_texto', 'baixando'], 'doc_id % 7')} AS state, n_chars * 2 AS bytes,
  sha256(text) AS sha256, (doc_id % 9)::INT AS pages, n_chars AS chars, text, lang, TIMESTAMP '{NOW}' - {hours('doc_id % 20')} AS updated_at,
  doc_id % 8 <> 0 AS active, CASE WHEN doc_id % 10 <> 0 THEN 'u/' || doc_id END AS url,
  {pick(['edital', 'anexo', 'outro', 'projeto', 'orcamento'], 'doc_id % 5')} AS doc_type, 'arquivo ' || doc_id AS name FROM documents""",
    "vectors": f"""
SELECT vec_id AS bid_id, embedding, label, CASE WHEN vec_id % 10 = 9 THEN 'antigo' ELSE '{MODEL}' END AS model, 'h' || (vec_id % 4) AS source_hash FROM embeddings""",
    "chunks": f"""
SELECT vec_id AS chunk_id, vec_id AS doc_id, vec_id // 3 AS bid_id, (vec_id % 3)::INT AS ord, embedding, label,
  CASE WHEN vec_id % 10 = 9 THEN 'antigo' ELSE '{MODEL}' END AS model, text,
  CASE WHEN vec_id % 5 = 0 THEN 'stale' ELSE md5(text) END AS source_hash FROM embeddings JOIN documents ON doc_id = vec_id""",
    "theme_parts": """
SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL""",
    "themes": """
SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS embedding FROM theme_parts GROUP BY label""",
    "calls": """
SELECT event_id, user_id AS job_id, ts, event_type, event_type <> 'error' AS ok, k, round(value * 10)::BIGINT AS latency_ms,
  (event_type = 'error' AND k % 4 = 0)::BIGINT AS timeouts, (event_type = 'error' AND k % 4 = 1)::BIGINT AS e429,
  (event_type = 'error' AND k % 4 = 2)::BIGINT AS e5xx, (event_type = 'error' AND k % 4 = 3)::BIGINT AS other
FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""",
    "jobs": f"""
SELECT job_id, started_at, CASE WHEN job_id % 6 <> 0 THEN last_ts END AS finished_at, total_new, total_updated,
  {pick(['concluido', 'concluido_com_erros', 'falhou', 'em_andamento'], 'job_id % 4')} AS status,
  CASE WHEN job_id % 2 = 0 THEN 'descoberta' ELSE 'incremental' END AS kind
FROM (SELECT job_id, min(ts) AS started_at, max(ts) AS last_ts, count(*) FILTER (event_type = 'signup') AS total_new,
  count(*) FILTER (event_type = 'purchase') AS total_updated FROM calls GROUP BY job_id)""",
    "segments": """
SELECT event_id AS segment_id, job_id, event_type AS uf, (k % 15 + 1)::INT AS modality_id, ts::DATE - (k % 7)::INT AS from_date, ts::DATE AS to_date,
  CASE WHEN k % 3 <> 0 THEN 'concluido' WHEN event_id % 50 = 7 THEN 'falhou' WHEN event_id % 10 = 9 THEN 'pendente' WHEN event_id % 50 = 11 THEN 'executando' ELSE 'concluido' END AS status,
  (event_id % 3)::INT AS priority,
  (k % 10)::BIGINT AS pages_applied, CASE WHEN k % 7 <> 0 THEN (k % 12)::BIGINT END AS total_pages, ts AS updated_at,
  CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL 1 DAY END AS retry_at FROM calls""",
    "frontier": """
SELECT uf, modality_id, CASE WHEN modality_id % 6 <> 0 THEN max(to_date) - 20 END AS last_closed_date FROM segments GROUP BY uf, modality_id""",
    "shortlist": "SELECT DISTINCT conv_id AS bid_id FROM conversations WHERE role = 'user'",
    "history": f"""
SELECT conv_id AS bid_id, turn AS event_no, role = 'user' AS added, TIMESTAMP '{NOW}' + {hours('turn')} AS "at", role AS entry FROM conversations""",
    "analyses": f"""
SELECT o_orderkey AS bid_id, {pick(['pronta', 'processando', 'erro', 'nunca'], 'o_orderkey % 4')} AS state, 'resumo ' || o_orderkey AS summary,
  'f' || (o_orderkey % 3) AS fingerprint, o_orderkey % 9 = 0 AS final_format FROM orders WHERE o_orderkey % 4 <> 0""",
    "sources": "SELECT doc_id, doc_id // 3 AS bid_id, 'doc-' || doc_id AS source_id, doc_id AS ord, text FROM documents",
    "answers": """
SELECT doc_id AS answer_id, (doc_id + CASE WHEN doc_id % 4 = 3 THEN 3 ELSE 0 END) // 3 AS bid_id,
  CASE doc_id % 3 WHEN 0 THEN 'prazos' WHEN 1 THEN 'requisitos' ELSE 'habilitacao' END AS section,
  CASE WHEN doc_id % 5 = 0 THEN 'Não se exige' WHEN doc_id % 7 <> 0 THEN 'valor ' || doc_id END AS value,
  CASE WHEN doc_id % 11 = 0 THEN 'O edital não menciona prazo' WHEN doc_id % 6 = 5 THEN string_split(text, chr(10))[1] || ' [...] ' || string_split(text, chr(10))[-1] WHEN doc_id % 6 = 4 THEN substr(text, length(text) // 2 + 1, 20 + doc_id % 200) ELSE string_split(text, chr(10))[1] END AS quote,
  ['doc-' || (doc_id + doc_id % 2), 'nada-' || doc_id] AS source_ids FROM documents""",
}

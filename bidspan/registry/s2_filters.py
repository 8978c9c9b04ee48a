"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.functions import classify, scoring
from bidspan.functions import text as tx
from bidspan.functions.vectors import cosine_distance
from bidspan.operators import filters as fl
from bidspan.plans import index, search
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.tables import MODEL, NOW, TODAY

ORIGIN, RADIUS = "0000003", 900.0


def context(t):
    return fl.Context(now=t.now)


def bid_ids(df):
    return df.select("bid_id")


def by_map(name, wanted, where):
    """A filter of the map, registered with the row predicate it must equal."""

    @query(name, f"SELECT bid_id FROM bids WHERE {where}")
    def run(t):
        placed = {"uf", "city", "term"} & set(wanted)
        source = t.bids if placed else t.bid_core
        return bid_ids(source.filter(fl.conjunction(wanted, context(t))))


SEARCHED = "lower(agency || ' ' || object || ' ' || city)"
OBJ = "coalesce(object, '') || ' ' || coalesce(agency, '')"


def sql_day(column, op, day, plus=0):
    bound = w.to_utc(f"(DATE '{day}' + {plus})")
    return f"{column} {op} {bound}"


@query("flt_substring", f"SELECT bid_id FROM bids WHERE contains({SEARCHED}, 'hospital')")
def _(t):
    return bid_ids(t.bids.filter(fl.substring(" HOSPITAL ")))


def has_terms(expr, words):
    return "(" + " AND ".join(f"list_contains({w.tokens(expr)}, {w.lit(x)})" for x in words) + ")"


@query("flt_fulltext", f"SELECT bid_id FROM bids WHERE contains({SEARCHED}, 'pavimentacoes urbanas') OR {has_terms(OBJ, index.query_tokens('pavimentacoes urbanas'))}")
def _(t):
    return bid_ids(t.bids.filter(search.term_predicate("pavimentacoes urbanas")))


STEMMED = f"' ' || array_to_string(list_transform({w.words(OBJ)}, lambda t: {w.stem('t')}), ' ') || ' '"
PHRASE = "executivo de engenharia"


@query("flt_phrase_any_none", f"""
SELECT bid_id, 'listas' AS form FROM bids WHERE {has_terms(OBJ, index.query_tokens('escola'))} AND ({has_terms(OBJ, index.query_tokens('reforma'))} OR {has_terms(OBJ, index.query_tokens('construções'))})
  AND NOT {has_terms(OBJ, index.query_tokens('urgente'))} AND NOT {has_terms(OBJ, ['urgent'])}
UNION ALL SELECT bid_id, 'frase' FROM bids WHERE contains({STEMMED}, ' {' '.join(__import__('re').sub(index.STEM_PATTERN, chr(92) + '1', x) for x in PHRASE.split())} ')""")
def _(t):
    text = search.object_text()
    lists = index.all_any_none(text, all_=["escola"], any_=["reforma", "construções"], none=["urgente", "urgent"])
    phrase = index.all_any_none(text, phrase_=PHRASE)
    a = t.bid_core.filter(lists).select("bid_id", F.lit("listas").alias("form"))
    return a.unionByName(t.bid_core.filter(phrase).select("bid_id", F.lit("frase").alias("form")))


by_map("flt_uf", {"uf": "ASIA"}, "uf = 'ASIA'")
by_map("flt_city", {"city": "NATION_7"}, "city = 'NATION_7'")
by_map("flt_agency", {"agency": "Customer#000000042"}, "agency = 'Customer#000000042'")
by_map("flt_modality", {"modality": "Pregão - Eletrônico"}, "modality = 'Pregão - Eletrônico'")
by_map("flt_category", {"category": "Reforma"}, "category = 'Reforma'")
by_map("flt_status", {"status": "interessante"}, "team_status = 'interessante'")
by_map("flt_value_min", {"value_min": "250000.50"}, "value >= 250000.50")
by_map("flt_value_max", {"value_max": "99999.99"}, "value <= 99999.99")
by_map("flt_published_from", {"published_from": "1998-06-15"}, sql_day("published_at", ">=", "1998-06-15"))
by_map("flt_published_to", {"published_to": "1998-06-15"}, sql_day("published_at", "<", "1998-06-15", 1))
by_map("flt_created_from", {"created_from": "1999-01-10"}, sql_day("created_at", ">=", "1999-01-10"))
by_map("flt_deadline_from", {"deadline_from": TODAY}, sql_day("closes_at", ">=", TODAY))
by_map("flt_deadline_to", {"deadline_to": TODAY}, sql_day("closes_at", "<", TODAY, 1))
by_map("flt_unreviewed", {"unreviewed": True}, "team_status = 'nova'")
by_map("flt_recommended", {"recommended": True}, "score >= 60")
by_map("flt_open_now", {"open_now": True}, w.is_open())


@query("flt_priority_tri", """
SELECT 'sim' AS choice, count(*) AS n FROM bids WHERE priority UNION ALL SELECT 'nao', count(*) FROM bids WHERE NOT priority UNION ALL SELECT '', count(*) FROM bids""")
def _(t):
    def count(choice):
        cond = fl.conjunction({"priority": choice}, context(t))
        df = t.bid_core if cond is None else t.bid_core.filter(cond)
        return df.agg(F.lit(choice).alias("choice"), F.count(F.lit(1)).alias("n"))

    return count("sim").unionByName(count("nao")).unionByName(count(""))


def with_document(name, types):
    cond = " AND ".join(f"bid_id IN (SELECT bid_id FROM docs WHERE active AND doc_type = '{x}')" for x in types)

    @query(name, f"SELECT bid_id FROM bids WHERE {cond}")
    def run(t):
        return bid_ids(fl.has_document(t.bid_core, t.docs, types))


with_document("flt_has_notice", ["edital"])
with_document("flt_has_project", ["projeto"])
with_document("flt_has_budget", ["orcamento"])
KM = w.haversine("o.lat", "o.lon", "c.lat", "c.lon")


@query("flt_radius", f"""
SELECT bid_id, round({KM}, 1) AS km FROM bids JOIN cities c USING (city_code), (SELECT lat, lon FROM cities WHERE city_code = '{ORIGIN}') o WHERE {KM} <= {RADIUS}""")
def _(t):
    return fl.within_radius(t.bids, t.cities, ORIGIN, RADIUS).select("bid_id", F.round("km", 1).alias("km"))


@query("flt_not_shortlisted", "SELECT bid_id FROM bids WHERE bid_id NOT IN (SELECT bid_id FROM shortlist)")
def _(t):
    return bid_ids(fl.not_shortlisted(t.bid_core, t.shortlist))


@query("flt_items", """
SELECT 'bolt' AS term, bid_id, number, partkey, suppkey, total FROM items WHERE (contains(lower(description), 'bolt') OR contains(lower(item_category), 'bolt') OR contains(code, 'bolt')) AND kind = 'M'
UNION ALL SELECT '7', bid_id, number, partkey, suppkey, total FROM items WHERE contains(lower(description), '7') OR number = 7 OR contains(lower(item_category), '7') OR contains(code, '7')""")
def _(t):
    keep = ["bid_id", "number", "partkey", "suppkey", "total"]
    a = t.items.filter(fl.items_matching("bolt", "material")).select(F.lit("bolt").alias("term"), *keep)
    return a.unionByName(t.items.filter(fl.items_matching("7")).select(F.lit("7").alias("term"), *keep))


@query("flt_documents_text", "SELECT doc_id FROM docs WHERE contains(lower(name), 'projeto') OR contains(lower(coalesce(source_type, '')), 'projeto')")
def _(t):
    return t.docs.filter(fl.documents_matching("Projeto")).select("doc_id")


@query("flt_shortlist_text", "SELECT bid_id FROM bids SEMI JOIN shortlist USING (bid_id) WHERE contains(lower(object || ' ' || agency || ' ' || city || ' ' || control_no), 'nation_1')")
def _(t):
    return bid_ids(t.bids.join(t.shortlist, "bid_id", "left_semi").filter(fl.shortlist_matching("Nation_1")))


@query("flt_options_folded", f"SELECT DISTINCT modality AS option FROM bids WHERE contains({w.fold('modality')}, 'concorrencia')")
def _(t):
    return t.bid_core.select(F.col("modality").alias("option")).distinct().filter(fl.options_matching("option", "CONCORRÊNCIA"))


CATALOG_CUT = "(b.bid_id % 3 = 0)"


def batch_and_catalog(t):
    """New rows are the whole bid table; a third of the keys is already known by rule."""
    return t.bid_core, t.bid_core.filter(F.col("bid_id") % 3 == 0)


@query("flt_admission", f"""
SELECT b.bid_id, {CATALOG_CUT} OR closes_at IS NULL OR closes_at > TIMESTAMP '{NOW}' AS admitted FROM bids b""")
def _(t):
    batch, catalog = batch_and_catalog(t)
    return fl.admission(batch, catalog, "abertas", t.now).select("bid_id", "admitted")


CFG = scoring.ScoreConfig()
CUT = max(CFG.min_recommended - CFG.weight_documents, 0)
DUE = (
    f"(state IS NULL OR state = 'pendente' OR (state = 'erro' AND {{at}} < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR) "
    f"OR (state = '{{busy}}' AND {{at}} < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE))"
)
DUE_BIDS = f"""
SELECT b.* FROM bids b LEFT JOIN doc_state s USING (bid_id) WHERE cnpj <> '' AND year IS NOT NULL AND seq IS NOT NULL AND {w.temporal()} IN ('aberta', 'nao_iniciada')
AND score >= {CUT} AND {DUE.format(at='s.changed_at', busy='coletando')}"""


def due_bids(t):
    return fl.due_documents(t.bid_core, t.doc_state, scoring.due_score(CFG), t.now)


@query("flt_due_documents", f"SELECT bid_id FROM ({DUE_BIDS})")
def _(t):
    return bid_ids(due_bids(t))


DUE_FILES = f"""
SELECT d.doc_id, d.doc_type FROM docs d LEFT JOIN (SELECT doc_id * 100 + 1 AS doc_id, state, updated_at FROM files) f USING (doc_id) WHERE d.active AND coalesce(d.url, '') <> '' AND {DUE.format(at='f.updated_at', busy='baixando')}"""


def due_files(t):
    files = t.files.select((F.col("doc_id") * 100 + 1).alias("doc_id"), "state", "updated_at")
    return fl.due_files(t.docs, files, t.now)


@query("flt_due_files", f"SELECT doc_id FROM ({DUE_FILES})")
def _(t):
    return due_files(t).select("doc_id")


ETEXT = "trim(object || ' ' || agency || ' ' || city)"
DUE_EMB = f"""
SELECT b.* FROM bids b LEFT JOIN (SELECT bid_id, model, CASE vectors.source_hash WHEN 'h0' THEN md5({ETEXT}) ELSE vectors.source_hash END AS h FROM vectors JOIN bids USING (bid_id)) v USING (bid_id)
WHERE length({ETEXT}) > 0 AND NOT (v.h IS NOT DISTINCT FROM md5({ETEXT}) AND v.model IS NOT DISTINCT FROM '{MODEL}')"""


def fresh_vectors(t):
    """Vectors whose hash is the current text for one rule class, stale otherwise."""
    text = t.bids.select("bid_id", F.md5(tx.embed_text(F.col("object"), F.col("agency"), F.col("city"))).alias("_h"))
    joined = t.vectors.join(text, "bid_id")
    return joined.withColumn("source_hash", F.when(F.col("source_hash") == "h0", F.col("_h")).otherwise(F.col("source_hash"))).drop("_h")


def due_embeddings(t):
    return fl.due_embeddings(t.bids, fresh_vectors(t), MODEL)


@query("flt_due_embeddings", f"SELECT bid_id FROM ({DUE_EMB})")
def _(t):
    return bid_ids(due_embeddings(t))


@query("flt_due_chunks", f"""
SELECT doc_id FROM files f WHERE state = 'extraido' AND text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = f.doc_id AND c.source_hash = md5(f.text) AND c.model = '{MODEL}')""")
def _(t):
    return fl.due_chunks(t.files, t.chunks, MODEL).select("doc_id")


@query("flt_text_dense", "SELECT doc_id, CASE WHEN pages > 0 AND chars >= pages * 200 THEN 'extraido' ELSE 'sem_texto' END AS state FROM files")
def _(t):
    return t.files.select("doc_id", classify.text_density_state(F.col("chars"), F.col("pages")).alias("state"))


@query("flt_distance_cut", f"""
SELECT v.vec_id, round(d, 6) AS distance FROM (SELECT v.vec_id, 1 - list_dot_product(v.embedding::DOUBLE[], q.embedding) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding, q.embedding)) AS d
FROM embeddings v JOIN themes q ON q.query_id = v.label) v WHERE d < 0.95""")
def _(t):
    """Strict distance cut on each vector's distance to its own label's mean."""
    joined = t.raw("embeddings").join(t.themes.withColumnRenamed("embedding", "center"), F.col("label") == F.col("query_id"))
    measured = joined.select("vec_id", cosine_distance(F.col("embedding"), F.col("center")).alias("distance"))
    return measured.filter(fl.distance_cut(0.95)).select("vec_id", F.round("distance", 6).alias("distance"))


def relevance_sql(name, label, typ, active, url):
    f = w.fold(f"coalesce({name}, '') || ' ' || coalesce({label}, '')")
    types = " ".join(f"WHEN {typ} = '{k}' THEN {v}" for k, v in classify.TYPE_RELEVANCE.items())
    return f"CASE WHEN NOT {active} OR coalesce({url}, '') = '' THEN -100 WHEN {w.any_of(f, classify.FORMALITY_TERMS)} THEN 1 WHEN {w.any_of(f, classify.KEY_DOCUMENT_TERMS)} THEN 100 {types} ELSE 10 END"


RELEVANCE = relevance_sql("name", "source_type", "doc_type", "active", "url")
ESSENTIAL = 2


@query("flt_essential_docs", f"""
SELECT bid_id, doc_id, relevance, place FROM (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY relevance DESC, doc_id)::INT AS place
FROM (SELECT *, {RELEVANCE} AS relevance FROM docs WHERE active AND coalesce(url, '') <> '') WHERE relevance > 0) WHERE place <= {ESSENTIAL}""")
def _(t):
    return fl.essential_documents(t.docs, ESSENTIAL).select("bid_id", "doc_id", "relevance", "place")


@query("filter_count", """
SELECT n, count(*) AS requests FROM (SELECT (coalesce(uf, '') <> '' AND coalesce(uf, '') <> 'ASIA')::INT + (notes <> '')::INT + (value IS NOT NULL)::INT + priority::INT AS n FROM bids) GROUP BY n""")
def _(t):
    n = fl.filter_count_column({"uf": "string", "notes": "string", "value": "number", "priority": "boolean"}, "ASIA")
    return t.bids.select(n.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("requests"))


@query("filter_dispatch", f"""
SELECT bid_id FROM bids WHERE uf = 'ASIA' AND value >= 50000 AND value <= 450000 AND {sql_day('published_at', '>=', '1997-01-01')} AND {sql_day('closes_at', '<', '2000-12-31', 1)} AND priority AND score >= 30""")
def _(t):
    wanted = {
        "uf": "ASIA", "city": "", "value_min": 50000, "value_max": 450000, "published_from": "1997-01-01", "deadline_to": "2000-12-31",
        "priority": "sim", "recommended": True, "unreviewed": False, "status": None,
    }
    return bid_ids(t.bids.filter(fl.conjunction(wanted, fl.Context(now=t.now, min_score=30))))


@query("flt_include_unknown", "SELECT bid_id FROM bids WHERE value >= 400000 OR value IS NULL")
def _(t):
    return bid_ids(t.bid_core.filter(fl.include_unknown(fl.value_min(400000), "value")))


@query("flt_or_branches", "SELECT bid_id FROM bids WHERE uf = 'ASIA' OR agency = 'Customer#000000042' OR value >= 490000")
def _(t):
    return bid_ids(fl.or_branches(t.bids, [fl.equals("uf", "ASIA"), fl.equals("agency", "Customer#000000042"), fl.value_min(490000)], "bid_id"))


@query("flt_item_match_state", """
SELECT bid_id, CASE WHEN bid_id IN (SELECT bid_id FROM items WHERE contains(lower(description), 'ring')) THEN 'match'
  WHEN bid_id IN (SELECT bid_id FROM doc_state WHERE state = 'completo') THEN 'no_match' ELSE 'pending' END AS match_state FROM bids""")
def _(t):
    return fl.item_match_state(t.bid_core.select("bid_id"), t.items, t.doc_state, "Ring")



"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidspan.functions import scoring
from bidspan.operators import filters as fl
from bidspan.operators import joins, sets, windows
from bidspan.plans import vectors as vx
from bidspan.registry import twin as w
from bidspan.registry.core import query
from bidspan.registry.s2_filters import CUT, batch_and_catalog, bid_ids
from bidspan.registry.tables import MODEL, NOW


@query("join_semi_doc_type", "SELECT bid_id, control_no FROM bids WHERE bid_id IN (SELECT bid_id FROM docs WHERE active AND doc_type = 'orcamento')")
def _(t):
    return fl.has_document(t.bid_core, t.docs, ["orcamento"]).select("bid_id", "control_no")


@query("join_semi_known", "SELECT bid_id FROM bids WHERE bid_id % 3 = 0")
def _(t):
    batch, catalog = batch_and_catalog(t)
    return bid_ids(joins.semi_known(batch, catalog))


@query("join_in_set", f"SELECT bid_id, state FROM doc_state WHERE bid_id IN (SELECT bid_id FROM bids WHERE score >= {CUT})")
def _(t):
    return joins.in_set(t.doc_state, t.bid_core.filter(F.col("score") >= scoring.due_score(scoring.ScoreConfig())), "bid_id").select("bid_id", "state")


@query("join_anti_hash", f"""
SELECT doc_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = f.doc_id AND c.source_hash = md5(f.text) AND c.model = '{MODEL}')""")
def _(t):
    return joins.anti_hash(t.files.withColumn("text_hash", F.md5("text")), t.chunks, MODEL).select("doc_id")


def latest_response(t):
    """Documents of a newer response: by rule, two bids in three answered and inactive ones are gone."""
    return t.docs.filter((F.col("bid_id") % 3 != 0) & F.col("active"))


RESPONSE = "SELECT * FROM docs WHERE bid_id % 3 <> 0 AND active"


@query("join_anti_removed", f"""
SELECT bid_id, seq FROM docs WHERE bid_id IN (SELECT bid_id FROM ({RESPONSE})) AND NOT active""")
def _(t):
    return joins.anti_removed(t.docs, latest_response(t)).select("bid_id", "seq")


@query("join_anti_conflict", "SELECT DISTINCT o_custkey AS bid_id FROM orders WHERE o_custkey NOT IN (SELECT bid_id FROM shortlist)")
def _(t):
    new = t.raw("orders").select(F.col("o_custkey").alias("bid_id"))
    return joins.anti_conflict(new, t.shortlist, ["bid_id"])


@query("join_left_state", "SELECT bid_id, coalesce(state, 'pendente') AS state FROM bids LEFT JOIN doc_state USING (bid_id)")
def _(t):
    return joins.left_state(t.bid_core, t.doc_state).select("bid_id", "state")


@query("join_left_embedding", "SELECT bid_id, v.model AS vector_model, len(embedding)::INT AS dims FROM bids LEFT JOIN vectors v USING (bid_id)")
def _(t):
    return joins.left_embedding(t.bid_core, t.vectors).select("bid_id", "vector_model", F.size("embedding").alias("dims"))


@query("join_inner_return", "SELECT doc_id, md5(text) AS hash, length(text)::INT AS chars FROM files WHERE state = 'extraido' ORDER BY updated_at, doc_id LIMIT 25")
def _(t):
    ids = t.files.filter("state = 'extraido'").select("doc_id", "updated_at").orderBy("updated_at", "doc_id").limit(25)
    return joins.late_columns(ids, t.files, "doc_id").select("doc_id", F.md5("text").alias("hash"), F.length("text").alias("chars"))


@query("join_nested_children", """
SELECT b.bid_id, 0 AS part, count(d.seq)::INT AS children, coalesce(string_agg(d.seq || ':' || d.doc_type || ':' || coalesce(f.state, '-'), '|' ORDER BY d.seq), '') AS docs
FROM bids b LEFT JOIN docs d USING (bid_id) LEFT JOIN files f ON f.bid_id = d.bid_id AND f.seq = d.seq GROUP BY b.bid_id""")
def _(t):
    nested = joins.nested_children(t.bid_core.select("bid_id"), t.docs, t.files)
    line = F.transform("docs", lambda d: F.concat_ws(":", d["seq"].cast("string"), d["doc_type"], F.coalesce(d["file_state"], F.lit("-"))))
    return nested.select("bid_id", "part", F.size("docs").alias("children"), F.array_join(line, "|").alias("docs"))


def rank_lists(t):
    """Three rankings of bids: by score among the open, by value, by vector label."""
    lex = windows.global_rank(t.bid_core.filter(F.col("score") >= 60).select("bid_id", "score"), ["score", "bid_id"], [False, True])
    obj = windows.global_rank(t.vectors.select("bid_id", "label"), ["label", "bid_id"], [True, True])
    chunk = windows.global_rank(t.chunks.groupBy("bid_id").agg(F.min("label").alias("label")), ["label", "bid_id"], [False, True])
    return lex, obj, chunk


RANKS = """
lex AS (SELECT bid_id, row_number() OVER (ORDER BY score DESC, bid_id) AS rank FROM bids WHERE score >= 60),
obj AS (SELECT bid_id, row_number() OVER (ORDER BY label, bid_id) AS rank FROM vectors),
chk AS (SELECT bid_id, row_number() OVER (ORDER BY min(label) DESC, bid_id) AS rank FROM chunks GROUP BY bid_id)"""


@query("join_full_outer_fusion", f"""
WITH {RANKS} SELECT coalesce(lex.bid_id, obj.bid_id, chk.bid_id) AS bid_id, lex.rank AS lex_rank, obj.rank AS obj_rank, chk.rank AS chunk_rank
FROM lex FULL JOIN obj ON obj.bid_id = lex.bid_id FULL JOIN chk ON chk.bid_id = coalesce(lex.bid_id, obj.bid_id)""")
def _(t):
    return joins.rank_fusion_join(*rank_lists(t))


@query("join_city_lookup", "SELECT bid_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM bids LEFT JOIN cities USING (city_code)")
def _(t):
    return joins.city_lookup(t.bids, t.cities).select("bid_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


RADIUS_KM = 60.0


def points(df, key, name):
    k = F.col(key)
    return df.select(k.alias(name), ((k * 37) % 1789 / 20.0 - 45.0).alias("lat"), ((k * 91) % 3571 / 20.0 - 90.0).alias("lon"))


def sql_points(table, key, name):
    return f"(SELECT {key} AS {name}, ({key} * 37) % 1789 / 20.0::DOUBLE - 45.0 AS lat, ({key} * 91) % 3571 / 20.0::DOUBLE - 90.0 AS lon FROM {table})"


D = w.haversine("a.lat", "a.lon", "b.lat", "b.lon")


@query("join_radius_theta", f"""
SELECT left_id, right_id, round({D}, 6) AS km FROM {sql_points('customer', 'c_custkey', 'left_id')} a, {sql_points('supplier', 's_suppkey', 'right_id')} b
WHERE abs(a.lat - b.lat) < 1 AND {D} <= {RADIUS_KM}""")
def _(t):
    a, b = points(t.raw("customer"), "c_custkey", "left_id"), points(t.raw("supplier"), "s_suppkey", "right_id")
    return joins.radius_pairs(a, b, RADIUS_KM, salts=4).withColumn("km", F.round("km", 6))


@query("join_config_cross", "SELECT bid_id, 30 AS cut, n AS regions FROM bids, (SELECT count(*) AS n FROM region) WHERE score >= 30")
def _(t):
    config = t.raw("region").agg(F.count(F.lit(1)).alias("regions")).withColumn("cut", F.lit(30))
    return joins.with_config(t.bid_core, config, ["cut", "regions"]).filter(F.col("score") >= F.col("cut")).select("bid_id", "cut", "regions")


COS = "(1 - list_dot_product(v.embedding::DOUBLE[], q.embedding) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding, q.embedding)))"


@query("join_query_cross", f"SELECT q.query_id, v.bid_id, round({COS}, 6) AS distance FROM themes q, vectors v WHERE {COS} < 0.9")
def _(t):
    hits = vx.under_limit(t.vectors, t.themes, 0.9, "bid_id")
    return hits.withColumn("distance", F.round("distance", 6))


@query("join_barrier_min", """
SELECT segment_id, job_id, priority::INT AS priority FROM segments s WHERE status IN ('pendente', 'executando')
AND priority = (SELECT min(priority) FROM segments m WHERE m.job_id = s.job_id AND m.status IN ('pendente', 'executando'))""")
def _(t):
    return joins.barrier_min(t.segments).select("segment_id", "job_id", "priority")


@query("join_scalar_count", "SELECT bid_id, (SELECT count(*) FROM docs d WHERE d.bid_id = b.bid_id) AS docs_total FROM bids b")
def _(t):
    return joins.scalar_count(t.bid_core, t.docs).select("bid_id", "docs_total")


@query("join_scalar_max_or", """
SELECT p.uf, p.modality_id, strftime(max(updated_at_source), '%Y-%m-%d %H:%M:%S') AS last_update
FROM (SELECT DISTINCT coalesce(uf, '') AS uf, modality_id FROM bids) p LEFT JOIN bids b ON b.modality_id = p.modality_id AND (p.uf = '' OR b.uf = p.uf) GROUP BY ALL""")
def _(t):
    parts = t.bids.select(F.coalesce("uf", F.lit("")).alias("uf"), "modality_id").distinct()
    out = joins.scalar_max_or(parts, t.bids)
    return out.select("uf", "modality_id", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"))


@query("join_update_from", f"""
SELECT bid_id, strftime(CASE WHEN bid_id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE seen_at END, '%Y-%m-%d %H:%M:%S') AS seen_at FROM bids""")
def _(t):
    seen = t.bid_core.filter(F.col("bid_id") % 3 == 0).select("control_no", t.now.alias("seen_at"))
    return joins.update_seen(t.bid_core, seen).select("bid_id", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


@query("join_upsert_guarded", f"""
SELECT bid_id, CASE WHEN wins THEN 'x' || source_hash ELSE source_hash END AS source_hash, CASE WHEN wins THEN 'atualizado' WHEN bid_id % 3 = 0 THEN 'ignorado' END AS action, team_status FROM (
  SELECT *, bid_id % 3 = 0 AND (updated_at_source IS NULL OR bid_id % 2 = 0) AS wins FROM bids)""")
def _(t):
    """A third of the catalogue arrives again, half of it older: only newer versions may change rows."""
    from bidspan.operators.merge import merge_catalog
    from bidspan.registry.s7_merge import stored

    cols = ["control_no", "bid_id", "closes_at", "updated_at_source", "source_hash", "seen_at"]
    team = ["team_status", "priority", "notes", "accessed_at", "created_at", "changed_at", "synced_at"]
    shift = F.when(F.col("bid_id") % 2 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))
    batch = t.bids.filter(F.col("bid_id") % 3 == 0).select(*cols).withColumns(
        {"source_hash": F.concat(F.lit("x"), "source_hash"), "updated_at_source": F.col("updated_at_source") + shift, "position": F.col("bid_id")}
    )
    table = stored(t, t.bids.select(*cols, *team), "control_no")
    table.merge(batch, 1, lambda held, b: merge_catalog(held, b, "todas", t.now))
    return table.read().select("bid_id", "source_hash", "action", "team_status")


def parts_of(x):
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\[[^\\]]*\\]|\\(\\.\\.\\.\\)|\\.{{3}}|…'), lambda p: {w.compare_form('p')}), lambda p: p <> '')"


@query("join_citation_source", f"""
SELECT item_id AS quote_id, source_id FROM (SELECT item_id, {parts_of('text')} AS parts FROM benchmark) q, (SELECT source_id, {w.compare_form('text')} AS form FROM sources) s
WHERE len(parts) > 0 AND length(array_to_string(parts, ' ')) >= 12 AND len(list_filter(parts, lambda p: NOT contains(form, p))) = 0""")
def _(t):
    quotes = t.raw("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return joins.quote_matches(quotes, t.sources)


# ------------------------------------------------------------------------- sets


@query("set_union_branches", "SELECT bid_id, model FROM vectors WHERE label < 5 UNION ALL SELECT bid_id, model FROM vectors WHERE label >= 5")
def _(t):
    v = t.vectors.select("bid_id", "model", "label")
    return sets.union_branches(v.filter("label < 5"), v.filter("label >= 5")).drop("label")


def fetches(t):
    """Three overlapping fetches of the catalogue with different versions."""
    b = t.bid_core.select("control_no", "bid_id", "status_id", "updated_at_source")
    pos = b.withColumn("position", F.col("bid_id"))
    newer = pos.filter(F.col("bid_id") % 2 == 0).withColumn("updated_at_source", F.col("updated_at_source") + F.expr("interval 1 day")).withColumn("status_id", F.lit(9))
    older = pos.filter(F.col("bid_id") % 5 == 0).withColumn("updated_at_source", F.col("updated_at_source") - F.expr("interval 1 day")).withColumn("status_id", F.lit(7))
    return [pos, newer, older]


@query("set_union_dedup_sources", """
SELECT control_no, bid_id, CASE WHEN bid_id % 2 = 0 AND updated_at_source IS NOT NULL THEN 9 WHEN updated_at_source IS NULL AND bid_id % 5 = 0 THEN 7
  WHEN updated_at_source IS NULL AND bid_id % 2 = 0 THEN 9 ELSE status_id END AS status_id FROM bids""")
def _(t):
    return sets.union_dedup_sources(fetches(t)).select("control_no", "bid_id", "status_id")


@query("set_distinct_tokens", "SELECT DISTINCT upper(trim(p_name)) AS code FROM part WHERE trim(p_name) <> ''")
def _(t):
    return sets.distinct_values(t.raw("part").select(F.concat(F.lit(" "), F.col("p_name")).alias("p_name")), "p_name")


def two_runs(t):
    """Two rankings per label: by id, and by distance to the label's mean vector."""
    by_id = windows.topn_per_group(t.vectors.select(F.col("label").cast("long").alias("query_id"), F.col("bid_id").alias("item_id")), ["query_id"], [F.col("item_id")], 20)
    near = vx.knn_exact(t.vectors.withColumnRenamed("bid_id", "item_id"), t.themes, 20)
    return by_id, near.select("query_id", "item_id", "rank")


RUNS = f"""
run_a AS (SELECT label::BIGINT AS query_id, bid_id AS item_id, row_number() OVER (PARTITION BY label ORDER BY bid_id) AS rank FROM vectors QUALIFY rank <= 20),
run_d AS (SELECT q.query_id, v.bid_id AS item_id, {COS} AS distance FROM themes q, vectors v),
run_b AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM run_d QUALIFY rank <= 20)"""


@query("set_new_in_hybrid", f"WITH {RUNS} SELECT query_id, item_id FROM run_b EXCEPT SELECT query_id, item_id FROM run_a")
def _(t):
    a, b = two_runs(t)
    return sets.new_in(b, a, ["query_id", "item_id"])


@query("set_recall_overlap", f"""
WITH {RUNS} SELECT b.query_id, round(count(a.item_id) / count(*), 6) AS recall FROM run_b b LEFT JOIN run_a a ON a.query_id = b.query_id AND a.item_id = b.item_id AND a.rank <= 15 WHERE b.rank <= 15 GROUP BY ALL""")
def _(t):
    a, b = two_runs(t)
    return sets.recall_overlap(a, b, 15).withColumn("recall", F.round("recall", 6))


KNOWN = """
WITH c AS (SELECT answer_id, bid_id, unnest(source_ids) AS source_id, generate_subscripts(source_ids, 1) AS pos FROM answers),
k AS (SELECT c.*, s.source_id IS NOT NULL AS known FROM c LEFT JOIN (SELECT DISTINCT bid_id, source_id FROM sources) s USING (bid_id, source_id))
SELECT answer_id, coalesce(string_agg(source_id, ',' ORDER BY pos) FILTER (known), '') AS source_ids, count(*) FILTER (NOT known) AS dropped FROM k GROUP BY answer_id"""


@query("set_known_sources", KNOWN)
def _(t):
    return sets.known_sources(t.answers, t.sources).select("answer_id", F.array_join("source_ids", ",").alias("source_ids"), "dropped")


@query("set_shortlist_union", "SELECT bid_id FROM shortlist UNION SELECT user_id FROM events")
def _(t):
    return sets.shortlist_union(t.shortlist, t.raw("events").select(F.col("user_id").alias("bid_id")))

"""Catalogue filters. Each is one ``Column``; ``conjunction`` ANDs a filter map.

An empty value means "no filter" and adds nothing to the plan, so Catalyst only
sees predicates that matter and can push them to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import classify, dates, geo
from bidspan.functions import text as tx
from bidspan.session import LOCAL_ZONE

ESSENTIAL = 8  # fixed value: documents of a bid that are read first


@dataclass(frozen=True)
class Context:
    """What a filter may need besides its value."""

    now: Column
    min_score: int = 60
    zone: str = LOCAL_ZONE


def is_empty(value: Any) -> bool:
    return value is None or value is False or (isinstance(value, str) and value.strip() == "")


# ---------------------------------------------------------------- predicates


def substring(term: str) -> Column:
    return tx.contains_ci(tx.search_text(F.col("agency"), F.col("object"), F.col("city")), term.strip())


def equals(column: str, value: str) -> Column:
    return F.col(column) == F.lit(value)


def priority_tri(value: str) -> Column:
    if value == "sim":
        return F.col("priority")
    if value == "nao":
        return ~F.col("priority")
    return F.lit(False)


def value_min(bound: Any) -> Column:
    return F.col("value") >= F.lit(Decimal(str(bound)))


def value_max(bound: Any) -> Column:
    return F.col("value") <= F.lit(Decimal(str(bound)))


def day_from(column: str, day: str, zone: str) -> Column:
    return F.col(column) >= dates.day_start(F.lit(day), 0, zone)


def day_to(column: str, day: str, zone: str) -> Column:
    return F.col(column) < dates.day_start(F.lit(day), 1, zone)


def unreviewed() -> Column:
    return F.col("team_status") == "nova"


def recommended(min_score: int) -> Column:
    return F.col("score") >= min_score


def open_now(now: Column) -> Column:
    return dates.is_open(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)


_ROW_FILTERS = {
    "uf": lambda v, c: equals("uf", v),
    "city": lambda v, c: equals("city", v),
    "agency": lambda v, c: equals("agency", v),
    "modality": lambda v, c: equals("modality", v),
    "category": lambda v, c: equals("category", v),
    "status": lambda v, c: equals("team_status", v),
    "priority": lambda v, c: priority_tri(v),
    "value_min": lambda v, c: value_min(v),
    "value_max": lambda v, c: value_max(v),
    "published_from": lambda v, c: day_from("published_at", v, c.zone),
    "published_to": lambda v, c: day_to("published_at", v, c.zone),
    "created_from": lambda v, c: day_from("created_at", v, c.zone),
    "deadline_from": lambda v, c: day_from("closes_at", v, c.zone),
    "deadline_to": lambda v, c: day_to("closes_at", v, c.zone),
    "unreviewed": lambda v, c: unreviewed(),
    "recommended": lambda v, c: recommended(c.min_score),
    "open_now": lambda v, c: open_now(c.now),
}
_DOCUMENT_FILTERS = {"has_notice": "edital", "has_project": "projeto", "has_budget": "orcamento"}
_OTHER_FILTERS = {"term", "origin_code", "radius_km"}
FILTER_NAMES = [*_ROW_FILTERS, *_DOCUMENT_FILTERS, *sorted(_OTHER_FILTERS)]


def check_names(filters: Mapping[str, Any]) -> None:
    unknown = sorted(set(filters) - set(FILTER_NAMES))
    if unknown:
        raise ValueError(f"unknown filter: {', '.join(unknown)}")


def conjunction(filters: Mapping[str, Any], context: Context) -> Column | None:
    """All row predicates of a filter map ANDed; None when there is nothing to test."""
    check_names(filters)
    found = [
        build(filters[name], context)
        for name, build in _ROW_FILTERS.items()
        if name in filters and not is_empty(filters[name])
    ]
    return reduce(lambda a, b: a & b, found) if found else None


def filter_count(filters: Mapping[str, Any], base_uf: str) -> int:
    """Active filters of one request; the team's own state does not count."""
    return sum(1 for k, v in filters.items() if not is_empty(v) and not (k == "uf" and v == base_uf))


def filter_count_column(columns: Mapping[str, str], base_uf: str) -> Column:
    """The same count over a table of logged requests, one column per filter."""
    total = F.lit(0)
    for name, kind in columns.items():
        c = F.col(name)
        active = F.coalesce(c, F.lit(False)) if kind == "boolean" else F.coalesce(c.cast("string"), F.lit("")) != ""
        if name == "uf":
            active = active & (F.coalesce(c, F.lit("")) != base_uf)
        total = total + active.cast("int")
    return total


def include_unknown(predicate: Column, column: str) -> Column:
    """Keep rows whose bounded column is NULL as well."""
    return F.coalesce(predicate, F.lit(False)) | F.col(column).isNull()


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def or_branches(df: DataFrame, predicates: Sequence[Column], key: str) -> DataFrame:
    """OR as a union of separate fetches, one row per key.

    Branch i drops rows an earlier branch already returns, so the union needs
    no shuffle. ``key`` must be unique in ``df``.
    """
    branches, earlier = [], None
    for predicate in predicates:
        sure = F.coalesce(predicate, F.lit(False))
        branches.append(df.filter(sure if earlier is None else sure & ~earlier))
        earlier = sure if earlier is None else earlier | sure
    return reduce(DataFrame.unionByName, branches)


# ------------------------------------------------------------------ on tables


def has_document(bids: DataFrame, docs: DataFrame, doc_types: Sequence[str], active_only: bool = True) -> DataFrame:
    """Bids holding every listed document type.

    One semi join per request however many types are asked for: documents are
    reduced map-side to one flag row per bid before the join.
    """
    kept = docs.filter(F.col("doc_type").isin(list(doc_types)))
    if active_only:
        kept = kept.filter("active")
    if len(doc_types) == 1:
        return bids.join(kept.select("bid_id"), "bid_id", "left_semi")
    flags = [F.bool_or(F.col("doc_type") == t).alias(f"_{t}") for t in doc_types]
    owners = kept.groupBy("bid_id").agg(*flags).filter(reduce(lambda a, b: a & b, [F.col(f"_{t}") for t in doc_types]))
    return bids.join(owners.select("bid_id"), "bid_id", "left_semi")


def resolve_origin(cities: DataFrame, origin_code: str | None, radius_km: float | None):
    """(lat, lon, radius) of the request; a radius needs a known origin."""
    code = (origin_code or "").strip() or None
    radius = float(radius_km) if radius_km not in (None, "") else None
    radius = radius if radius is not None and radius > 0 else None
    if code is None:
        if radius is not None:
            raise ValueError("radius_km needs origin_code")
        return None, None, None
    row = cities.filter(F.col("city_code") == code).select("lat", "lon").limit(1).first()
    if row is None:
        raise ValueError(f"unknown origin_code: {code}")
    return row["lat"], row["lon"], radius


def with_distance(bids: DataFrame, cities: DataFrame, lat: float | None, lon: float | None) -> DataFrame:
    """Attach ``km``: NULL when the bid's city or the origin is unknown.

    The distance is computed once per city; the city table is a national list
    and Spark broadcasts it when its measured size allows.
    """
    if lat is None or lon is None:
        return bids.withColumn("km", F.lit(None).cast("double"))
    from_origin = cities.select(
        "city_code", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")).alias("km")
    )
    return bids.join(from_origin, "city_code", "left")


def within_radius(bids: DataFrame, cities: DataFrame, origin_code: str | None, radius_km: float | None) -> DataFrame:
    lat, lon, radius = resolve_origin(cities, origin_code, radius_km)
    if radius is not None:
        # cities outside are dropped before the join: the join itself is the filter
        near = cities.select(
            "city_code", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")).alias("km")
        ).filter(F.col("km") <= radius)
        return bids.join(near, "city_code", "inner")
    return with_distance(bids, cities, lat, lon)


def not_shortlisted(bids: DataFrame, shortlist: DataFrame) -> DataFrame:
    return bids.join(shortlist.select("bid_id"), "bid_id", "left_anti")


def document_flags_wanted(filters: Mapping[str, Any]) -> list[str]:
    return [t for name, t in _DOCUMENT_FILTERS.items() if name in filters and not is_empty(filters[name])]


def essential_documents(docs: DataFrame, limit: int = ESSENTIAL) -> DataFrame:
    """The documents of each bid that matter most, with ``relevance`` and ``place``; the limit is the feature.

    Inactive documents and those without an address are out, ties go to the
    smaller id. Ranks are cut before the shuffle, so a bid with very many
    documents sends ``limit`` rows a task.
    """
    from bidspan.operators.windows import topn_per_group

    relevance = classify.document_relevance(F.col("name"), F.col("source_type"), F.col("doc_type"), F.col("active"), F.col("url"))
    scored = docs.withColumn("relevance", relevance).filter(F.col("relevance") > 0)
    return topn_per_group(scored, ["bid_id"], [F.desc("relevance"), F.col("doc_id")], limit).withColumnRenamed("rank", "place")


# ------------------------------------------------------------- smaller screens


def distance_cut(limit: float) -> Column:
    """Strictly nearer than the limit."""
    return F.col("distance") < limit


def items_matching(term: str = "", kind: str = "todos") -> Column:
    """Line items by text, exact number or code, and by material/service."""
    cond = F.lit(True)
    if term:
        empty, exact = F.lit(""), term.strip()
        cond = (
            tx.contains_ci(F.col("description"), term)
            | (F.col("number").cast("string") == exact)
            | tx.contains_ci(F.coalesce(F.col("item_category"), empty), term)
            | F.contains(F.coalesce(F.col("code"), empty), F.lit(exact))
        )
    if kind in ("material", "servico"):
        cond = cond & F.coalesce(F.col("kind") == {"material": "M", "servico": "S"}[kind], F.lit(False))
    return cond


def documents_matching(term: str) -> Column:
    empty = F.lit("")
    return tx.contains_ci(F.coalesce(F.col("name"), empty), term) | tx.contains_ci(
        F.coalesce(F.col("source_type"), empty), term
    )


def shortlist_matching(term: str) -> Column:
    empty = F.lit("")
    parts = [F.coalesce(F.col(c), empty) for c in ("object", "agency", "city", "control_no")]
    return tx.contains_ci(F.concat_ws(" ", *parts), term)


def options_matching(column: str, query: str) -> Column:
    return F.contains(tx.fold(F.col(column)), F.lit(classify.plain_fold(query)))


def item_match_state(bids: DataFrame, items: DataFrame, state: DataFrame, term: str) -> DataFrame:
    """match / no_match / pending, the last when a bid's items were not collected."""
    hits = items.filter(tx.contains_ci(F.col("description"), term)).select("bid_id").distinct()
    hits = hits.withColumn("_hit", F.lit(True))
    known = state.filter(F.col("state") == "completo").select("bid_id").distinct().withColumn("_known", F.lit(True))
    label = F.when(F.col("_hit"), "match").when(F.col("_known"), "no_match").otherwise("pending")
    return bids.join(hits, "bid_id", "left").join(known, "bid_id", "left").withColumn("match_state", label).drop("_hit", "_known")


# --------------------------------------------------------- due work (no leases)


def admission(batch: DataFrame, catalog: DataFrame, policy: str, now: Column) -> DataFrame:
    """Attach ``admitted``: unknown rows enter only with an open or missing deadline."""
    if policy not in ("todas", "abertas"):
        raise ValueError(f"unknown admission policy: {policy}")
    if policy == "todas":
        return batch.withColumn("admitted", F.lit(True))
    known = catalog.select("control_no", F.lit(True).alias("_known"))
    enters = F.col("_known").isNotNull() | F.col("closes_at").isNull() | (F.col("closes_at") > now)
    return batch.join(known, "control_no", "left").withColumn("admitted", enters).drop("_known")


def due_state(
    state: Column, changed_at: Column, now: Column, lease: str = "15 minutes", retry: str = "6 hours", busy: str = "coletando"
) -> Column:
    """A reservation or an error that is old enough returns to the queue."""
    return (
        state.isNull()
        | (state == "pendente")
        | ((state == "erro") & (changed_at < now - F.expr(f"interval {retry}")))
        | ((state == busy) & (changed_at < now - F.expr(f"interval {lease}")))
    )


def usable_identity() -> Column:
    return (F.col("cnpj") != "") & F.col("year").isNotNull() & F.col("seq").isNotNull()


def worth_collecting(now: Column, cut: Column) -> Column:
    live = dates.temporal_state(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)
    return usable_identity() & live.isin("aberta", "nao_iniciada") & (F.col("score") >= cut)


def due_documents(bids: DataFrame, state: DataFrame, cut: Column, now: Column) -> DataFrame:
    slim = state.select("bid_id", F.col("state").alias("_state"), F.col("changed_at").alias("_at"))
    kept = bids.filter(worth_collecting(now, cut)).join(slim, "bid_id", "left")
    return kept.filter(due_state(F.col("_state"), F.col("_at"), now)).drop("_state", "_at")


def due_files(docs: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    slim = files.select("doc_id", F.col("state").alias("_state"), F.col("updated_at").alias("_at"))
    wanted = docs.filter(F.col("active") & (F.coalesce(F.col("url"), F.lit("")) != ""))
    due = due_state(F.col("_state"), F.col("_at"), now, busy="baixando")
    return wanted.join(slim, "doc_id", "left").filter(due).drop("_state", "_at")


def due_embeddings(bids: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Bids whose vector is missing, of another text or of another model."""
    text = tx.embed_text(F.col("object"), F.col("agency"), F.col("city"))
    slim = vectors.select("bid_id", F.col("model").alias("_model"), F.col("source_hash").alias("_hash"))
    wanted = bids.withColumn("embed_text", text).withColumn("embed_hash", F.md5(text)).filter(F.length("embed_text") > 0)
    fresh = F.col("_hash").eqNullSafe(F.col("embed_hash")) & F.col("_model").eqNullSafe(F.lit(model))
    return wanted.join(slim, "bid_id", "left").filter(~fresh).drop("_model", "_hash")


def due_chunks(files: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """Extracted texts without a chunk of the same hash and model."""
    ready = files.filter((F.col("state") == "extraido") & F.col("text").isNotNull()).withColumn("text_hash", F.md5("text"))
    done = chunks.filter(F.col("model") == model).select("doc_id", F.col("source_hash").alias("text_hash"))
    return ready.join(done, ["doc_id", "text_hash"], "left_anti")

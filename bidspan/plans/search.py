"""Catalogue search: a filter map in, one page of bids out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import dates, geo
from bidspan.operators import filters, ordering, projections, windows
from bidspan.plans import index, vectors
from bidspan.session import settle


@dataclass(frozen=True)
class HybridConfig:
    active: bool = True
    weight_lexical: float = 1.0
    weight_vector: float = 1.0
    distance_limit: float = 0.40
    model: str = "bge-m3"
    min_chars: int = 4


def object_text() -> Column:
    return F.concat_ws(" ", F.coalesce("object", F.lit("")), F.coalesce("agency", F.lit("")))


def term_predicate(term: str) -> Column:
    """Full-text match on object and agency, or the plain substring."""
    return filters.substring(term) | index.fulltext(object_text(), term)


def eligible(
    bids: DataFrame, docs: DataFrame, cities: DataFrame, wanted: Mapping[str, Any], context: filters.Context, active_only: bool = True, shortlist: DataFrame | None = None
) -> DataFrame:
    """Every filter of the map except the term, cheapest first; adds ``km``. Bids on the ``shortlist`` are left out."""
    cond = filters.conjunction(wanted, context)
    out = bids if cond is None else bids.filter(cond)
    if shortlist is not None:
        out = filters.not_shortlisted(out, shortlist)
    types = filters.document_flags_wanted(wanted)
    if types:
        out = filters.has_document(out, docs, types, active_only)
    return filters.within_radius(out, cities, wanted.get("origin_code"), wanted.get("radius_km"))


def _computed(df: DataFrame, now: Column) -> DataFrame:
    args = (F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)
    return df.withColumns(
        {"open_now": dates.is_open(*args), "temporal_state": dates.temporal_state(*args), "distance_km": geo.rounded(F.col("km"))}
    )


def lexical_matches(bids, docs, cities, wanted, context, active_only=True, shortlist=None) -> DataFrame:
    term = (wanted.get("term") or "").strip()
    out = eligible(bids, docs, cities, wanted, context, active_only, shortlist)
    return out.filter(term_predicate(term)) if term else out


#: Pages up to this many rows are fetched as ids, which the scans of wide rows and documents then look for.
PAGE_ROWS = 1000


class _Page:
    """The rows of one page: as ids in the scans' filters, or as a table if the page is large."""

    def __init__(self, page: DataFrame, limit: int | None):
        if limit is not None and limit <= PAGE_ROWS:
            rows = page.collect()
            self.ids = [r["bid_id"] for r in rows]
            self.page = page.sparkSession.createDataFrame(rows, page.schema)
        else:
            self.ids, self.page = None, settle(page, "page")

    def own(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.page.select("bid_id"), "bid_id", "left_semi") if self.ids is None else rows.filter(F.col("bid_id").isin(self.ids))

    def wide(self, bids: DataFrame) -> DataFrame:
        return self.own(bids).join(self.page, "bid_id")

    def listing(self, rows: DataFrame, docs: DataFrame, doc_state: DataFrame | None, now: Column) -> DataFrame:
        """Computed columns and document totals; documents of other bids are not counted."""
        state = self.page.select("bid_id", F.lit(None).cast("string").alias("state")) if doc_state is None else self.own(doc_state)
        return projections.with_document_totals(_computed(rows, now), self.own(docs), state)


def search_lexical(
    bids: DataFrame,
    docs: DataFrame,
    cities: DataFrame,
    wanted: Mapping[str, Any],
    context: filters.Context,
    key: str = "deadline",
    direction: str = "asc",
    limit: int | None = 25,
    offset: int | None = 0,
    active_only: bool = True,
    shortlist: DataFrame | None = None,
    doc_state: DataFrame | None = None,
) -> DataFrame:
    """Page rows with computed state, distance, document totals and ``total`` under the same filter.

    The filters run once: what matched is settled as ids and sort columns, from
    which total and page are taken. Wide rows, documents and states are read for
    the page only, its ids being part of their scans' filters.
    """
    matched = lexical_matches(bids, docs, cities, wanted, context, active_only, shortlist)
    keys = ordering.sort_keys(key, direction)
    narrow = settle(matched.select("bid_id", "km", *(c for c in ordering.SORT_COLUMNS.values() if c in matched.columns)), "matched")
    page = _Page(ordering.page_with_total(narrow, keys, limit, offset).select("bid_id", "km", "total"), limit)
    return page.listing(page.wide(bids), docs, doc_state, context.now).withColumn("mode", F.lit("lexical")).orderBy(*keys)


def search_mode(config: HybridConfig, has_vector: bool, term: str | None) -> str:
    """Lexical when hybrid is off, without a vector, without a term, or for a very short one."""
    usable = config.active and has_vector and bool(term and term.strip()) and len(term.strip()) >= config.min_chars
    return "hibrido" if usable else "lexical"


def search_fallback(config: HybridConfig, provider_failed: bool, term: str | None) -> dict[str, Any]:
    """A failed vectoriser means a lexical answer that says so."""
    wanted = config.active and bool(term and term.strip()) and len(term.strip()) >= config.min_chars
    return {"mode": search_mode(config, not provider_failed, term), "degraded": wanted and provider_failed}


def search_mode_of(term: Column, config: HybridConfig, has_vector: bool = True) -> Column:
    """:func:`search_mode` of a column of terms."""
    usable = F.lit(config.active and has_vector) & (F.length(F.trim(F.coalesce(term, F.lit("")))) >= config.min_chars)
    return F.when(usable, "hibrido").otherwise("lexical")


def strategy(eligible_count: Column, exact_limit: int) -> Column:
    """Which scan a service that switches at ``exact_limit`` reports; the search here is exact at every size."""
    return F.when(eligible_count <= exact_limit, "exata").otherwise("aproximada")


def lexical_ranking(hits: DataFrame, postings: DataFrame, stats: DataFrame, term: str) -> DataFrame:
    """(bid_id, rank) of bids that match the term, by text score desc, id. A substring-only hit scores 0."""
    scored = index.rank_text(postings, stats, "bid_id", index.query_tokens(term)).select("bid_id", "score")
    hits = hits.select("bid_id").join(scored, "bid_id", "left")
    hits = hits.withColumn("score", F.coalesce(F.round("score", 9), F.lit(0.0)))
    return windows.global_rank(hits, ["score", "bid_id"], [False, True])


def search_hybrid(
    bids: DataFrame,
    docs: DataFrame,
    cities: DataFrame,
    object_vectors: DataFrame,
    chunks: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    wanted: Mapping[str, Any],
    query: DataFrame | None,
    context: filters.Context,
    config: HybridConfig = HybridConfig(),
    limit: int | None = 25,
    offset: int | None = 0,
    key: str | None = None,
    direction: str = "asc",
    active_only: bool = True,
    shortlist: DataFrame | None = None,
    doc_state: DataFrame | None = None,
) -> DataFrame:
    """Fused page of three complete rankings over one eligible set.

    ``query`` is one row (query_id, embedding) or None. Filters come first; every
    eligible bid within the distance limit is ranked, by its own vector and by its
    best chunk, so ``total`` and later pages are whole, and one more bid never
    changes the way. Rankings carry ids; wide rows and texts are read for the
    page only. ``key`` None orders by relevance, or by deadline if the search
    falls back to the lexical one.
    """
    term = (wanted.get("term") or "").strip()
    if search_mode(config, query is not None, term) == "lexical":
        return search_lexical(bids, docs, cities, wanted, context, key or "deadline", direction, limit, offset, active_only, shortlist, doc_state)

    pool = eligible(bids, docs, cities, wanted, context, active_only, shortlist)
    # one pass over the catalogue: ids, sort columns and whether the term occurs
    columns = [c for c in ordering.SORT_COLUMNS.values() if c in pool.columns]
    ids = settle(pool.select("bid_id", "km", *columns, term_predicate(term).alias("_hit")), "eligible")
    own = object_vectors.filter(F.col("model") == config.model).join(ids, "bid_id", "left_semi")
    parts = chunks.filter(F.col("model") == config.model).join(ids, "bid_id", "left_semi")
    objects = vectors.full_ranking(vectors.under_limit(own, query, config.distance_limit, "bid_id"), "bid_id")
    pieces = vectors.knn_chunks(parts, query, config.distance_limit)
    lexical = lexical_ranking(ids.filter("_hit"), postings, stats, term)
    w, v = config.weight_lexical, config.weight_vector
    fused = vectors.fuse_rrf([(lexical, w), (objects, v), (pieces, v)]).withColumn("rrf_score", F.round("rrf_score", 12))
    ranked = settle(fused.join(ids.drop("_hit"), "bid_id"), "fused")
    keys = ordering.relevance_keys() if key is None else ordering.sort_keys(key, direction)
    count = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = ordering.page_with_total(ranked, keys, limit, offset).withColumn("eligible", count)
    page = _Page(page.select("bid_id", "km", "rrf_score", "semantic", "chunk_id", "total", "eligible"), limit)
    rows = vectors.excerpts(page.wide(bids), page.own(chunks)).drop("chunk_id")
    return page.listing(rows, docs, doc_state, context.now).withColumns({"mode": F.lit("hibrido"), "strategy": F.lit("exata")}).orderBy(*keys)

"""Join shapes of the catalogue. Sides are broadcast only by Spark's own size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import geo, winnow
from bidspan.functions import text as tx
from bidspan.session import settle


def semi_known(batch: DataFrame, catalog: DataFrame, key: str = "control_no") -> DataFrame:
    return batch.join(catalog.select(key), key, "left_semi")


def in_set(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_semi")


def anti_hash(files: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    done = chunks.filter(F.col("model") == model).select("doc_id", F.col("source_hash").alias("text_hash"))
    return files.join(done, ["doc_id", "text_hash"], "left_anti")


def anti_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of refreshed bids that the latest response no longer lists."""
    refreshed = old.join(new.select("bid_id").distinct(), "bid_id", "left_semi")
    return refreshed.join(new.select("bid_id", "seq"), ["bid_id", "seq"], "left_anti")


def anti_conflict(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that may be inserted: one per key, key not stored yet."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def left_state(bids: DataFrame, state: DataFrame, default: str = "pendente") -> DataFrame:
    slim = state.select("bid_id", F.col("state").alias("_s"))
    return bids.join(slim, "bid_id", "left").withColumn("state", F.coalesce("_s", F.lit(default))).drop("_s")


def left_embedding(bids: DataFrame, vectors: DataFrame) -> DataFrame:
    slim = vectors.select("bid_id", "embedding", F.col("model").alias("vector_model"))
    return bids.join(slim, "bid_id", "left")


def late_columns(ids: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """Chosen ids back to their wide columns: the wide side is read once, after the cut."""
    return wide.join(ids.select(key), key, "inner")


CHILDREN_PER_ROW = 1000


def nested_children(bids: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Bids with their documents, each with 0..1 file state, nested in seq order.

    One row per bid and ``part`` (seq // 1000): a usual bid has the single part
    0, and a bid with very many documents is spread over rows and tasks instead
    of becoming one unbounded array.
    """
    slim = files.select("bid_id", "seq", F.col("state").alias("file_state"), "pages")
    child = F.struct("seq", "doc_type", "name", "file_state", "pages")
    part = F.floor(F.col("seq") / CHILDREN_PER_ROW).cast("int")
    nested = (
        docs.join(slim, ["bid_id", "seq"], "left")
        .groupBy("bid_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(child)).alias("docs"))
    )
    empty = F.array().cast(nested.schema["docs"].dataType)
    joined = bids.join(nested, "bid_id", "left")
    return joined.withColumn("docs", F.coalesce("docs", empty)).withColumn("part", F.coalesce("part", F.lit(0)))


def rank_fusion_join(lexical: DataFrame, objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """id with up to three ranks. Union + one aggregation replaces two full outer joins."""
    lists = [("lex_rank", lexical), ("obj_rank", objects), ("chunk_rank", chunks)]
    names = [n for n, _ in lists]
    united = None
    for name, df in lists:
        cols = [F.col("rank").alias(n) if n == name else F.lit(None).cast("int").alias(n) for n in names]
        part = df.select("bid_id", *cols)
        united = part if united is None else united.unionByName(part)
    return united.groupBy("bid_id").agg(*[F.max(n).alias(n) for n in names])


def city_lookup(bids: DataFrame, cities: DataFrame) -> DataFrame:
    return bids.join(cities.select("city_code", "lat", "lon"), "city_code", "left")


def radius_pairs(left: DataFrame, right: DataFrame, km: float, salts: int = 1) -> DataFrame:
    """Pairs (left_id, right_id) within ``km``, exact, as a hash join on sphere cells.

    ``left(left_id, lat, lon)``, ``right(right_id, lat, lon)``. The right side is
    copied to its 27 adjacent cells. ``salts`` > 1 splits crowded cells: left
    rows spread over the salts, right rows are repeated per salt.
    """
    a = left.select(
        "left_id", F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"), geo.sphere_cell(F.col("lat"), F.col("lon"), km).alias("_cell")
    )
    b = right.select("right_id", F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"))
    near = geo.adjacent_cells(geo.sphere_cell(F.col("_lat2"), F.col("_lon2"), km))
    b = b.withColumn("_cell", F.explode(near))
    on = ["_cell"]
    if salts > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64("left_id"), F.lit(salts)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("_salt")
    dist = geo.haversine(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))
    # The size check sees the rows before they are copied, so a broadcast would hold all copies in the driver.
    return a.join(b.hint("merge"), on).withColumn("km", dist).filter(F.col("km") <= km).select("left_id", "right_id", "km")


def with_config(rows: DataFrame, config: DataFrame, columns: list[str]) -> DataFrame:
    """Attach the single settings row as scalar subqueries; no join at all."""
    return rows.withColumns({c: config.select(c).scalar() for c in columns})


def barrier_min(segments: DataFrame) -> DataFrame:
    from bidspan.operators.windows import stage_barrier

    return stage_barrier(segments).filter(F.col("priority") == F.col("min_stage"))


def scalar_count(bids: DataFrame, docs: DataFrame, name: str = "docs_total") -> DataFrame:
    counts = docs.groupBy("bid_id").agg(F.count(F.lit(1)).alias("_n"))
    return bids.join(counts, "bid_id", "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n")


def scalar_max_or(partitions: DataFrame, bids: DataFrame) -> DataFrame:
    """Newest source update per (modality, uf); uf '' means every state.

    The "all states" level is a second, tiny aggregation over the first one, so
    the disjunctive key becomes an equi join.
    """
    dated = bids.filter(F.col("updated_at_source").isNotNull())
    by_uf = dated.groupBy("modality_id", "uf").agg(F.max("updated_at_source").alias("last_update"))
    every = by_uf.groupBy("modality_id").agg(F.max("last_update").alias("last_update")).withColumn("uf", F.lit(""))
    levels = by_uf.filter(F.col("uf").isNotNull()).unionByName(every)
    return partitions.join(levels, ["modality_id", "uf"], "left")


def update_seen(catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """Refresh ``seen_at`` of received keys only; rows not received keep theirs."""
    newest = seen.groupBy("control_no").agg(F.max("seen_at").alias("_seen"))
    return catalog.join(newest, "control_no", "left").withColumn("seen_at", F.coalesce("_seen", "seen_at")).drop("_seen")


#: Most short forms of a bid's probes that are looked for inside a text; beyond, the join alone decides.
PROBES = 4096


def quote_matches(quotes: DataFrame, sources: DataFrame, on: list[str] | None = None, min_chars: int = 12) -> DataFrame:
    """(quote_id, source_id) where every fragment of the quote occurs in the source.

    ``on`` restricts a quote to sources with equal columns (its bid); without it
    all sources are searched. Exact, and without pairing all with all:

    - the longest fragment is the probe, and one winnowed gram of it is looked for
      (see :mod:`bidspan.functions.winnow`): a text that holds the probe has that
      gram among its own winnowed ones, of which there is one in every 33
      characters for long quotes, 7 for middling and 3 for short ones;
    - a text meets the short forms of its bid's probes first (a set of at most
      ``PROBES`` of ``2 ** 16`` values) and leaves only the grams found there; a bid
      with more probes leaves all of its grams, which is linear in its texts;
    - candidates come from an equi join on the whole hash, in one pass over the texts
      for all lengths, so a bid with very many quotes and sources spreads over as
      many hash values as it has texts;
    - survivors are checked with ``contains`` on the comparison form, the second
      and last time that texts are read; only those of survivors are formed again.

    Quotes with fewer than ``min_chars`` comparable characters match nothing.
    """
    on = on or []
    q = quotes.select("quote_id", *on, tx.split_ellipsis(F.col("quote")).alias("_parts"))
    longest = F.element_at(F.array_sort("_parts", lambda x, y: F.length(y) - F.length(x)), 1)
    q = q.filter(F.length(F.array_join("_parts", " ")) >= min_chars).select("quote_id", *on, "_parts", longest.alias("_probe"))
    q = settle(q.withColumn("_h", winnow.probe_key(F.col("_probe"))), "probes")
    forms = sources.select("source_id", *on, tx.compare_form(F.col("text")).alias("_form"))

    lengths = q.select(F.least(F.octet_length("_probe"), F.lit(winnow.TIERS[0][0])).alias("n")).distinct().collect()  # at most 96 values
    tiers = sorted({winnow.tier(r["n"]) for r in lengths})
    if not tiers:  # no quote long enough to prove anything
        ids = f"quote_id {dict(q.dtypes)['quote_id']}, source_id {dict(forms.dtypes)['source_id']}"
        return quotes.sparkSession.createDataFrame([], ids)
    short = F.collect_set(winnow.short_form(F.col("_h"))).alias("_short")
    sieve = q.groupBy(*on).agg(short).withColumn("_short", F.when(F.size("_short") <= PROBES, F.col("_short")))
    met = forms.join(sieve, on) if on else forms.withColumn("_short", sieve.select("_short").scalar())
    texts = met.select("source_id", *on, F.explode(winnow.text_keys(F.col("_form"), tiers, F.col("_short"))).alias("_h"))
    candidates = settle(q.select("quote_id", *on, "_parts", "_h").join(texts, [*on, "_h"]).select("quote_id", "_parts", "source_id"), "candidates")
    met = sources.join(candidates.select("source_id").distinct(), "source_id", "left_semi")  # other texts are neither formed again nor moved
    checked = candidates.join(met.select("source_id", tx.compare_form(F.col("text")).alias("_form")), "source_id")
    return checked.filter(F.forall("_parts", lambda p: F.contains(F.col("_form"), p))).select("quote_id", "source_id")

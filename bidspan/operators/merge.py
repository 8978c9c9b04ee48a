"""Merges without row-level updates: each takes the old table and a batch and
returns the new table, so a snapshot can be written beside the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import hashing
from bidspan.operators import filters, joins, windows

# Columns only the team writes; no source batch may touch them.
TEAM_FIELDS = ["team_status", "priority", "notes", "accessed_at"]
# Columns the merge itself maintains.
MERGE_FIELDS = ["created_at", "changed_at", "synced_at", "seen_at"]
TEAM_DEFAULTS = {"team_status": "nova", "priority": False, "notes": "", "accessed_at": None}


def version_guard(old: Column, new: Column) -> Column:
    """A late version never wins; equal versions and unknown ones do."""
    return old.isNull() | new.isNull() | (new >= old)


def keep_seen(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def touch_times(changed: Column, now: Column, old_changed: Column) -> dict[str, Column]:
    """``changed_at`` moves only on change, ``synced_at`` on every received row."""
    return {"changed_at": F.when(changed, now).otherwise(old_changed), "synced_at": now}


def merge_catalog(catalog: DataFrame, batch: DataFrame, policy: str, now: Column, key: str = "control_no", unique: bool = False) -> DataFrame:
    """The merged catalogue, each row with the ``action`` the batch had on it.

    ``action``: novo, atualizado, ignorado, recusado, or NULL for a row the batch
    did not mention. One full outer join on the key does admission, the version
    guard, the change test and the merge; ``result`` and ``merge_counters`` read
    different columns of the same plan.

    ``batch`` has the source columns of the catalogue plus ``position``. Of a key
    that it repeats the newest row counts; ``unique`` says that it repeats none.
    """
    if policy not in ("todas", "abertas"):
        raise ValueError(f"unknown admission policy: {policy}")
    source = [c for c in batch.columns if c not in (key, "position", *TEAM_FIELDS, *MERGE_FIELDS)]
    newest = batch if unique else windows.dedup_batch(batch, key)
    incoming = newest.select(key, F.struct(*source, "seen_at").alias("_n"))
    held = catalog.select(key, F.struct(*[c for c in catalog.columns if c != key]).alias("_o"))
    both = held.join(incoming, key, "full_outer")

    old, new = F.col("_o"), F.col("_n")
    exists, arrives = old.isNotNull(), new.isNotNull()
    admitted = exists | F.lit(policy == "todas") | new["closes_at"].isNull() | (new["closes_at"] > now)
    differs = ~old["source_hash"].eqNullSafe(new["source_hash"])
    wins = version_guard(old["updated_at_source"], new["updated_at_source"])
    action = (
        F.when(~arrives, F.lit(None).cast("string"))
        .when(~admitted, "recusado")
        .when(~exists, "novo")
        .when(differs & wins, "atualizado")
        .otherwise("ignorado")
    )
    judged = both.withColumn("action", action)
    takes = F.col("action").isin("novo", "atualizado")
    # a received row that loses or is unchanged still counts as seen
    times = touch_times(takes, now, old["changed_at"])
    received = arrives & (F.col("action") != "recusado")

    def value(c: str) -> Column:
        if c in source:
            return F.when(takes, new[c]).otherwise(old[c])
        if c in TEAM_FIELDS:
            return F.when(exists, old[c]).otherwise(F.lit(TEAM_DEFAULTS[c]))
        if c == "created_at":
            return F.when(exists, old[c]).otherwise(now)
        if c == "seen_at":
            return F.when(received, keep_seen(new[c], old[c])).otherwise(old[c])
        if c == "synced_at":
            return F.when(received, times[c]).otherwise(old[c])
        if c == "changed_at":
            return F.coalesce(times[c], old[c])
        return old[c]

    return judged.select(key, *[value(c).alias(c) for c in catalog.columns if c != key], "action")


def result(merged: DataFrame) -> DataFrame:
    """The new catalogue: everything but refused arrivals."""
    return merged.filter(F.coalesce("action", F.lit("")) != "recusado").drop("action")


HISTORY_TEXT = "Importada do PNCP"  # fixed value


def history(merged: DataFrame, now: Column, key: str = "control_no") -> DataFrame:
    """One log row per inserted key; updates are not logged."""
    return merged.filter(F.col("action") == "novo").select(
        key, F.lit(HISTORY_TEXT).alias("entry"), F.lit("pncp").alias("origin"), now.alias("at")
    )


def merge_documents(docs: DataFrame, fresh: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Documents after a refresh, each with its ``action``.

    For refreshed bids the response is the truth: listed documents are written,
    missing ones get ``removido``. Other bids pass through untouched (NULL).
    ``refreshed(bid_id)`` names the bids whose response arrived, so an empty
    response really empties the bid.
    """
    cols = [c for c in docs.columns if c not in ("bid_id", "seq")]
    new = windows.best_row(fresh, ["bid_id", "seq"], F.col("position")).select("bid_id", "seq", F.struct(*cols).alias("_n"))
    old = docs.select("bid_id", "seq", F.struct(*cols).alias("_o"))
    touched = refreshed.select("bid_id").distinct().withColumn("_touched", F.lit(True))
    both = old.join(new, ["bid_id", "seq"], "full_outer").join(touched, "bid_id", "left")
    action = F.when(F.col("_n").isNotNull(), "gravado").when(F.col("_touched"), "removido")
    row = F.coalesce("_n", "_o")
    return both.select("bid_id", "seq", *[row[c].alias(c) for c in cols], action.alias("action"))


def document_counts(merged: DataFrame) -> DataFrame:
    """written / removed / active per refreshed bid."""
    a = F.col("action")
    return merged.filter(a.isNotNull()).groupBy("bid_id").agg(
        F.count_if(a == "gravado").alias("written"),
        F.count_if(a == "removido").alias("removed"),
        F.count_if((a == "gravado") & F.col("active")).alias("active_docs"),
    )


def merge_score(bids: DataFrame, scores: DataFrame) -> DataFrame:
    """New score clamped to 0..100, only where given; ``score_changed`` tells a write is due."""
    given = scores.select("bid_id", F.greatest(F.lit(0), F.least(F.lit(100), F.col("score"))).alias("_s"))
    joined = bids.join(given, "bid_id", "left")
    changed = F.col("_s").isNotNull() & (F.col("_s") != F.col("score"))
    return joined.withColumn("score_changed", changed).withColumn("score", F.coalesce("_s", "score")).drop("_s")


def merge_chunks_replace(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of refreshed documents replaced at once."""
    kept = chunks.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(fresh.select(*chunks.columns))


def upsert_latest(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace by key; new keys are added. ``fresh`` has one row per key."""
    kept = table.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def merge_embedding(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert_latest(vectors, fresh, ["bid_id"])


FILE_FIELDS = ["file_name", "extension", "mime", "bytes", "sha256", "pages", "chars", "text"]


def merge_file_state(files: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """Partial update of file rows: a NULL in the patch keeps what is stored.

    State and error are always taken from the patch; density is recomputed when
    the patch brings pages.
    """
    fields = [f for f in FILE_FIELDS if f in files.columns and f in patch.columns]
    p = patch.select("doc_id", F.struct("state", "error", *fields).alias("_p"))
    hit = F.col("_p").isNotNull()
    pages, chars = F.col("_p")["pages"], F.coalesce(F.col("_p")["chars"], F.lit(0))
    density = F.when(hit & (pages > 0), F.round(chars / pages, 1)).otherwise(F.col("density"))

    def value(c: str) -> Column:
        if c in ("state", "error"):
            return F.when(hit, F.col("_p")[c]).otherwise(F.col(c))
        if c in fields:
            return F.coalesce(F.col("_p")[c], F.col(c))
        if c == "updated_at":
            return F.when(hit, now).otherwise(F.col(c))
        if c == "density":
            return density
        return F.col(c)

    return files.join(p, "doc_id", "left").select(*[value(c).alias(c) for c in files.columns])


def merge_team_fields(bids: DataFrame, patch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Patched bids and the log rows; ``patch(bid_id, team_status?, priority?, notes?, entry?)``."""
    fields = ["team_status", "priority", "notes"]
    p = patch.select("bid_id", F.struct(*fields).alias("_p"))
    cols = [
        F.coalesce(F.col("_p")[c], F.col(c)).alias(c) if c in fields
        else F.when(F.col("_p").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "changed_at"
        else F.col(c)
        for c in bids.columns
    ]
    known = patch.join(bids.select("bid_id"), "bid_id", "left_semi").filter(F.col("entry").isNotNull())
    log = known.select("bid_id", "entry", F.lit("equipe").alias("origin"), now.alias("at"))
    return bids.join(p, "bid_id", "left").select(*cols), log


ADDED = "Movida para Minhas Licitações"  # fixed values
REMOVED = "Removida de Minhas Licitações (devolvida para Licitações Gerais)"


def merge_shortlist(shortlist: DataFrame, add: DataFrame, remove: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Shortlist after adding and then removing ids, and one log row per request."""
    grown = shortlist.select("bid_id").unionByName(joins.anti_conflict(add.select("bid_id"), shortlist, ["bid_id"]))
    left = grown.join(remove.select("bid_id"), "bid_id", "left_anti")
    logs = [
        df.select("bid_id", F.lit(text).alias("entry"), F.lit("equipe").alias("origin"), now.alias("at"))
        for df, text in ((add, ADDED), (remove, REMOVED))
    ]
    return left, logs[0].unionByName(logs[1])


def page_ledger(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """``decision`` per page: aplicar, pular (already applied) or erro (a page is missing before it).

    ``pages(segment_id, page)``, ``ledger(segment_id, next_page)``. A run of
    consecutive pages starting at the expected one is applied in one batch. The
    first gap is found with a min per segment over missing successors, so a
    segment with very many pages needs no per-segment ordering.
    """
    expected = ledger.select("segment_id", "next_page")
    seen = pages.select("segment_id", "page").distinct().join(expected, "segment_id", "left")
    seen = seen.withColumn("next_page", F.coalesce("next_page", F.lit(1)))
    fresh = seen.filter(F.col("page") >= F.col("next_page"))
    # a page is reachable when its predecessor is there too, or it is the expected one
    prev = fresh.select("segment_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("_has_prev"))
    linked = fresh.join(prev, ["segment_id", "page"], "left")
    orphan = (F.col("page") != F.col("next_page")) & F.col("_has_prev").isNull()
    gaps = linked.groupBy("segment_id").agg(F.min(F.when(orphan, F.col("page"))).alias("_gap"))
    decision = (
        F.when(F.col("page") < F.col("next_page"), "pular")
        .when(F.col("_gap").isNotNull() & (F.col("page") >= F.col("_gap")), "erro")
        .otherwise("aplicar")
    )
    return seen.join(gaps, "segment_id", "left").select("segment_id", "page", decision.alias("decision"))


def segment_finish(page: Column, total_pages: Column, received: Column) -> Column:
    return F.coalesce(page >= total_pages, F.lit(False)) | (received == 0)


def state_expire(state: DataFrame, now: Column, lease: str = "15 minutes", retry: str = "6 hours") -> DataFrame:
    """Reservations and errors that are old enough are pending again."""
    stale = filters.due_state(F.col("state"), F.col("changed_at"), now, lease, retry)
    return state.withColumn("state", F.when(stale, "pendente").otherwise(F.col("state")))


def state_fail(state: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Record failures ``(bid_id, message, final)``: transient ones wait, final ones are errors."""
    fresh = failures.select(
        "bid_id",
        F.when(F.col("final"), "erro").otherwise("pendente").alias("state"),
        F.coalesce("message", F.lit("")).alias("error"),
        now.alias("changed_at"),
    )
    return upsert_latest(state.select("bid_id", "state", "error", "changed_at"), fresh, ["bid_id"])


def analysis_reuse(bids: DataFrame, cache: DataFrame) -> DataFrame:
    """``reuse`` is true when a ready result exists for the same fingerprint or is already final."""
    slim = cache.select("bid_id", F.col("state").alias("_s"), F.col("fingerprint").alias("_f"), F.col("final_format").alias("_final"))
    ready = F.col("_s") == "pronta"
    same = (F.col("_f") == F.col("fingerprint")) | F.coalesce("_final", F.lit(False))
    return bids.join(slim, "bid_id", "left").withColumn("reuse", F.coalesce(ready & same, F.lit(False))).drop("_s", "_f", "_final")


def fingerprint(bids: DataFrame, docs: DataFrame, header_fields: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Digest per bid of its header, its documents in any order, and version labels.

    Document digests are summed word by word instead of being sorted into one
    string: order-independent, combined map-side, and one row per bid however
    many documents it has.
    """
    fields = ["seq", "active", "state", "sha256", "name", "doc_type"]
    digest = F.md5(F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"}))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_w{i}") for i in range(4)]
    per_bid = docs.select("bid_id", *words).groupBy("bid_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_w{i}").alias(f"_w{i}") for i in range(4)]
    )
    packed = F.concat_ws(":", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("_n", "_w0", "_w1", "_w2", "_w3")])
    header = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(header_fields)]), {"ignoreNullFields": "false"})
    joined = bids.join(per_bid, "bid_id", "left").withColumn("fingerprint", hashing.fingerprint(header, packed, versions))
    return joined.drop("_n", "_w0", "_w1", "_w2", "_w3")


def patch_config(config: DataFrame, patch: DataFrame) -> DataFrame:
    """Single settings row after a patch; what the patch leaves out stays."""
    return config.select(
        *[
            F.coalesce(patch.select(c).scalar(), F.col(c)).alias(c) if c in patch.columns else F.col(c)
            for c in config.columns
        ]
    )

"""Per-group windows. Where only one row per group is wanted the group is
reduced with ``min_by``/``max_by`` instead, which combines map-side and so does
not care how large one group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspan.functions import scoring


def best_row(df: DataFrame, keys: Sequence[str], order: Column, newest: bool = True) -> DataFrame:
    """One row per key: the one with the greatest (or least) ``order``.

    ``order`` should be a struct ending in something unique, so the survivor
    does not depend on row order. Partial aggregation keeps one row per key per
    map task, so a key holding a third of the data shuffles a handful of rows.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def dedup_batch(batch: DataFrame, key: str = "control_no", version: str = "updated_at_source", position: str = "position") -> DataFrame:
    """Newest version of each key in a batch, last position on equal versions."""
    # a missing version sorts below every date, like NULL in a struct comparison
    return best_row(batch, [key], F.struct(F.col(version), F.col(position)))


def dedup_hash(rows: DataFrame, key: str, hash_: str) -> DataFrame:
    return rows.dropDuplicates([key, hash_])


def dedup_documents(docs: DataFrame, order: Column) -> DataFrame:
    return best_row(docs, ["bid_id", "seq"], order)


def page_rank(df: DataFrame, keys: list[Column], first: int, last: int) -> DataFrame:
    """Rows ``first..last`` of a total order, with their rank.

    The head is bounded by ``last`` before it is numbered, so the one-task
    window only ever sees a page.
    """
    head = df.orderBy(*keys).limit(last)
    numbered = head.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
    return numbered.filter(F.col("rank").between(first, last))


def global_rank(df: DataFrame, keys: Sequence[str], directions: Sequence[bool], name: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row without a single-task window.

    Rows are range-partitioned on the order; each partition is numbered on its
    own and shifted by the sizes of the partitions before it. The input is
    written first: range partitioning samples it, and would otherwise compute
    it twice. Pass narrow rows (keys and order columns).
    """
    order = [F.col(k).asc_nulls_last() if asc else F.col(k).desc_nulls_last() for k, asc in zip(keys, directions)]
    from bidspan.session import settle

    ranged = settle(df, "unranked").repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = settle(ranged, "rank")  # partition ids must not change between the two uses
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def best_chunk(hits: DataFrame) -> DataFrame:
    """Nearest chunk of each bid, with its text."""
    return best_row(hits, ["bid_id"], F.struct("distance", "chunk_id"), newest=False)


def most_advanced(windows: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    return windows.groupBy(*keys).agg(F.max(day).alias(day))


def latest_event(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return best_row(events, [key], F.struct(*order))


def stage_barrier(segments: DataFrame) -> DataFrame:
    """Pending segments with the lowest pending stage of their job.

    min per job is aggregated first (map-side) and joined back: a job with most
    of the segments is one row on the small side, never one window partition.
    """
    pending = segments.filter(F.col("status").isin("pendente", "executando"))
    lowest = pending.groupBy("job_id").agg(F.min("priority").alias("min_stage"))
    return pending.join(lowest, "job_id")


def evidence_dedup(evidence: DataFrame) -> DataFrame:
    """Best hit per evidence id by (distance, document, order, id, text)."""
    return best_row(evidence, ["evidence_id"], F.struct("distance", "doc_id", "ord", "evidence_id", "excerpt"), newest=False)


def failure_streak(
    calls: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts", "event_id"), ok: str = "ok"
) -> DataFrame:
    """Consecutive failures since the last success, and the wait before the next try.

    Streaks are counted inside (key, day) slices, so one busy job spreads over
    tasks; a one-row-per-slice summary then carries open streaks across days.
    ``order`` must start with the timestamp the slices are cut from.
    """
    sliced = calls.withColumn("_slice", F.to_date(F.col(order[0])))
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sliced = sliced.withColumn("_run", F.sum(F.col(ok).cast("long")).over(upto))
    in_run = Window.partitionBy(key, "_slice", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sliced = sliced.withColumn("_local", F.sum((~F.col(ok)).cast("long")).over(in_run))

    slices = sliced.groupBy(key, "_slice").agg(
        F.max_by("_local", F.struct(*order)).alias("_tail"), F.bool_or(ok).cast("long").alias("_has_ok")
    )
    by_slice = Window.partitionBy(key).orderBy("_slice")
    slices = slices.withColumn("_island", F.sum("_has_ok").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
    in_island = Window.partitionBy(key, "_island").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("_open", F.sum("_tail").over(in_island))
    carry = slices.select(key, "_slice", F.coalesce(F.lag("_open").over(by_slice), F.lit(0)).alias("_carry"))

    streak = F.col("_local") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    out = sliced.join(carry, [key, "_slice"]).withColumn("streak", streak)
    wait = F.when(F.col("streak") > 0, scoring.backoff_ms(F.col("streak"))).otherwise(0)
    return out.withColumn("wait_ms", wait).select(*calls.columns, "streak", "wait_ms")


def interval_merge(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int = 4096) -> DataFrame:
    """Union of overlapping or touching spans per document.

    Spans are cut into slices of ``width`` by their start, and looked at inside
    (document, slice), so a document with very many spans is not one task. One row
    a slice carries on how far earlier spans reach and where the last union began.
    """
    slices = [*keys, "_slice"]
    cut = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.floor(F.col(start) / width).alias("_slice"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: str, name: str) -> DataFrame:
        each = rows.groupBy(*slices).agg(F.max(value).alias(value))
        return each.select(*slices, F.max(value).over(before).alias(name))

    def same(left: DataFrame, right: DataFrame) -> DataFrame:  # documents may be NULL
        renamed = right.select(*[F.col(c).alias(f"_{c}_") for c in slices], *[c for c in right.columns if c not in slices])
        return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in slices]).drop(*[f"_{c}_" for c in slices])

    order = Window.partitionBy(*slices).orderBy("_s", "_e")
    reach = F.greatest(F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reached"))
    opened = same(cut, carried(cut, "_e", "_reached")).withColumn("_far", reach)
    opened = opened.withColumn("_opens", F.when(F.col("_far").isNull() | (F.col("_s") > F.col("_far")), F.col("_s"))).drop("_far", "_reached")
    inside = F.max("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    named = same(opened.withColumn("_inside", inside), carried(opened, "_opens", "_earlier"))
    return named.groupBy(*keys, F.coalesce("_inside", "_earlier").alias(start)).agg(F.max("_e").alias(end))


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based place of every row in its group, by ascending ``order``, without a window over a group.

    All rows are ranked once over range partitions (see :func:`global_rank`); a
    group's places count from its first rank, one row a group.
    """
    ranked = global_rank(df, [*group, *order], [True] * (len(group) + len(order)), "_rank")
    first = ranked.groupBy(*[F.col(c).alias(f"_{c}_") for c in group]).agg(F.min("_rank").alias("_first"))
    joined = ranked.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in group])  # groups may be NULL
    return joined.select(*df.columns, (F.col("_rank") - F.col("_first") + 1).cast("int").alias(name))


def topn_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Best ``n`` rows per group, ranked.

    Spark 4 pushes the rank limit below the shuffle (WindowGroupLimit), so each
    map task forwards at most n rows of a group.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def share(counts: DataFrame, value: str = "n", floor_percent: float = 2.0) -> DataFrame:
    """Bar share of the largest (never under the floor) and percent of the total.

    Maximum and sum come from scalar subqueries rather than a window over the
    whole table, so nothing is pulled into one task.
    """
    top = counts.agg(F.max(value)).scalar()
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn("bar", F.greatest(F.lit(floor_percent), F.round(F.col(value) * 100.0 / top, 4))).withColumn(
        "percent", F.round(F.try_divide(F.col(value) * 100.0, total), 4)
    )

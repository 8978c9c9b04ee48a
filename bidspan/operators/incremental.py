"""Frontier and window arithmetic of incremental collection, as joins over dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import dates, scoring
from bidspan.operators.aggregates import partition_closed, type_flags

OVERLAP_DAYS = 2
WINDOW_DAYS = 7


def partitions(ufs: DataFrame, modalities: DataFrame) -> DataFrame:
    """Every (uf, modality). The modality domain is a list of under 20 ids that is
    turned into an array once, so this is a projection and not a cross join."""
    ids = F.array_sort(F.collect_set("modality_id"))
    domain = modalities.agg(ids.alias("ids")).scalar()
    return ufs.select("uf", F.explode(domain).alias("modality_id"))


def window_plan(parts: DataFrame, frontier: DataFrame, start: str, today: str, overlap: int = OVERLAP_DAYS, width: int = WINDOW_DAYS) -> DataFrame:
    """Disjoint windows per partition, from the day after its frontier (or ``start``)
    minus the overlap, up to today, which is always asked again."""
    if not 1 <= width <= 7:
        raise ValueError("a window has 1 to 7 days")
    if overlap < 0:
        raise ValueError("the overlap has 0 or more days")
    end = F.lit(today).cast("date")
    raw = F.coalesce(F.date_add("last_closed_date", 1), F.lit(start).cast("date"))
    first = F.least(F.date_sub(raw, overlap), end)
    joined = parts.join(frontier.select("uf", "modality_id", "last_closed_date"), ["uf", "modality_id"], "left")
    starts = joined.select("uf", "modality_id", F.explode(F.sequence(first, end, F.expr(f"interval {width} days"))).alias("from_date"))
    return starts.withColumn("to_date", F.least(F.date_add("from_date", width - 1), end))


def stages(horizon: int, steps: tuple[int, ...] = (5, 15)) -> list[int]:
    if horizon < 1:
        raise ValueError("the horizon has 1 or more days")
    return sorted({s for s in (*steps, horizon) if 0 < s <= horizon})


def stage_plan(parts: DataFrame, horizon: int, today: str, steps: tuple[int, ...] = (5, 15)) -> DataFrame:
    """Segments stage × uf × modality: near deadlines first, with a stable signature."""
    table = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(d).alias("stage_days")) for i, d in enumerate(stages(horizon, steps))])
    rows = parts.select("uf", "modality_id", F.explode(table).alias("s")).select("uf", "modality_id", "s.*")
    rows = rows.withColumn("until", F.date_add(F.lit(today).cast("date"), F.col("stage_days")))
    parts_of = F.concat_ws("|", F.lit("proposta"), F.col("stage_days").cast("string"), F.date_format("until", "yyyyMMdd"), "uf", F.coalesce(F.col("modality_id").cast("string"), F.lit("")))
    return rows.withColumn("signature", F.md5(parts_of))


def frontier_advance(frontier: DataFrame, segments: DataFrame, today: Column) -> DataFrame:
    """Frontier after a cycle. A partition that closed no day keeps its date (greatest ignores NULL)."""
    closed = partition_closed(segments, today).withColumnRenamed("last_closed_date", "_closed")
    joined = frontier.join(closed, ["uf", "modality_id"], "full_outer")
    return joined.withColumn("last_closed_date", F.greatest("last_closed_date", "_closed")).select(*frontier.columns)


def bootstrap_start(jobs: DataFrame) -> DataFrame:
    """Local day the earliest discovery started; NULL when none did."""
    return jobs.filter(F.col("kind") == "descoberta").agg(dates.local_day(F.min("started_at")).alias("start_day"))


def rescore(bids: DataFrame, docs: DataFrame, now: Column, config: scoring.ScoreConfig = scoring.ScoreConfig()) -> DataFrame:
    """(bid_id, old_score, new_score, open_now) of the whole catalogue in one join."""
    joined = bids.join(type_flags(docs), "bid_id", "left")
    flags = {t: F.col(f"has_{t}") for t in scoring.DOCUMENT_SHARES}
    new = scoring.score(F.col("object"), F.coalesce("modality", F.lit("")), F.col("value"), F.col("category"), flags, config)
    open_now = dates.is_open(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now)
    return joined.select("bid_id", F.col("score").alias("old_score"), new.alias("new_score"), open_now.alias("open_now"))


def reconcile(catalog: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """Open bids the source no longer shows are flagged ``recheck``; nothing is deleted."""
    seen = observed.groupBy("control_no").agg(F.max("seen_at").alias("_seen"))
    joined = catalog.join(seen, "control_no", "left")
    open_now = F.coalesce(dates.is_open(F.col("status_id"), F.col("opens_at"), F.col("closes_at"), now), F.lit(False))
    return (
        joined.withColumn("recheck", open_now & F.col("_seen").isNull())
        .withColumn("seen_at", F.coalesce("_seen", "seen_at"))
        .drop("_seen")
    )

"""Total orders, pages and queues. Sorted heads plan as TakeOrderedAndProject."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import hashing, scoring

SORT_COLUMNS = {  # fixed values: the four orders a caller may choose
    "deadline": "closes_at",
    "value": "value",
    "published": "published_at",
    "score": "score",
}
MAX_PAGE = 200


def sort_keys(key: str, direction: str, tie: str = "bid_id") -> list[Column]:
    """NULLs last in both directions, unique tie-break last."""
    if key not in SORT_COLUMNS or direction not in ("asc", "desc"):
        raise ValueError(f"unknown order: {key} {direction}")
    column = F.col(SORT_COLUMNS[key])
    first = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    return [first, F.col(tie).asc()]


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    size = min(max(25 if limit is None else limit, 1), MAX_PAGE)
    return size, max(offset or 0, 0)


def page(df: DataFrame, keys: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    size, skip = clamp(limit, offset)
    return df.orderBy(*keys).offset(skip).limit(size)


def total_pages(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def page_with_total(df: DataFrame, keys: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    """The page, each row carrying the total under the same filter.

    The total is a scalar subquery over the same plan: a map-side count that
    never moves rows, next to a bounded top-k.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page(df, keys, limit, offset).withColumn("total", total)


def keyset_after(column: str, key: str, cursor: tuple | None, direction: str = "asc") -> Column:
    """Rows after the cursor in the (column, NULLs last, key) order."""
    if cursor is None:
        return F.lit(True)
    value, last_key = cursor
    tail = F.col(column).isNull()
    if value is None:
        return tail & (F.col(key) > F.lit(last_key))
    beyond = F.col(column) > F.lit(value) if direction == "asc" else F.col(column) < F.lit(value)
    return beyond | ((F.col(column) == F.lit(value)) & (F.col(key) > F.lit(last_key))) | tail


def page_keyset(df: DataFrame, column: str, key: str, cursor: tuple | None, n: int, direction: str = "asc") -> DataFrame:
    """Next ``n`` rows plus one look-ahead row (``ahead``) that tells a next page exists."""
    first = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_last()
    head = df.filter(keyset_after(column, key, cursor, direction)).orderBy(first, F.col(key).asc()).limit(n + 1)
    return ranked(head, [first, F.col(key).asc()]).withColumn("ahead", F.col("rank") > n)


def ranked(head: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """Number an already bounded head (at most a page or a candidate list)."""
    from pyspark.sql import Window

    return head.withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def relevance_keys() -> list[Column]:
    return [F.col("rrf_score").desc(), F.col("closes_at").asc_nulls_last(), F.col("bid_id").asc()]


def nearest_keys() -> list[Column]:
    return [F.col("km").asc_nulls_last(), F.col("bid_id").asc()]


def queue_documents(due: DataFrame, n: int, now: Column) -> DataFrame:
    """Still open first, earliest deadline, highest score."""
    late = F.when(F.col("closes_at") >= now, 0).otherwise(1)
    return due.orderBy(late, F.col("closes_at").asc_nulls_last(), F.col("score").desc(), F.col("bid_id")).limit(max(n, 0))


def queue_files(due: DataFrame, n: int) -> DataFrame:
    """Notices first, then the key."""
    return due.orderBy(F.when(F.col("doc_type") == "edital", 0).otherwise(1), F.col("doc_id")).limit(max(n, 0))


def queue_embeddings(due: DataFrame, n: int, min_score: int, now: Column) -> DataFrame:
    return due.orderBy(
        scoring.bid_priority(now, min_score),
        F.col("accessed_at").desc_nulls_last(),
        F.col("closes_at").asc_nulls_last(),
        F.col("bid_id"),
    ).limit(max(n, 0))


def next_segment(segments: DataFrame, now: Column) -> DataFrame:
    """Oldest touched segment of the lowest pending stage that is out of its waiting time."""
    from bidspan.operators.windows import stage_barrier

    ready = F.col("retry_at").isNull() | (F.col("retry_at") <= now)
    at_stage = stage_barrier(segments).filter((F.col("priority") == F.col("min_stage")) & ready)
    return at_stage.orderBy("updated_at", "segment_id").limit(1)


def shuffle_seeded(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Repeatable random order: sort by a keyed hash."""
    return df.withColumn("draw", hashing.uniform(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("draw", key)


def split_deterministic(df: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """Hash-uniform split into ``ajuste`` and ``final``; no sort, no counting, stable under growth."""
    draw = hashing.uniform(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("draw", draw).withColumn("part", F.when(F.col("draw") < share, "ajuste").otherwise("final"))

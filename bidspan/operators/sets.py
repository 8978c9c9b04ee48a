"""Set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspan.operators.windows import dedup_batch


def union_branches(exact: DataFrame | None, approximate: DataFrame | None) -> DataFrame:
    """Candidates of whichever branch is live (or of both)."""
    live = [b for b in (exact, approximate) if b is not None]
    if not live:
        raise ValueError("no live branch")
    return reduce(DataFrame.unionByName, live)


def union_dedup_sources(batches: list[DataFrame]) -> DataFrame:
    """Rows of several fetches, one per key; a later batch wins on equal versions."""
    tagged = [
        b.withColumn("position", F.lit(i).cast("long") * F.lit(1 << 40) + F.col("position")) for i, b in enumerate(batches)
    ]
    return dedup_batch(reduce(DataFrame.unionByName, tagged)).drop("position")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Trimmed upper-case codes, blanks dropped."""
    code = F.upper(F.trim(F.col(column)))
    return df.select(code.alias("code")).filter(F.col("code") != "").distinct()


def new_in(candidate: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    return candidate.select(*keys).distinct().join(base.select(*keys), keys, "left_anti")


def recall_overlap(approx: DataFrame, exact: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """|approx ∩ exact| / |exact| per query, each list cut at rank k."""
    a = approx.filter(F.col("rank") <= k).select(query, item, F.lit(1).alias("_hit"))
    e = exact.filter(F.col("rank") <= k).select(query, item)
    joined = e.join(a, [query, item], "left")
    return joined.groupBy(query).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def known_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Keep cited ids that exist for the bid; count the dropped ones.

    ``answers(answer_id, bid_id, source_ids)``. Works on exploded citations and
    an equi join, so a bid with very many sources is never one array.
    """
    cited = answers.select("answer_id", "bid_id", F.posexplode_outer("source_ids").alias("_pos", "source_id"))
    real = sources.select("bid_id", "source_id").distinct().withColumn("_real", F.lit(True))
    joined = cited.join(real, ["bid_id", "source_id"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("_real"), F.struct("_pos", "source_id"))))
    dropped = F.count_if(F.col("source_id").isNotNull() & F.col("_real").isNull())
    return (
        joined.groupBy("answer_id", "bid_id")
        .agg(kept.alias("_kept"), dropped.alias("dropped"))
        .withColumn("source_ids", F.transform("_kept", lambda s: s["source_id"]))
        .drop("_kept")
    )


def shortlist_union(persisted: DataFrame, requested: DataFrame) -> DataFrame:
    return persisted.select("bid_id").unionByName(requested.select("bid_id")).distinct()

"""Ranking evaluation over runs and judgments.

``run(query_id, rank, item_id)``, ``judgments(query_id, item_id, grade 0..3)``.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidspan.functions import scoring


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def _discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def judged_run(run: DataFrame, judgments: DataFrame, unjudged: str = "zero") -> DataFrame:
    """Run with grades; ``condensado`` drops unjudged items and closes the ranks."""
    if unjudged not in ("zero", "condensado"):
        raise ValueError("unjudged is zero or condensado")
    joined = run.join(judgments.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left")
    if unjudged == "zero":
        return joined
    kept = joined.filter(F.col("grade").isNotNull())
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id")))


def ndcg(run: DataFrame, judgments: DataFrame, k: int = 10, unjudged: str = "zero") -> DataFrame:
    """(query_id, ndcg?, unjudged). The ideal comes from the whole judged pool.

    NULL where the pool has nothing relevant; 0 for a query the run left empty.
    Both sides cut at k with a rank limit that Spark applies before the shuffle.
    """
    lists = judged_run(run, judgments, unjudged).filter(F.col("rank") <= k)
    dcg = lists.groupBy("query_id").agg(
        F.sum(_gain(F.coalesce("grade", F.lit(0))) / _discount(F.col("rank"))).alias("_dcg"),
    )
    missing = judged_run(run, judgments).filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.count_if(F.col("grade").isNull()).alias("unjudged")
    )
    best = judgments.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")))
    ideal = best.filter(F.col("_r") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade")) / _discount(F.col("_r"))).alias("_ideal"))
    joined = ideal.join(dcg, "query_id", "left").join(missing, "query_id", "left")
    value = F.when(F.col("_ideal") > 0, F.coalesce("_dcg", F.lit(0.0)) / F.col("_ideal"))
    return joined.select("query_id", value.alias("ndcg"), F.coalesce("unjudged", F.lit(0)).alias("unjudged"))


def reciprocal_rank(run: DataFrame, judgments: DataFrame, k: int = 10, min_grade: int = 2, unjudged: str = "zero") -> DataFrame:
    """(query_id, rr?): 0 when the top k has no good item, NULL when the pool has none."""
    pool = judgments.groupBy("query_id").agg(F.max("grade").alias("_top"))
    first = judged_run(run, judgments, unjudged).filter((F.col("rank") <= k) & (F.col("grade") >= min_grade))
    first = first.groupBy("query_id").agg(F.min("rank").alias("_first"))
    value = F.when(F.col("_top") >= min_grade, F.coalesce(1.0 / F.col("_first"), F.lit(0.0)))
    return pool.join(first, "query_id", "left").select("query_id", value.alias("rr"))


def topk_compare(base: DataFrame, candidate: DataFrame, eligible: DataFrame, k: int = 10) -> DataFrame:
    """Per query: items only the candidate has, and whether it filled its k places.

    ``eligible(query_id, n)`` tells how many results were possible.
    """
    b = base.filter(F.col("rank") <= k).select("query_id", "item_id", F.lit(1).alias("_b"))
    c = candidate.filter(F.col("rank") <= k).select("query_id", "item_id")
    per = c.join(b, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.count_if(F.col("_b").isNull()).alias("new_items"), F.count(F.lit(1)).alias("returned")
    )
    joined = eligible.join(per, "query_id", "left")
    got = F.coalesce("returned", F.lit(0))
    return joined.select(
        "query_id", F.coalesce("new_items", F.lit(0)).alias("new_items"), got.alias("returned"),
        F.when(F.col("n") >= k, got == k).otherwise(True).alias("complete"),
    )


def kappa(pairs: DataFrame, categories: int = 4, a: str = "rating_a", b: str = "rating_b") -> DataFrame:
    """Quadratic weighted kappa and exact agreement of two raters; NULL kappa without expected disagreement.

    Only the confusion table (categories squared) leaves the scan. The expected
    disagreement is a closed form of the marginals' first two moments, so no
    pairing of marginals is needed.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    cells = pairs.filter(x.isNotNull() & y.isNotNull()).groupBy(x.alias("_x"), y.alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    mean = lambda e: F.sum(e * F.col("_n")) / n
    cx, cy = F.col("_x"), F.col("_y")
    observed = mean((cx - cy) * (cx - cy))
    expected = mean(cx * cx) - 2 * mean(cx) * mean(cy) + mean(cy * cy)
    scale = float((categories - 1) ** 2)
    return cells.agg(
        n.alias("pairs"),
        F.when(F.abs(expected) > 1e-12, 1 - (observed / scale) / (expected / scale)).alias("kappa"),
        (F.sum(F.when(cx == cy, F.col("_n")).otherwise(0)) / n).alias("exact_agreement"),
    )


def poisson_edges(bits: int = 32, terms: int = 12) -> list[int]:
    """Where the Poisson(1) distribution steps from one count to the next, on a scale of ``bits`` bits."""
    steps = [math.exp(-1) / math.factorial(k) for k in range(terms)]
    return [int(sum(steps[: k + 1]) * 2**bits) for k in range(terms)]


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: str = "20260921", key: str = "query_id") -> DataFrame:
    """Paired bootstrap 95% interval of the relative gain of means, seeded.

    ``pairs(query_id, base, candidate)``; NULLs are left out. Each row weighs in a
    resample by a Poisson(1) count, a hash of (seed, resample, key), in place of
    being drawn by number: the same in the limit, without numbering rows or
    joining draws. Weights arise where the row lies and are summed before
    anything is shuffled, so a resample is two sums, whatever the partitioning.
    """
    clean = pairs.filter(F.col("base").isNotNull() & F.col("candidate").isNotNull())
    roll = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "resample", F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    weight = reduce(operator.add, ((F.col("_roll") >= e).cast("int") for e in poisson_edges()))
    draws = clean.select(key, "base", "candidate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).withColumn("_roll", roll).withColumn("_w", weight)

    def gain(weight: Column) -> Column:
        """Of the sums; in decimals, so that their order does not matter."""
        total = lambda c: F.sum((weight * F.col(c)).cast("decimal(28,15)")).cast("double")
        return scoring.relative_gain(total("base"), total("candidate")).alias("gain")

    interval = draws.groupBy("resample").agg(gain(F.col("_w"))).agg(
        F.expr("percentile_disc(0.025) within group (order by gain)").alias("low"),
        F.expr("percentile_disc(0.975) within group (order by gain)").alias("high"),
    )
    estimate = clean.agg(gain(F.lit(1)).alias("estimate"))
    ends = interval.select(F.struct("low", "high").alias("ends")).scalar()
    return estimate.withColumn("_ends", ends).select("estimate", "_ends.low", "_ends.high")


MIN_PER_SEGMENT = 10
SEGMENT_TOLERANCE = -0.02


def segments(scores: DataFrame, minimum: int = MIN_PER_SEGMENT, tolerance: float = SEGMENT_TOLERANCE) -> DataFrame:
    """``scores(query_id, segment, base, candidate)`` to per-segment delta and verdict."""
    both = scores.filter(F.col("base").isNotNull() & F.col("candidate").isNotNull())
    per = both.groupBy("segment").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("candidate") - F.col("base")).alias("delta"))
    reason = F.when(F.col("queries") < minimum, "segmento insuficiente").when(F.col("delta") < tolerance - 1e-9, "regressão no segmento")
    return per.withColumn("reason", reason).withColumn("pass", F.col("reason").isNull())


def gate(metrics: DataFrame, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """All failing reasons accumulated; pass means none. ``checks`` are (must hold, reason)."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks]))
    return metrics.withColumn("reasons", found).withColumn("pass", F.size("reasons") == 0)

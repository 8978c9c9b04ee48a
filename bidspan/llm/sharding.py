"""Sharding by a weighted hash tree: region, rack, shard, each level a weighted draw."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled, hex_bucket, unit_draw

#: Hex digits of the bucket in which slots of a shard are counted: 4096 buckets a shard.
SLOT_DIGITS = 3


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight (0: takes no rows)."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def uniform_tree(shards: int, *, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Equal shards, filled region by region; whole regions of ``racks * per_rack`` shards.

    From a multiple of that size on, one more shard opens a region of its own,
    so rows move into that shard only.
    """
    size = racks * per_rack
    return [Leaf(s, f"region{s // size}", f"rack{s % size // per_rack}") for s in range(shards)]


def _pick(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the best draw; the chance of each is its weight's share.

    The score -ln(u) / weight is exponential with rate ``weight``, so changing one
    weight changes one score: rows move to or from that option only.
    """
    live = [o for o in options if o[1] > 0]
    scores = [(-F.log(unit_draw(key, F.lit(name))) / F.lit(float(weight)), value) for name, weight, value in live]
    if len(scores) == 1:
        return scores[0][1]
    return F.array_min(F.array(*(F.struct(s.alias("s"), F.lit(i).alias("i"), v.alias("v")) for i, (s, v) in enumerate(scores))))["v"]


def tree_shard(key: Column, tree: list[Leaf]) -> Column:
    """The shard of ``key`` in ``tree``: one draw among regions, then racks, then shards."""
    levels: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        levels.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)

    def weight(leaves) -> float:
        return sum(x.weight for x in leaves)

    regions = []
    for region, racks in levels.items():
        below = []
        for rack, leaves in racks.items():
            shard = _pick(key, [(f"{region}/{rack}/{x.shard}", x.weight, F.lit(x.shard)) for x in leaves]) if weight(leaves) else None
            below.append((f"{region}/{rack}", weight(leaves), shard))
        regions.append((region, sum(b[1] for b in below), below))
    # the draw among regions comes first and only its winner's subtree is evaluated
    live = [r for r in regions if r[1] > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    region = _pick(key, [(name, w, F.lit(name)) for name, w, _ in live])
    out = F.lit(None).cast("int")
    for name, _, below in live:
        out = F.when(region == name, _pick(key, below)).otherwise(out)
    return out.cast("int")


def assign_shards(docs: DataFrame, tree: list[Leaf], grown: list[Leaf]) -> DataFrame:
    """One narrow row per document: ``doc_id, size, text_crc32, shard, slot, grown_shard``.

    The shard depends on ``doc_id`` and the tree alone. Slots number each shard's
    rows from 0 without a gap: rows are counted in 4096 hash buckets a shard,
    buckets get running offsets, and only inside a bucket are rows ordered, so no
    shard is sorted in one task. Texts are read once and never shuffled.

    A null text has size 1 and the checksum of an empty text. Rows without a
    ``doc_id`` share one key. Rows that repeat an id go to one shard with slots of
    their own. An empty table gives an empty table; other columns are not read.
    """
    settle = Settled(docs.sparkSession, "shards")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            tree_shard(key, tree).alias("shard"),
            tree_shard(key, grown).alias("grown_shard"),
        ).withColumn("bucket", hex_bucket(SLOT_DIGITS, F.lit("slot"), key, F.col("text_crc32").cast("string")))
    )
    counted = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = "coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0)"
    offsets = counted.select("shard", "bucket", F.expr(before).alias("before"))
    numbered = rows.withColumn("rn", F.expr("row_number() over (partition by shard, bucket order by doc_id nulls first, text_crc32, size)"))
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rn") - 1).cast("long").alias("slot"), "grown_shard"
    )

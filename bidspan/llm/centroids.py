"""Exact k-means on integer vectors: Hilbert-ordered blocks with boxes, which tell each block's candidate centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled, small_batches

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Vectors of one block, blocks that a task holds at a time, and axes and bits of the curve (their product fits a long).
BLOCK, BLOCKS_A_BATCH, AXES, BITS = 256, 16, 12, 5
#: Components beyond this could give squared distances that do not fit a long.
WIDEST = 2**27


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: vectors of exactly ``dim`` finite components as floor(scale * x) in doubles; others are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("x").isNotNull() & (F.size("x") == dim) & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.select("vec_id", x.alias("x")).where(sound).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points whose coordinates are ``bits`` bits wide; one row a point."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the sub-cubes, coarse ones first
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a point of the box: no other is surely nearer to all of it."""
    least = np.square(np.maximum(0, np.maximum(low - centroids, centroids - high))).sum(1)
    most = np.square(np.maximum(np.abs(centroids - low), np.abs(centroids - high))).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid, the smaller number on ties, and its squared distance, in whole numbers."""
    some = candidates(low, high, centroids)
    d = np.stack([np.square(points - c).sum(1) for c in centroids[some]], axis=1)
    at = d.argmin(1)  # candidates are in ascending order
    return some[at], d[np.arange(len(points)), at]


def _axis_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            m = np.stack(b["v"].to_list()).astype(np.float64)
            yield pd.DataFrame({"axis": range(m.shape[1]), "low": m.min(0), "high": m.max(0), "total": m.sum(0), "squares": np.square(m).sum(0), "n": float(len(m))})


def _keyed(axes: list[int], low: np.ndarray, step: np.ndarray, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_list())[:, axes]
                b["place"] = hilbert_keys(np.clip((m - low) / step, 0, (1 << bits) - 1).astype(np.int64), bits)
                yield b[["vec_id", "v", "place"]]

    return run


def _blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), BLOCK):
            some = b.iloc[at : at + BLOCK]
            m = np.stack(some["v"].to_list()).astype(np.int64)
            known = some["vec_id"].notna().to_numpy()
            ids = some["vec_id"].fillna(0).astype(np.int64).to_numpy()
            yield pd.DataFrame({"ids": [ids.tobytes()], "known": [known.tobytes()], "m": [m.tobytes()], "low": [m.min(0)], "high": [m.max(0)]})


def blocks(rows: DataFrame, settle: Settled, dim: int = DIM) -> DataFrame:
    """Blocks of up to 256 vectors that are neighbours on the curve, with their boxes: the zone map.

    The curve runs through the axes along which the vectors vary most. Equal
    vectors share a place, so ids (and a hash) break the range partitioning's
    ties, and a vector that a third of all rows hold spreads over many tasks.
    """
    found = rows.mapInPandas(_axis_sums, "axis int, low double, high double, total double, squares double, n double").groupBy("axis").agg(F.min("low"), F.max("high"), F.sum("total"), F.sum("squares"), F.sum("n")).collect()
    axis, low, high, total, squares, n = (np.array(c) for c in zip(*[tuple(r) for r in found])) if found else (np.zeros(0),) * 6
    if len(axis) and max(np.abs(low).max(), np.abs(high).max()) > WIDEST:
        raise ValueError("squared distances do not fit in 64 bits")
    spread = squares - total * total / np.maximum(n, 1)
    order = np.lexsort((axis, -spread))[: min(AXES, dim)]
    step = np.maximum(high[order] - low[order], 1) / (1 << BITS)
    keyed = rows.mapInPandas(_keyed([int(a) for a in axis[order]], low[order], step, BITS), "vec_id long, v array<bigint>, place long")
    dealt = settle(keyed).repartitionByRange("place", "vec_id", F.xxhash64("v")).sortWithinPartitions("place", "vec_id")
    return settle(dealt.mapInPandas(_blocked, "ids binary, known binary, m binary, low array<bigint>, high array<bigint>"))


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.array(row.low, np.int64), np.array(row.high, np.int64)
    return np.frombuffer(row.m, np.int64).reshape(-1, len(low)), low, high


def _summed(centroids: np.ndarray):
    """Counts and sums of the vectors next to each centroid, one row a centroid and batch of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for row in batch.itertuples(index=False):
                m, low, high = _read(row)
                to, _ = nearest(m, low, high, centroids)
                np.add.at(sums, to, m)
                counts += np.bincount(to, minlength=len(centroids))
            some = np.flatnonzero(counts)
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some], "sums": list(sums[some])})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                m, low, high = _read(row)
                to, d = nearest(m, low, high, centroids)
                ids = pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")
                ids[~np.frombuffer(row.known, bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": to.astype(np.int32), "distance": d})

    return run


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; ids that repeat are ordered by their components, null ids come last."""
    head = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r.v for r in head.collect()], np.int64)


def cluster(vectors: DataFrame, *, dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: each vector's centroid after ``rounds`` rounds of exact k-means.

    Vectors are ordered along a Hilbert curve and cut into blocks with least and
    greatest components. A centroid whose least distance to a block's box is more
    than another's greatest cannot be nearest to any of its vectors; what is left
    is compared exactly, in whole numbers. Blocks are built once and stay where
    they lie: a round moves one sum per centroid and task, and only the ``k``
    centroids pass through the driver.

    Vectors of another length, null ones, and those with null or non-finite
    components take no part. Fewer vectors than ``k`` give fewer centroids; of
    equal centroids the first takes all, the others keep their place. Rows that
    repeat an id, or have none, are each assigned. An empty table gives an empty
    table. Other columns are not read. Components of 2^27 and more in size raise
    ``ValueError``.
    """
    spark = vectors.sparkSession
    settle = Settled(spark, "centroids")
    rows = settle(whole_vectors(vectors, dim, scale))
    cells = blocks(rows, settle, dim)
    centroids = first_centroids(rows, k, seed).reshape(-1, dim)
    if not len(centroids):
        centroids = np.zeros((1, dim), np.int64)  # no vector will ask for it
    with small_batches(spark, BLOCKS_A_BATCH):
        for _ in range(rounds):
            part = cells.mapInPandas(_summed(centroids), "cluster int, n long, sums array<bigint>")
            each = part.select("cluster", "n", F.posexplode("sums").alias("axis", "s")).groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            for r in each.collect():  # at most k x dim rows
                centroids[r.cluster, r.axis] = int(r.s) // r.n
        found = settle(cells.mapInPandas(_assigned(centroids), "vec_id long, cluster int, distance long"))
    each = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(i, each.get(i, 0), sum(each.values()), ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)]
    final = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, parts string")
    final = final.select("cluster", "cluster_inertia", "inertia", F.sha2("parts", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

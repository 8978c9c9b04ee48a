"""SimHash near-duplicates: fingerprints linked within a few bits, compared on vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled, components, free_name, join_labels, pair_groups, whole_groups

WIDTH, RADIUS, SEED = 4, 4, 42
#: Runs of bits that fingerprints are divided into; ``BLOCKS - RADIUS`` of them are equal in any linked pair.
BLOCKS = 6
#: Fingerprints of a bucket that are compared with each other in one go; larger buckets are split.
CHUNK = 4096
#: Small buckets are joined up to so many fingerprints, so that planes have whole words.
JOIN = 512
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """A bit is 1 if over half of the shingle hashes have it; 0 for a text without words. Signed 64 bits."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        upto = min(n, at + 65536)
        last = ends[at + width - 1 : upto + width - 1].tolist() if len(words) >= width else [len(line)]
        digests = np.frombuffer(b"".join([xxh64_digest(line[a:b], seed) for a, b in zip(starts[at:upto].tolist(), last)]), np.uint8).reshape(-1, 8)
        if len(digests) < 256:
            counts += np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(digests[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` for every row, where the text is read."""
    kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((fingerprint(t.as_py(), width, seed) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter, or whose overflow bit, says more than ``radius``."""
    more, same = over.copy(), ~over
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def close_pairs(fps: np.ndarray, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), first <= i < last, i < j, of fingerprints that differ in at most ``radius`` bits.

    Bit b of all fingerprints is one vertical plane. A query flips the planes
    where its own bit is set, which gives one difference bit a candidate; full
    adders sum two planes at a time into carry-save counters, 64 candidates a word.
    A query leaves as soon as all of its candidates are beyond the radius.
    """
    n = len(fps)
    padded = np.zeros(-n % 64 + n, np.uint64)
    padded[:n] = fps.view(np.uint64)
    planes = [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(64)]
    rows = np.arange(first, last)
    columns = np.arange(len(padded))
    shape = (len(rows), len(padded) // 64)
    # candidates up to the query itself, and the padding, count as beyond the radius from the start
    out = np.packbits((columns[None, :] <= rows[:, None]) | (columns[None, :] >= n), axis=1, bitorder="little").view(np.uint64)
    counter = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = out
    flips = fps[first:last].view(np.uint64)
    for b in range(0, 64, 2):
        d1, d2 = (planes[k][None, :] ^ np.where(flips >> np.uint64(k) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None] for k in (b, b + 1))
        half = d1 ^ d2
        carry = (d1 & d2) | (half & counter[0])
        counter[0] ^= half
        for k in range(1, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 6:
            over = _exceeds(counter, over, radius)
            alive = (over != ~np.uint64(0)).any(axis=1)
            if not alive.any():
                return rows[:0], rows[:0]
            if alive.mean() < 0.7:
                rows, flips, over, counter = rows[alive], flips[alive], over[alive], [c[alive] for c in counter]
    i, j = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that has links within ``fps``, with the least one it is connected to: n - 1 rows at most."""
    fps = np.unique(fps)
    label = np.arange(len(fps))
    step = max(16, 2**22 // max(1, len(fps)))
    for at in range(0, len(fps), step):
        a, b = close_pairs(fps, at, min(len(fps), at + step), radius)
        label = join_labels(label, a, b)
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _band_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - radius`` bit runs; a linked pair agrees in one of them at least."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    runs = [F.shiftrightunsigned(fp, edge[k]).bitwiseAND(2 ** (edge[k + 1] - edge[k]) - 1) for k in range(blocks)]
    return F.array(*(F.xxhash64(F.lit(i), *(runs[k] for k in pick)) for i, pick in enumerate(combinations(range(blocks), blocks - radius))))


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges ``u, v`` that connect just the fingerprints ``fp`` (distinct) within ``radius`` bits of each other.

    Buckets hold the fingerprints with equal bit runs. A bucket over 4,096 is split:
    every pair of its parts is compared in a task of its own, so no bucket is one
    task however large. A task returns a forest, not its pairs.
    """
    rows = fps.select("fp", F.explode(_band_keys(F.col("fp"), radius, blocks)).alias("key"))
    groups = pair_groups(rows, "key", "fp", CHUNK).select("fp", "g").repartition("g").sortWithinPartitions("g")
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1, JOIN):
            u, v = _forest(t.column(0).to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=kinds)

    return groups.mapInArrow(run, "u bigint, v bigint")


def simhash_components(docs: DataFrame, *, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest ``doc_id`` that links lead to.

    Equal fingerprints are one node, so a group of exact copies costs one
    comparison. Only fingerprints and ids are shuffled. Every link within the
    radius counts: ``blocks`` runs of bits of which ``radius`` at most can differ.

    A null or empty text, or one of blanks, has fingerprint 0, linked like any
    other. A null ``doc_id`` keeps its row; a component of null ids alone has a
    null ``component_id``. Repeated rows stay. An empty table gives an empty table;
    other columns are not read.
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must be over 0 and below blocks")
    settle = Settled(docs.sparkSession, "simhash")
    fps = settle(fingerprints(docs, width, seed))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = components(linked_fingerprints(nodes.select("fp"), radius, blocks), settle)
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The document of each component whose id names it; rows without an id stay, repeated rows become one.

    Null and blank texts share the fingerprint zero and are one component. All
    columns come back as they were, whatever their names.
    """
    name = free_name(docs, "stays")
    found = simhash_components(docs, **how).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    stay = docs.join(found, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where("doc_id is null"))

"""Quality classifier: an additive model of lookup tables with pairwise interactions."""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import free_name

#: Labelled rows that the model is fitted on, at most: the least by hash of the id.
MAX_TRAIN = 20_000
#: One row in FOLDS is held out; a document counts as good from CUT.
FOLDS, CUT = 5, 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 150, 60, 0.1

FEATURES = (
    "log_words", "word_chars", "long_word", "upper_share", "digit_share", "stop_share", "symbol_share", "title_share", "distinct_share",
    "top_share", "adjacent_share", "pair_share", "sentence_words", "line_words", "line_repeat_share", "short_share",
)
_UPPER, _DIGIT, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?"
_LETTER = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOL = bytes(c for c in range(128) if c not in _LETTER + _DIGIT + _STOP + _BLANK)


def features(text: str | None) -> tuple[float, ...]:
    """Numbers about the whole text, in the order of FEATURES; neither language, source nor id is among them."""
    text = text or ""
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return (0.0,) * len(FEATURES)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    return (
        math.log1p(n),
        float(lengths.mean()),
        math.log1p(float(lengths.max())),
        share(_UPPER),
        share(_DIGIT),
        share(_STOP),
        share(_SYMBOL),
        sum(map(str.istitle, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        math.log1p(n / (1 + raw.count(b". ") + raw.count(b".\n"))),
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        float((lengths <= 3).mean()),
    )


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether the row is kept from training: crc32 of the id as text leaves 0. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass
class Model:
    """Edges of the bins of each feature, its table, and tables of pairs over coarser bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the looked-up terms, whole columns at a time."""
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        rough = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[rough[a], rough[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray, depth: int, out: np.ndarray, lo: int, hi: int, least: float = 1.0) -> None:
    """A tree of ``depth`` over bins lo..hi, written as the Newton step of each bin's leaf."""
    G, H = g[lo:hi].sum(), h[lo:hi].sum()
    out[lo:hi] = G / (H + least)
    if not depth or hi - lo < 2:
        return
    left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    gain = left_g**2 / (left_h + least) + (G - left_g) ** 2 / (H - left_h + least)
    gain[(left_h < 0.5) | (H - left_h < 0.5)] = -1.0
    k = int(gain.argmax())
    if gain[k] > G * G / (H + least) + 1e-9:
        _split(g, h, depth - 1, out, lo, lo + k + 1)
        _split(g, h, depth - 1, out, lo + k + 1, hi)


def _cross(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quadrants: its gain and the Newton step of every cell."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = -1.0, np.zeros_like(g)
    for i, j in ((i, j) for i in range(1, g.shape[0]) for j in range(1, g.shape[1])):
        quads = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, g.shape[0])) for c, d in ((0, j), (j, g.shape[1]))]
        sums = [(cg[r.stop, s.stop] - cg[r.start, s.stop] - cg[r.stop, s.start] + cg[r.start, s.start], ch[r.stop, s.stop] - ch[r.start, s.stop] - ch[r.stop, s.start] + ch[r.start, s.start]) for r, s in quads]
        gain = sum(a * a / (b + least) for a, b in sums)
        if gain > best:
            best = gain
            for quad, (a, b) in zip(quads, sums):
                step[quad] = a / (b + least)
    return best, step


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosting that cycles over the features, one tree of depth 2 a turn, then over the strongest pairs.

    Each tree sees one feature (or one pair) and is added to that term's table, so
    what is learned is a table per term. Without labels of both classes the model
    is its base rate (one half if there are none).
    """
    n, d = x.shape if x.size else (0, len(FEATURES))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model([_cuts(x[:, k], BINS) if n else np.zeros(0) for k in range(d)], [_cuts(x[:, k], PAIR_BINS) if n else np.zeros(0) for k in range(d)], [], [], [], math.log(rate / (1 - rate)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    raw = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = np.zeros(len(table))
            _split(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)), 2, step, 0, len(table))
            table += RATE * step
            raw += RATE * step[bins[k]]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return np.bincount(rough[a] * shape[1] + rough[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_cross(grid(a, b, g), grid(a, b, h))[0], (a, b)) for a, b in combinations(range(d), 2)), reverse=True)
    model.pairs = [pair for _, pair in gains[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            gain, step = _cross(grid(a, b, g), grid(a, b, h))
            if gain > 0:
                table += RATE * step
                raw += RATE * step[rough[a], rough[b]]
    return model


def _numbers(batch: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in batch], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model:
    """The model of ``labels.quality``, from rows that are not held out and at most ``max_train`` of them.

    Null and other values than 0 and 1 are no labels; an id with both is left out.
    The bound is on labelled ids, which are few enough to be broadcast; only their
    features, 16 numbers each, reach the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most")
    known = known.select("doc_id", "y").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_train)
    names = [f"f{k}" for k in range(len(FEATURES))]
    kinds = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), *((c, pa.float64()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in _numbers(b.column(2)).T)], schema=kinds)

    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known.select(F.col("doc_id").cast("long"), F.col("y").cast("double"))), "doc_id").select("doc_id", "y", "text")
    rows = found.mapInArrow(run, f"doc_id bigint, y double, {', '.join(f'{c} double' for c in names)}").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return train(rows[names].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, from 0 to 1, added (or replaced).

    A null or empty text has all features 0 and is scored like any other. Null and
    repeated ids, and further columns, pass through. An empty table gives an empty
    table.
    """
    rows = docs.drop(column)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))))

    return rows.withColumn(column, scored("text"))


def keep_good(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, **how) -> DataFrame:
    """The documents that score ``cut`` or more, as they are; null and empty texts are scored like any other."""
    name = free_name(docs, "score")
    scored = score_documents(docs, fit(docs, labels, **how), name)
    return scored.where(F.col(name) >= cut).drop(name)

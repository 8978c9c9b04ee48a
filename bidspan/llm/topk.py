"""Exact top-k search by histogram selection: find each query's k-th score, then keep what reaches it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled, small_batches

K, SCALE = 5, 256
#: Bins of one histogram; every round narrows each query's range by this factor.
BINS = 512
#: Vectors packed into one row, queries of one block, and pairs of the two that a task is handed at a time.
PACK, QUERY_PACK, PAIRS_A_BATCH = 1024, 512, 8
#: Packs that one task holds while the blocks of queries stream past.
PACKS_A_DEAL = 128


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, v``: components as floor(scale * x) in doubles; other vectors are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", x.alias("x")).where(sound)
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _bytes(v: pd.Series) -> bytes:
    """Components as the narrowest whole numbers that hold them: 16 or 32 bits, as squares stay below 2^62."""
    m = np.stack(v.to_list())
    return m.astype(np.int16 if not m.size or np.abs(m).max() < 2**15 else np.int32).tobytes()


def _pack(rows: DataFrame, names: str, size: int) -> DataFrame:
    """Vectors of one length as one row: ``dim`` and, in ``names``, their ids and components as bytes.

    Packed where they lie, at most ``size`` to a row, so nothing is shuffled.
    """
    ids, m = names.split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, found in batch.groupby("dim"):
                for at in range(0, len(found), size):
                    some = found.iloc[at : at + size]
                    yield pd.DataFrame({"dim": [dim], ids: [some["vec_id"].to_numpy(np.int64).tobytes()], m: [_bytes(some["v"])]})

    return rows.select("vec_id", "dim", "v").mapInPandas(run, f"dim int, {ids} binary, {m} binary")


def _blocks_of(asked: DataFrame) -> DataFrame:
    """``dim, block, qids, q``: the queries of a block by id, their ids and components as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"dim": [row.dim], "block": [row.block], "qids": [np.asarray(row.qids, np.int64).tobytes()], "q": [_bytes(pd.Series(list(row.v)))]})

    held = asked.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("a"))
    return held.select("dim", "block", F.col("a.vec_id").alias("qids"), F.col("a.v").alias("v")).mapInPandas(run, "dim int, block int, qids binary, q binary")


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats or doubles where these hold every sum, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (q.astype(kind) @ m.T.astype(kind)).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, bins: int = BINS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every query row, ties to smaller ids.

    Vectors are packed into rows of some hundred and dealt over the tasks; the
    blocks of queries are sent to every deal and stream past the packs that lie
    there, the stated query set against all rows. Each round scores everything, counts scores in a histogram of each
    query's current range, adds the histograms up over all tasks and narrows the
    range to the bin that holds the k-th score, until a bin is one integer wide.
    Of a histogram a task sends the bins from its own k-th score up: the k-th of
    all is not below it. A last pass keeps scores above the k-th, and of those
    equal to it, in each deal, only the smallest ids that can still be needed, so ties of any number
    are neither dropped wrongly nor gathered. No scores are stored or collected,
    and the copies of the queries are never broadcast.

    Vectors that are null, or hold null or non-finite components, take no part,
    and so do null ids. Only vectors of equal length are compared. A query with
    fewer candidates than ``k`` returns all. Rows that repeat an id are candidates
    each, except for queries of their own id; repeated queries are one query, the
    first by its components. An empty table gives an empty table; other columns
    are not read. Products of 2^62 and above raise an error.
    """
    spark = vectors.sparkSession
    settle = Settled(spark, "topk")
    rows = settle(quantised(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    n_rows, n_queries, widest = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    bound = int(widest or 0.0) + 1
    if bound >= 2**62:
        raise ValueError("integer products do not fit in 64 bits")
    span = 1
    while span <= 2 * bound:
        span *= bins
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    blocks = max(1, -(-n_queries // QUERY_PACK))
    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    queries = settle(_blocks_of(asked))
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // (PACK * PACKS_A_DEAL)))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(deals)).cast("int")
    packs = settle(_pack(rows, "ids m", PACK).withColumn("deal", deal))
    state = settle(asked.select("dim", "block", F.col("vec_id").alias("query_id"), F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need")))
    settle.drop(rows)

    with small_batches(spark, PAIRS_A_BATCH):
        while span > 1:
            width = span // bins
            histograms = _met(queries, state, packs, deals).mapInArrow(_counter(width, bins), "query_id long, bin int, n long")
            counts = histograms.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
            above = "coalesce(sum(n) over (partition by query_id order by bin desc rows between unbounded preceding and 1 preceding), 0)"
            ranked = counts.withColumn("above", F.expr(above)).join(state.hint("merge"), "query_id").where("above < need and above + n >= need")
            found = ranked.select(
                "query_id", (F.col("low") + F.col("bin").cast("long") * F.lit(width).cast("long")).alias("low_"), (F.col("need") - F.col("above")).alias("need_")
            )
            # fewer candidates than needed: all count, so the range stays at its lower end
            after = state.join(found.hint("merge"), "query_id", "left").select("dim", "block", "query_id", F.coalesce("low_", "low").alias("low"), F.coalesce("need_", "need").alias("need"))
            after = settle(after)
            settle.drop(state)
            state, span = after, width
        hits = settle(_met(queries, state, packs, deals).mapInArrow(_keeper(), "query_id long, vec_id long, score long"))
    for table in (asked, queries, packs, state):
        settle.drop(table)
    ranked = hits.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _met(queries: DataFrame, state: DataFrame, packs: DataFrame, deals: int) -> DataFrame:
    """Every block of queries beside every pack of its dimension: ``dim, block, deal, qids, q, low, need, ids, m``.

    An equi-join on dimension and deal, never on rows. It is a merge join by name:
    Spark's size check sees the blocks before they are copied to the deals, and
    would gather the copies on the driver. Blocks stream, the packs of a deal wait.
    """
    now = state.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("query_id", "low", "need"))).alias("s"))
    asked = queries.join(now.hint("merge"), ["dim", "block"]).select("dim", "block", "qids", "q", F.col("s.low").alias("low"), F.col("s.need").alias("need"))
    copies = asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    met = copies.hint("merge").join(packs, ["dim", "deal"])
    return met.select("dim", "block", "deal", "qids", "q", "low", "need", "ids", "m")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block of queries and pack: which block and deal it is, ids of queries, their limits, ids of rows, scores."""
    last, held = None, ()

    def whole(b: pa.RecordBatch, name: str, at: int, dim: int) -> np.ndarray:
        raw, ids = b.column(name)[at].as_buffer(), b.column("qids" if name == "q" else "ids")[at].as_buffer()
        n = ids.size // 8
        return np.frombuffer(raw, np.int16 if raw.size == 2 * n * dim else np.int32).reshape(n, dim)

    for b in batches:
        for at in range(b.num_rows):
            dim, block, deal = (b.column(c)[at].as_py() for c in ("dim", "block", "deal"))
            if (dim, block, deal) != last:
                last = (dim, block, deal)
                qids = np.frombuffer(b.column("qids")[at].as_buffer(), np.int64)
                held = (qids, *(b.column(c)[at].values.to_numpy() for c in ("low", "need")), whole(b, "q", at, dim))
            qids, low, need, q = held
            yield last, qids, low, need, np.frombuffer(b.column("ids")[at].as_buffer(), np.int64), _scores(q, whole(b, "m", at, dim))


def _counter(width: int, bins: int):
    """Histograms of ``bins`` bins of ``width`` from each query's lower end, summed over a deal, from its ``need``-th score up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, h, floor = None, None, None, None

        def sent() -> pa.RecordBatch:
            i, b = np.nonzero(h)
            upper = b >= floor[i]
            i, b = i[upper], b[upper]
            return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(b.astype(np.int32)), pa.array(h[i, b])], names=["query_id", "bin", "n"])

        for key, qids, low, need, ids, s in _pairs(batches):
            if key != last:
                if last is not None:
                    yield sent()
                last, names, h, floor = key, qids, np.zeros((len(qids), bins), np.int64), np.zeros(len(qids), np.int64)
            s -= low[:, None]
            i, j = np.nonzero((s >= (floor * width)[:, None]) & (s < width * bins))
            other = qids[i] != ids[j]
            i, j = i[other], j[other]
            h += np.bincount(i * bins + s[i, j] // width, minlength=h.size).reshape(h.shape)
            # the highest bin that, with those above it, holds as many scores as are needed
            enough = np.cumsum(h[:, ::-1], axis=1) >= need[:, None]
            floor = np.where(enough[:, -1], bins - 1 - enough.argmax(axis=1), 0)
        if last is not None:
            yield sent()

    return run


def _keeper():
    """Scores above the k-th, and the ``need`` smallest ids of those equal to it, in each deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, limit, even = None, None, None, []

        def sent(i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (names[i], ids, s)], names=["query_id", "vec_id", "score"])

        def least(parts: list[tuple]) -> tuple:
            """The smallest ids of each query, as many as it needs."""
            i, ids, s = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((ids, i))
            i, ids, s = i[order], ids[order], s[order]
            begins = np.searchsorted(i, i)
            fits = np.arange(len(i)) - begins < limit[i]
            return i[fits], ids[fits], s[fits]

        for key, qids, low, need, ids, s in _pairs(batches):
            if key != last:
                if even:
                    yield sent(*least(even))
                last, names, limit, even = key, qids, need, []
            i, j = np.nonzero(s >= low[:, None])
            other = qids[i] != ids[j]
            i, j = i[other], j[other]
            found = s[i, j]
            more = found > low[i]
            yield sent(i[more], ids[j[more]], found[more])
            if not more.all():
                even = [least([*even, (i[~more], ids[j[~more]], found[~more])])]
        if even:
            yield sent(*least(even))

    return run

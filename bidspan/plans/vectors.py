"""Nearest neighbours: exact scans that keep only k rows per task, and cells around centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspan.functions import vectors as vx
from bidspan.operators import windows
from bidspan.session import settle

#: Request vectors that one pass over the stored vectors compares.
QUERIES_PER_PASS = 1024
#: Vectors that centroids are fitted on, at most: the least by hash of the id.
FIT_SAMPLE = 10_000


def model_guard(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors of one model; a wrong dimension fails the query instead of ranking nonsense."""
    size = F.size("embedding")
    message = F.concat(F.lit(f"vector of {dim} numbers expected, got "), size.cast("string"))
    checked = F.when(size == dim, F.col("embedding")).otherwise(F.raise_error(message))
    return vectors.filter(F.col("model") == model).withColumn("embedding", checked)


def normalised(vectors: DataFrame) -> DataFrame:
    """Unit vectors; a zero vector has no direction and is left out."""
    length = vx.norm(F.col("embedding"))
    scaled = F.transform("embedding", lambda x: x.cast("double") / F.col("_len"))
    return vectors.withColumn("_len", length).filter(F.col("_len") > 0).withColumn("embedding", scaled).drop("_len")


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, bool]]:
    """Request vectors in blocks of bounded size, unit length, and whether it is the only block.

    Queries are what one request asks (a vector, or a dozen themes). A larger set
    is not refused or cut: it becomes several blocks, one exact pass each, of
    which the driver holds one at a time.
    """
    blocks = max(1, math.ceil(queries.count() / QUERIES_PER_PASS))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = [r for r in part.select("query_id", "embedding").collect() if r["embedding"] is not None]
        if rows:
            matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            yield [r["query_id"] for r in rows], matrix, blocks == 1


def _local_hits(ids: list, matrix: np.ndarray, k: int | None, limit: float | None, item: str, owner: str | None, probes: list[np.ndarray] | None, each: int = 1):
    """Per task: distances of each batch to all queries, keeping a running top k per query.

    Everything tied with the k-th distance is kept, so the final cut by
    (distance, item) sees every row that could belong to it. With ``owner`` each
    batch keeps the ``each`` best items of an owner only. ``probes`` are the cells that each
    query looks into.
    """

    def shrink(best: pd.DataFrame) -> pd.DataFrame:
        if k is None:
            return best
        edge = best.groupby("query_id")["distance"].transform(lambda d: d.nsmallest(k).iloc[-1])
        return best[best["distance"] <= edge]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = []
        held = 0
        for pdf in batches:
            if pdf.empty:
                continue
            v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            length = np.linalg.norm(v, axis=1)
            usable = length > 0
            v, keys = v[usable] / length[usable, None], pdf[item].to_numpy()[usable]
            owners = pdf[owner].to_numpy()[usable] if owner else None
            cells = pdf["cell"].to_numpy()[usable] if probes is not None else None
            dist = 1.0 - v @ matrix.T
            for j, query in enumerate(ids):
                d = dist[:, j]
                keep = np.ones(len(d), dtype=bool) if limit is None else d < limit
                if cells is not None:
                    keep &= np.isin(cells, probes[j])
                if k is not None and keep.sum() > k:
                    keep &= d <= np.partition(d[keep], k - 1)[k - 1]
                at = np.flatnonzero(keep)
                if owners is not None and len(at):
                    at = at[np.lexsort((keys[at], d[at], owners[at]))]
                    new = np.concatenate(([True], owners[at][1:] != owners[at][:-1]))
                    place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                    at = at[place < each]
                if len(at):
                    best.append(pd.DataFrame({"query_id": query, item: keys[at], **({owner: owners[at]} if owner else {}), "distance": d[at]}))
                    held += len(at)
            if k is None:
                yield from best
                best, held = [], 0
            elif held > 4 * k * len(ids):
                best = [shrink(pd.concat(best))]
                held = len(best[0])
        if best:
            yield shrink(pd.concat(best))

    return run


def distances(
    vectors: DataFrame, queries: DataFrame, item: str, k: int | None, limit: float | None = None, owner: str | None = None, each: int = 1
) -> DataFrame:
    """(query_id, item, distance) of each query's candidates, exact.

    With ``k`` a task returns its k nearest (and ties) per query; the caller ranks
    them. With ``k`` None every row strictly under ``limit`` is returned, all rows
    if that is None too. ``owner`` (``k`` None only) adds that column and returns
    the ``each`` nearest items of each owner; batches are reduced in the scan, the caller
    reduces across them.
    """
    if owner and k is not None:
        raise ValueError("a cut before the best item of each owner would lose owners")
    types = dict(vectors.dtypes)
    carried = [owner] if owner else []
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {item} {types[item]}, {''.join(f'{c} {types[c]}, ' for c in carried)}distance double"
    slim = vectors.select(item, *carried, "embedding").filter(F.col("embedding").isNotNull())
    out = None
    for ids, matrix, only in _query_blocks(queries):
        made = slim.mapInPandas(_local_hits(ids, matrix, k, limit, item, owner, None, each), schema)
        made = made if only else settle(made, "distances")
        out = made if out is None else out.unionByName(made)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int, limit: float | None = None, item: str = "item_id") -> DataFrame:
    """k nearest per query by (distance, item), with ``rank``."""
    hits = distances(vectors, queries, item, k, limit)
    return windows.topn_per_group(hits, ["query_id"], [F.col("distance"), F.col(item)], k)


def under_limit(vectors: DataFrame, queries: DataFrame, limit: float, item: str = "item_id") -> DataFrame:
    return distances(vectors, queries, item, None, limit)


def counts_under(vectors: DataFrame, queries: DataFrame, thresholds: Sequence[float], known: str) -> DataFrame:
    """``query_id, threshold, extra``: vectors nearer than each threshold that the query does not know yet.

    ``known`` is the column with the ids of the queries that found the vector by
    other means. Counted inside the scan: a task returns one row per query and
    threshold, whatever it read.
    """
    limits = np.array(sorted(thresholds), dtype=np.float64)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, threshold double, extra long"

    def counter(ids: list, matrix: np.ndarray):
        column = {q: j for j, q in enumerate(ids)}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros((len(ids), len(limits)), np.int64)
            for pdf in batches:
                if pdf.empty:
                    continue
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                length = np.linalg.norm(v, axis=1)
                new = np.repeat((length > 0)[:, None], len(ids), axis=1)
                for i, found in enumerate(pdf[known]):
                    for q in found if found is not None else ():
                        if q in column:
                            new[i, column[q]] = False
                dist = 1.0 - (v / np.where(length > 0, length, 1.0)[:, None]) @ matrix.T
                for j in range(len(ids)):
                    counts[j] += np.searchsorted(np.sort(dist[new[:, j], j]), limits, side="left")
            j, t = np.nonzero(counts)
            yield pd.DataFrame({"query_id": [ids[x] for x in j], "threshold": limits[t], "extra": counts[j, t]})

        return run

    slim = vectors.select("embedding", known).filter(F.col("embedding").isNotNull())
    parts = [vectors.sparkSession.createDataFrame([], schema)]
    for ids, matrix, only in _query_blocks(queries):
        made = slim.mapInPandas(counter(ids, matrix), schema)
        parts.append(made if only else settle(made, "counts"))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.groupBy("query_id", "threshold").agg(F.sum("extra").alias("extra"))


def full_ranking(hits: DataFrame, item: str) -> DataFrame:
    """``hits(query_id, item, distance, ...)`` with the ``rank`` of every row of its query: no cut, no one-task window."""
    ranked = windows.global_rank(hits, ["query_id", "distance", item], [True, True, True])
    first = ranked.groupBy("query_id").agg(F.min("rank").alias("_first"))
    return ranked.join(first, "query_id").withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("_first")


def fit_centroids(vectors: DataFrame, cells: int, item: str = "item_id", sample: int = FIT_SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, by spherical k-means on ``sample`` vectors at most.

    The sample is the least by hash of the id; it only shapes the cells. Every
    vector is indexed.
    """
    rows = vectors.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64(item), item).limit(sample).select("embedding").collect()
    v = np.array([r["embedding"] for r in rows], dtype=np.float64)
    length = np.linalg.norm(v, axis=1) if len(v) else np.zeros(0)
    v = v[length > 0] / length[length > 0, None]
    if not len(v):
        return np.zeros((0, 0))
    centroids = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)]
    for _ in range(rounds):
        nearest = (v @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, v)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centroids)
    return centroids


def write_cells(vectors: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Store every vector under the ``cell`` of its nearest centroid, and each cell's centroid, size and radius.

    The radius is the largest angle between the centroid and a vector of its cell;
    with it a search knows how near a cell's vectors can be without reading them.
    """

    @F.pandas_udf("struct<cell int, angle double>")
    def place(batch: pd.Series) -> pd.DataFrame:
        v = np.stack(batch.to_numpy()).astype(np.float64)
        cosines = v @ centroids.T
        cell, length = cosines.argmax(axis=1), np.linalg.norm(v, axis=1)
        best = np.divide(cosines[np.arange(len(v)), cell], length, out=np.ones(len(v)), where=length > 0)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.arccos(np.clip(best, -1.0, 1.0))})

    rows = vectors.filter(F.col("embedding").isNotNull()).withColumn("_place", place("embedding"))
    rows.select("*", "_place.*").drop("_place").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    middles = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    middles.join(sizes, "cell", "left").write.parquet(f"{path}/cells")


def reachable(angles: np.ndarray, radius: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Per query (row) and cell, whether the cell can hold a vector within the distance ``edge`` of the query."""
    least = 1.0 - np.cos(np.maximum(angles - radius, 0.0))
    return least <= edge[:, None] + 1e-9


def nearest_cells(angles: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Per query, its nearest cells, as few as hold ``k`` vectors."""
    order = np.argsort(angles, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(angles.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out


def knn_cells(
    spark: SparkSession, path: str, queries: DataFrame, k: int, limit: float | None = None, item: str = "item_id", probe: int | None = None, read: list[int] | None = None
) -> DataFrame:
    """k nearest per query by (distance, item) from a stored index, with ``rank``: exact, from the cells that can matter.

    Each query first looks into its nearest cells, as few as hold k vectors. The
    k-th distance found bounds what is left: only cells whose angle to the query,
    less their radius, is within it are read too, so vectors that cluster cost a
    part of the cells and the answer is still exact. ``probe`` looks into that many
    nearest cells instead and stops there: fewer reads, neighbours may be missed.
    ``read``, if given, receives the number of (query, cell) pairs that were read.

    Only the cells' centroids and, per query, one distance pass through the driver.
    """
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # one row a cell
    if not cells:
        raise ValueError("no vectors were indexed")
    middles = np.array([c["centroid"] for c in cells], dtype=np.float64)
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    sizes, radius = np.array([c["n"] or 0 for c in cells]), np.array([c["radius"] or 0.0 for c in cells])
    rows = spark.read.parquet(f"{path}/vectors").select(item, "embedding", "cell")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {item} {dict(rows.dtypes)[item]}, distance double"

    def look(ids: list, matrix: np.ndarray, wanted: np.ndarray) -> DataFrame:
        if read is not None:
            read.append(int(wanted.sum()))
        some = rows.filter(F.col("cell").isin(np.flatnonzero(wanted.any(axis=0)).tolist()))
        return settle(some.mapInPandas(_local_hits(ids, matrix, k, limit, item, None, [np.flatnonzero(w) for w in wanted]), schema), "distances")

    parts = [spark.createDataFrame([], schema)]
    for ids, matrix, _ in _query_blocks(queries):
        angles = np.arccos(np.clip(matrix @ middles.T, -1.0, 1.0))
        if probe is not None:
            wanted = np.zeros(angles.shape, bool)
            np.put_along_axis(wanted, np.argsort(angles, axis=1, kind="stable")[:, :probe], True, axis=1)
            parts.append(look(ids, matrix, wanted & (sizes > 0)))
            continue
        first = nearest_cells(angles, sizes, k) & (sizes > 0)
        parts.append(look(ids, matrix, first))
        ranked = windows.topn_per_group(parts[-1], ["query_id"], [F.col("distance"), F.col(item)], k)
        found = {r["query_id"]: r["edge"] for r in ranked.groupBy("query_id").agg(F.max("distance").alias("edge"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).collect()}
        edge = np.array([found.get(q, np.inf if limit is None else limit) for q in ids], dtype=np.float64)
        rest = reachable(angles, radius, edge) & (sizes > 0) & ~first
        if rest.any():
            parts.append(look(ids, matrix, rest))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return windows.topn_per_group(hits, ["query_id"], [F.col("distance"), F.col(item)], k)


def knn_chunks(chunks: DataFrame, queries: DataFrame, limit: float | None = None, k: int | None = None) -> DataFrame:
    """Nearest chunk per bid and query, bids ranked; the ``k`` best bids, or all.

    The best chunk of a bid is found before anything is cut, so no bid is crowded
    out by the chunks of another. Texts are not read here; see :func:`excerpts`.
    """
    hits = distances(chunks, queries, "chunk_id", None, limit, owner="bid_id")
    best = windows.best_row(hits, ["query_id", "bid_id"], F.struct("distance", "chunk_id"), newest=False)
    if k is None:
        return full_ranking(best, "bid_id")
    return windows.topn_per_group(best, ["query_id"], [F.col("distance"), F.col("bid_id")], k)


def excerpts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` with the text of their ``chunk_id`` as ``excerpt``; for the rows that are shown."""
    return rows.join(chunks.select("chunk_id", F.col("text").alias("excerpt")), "chunk_id", "left")


def knn_within(chunks: DataFrame, docs: DataFrame, query: DataFrame, model: str, k: int = 12, bid_id: int | None = None) -> DataFrame:
    """Nearest chunks inside a bid's active documents; filtering comes first.

    Without ``bid_id`` every bid gets its own top k for the one query.
    """
    own = chunks.filter(F.col("model") == model)
    active = docs.filter("active")
    if bid_id is not None:
        own, active = own.filter(F.col("bid_id") == bid_id), active.filter(F.col("bid_id") == bid_id)
    own = own.join(active.select("doc_id"), "doc_id", "left_semi")
    if bid_id is not None:
        return knn_exact(own, query, k, item="chunk_id")
    hits = distances(own, query, "chunk_id", None, owner="bid_id", each=k)
    return windows.topn_per_group(hits, ["query_id", "bid_id"], [F.col("distance"), F.col("chunk_id")], k)


def knn_multi_query(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """Top k chunks of every theme, one evidence row per chunk (its best theme)."""
    hits = knn_exact(chunks, queries, k, item="chunk_id").drop("rank")
    info = chunks.select("chunk_id", "doc_id", "ord", F.col("text").alias("excerpt"))
    evidence = hits.withColumnRenamed("chunk_id", "evidence_id").join(
        info.withColumnRenamed("chunk_id", "evidence_id"), "evidence_id"
    )
    return windows.evidence_dedup(evidence)


def embed(texts: DataFrame, column: str, vectorise: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """Attach ``embedding`` made by a caller-supplied function, called with small batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            made: list = []
            values = series.fillna("").tolist()
            for i in range(0, len(values), batch):
                made.extend(vectorise(values[i : i + batch]))
            yield pd.Series(made)

    return texts.withColumn("embedding", run(F.col(column)))


def fake_vectoriser(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for tests: equal texts give equal unit vectors."""
    import hashlib

    def one(text: str) -> list[float]:
        raw = np.array([hashlib.sha256(f"{i}:{text}".encode()).digest()[0] / 255 - 0.5 for i in range(dim)])
        return (raw / np.linalg.norm(raw)).astype(np.float32).tolist()

    return lambda texts: [one(t) for t in texts]


def fuse_rrf(rankings: list[tuple[DataFrame, float]], k: int = 60, key: str = "bid_id") -> DataFrame:
    """Weighted reciprocal rank fusion over any number of rankings.

    ``(key, rrf_score)``: rank lists are united and summed once, whatever their
    number. A ranking may carry ``chunk_id`` and counts as semantic when it has
    a ``distance``.
    """
    united = None
    kind = next((dict(df.dtypes)["chunk_id"] for df, _ in rankings if "chunk_id" in df.columns), "bigint")
    for df, weight in rankings:
        part = df.select(
            key,
            (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("_part"),
            F.lit("distance" in df.columns).alias("_semantic"),
            (F.col("chunk_id") if "chunk_id" in df.columns else F.lit(None)).cast(kind).alias("chunk_id"),
        )
        united = part if united is None else united.unionByName(part)
    return united.groupBy(key).agg(
        F.sum("_part").alias("rrf_score"), F.bool_or("_semantic").alias("semantic"), F.max("chunk_id").alias("chunk_id")
    )

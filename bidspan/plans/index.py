"""Text index and relevance: tokens, postings, BM25, term and phrase predicates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspan.functions import classify
from bidspan.functions import text as tx
from bidspan.session import settle

# --- fixed values: words that carry no meaning for search --------------------
STOP_WORDS = [
    "a", "ao", "aos", "as", "com", "como", "da", "das", "de", "do", "dos", "e", "em", "entre", "na", "nas", "no",
    "nos", "o", "os", "ou", "para", "pela", "pelas", "pelo", "pelos", "por", "que", "se", "sem", "sob", "sobre",
    "um", "uma",
]
# --- fixed values: endings a stem drops, longest first -----------------------
SUFFIXES = [
    "amentos", "imentos", "amento", "imento", "adores", "adoras", "idades", "adora", "idade", "acoes", "mente",
    "ador", "acao", "ezas", "icas", "icos", "eza", "ica", "ico", "oes", "ais", "eis", "ares", "ao", "as", "os",
    "es", "a", "e", "o", "s",
]
STEM_PATTERN = "^(.{3,}?)(" + "|".join(SUFFIXES) + ")$"
MIN_STEM = 3
_STOPS, _STEM = frozenset(STOP_WORDS), re.compile(STEM_PATTERN)
BM25_K1, BM25_B = 1.2, 0.75


def stem(token: Column) -> Column:
    """``STEM_PATTERN`` applied to a word: its longest listed ending dropped, at least 3 letters kept.

    Written as set lookups by ending length, which cost a fraction of the
    backtracking pattern on every word of a corpus.
    """
    out = None
    for size in sorted({len(s) for s in SUFFIXES}, reverse=True):
        fits = (F.length(token) >= size + MIN_STEM) & F.substring(token, -size, size).isin([s for s in SUFFIXES if len(s) == size])
        cut = F.substring(token, F.lit(1), F.length(token) - size)
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(token)


def words(text: Column, fold_accents: bool = True) -> Column:
    """All words in order; blanks and punctuation separate."""
    base = tx.fold(text) if fold_accents else F.lower(text)
    splitter = "[^a-z0-9]+" if fold_accents else r"[^\p{L}0-9]+"
    return F.filter(F.split(base, splitter), lambda t: t != "")


def tokens(text: Column, fold_accents: bool = True) -> Column:
    """Stemmed words without stop words."""
    kept = F.filter(words(text, fold_accents), lambda t: ~t.isin(STOP_WORDS))
    return F.transform(kept, stem)


def query_tokens(term: str) -> list[str]:
    """The same reduction for a request's term, on the driver."""
    found = [w for w in re.split("[^a-z0-9]+", classify.plain_fold(term)) if w and w not in STOP_WORDS]
    return [re.sub(STEM_PATTERN, r"\1", w) for w in found]


def has_all(tokens_: Column, terms: Sequence[str]) -> Column:
    cond = F.lit(bool(terms))
    for t in terms:
        cond = cond & F.array_contains(tokens_, t)
    return cond


def fulltext(text: Column, term: str, fold_accents: bool = True) -> Column:
    """Every word of the term occurs, after stemming.

    A stem is always a prefix of its word, so a matching text contains each stem
    literally; that cheap test runs first and spares most rows the stemming.
    """
    terms = query_tokens(term)
    base = tx.fold(text) if fold_accents else F.lower(text)
    possible = F.lit(True)
    for t in terms:
        possible = possible & F.contains(base, F.lit(t))
    return possible & has_all(tokens(text, fold_accents), terms)


def phrase(text: Column, wanted: str) -> Column:
    """The words of the phrase stand next to each other, after stemming."""
    line = F.concat(F.lit(" "), F.array_join(F.transform(words(text), stem), " "), F.lit(" "))
    return F.contains(line, F.lit(" " + " ".join(_stems(wanted)) + " "))


def _stems(wanted: str) -> list[str]:
    """Stemmed words of a phrase, stop words included, on the driver."""
    return [re.sub(STEM_PATTERN, r"\1", w) for w in re.split("[^a-z0-9]+", classify.plain_fold(wanted)) if w]


def all_any_none(text: Column, all_: Sequence[str] = (), any_: Sequence[str] = (), none: Sequence[str] = (), phrase_: str = "") -> Column:
    """Web-style search given as lists instead of a query string.

    As in :func:`fulltext`, texts without the stems themselves are told first.
    """
    row = tokens(text)
    one = lambda w: has_all(row, query_tokens(w))

    def possible(base: Column) -> Column:
        held = lambda terms: reduce(and_, [F.contains(base, F.lit(t)) for t in terms], F.lit(True))
        some = reduce(or_, [held(query_tokens(w)) for w in any_], F.lit(not any_))
        return reduce(and_, [held(query_tokens(w)) for w in all_], some) & held(_stems(phrase_))

    cond = tx.let(tx.fold(text), possible)
    for w in all_:
        cond = cond & one(w)
    if any_:
        hit = F.lit(False)
        for w in any_:
            hit = hit | one(w)
        cond = cond & hit
    for w in none:
        cond = cond & ~one(w)
    if phrase_:
        cond = cond & phrase(text, phrase_)
    return cond


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(token, key, length, tf, positions): one row per token and document.

    A document is one row, so its tokens are grouped inside it: building
    the index shuffles nothing, and no token, however common, meets in one
    task. The document length rides along, so scoring needs no join back.
    """
    return _exploded(_grouped_documents(docs, key, text), key)


#: Words of texts grouped together; words whose stems a task remembers.
WORDS_AT_ONCE, KNOWN = 500_000, 200_000


def _grouped_documents(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, length, groups): a document's tokens with their positions, one group a token.

    Words are split in the JVM. Each distinct one of a batch is stemmed once, and
    numbers, not words, are sorted, which costs a fraction of lambdas over arrays.
    """
    groups = "array<struct<token:string,positions:array<int>>>"
    out = docs.select(key, F.lit(None).cast("int").alias("length"), F.lit(None).cast(groups).alias("groups")).schema
    listed = pa.list_(pa.struct([("token", pa.string()), ("positions", pa.list_(pa.int32()))]))

    def grouped(b: pa.RecordBatch, known: dict[str, str | None]) -> pa.RecordBatch:
        texts = b.column(1)
        sizes = texts.value_lengths().fill_null(0).to_numpy()
        words_ = texts.flatten().dictionary_encode()
        distinct = words_.dictionary.to_pylist()
        for w in distinct:
            if w not in known:
                known[w] = None if w in _STOPS else _STEM.sub(r"\1", w)
        names = sorted({known[w] for w in distinct} - {None})
        number = {None: -1} | {n: i for i, n in enumerate(names)}
        token = np.array([number[known[w]] for w in distinct], np.int64)[words_.indices.to_numpy()]
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = token >= 0
        row, token, place = row[kept], token[kept], place[kept]
        order = np.argsort(row * len(names) + token, kind="stable")
        row, token, place = row[order], token[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])))) if len(row) else np.zeros(0, np.int64)
        positions = pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), place.astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(token[first])), positions], names=["token", "positions"])
        lengths, held = np.bincount(row, minlength=len(sizes)), np.bincount(row[first], minlength=len(sizes))
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(held)).astype(np.int32), pairs).cast(listed)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths.astype(np.int32), mask=texts.is_null().to_numpy(zero_copy_only=False)), lists], names=[key, "length", "groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for b in batches:
            stretch = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy()) // WORDS_AT_ONCE
            edges = [0, *(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                if len(known) > KNOWN:
                    known.clear()
                yield grouped(b.slice(i, j - i), known)

    return docs.select(key, words(text).alias("_w")).mapInArrow(run, out)


def _exploded(grouped: DataFrame, key: str) -> DataFrame:
    rows = grouped.select(key, "length", F.explode("groups").alias("_g"))
    return rows.select("_g.token", key, "length", F.size("_g.positions").cast("long").alias("tf"), "_g.positions")


def collection_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size(tokens(text))).alias("mean_length"))


#: Postings that one task sorts when an index is written; more of them are more tasks, so the memory of one does not grow.
POSTINGS_A_TASK = 500_000


class TextIndex:
    """A stored index: postings in token order, and the collection's figures in one row.

    Texts are tokenised once, when it is written. A query's tokens are filters of
    the postings' scan, which skips files by their token ranges; no text is read.
    The range key includes the document, so a very common token spans files.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def write(cls, docs: DataFrame, key: str, text: Column, path: str) -> TextIndex:
        index = cls(docs.sparkSession, path, key)
        grouped = settle(_grouped_documents(docs, key, text), "tokens")
        grouped.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length")).write.parquet(f"{index.path}/stats")
        rows = _exploded(grouped, key)
        held = grouped.agg(F.sum(F.size(F.coalesce("groups", F.array().cast(grouped.schema["groups"].dataType))))).first()[0] or 0
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // POSTINGS_A_TASK))
        rows.repartitionByRange(tasks, "token", key).sortWithinPartitions("token", key).write.parquet(f"{index.path}/postings")
        return index

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def rank(self, terms: Sequence[str]) -> DataFrame:
        return rank_text(self.postings, self.stats, self.key, terms)


def rank_text(postings_: DataFrame, stats: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """BM25 score per document holding at least one term; ``(key, score, matched)``."""
    wanted = sorted(set(terms))
    hits = postings_.filter(F.col("token").isin(wanted))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))  # one row per term
    n, mean = stats.select("docs").scalar(), stats.select("mean_length").scalar()
    idf = F.log(1 + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    damp = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / mean)
    part = idf * F.col("tf") * (BM25_K1 + 1) / damp
    scored = hits.join(F.broadcast(df), "token")  # bounded by the number of terms in the request
    return scored.groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))


def term_semi_join(docs: DataFrame, postings_: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Documents holding every term, through the index instead of the texts."""
    wanted = sorted(set(terms))
    hits = postings_.filter(F.col("token").isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    return docs.join(hits.filter(F.col("_m") == len(wanted)).select(key), key, "left_semi")

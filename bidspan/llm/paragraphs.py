"""Substring deduplication: paragraphs whose MinHash bands collide, verified, clustered and removed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled, components, join_labels, pair_groups, whole_groups

#: Words of a shingle, and the Jaccard similarity from which paragraphs are copies.
WIDTH, SIMILAR = 5, 0.8
#: Words of a paragraph. One starts in any STEP + 2 words in a row, so a passage of LENGTH + STEP + 2 words holds a whole one.
LENGTH, STEP = 24, 24
#: Contents of a band that are compared in one go; small bands are joined up to as many.
CHUNK = 256
#: Bytes of text that are cut in one go.
SLICE = 1 << 18
_MIX = np.random.default_rng(20).integers(1, 2**63, (6, 2), dtype=np.int64).astype(np.uint64) | np.uint64(1)


_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words of the whole text: polynomials in their bytes, mixed."""
    return _words_at(_lowered(text))[0]


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _words_at(lowered: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the bytes they start at."""
    raw = np.frombuffer(lowered, np.uint8)
    visible = ~_BLANK[raw]
    begins = visible.copy()
    begins[1:] &= ~visible[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    raw, visible, first = raw[starts[0] :], visible[starts[0] :], starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    longest = int(place.max()) + 1
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _POWERS[0], np.uint64))
    return _mixed(np.add.reduceat(np.where(visible, raw + np.uint64(1), np.uint64(0)) * powers[place], first), _MIX[1]), starts


def _mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * by[0]
    return (h ^ (h >> np.uint64(32))) * by[1]


def _fold(columns: Iterator[np.ndarray], n: int) -> np.ndarray:
    """One hash of the columns, row by row."""
    out = np.zeros(n, np.uint64)
    for c in columns:
        out = (out + c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _run_hash(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(words) - width + 1
    return _fold((words[k : k + n] for k in range(width)), n)


def paragraph_starts(words: np.ndarray) -> np.ndarray:
    """Where paragraphs start: the least of every STEP neighbouring three-word hashes.

    The choice looks at the words alone, so a passage is cut alike wherever it
    stands, in the middle of a line too. Every paragraph is LENGTH words long;
    a shorter text is one paragraph, unless it is shorter than a shingle.
    """
    if len(words) < LENGTH:
        return np.zeros(int(len(words) >= WIDTH), np.int64)
    anchors = _mixed(_run_hash(words, 3), _MIX[0])[: len(words) - LENGTH + 1]
    if len(anchors) <= STEP:
        return np.array([int(anchors.argmin())])
    return np.unique(_least_of_step(anchors))


def _least_of_step(values: np.ndarray) -> np.ndarray:
    """Where the first least of every STEP neighbouring values is, by windows of 2, 4, 8, 16 and STEP."""
    least, at, wide = values, np.arange(len(values)), 1
    while wide < STEP:
        by = min(wide, STEP - wide)
        right = least[by:] < least[:-by]
        least, at = np.where(right, least[by:], least[:-by]), np.where(right, at[by:], at[:-by])
        wide += by
    return at


def paragraphs_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, starts of the paragraphs, and a hash of each one's words; equal ones count once, at their first place."""
    words = word_hashes(text or "")
    starts = paragraph_starts(words)
    if not len(starts):
        return words, starts, np.zeros(0, np.uint64)
    content, first = np.unique(_fold((words[starts + k] for k in range(min(LENGTH, len(words)))), len(starts)), return_index=True)
    return words, starts[first], content


def _prefix(kinds: int, similar: float) -> int:
    """How many of its least shingles a set of ``kinds`` must show to meet every set at ``similar`` that shows its own."""
    return kinds - math.ceil(similar * kinds - 1e-9) + 1


def bands_of(similar: float) -> tuple[int, int]:
    """Bands of a paragraph whose shingles all differ, one repeat allowed: to meet others of that kind, and to meet all.

    Two sets of n share ``2 n similar / (1 + similar)`` shingles at least, which
    of one set leaves one less than its bands; so their least ones meet.
    """
    n = LENGTH - WIDTH + 1
    return max(k - math.ceil(2 * k * similar / (1 + similar) - 1e-9) + 1 for k in (n - 1, n)), _prefix(n, similar)


def _sorted_shingles(shingles: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The MinHash values of each paragraph's shingles in order, and which of them differ from the one before.

    A paragraph of fewer than LENGTH words (``sizes``) has fewer; what fills its row up comes last and is none of them.
    """
    place = np.arange(LENGTH - WIDTH + 1)
    own = place < np.broadcast_to(np.asarray(sizes), starts.shape)[:, None] - WIDTH + 1
    at = starts[:, None] + place
    held = np.sort(np.where(own, shingles[np.minimum(at, max(0, len(shingles) - 1))], ~np.uint64(0)), axis=1) if len(starts) else np.zeros(at.shape, np.uint64)
    new = own.copy()
    new[:, 1:] &= held[:, 1:] != held[:, :-1]
    return held, new


def band_hashes(words: np.ndarray, starts: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The least MinHash values of each paragraph, as many as it takes that no similar pair without repeats is missed."""
    return _sorted_shingles(_mixed(_run_hash(words, WIDTH), _MIX[0]), starts)[0][:, : bands_of(similar)[0]]


def _table(fields: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Whole numbers as signed 64 bits, under the names in ``fields``."""
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=fields.split())


_CUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("content", pa.int64()), ("marks", pa.int64()), ("sparse", pa.bool_()),
    ("bands", pa.list_(pa.int64())), ("more", pa.list_(pa.int64())), ("n_words", pa.int64()),
])


def _cut(docs: list[int], texts: list[bytes], similar: float) -> pa.RecordBatch:
    """:func:`paragraphs_of` and the bands of several texts at once."""
    words, at = _words_at(b"\n".join(texts))
    ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))
    sizes = np.diff(ends, prepend=0)
    starts = np.zeros(len(words), bool)
    if len(words) >= LENGTH:
        anchors = _mixed(_run_hash(words, 3), _MIX[0])
        short = (sizes >= LENGTH) & (sizes < LENGTH + STEP)
        for end, size in zip(ends[short].tolist(), sizes[short].tolist()):
            starts[end - size + anchors[end - size : end - LENGTH + 1].argmin()] = True
        if len(anchors) >= STEP:
            least = _least_of_step(anchors)
            room = np.repeat(ends, sizes)[: len(least)] - np.arange(len(least))
            starts[least[room >= LENGTH + STEP - 1]] = True
    starts[(ends - sizes)[(sizes >= WIDTH) & (sizes < LENGTH)]] = True
    starts = np.flatnonzero(starts)
    row = np.searchsorted(ends, starts, "right")
    lengths = np.minimum(sizes[row], LENGTH)
    content = np.zeros(len(starts), np.uint64)
    for n in np.unique(lengths).tolist():
        of = starts[lengths == n]
        content[lengths == n] = _fold((words[of + k] for k in range(n)), len(of))
    order = np.lexsort((starts, content, row))
    first = np.ones(len(order), bool)
    first[1:] = (content[order][1:] != content[order][:-1]) | (row[order][1:] != row[order][:-1])
    order = order[first]
    starts, row, content, lengths = starts[order], row[order], content[order], lengths[order]

    shingles = _mixed(_run_hash(words, WIDTH), _MIX[0]) if len(starts) else np.zeros(0, np.uint64)
    held, new = _sorted_shingles(shingles, starts, lengths)
    kinds = new.sum(axis=1)
    marks = np.bitwise_or.reduce(np.where(new, np.uint64(1) << (held >> np.uint64(58)), np.uint64(0)), axis=1)
    few, every = bands_of(similar)
    sparse = kinds < LENGTH - WIDTH
    need = np.array([0, *(_prefix(k, similar) for k in range(1, LENGTH - WIDTH + 2))])[kinds][:, None]
    rank = np.cumsum(new, axis=1)
    shown = new & (rank <= need) & (sparse[:, None] | (rank <= few))
    rest = new & (rank <= need) & ~shown

    def lists(mask: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(mask.sum(axis=1))).astype(np.int32), held[mask].view(np.int64))

    whole = [np.array(docs, np.int64)[row], starts - (ends - sizes)[row], content.view(np.int64), marks.view(np.int64)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in whole), pa.array(sparse), lists(shown), lists(rest), pa.array(lengths, pa.int64())], schema=_CUT)


def cut(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Every paragraph of every text: ``doc_id, start, content, marks, sparse, bands, more, n_words``.

    ``bands`` are its least MinHash values, ``marks`` 64 bits of which each shingle
    sets one. Where shingles repeat or are few (``sparse``), bands are all that any partner
    needs; where not, ``more`` are those that only sparse partners need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc)
                texts.append(_lowered(text.as_py() or ""))
                size += len(texts[-1])
                if size >= SLICE:
                    yield _cut(ids, texts, similar)
                    ids, texts, size = [], [], 0
            if ids:
                yield _cut(ids, texts, similar)

    kinds = "doc_id bigint, start bigint, content bigint, marks bigint, sparse boolean, bands array<bigint>, more array<bigint>, n_words bigint"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def band_pairs(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """:func:`colliding` of the paragraphs of ``docs``."""
    found = cut(docs, similar)
    return colliding(found, found.where("sparse").select(F.explode("bands").alias("band")).distinct())


def colliding(paragraphs: DataFrame, sparse: DataFrame) -> DataFrame:
    """``band, u, v``: contents ``u`` that share a band with a smaller content ``v``, the least of the band.

    Every content of a text is under each of its bands, and under those of
    ``more`` that a paragraph with repeats has. Bands of one document
    alone are left out: overlapping paragraphs are alike, but not elsewhere.
    Only numbers are shuffled; of the documents that hold a content, a batch
    sends the first and the last. A band's rows stream past in order, each
    compared with the first, so a hot band costs no memory; what waits is the
    start of a band until a second document shows up in it.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owner = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((owner, found))
            found, owner = found[order], owner[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            last = np.append(new[1:], True)[: len(new)]
            begins = np.flatnonzero(new)
            lowest = np.repeat(owner[begins], np.diff(np.append(begins, len(found))))
            send = new | last & (owner != lowest)
            keys = b.column(2).take(pa.array(order[send]))
            sizes = keys.value_lengths().to_numpy()
            yield _table("band content doc_id", [keys.flatten().to_numpy(), np.repeat(found[send], sizes), np.repeat(owner[send], sizes)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, first, met = None, 0, False
        held = [np.zeros(0, np.int64)] * 3  # the last band, as long as one document alone is in it
        for b in batches:
            if not len(b):
                continue
            keys, found, owner = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns))
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(begins, len(keys)))
            firsts, shared = found[begins].copy(), np.minimum.reduceat(owner, begins) < np.maximum.reduceat(owner, begins)
            if met and keys[0] == band:
                firsts[0], shared[0] = first, True
            band, first, met = keys[-1], firsts[-1], bool(shared[-1])
            held = [c[len(keys) if met else begins[-1] :] for c in (keys, found, owner)]
            least = np.repeat(firsts, sizes)
            other = np.repeat(shared, sizes) & (found != least)
            other[1:] &= (keys[1:] != keys[:-1]) | (found[1:] != found[:-1])
            yield _table("band u v", [keys[other], found[other], least[other]])

    shown = paragraphs.select("content", "doc_id", "bands").mapInArrow(bands, "band bigint, content bigint, doc_id bigint")
    more = paragraphs.where("not sparse").select(F.explode("more").alias("band"), "content", "doc_id").join(sparse, "band", "left_semi")
    dealt = shown.union(more).repartition("band").sortWithinPartitions("band", "content")
    return dealt.mapInArrow(pairs, "band bigint, u bigint, v bigint")


def close_members(pairs: DataFrame, marks: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``g, content``: groups in which every two contents of a band meet, without contents that are far from all others of theirs.

    Sets at ``similar`` differ in a few shingles at most, and their marks in no
    more bits than that; so a content without such a partner has none.
    """
    apart = math.floor(2 * (LENGTH - WIDTH + 1) * (1 - similar) / (1 + similar) + 1e-9)
    members = pairs.select("band", F.col("u").alias("content")).union(pairs.select("band", "v")).distinct()
    groups = pair_groups(members, "band", "content", CHUNK).join(marks, "content")
    dealt = groups.select("g", "content", "marks").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 0, CHUNK):
            g, content, held = (t.column(k).to_numpy() for k in range(3))
            held = held.view(np.uint64)  # bits of signed numbers are counted without their sign
            near = (np.bitwise_count(held[:, None] ^ held[None, :]) <= apart) & (g[:, None] == g[None, :])
            np.fill_diagonal(near, False)
            at = near.any(axis=1)
            yield _table("g content", [g[at], content[at]])

    return dealt.mapInArrow(run, "g bigint, content bigint")


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``content, shingles`` (distinct hashes, sorted, as bytes) of the ``wanted(doc_id, start, content)``, read from the texts again."""
    kinds = pa.schema([("content", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = [], []
            for text, starts, content in zip(b.column(0), b.column(1), b.column(2)):
                words, starts, content = word_hashes(text.as_py()), starts.values.to_numpy(), content.values.to_numpy()
                size = min(LENGTH, len(words))
                fits = starts + size <= len(words)  # rows that repeat an id may hold another text
                starts, content = starts[fits], content[fits]
                same = _fold((words[starts + k] for k in range(size)), len(starts)).view(np.int64) == content
                names += content[same].tolist()
                if same.any():
                    held, new = _sorted_shingles(_run_hash(words, WIDTH), starts[same], size)
                    out += [h[n].tobytes() for h, n in zip(held, new)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], schema=kinds)

    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "content")).alias("w"))
    texts = docs.select("doc_id", "text").join(by_doc, "doc_id").select("text", F.col("w.start").alias("start"), F.col("w.content").alias("content"))
    return texts.mapInArrow(run, "content bigint, shingles binary").dropDuplicates(["content"])


def similar_members(sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of shingle sets whose exact Jaccard similarity is ``similar`` or more."""
    sizes = np.array([len(x) for x in sets])
    found, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(found), -1)
    place[shared] = np.arange(len(shared))
    owner, column = np.repeat(np.arange(len(sets)), sizes), place[at]
    m = np.zeros((len(sets), max(1, len(shared))), np.float32)
    m[owner[column >= 0], column[column >= 0]] = 1
    common = (m @ m.T).astype(np.float64)
    return np.nonzero(np.triu(common / (sizes[:, None] + sizes[None, :] - common) >= similar, 1))


def verified(groups: DataFrame, shingles: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``u, v``: links that connect just the contents of a band whose similarity holds, every two of a group compared.

    A large band was split, every two of its parts compared in a group of their
    own; a group returns a forest, not its pairs.
    """
    dealt = groups.join(shingles, "content").select("g", "content", "shingles").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 0, CHUNK):
            contents, first = np.unique(t.column(1).to_numpy(), return_index=True)
            held = t.column(2).take(first).to_pylist()
            i, j = similar_members([np.frombuffer(x, np.uint64) for x in held], similar)
            label = join_labels(np.arange(len(contents)), i, j)
            moved = label != np.arange(len(contents))
            yield _table("u v", [contents[moved], contents[label[moved]]])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def shared_paragraphs(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """Every paragraph that stands, alike, in another document: ``doc_id, start, n_words, cluster, kept_doc_id, removed``.

    Equal paragraphs are one content. MinHash bands bring similar contents
    together, so many that no pair at ``similar`` misses (:func:`bands_of`); the exact
    Jaccard similarity of their shingles (five words, 0.8)
    decides for every two of a band, and connected components are the clusters. The paragraph of a
    cluster's smallest ``doc_id`` stays, the others are marked as removed.
    ``start`` counts words (runs of anything but ASCII blanks) of the text.

    All texts are read whole and cut once. What is shuffled is numbers, and once,
    to verify, the texts. Words are compared in lower case (A-Z). A text of 5 to 23 words
    is one paragraph, a shorter one holds none. Null texts and null ids have no rows; rows that repeat an id are
    one document; a paragraph that a document repeats counts at its first place.
    An empty table, or one without shared paragraphs, gives an empty table; other
    columns are not read.
    """
    settle = Settled(docs.sparkSession, "paragraphs")
    named = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    every = settle(cut(named, similar))
    sparse = settle(every.where("sparse").select(F.explode("bands").alias("band")).distinct())
    pairs = settle(colliding(every, sparse))
    settle.drop(sparse)
    near = pairs.select(F.col("u").alias("content")).union(pairs.select("v")).distinct().withColumn("near", F.lit(True))
    held = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("start", "doc_id").alias("start"), F.min("marks").alias("marks")]
    found = settle(every.groupBy("content").agg(*held).join(near, "content", "left").where("lo < hi or near"))
    groups = settle(close_members(pairs, found.where("near").select("content", "marks"), similar))
    settle.drop(pairs)
    wanted = found.join(groups.select("content").distinct(), "content").select(F.col("lo").alias("doc_id"), "start", "content")
    parts = components(verified(groups, shingles_of(named, wanted), similar), settle)
    settle.drop(groups)
    clusters = found.join(parts.withColumnRenamed("node", "content"), "content", "left").withColumn("cluster", F.coalesce("component", "content"))
    spans = clusters.groupBy("cluster").agg(F.min("lo").alias("kept_doc_id"), F.max("hi").alias("last")).where("kept_doc_id < last")
    clusters = clusters.join(spans, "cluster").select("content", "cluster", "kept_doc_id")
    return every.select("doc_id", "start", "content", "n_words").join(clusters, "content").select(
        "doc_id", "start", "n_words", "cluster", "kept_doc_id", (F.col("doc_id") != F.col("kept_doc_id")).alias("removed")
    )


def without_shared(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``text`` cleared of the words of removed paragraphs; what is kept of a changed text is joined by spaces."""
    gone = shared_paragraphs(docs, **how).where("removed").groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    gone = gone.select(F.col("doc_id").alias("_id"), "starts")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        def one(text: str, at) -> str:
            words = text.encode("utf-8", "surrogatepass").split()
            keep = np.ones(len(words), bool)
            for s in at:
                keep[s : s + LENGTH] = False
            return b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass")

        return pd.Series([t if t is None or a is None else one(t, a) for t, a in zip(texts, starts)], dtype="object")

    out = docs.join(gone, F.col("doc_id") == F.col("_id"), "left").withColumn("text", F.when(F.col("starts").isNull(), F.col("text")).otherwise(cut("text", "starts")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))

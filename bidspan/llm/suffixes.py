"""Removal of long repeated byte strings by a distributed difference-cover suffix array."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled, small_batches
from bidspan.llm.sorted_runs import ranked_runs, twin_rows

#: Length of the strings that may not repeat; grams and windows of grams that choose the places of the suffix array.
LENGTH, GRAM, WINDOW = 400, 16, 256
#: The bytes from a place on that fix where the next place is.
LETTER = GRAM + WINDOW
#: Bytes of texts hashed together, texts handed to Python at a time, texts remembered by a task.
CHUNK, TEXTS_A_BATCH, SEEN = 1 << 17, 256, 100_000
#: Places that a task holds back until it knows whether others need them; beyond that they count as needed.
PENDING = 50_000
#: Places of one cluster that are compared in pairs where they are met; larger clusters are told apart by hashes.
PAIRED = 64
_END = 2**62
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
_PLACE = _U(2**30 - 1)


def letter_bytes(length: int) -> int:
    """Bytes of a letter: enough to fix the next place, and so many that any three neighbours cover ``length`` bytes."""
    return max(LETTER, length - 2)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _MIX[2]
    return x ^ (x >> _U(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every byte, as one number each; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(len(data), np.uint64)
    for r in range(min(8, len(data))):
        some = padded[r : r + (len(padded) - r) // 8 * 8].view("<u8")
        out[r::8] = some[: len(out[r::8])]
    return out


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours."""
    n = len(x) - w + 1
    rows = np.concatenate((x, np.full(-len(x) % w, _U(2**64 - 1)))).reshape(-1, w)
    ahead, back = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def places(data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts in ``data``: each place's text and offset, and the first and last string start that it answers for.

    A string start belongs to the least gram hash of the window that begins there,
    the last one on ties, so equal strings of LETTER bytes and more have the same
    places. Starts of ``length`` bytes only count; a place without any has none
    (its first lies behind its last).
    """
    none = np.zeros(0, np.int64)
    if len(data) < LETTER:
        return none, none, none, none
    h = _stirred(words * _MIX[0] + np.concatenate((words[8:], np.zeros(8, np.uint64))) * _MIX[1])[: len(data) - GRAM + 1]
    at = _least((h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64)), WINDOW)
    n = np.minimum(np.maximum(ends - starts - LETTER + 2, 0), len(at) - starts)
    turns = np.zeros(len(at), bool)
    turns[1:] = at[1:] != at[:-1]
    turns[starts[n > 0]] = True
    new = np.flatnonzero(turns)
    text = np.searchsorted(starts, new, "right") - 1
    stop = (starts + n)[text]
    inside = new < stop
    last = np.minimum(np.append(new[1:], len(at))[: len(new)], stop)[inside] - 1
    new, text = new[inside], text[inside]
    a = (_PLACE - (at[new] & _PLACE)).astype(np.int64)
    return text, a, new, np.minimum(last, ends[text] - length)


def _chunks(values: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Stretches of the list of about ``size`` bytes."""
    at, total = 0, 0
    for i, v in enumerate(values):
        if total and total + len(v) > size:
            yield at, i
            at, total = i, 0
        total += len(v)
    if at < len(values):
        yield at, len(values)


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(v) for v in values])
    return np.frombuffer(b"".join(values), np.uint8), ends - [len(v) for v in values], ends


def _sieve(length: int):
    """``digest, pos, h``: every place that answers for a start, with a hash of the bytes all its strings share."""
    least = length - WINDOW + 1
    factors = np.random.default_rng(7).integers(0, 2**64, least // 8 + 1, dtype=np.uint64) | _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, texts = [], []
            for d, t in zip(b.column("digest").to_pylist(), b.column("body").to_pylist()):
                if d not in seen:  # copies met by this task are one text
                    seen.add(d)
                    digests.append(d)
                    texts.append(t)
            if len(seen) > SEEN:
                seen.clear()
            for i, j in _chunks(texts):
                data, starts, ends = _joined(texts[i:j])
                words = _words(data)
                text, a, first, last = places(data, words, starts, ends, length)
                some = np.flatnonzero(first <= last)
                text, a = text[some], a[some]
                if len(a):
                    ahead = words[np.minimum(a[:, None] + 8 * np.arange(least // 8), len(data) - 1)]
                    h = (_stirred(ahead) * factors[:-1]).sum(1, dtype=np.uint64)
                    if least % 8:
                        h += _stirred(words[a + least - 8]) * factors[-1]
                    yield pa.RecordBatch.from_pydict({"digest": pa.array(digests[i:j], pa.binary()).take(pa.array(text)), "pos": a - starts[text], "h": _stirred(h).view(np.int64)})

    return run


_RUNS = "digest binary, base long, segment binary, pos array<bigint>, low array<int>, high array<int>"


def _strings(length: int):
    """Stretches of text that hold surviving places, on to ``length`` bytes behind the last of them, with all places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {c.split()[0]: [] for c in _RUNS.split(", ")}
            for digest, body, kept in zip(b.column("digest").to_pylist(), b.column("body").to_pylist(), b.column("kept").to_pylist()):
                data = np.frombuffer(body, np.uint8)
                _, a, first, last = places(data, _words(data), np.zeros(1, np.int64), np.array([len(data)]), length)
                mine = np.searchsorted(a, np.array(sorted(kept)))
                until = np.minimum(np.searchsorted(a, a[mine] + length - letter_bytes(length)), len(a) - 1)
                wanted = np.zeros(len(a) + 1, np.int64)
                np.add.at(wanted, mine, 1)
                np.add.at(wanted, until + 1, -1)
                held, alive = np.cumsum(wanted)[:-1] > 0, np.zeros(len(a), bool)
                alive[mine] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([0], held.view(np.int8), [0]))))
                for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    at, ok = a[i:j], alive[i:j]
                    base = max(0, int(at[0]) - WINDOW + 1)
                    row = (digest, base, body[base : int(at[-1]) + length], at, np.where(ok, at - last[i:j], -1).astype(np.int32), np.where(ok, at - first[i:j], -1).astype(np.int32))
                    for column, value in zip(found.values(), row):
                        column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds)], names=list(found))

    return run


def suffix_ranks(level: DataFrame, settle: Settled, length: int) -> DataFrame:
    """``run, s, i, r``: how many suffixes are smaller, for ``level(run, s, i, c, pos, upto)``; ``c`` names a letter by the number of smaller ones plus 1.

    Suffixes at 1 and 2 modulo 3 are the sample: their triples are sorted and
    named, and the names, one string per residue, are ranked by the same function.
    A suffix at 0 is its letter and the rank behind it: sorted with those at 1 by
    (letter, next rank), and with those at 2 by (two letters, the rank behind
    them), which counts the sample suffixes below it and the other way round.

    Names need not be told apart beyond ``length`` bytes: the recursion ends when
    every name covers that much or the end of its string. Suffixes that agree so
    far have neighbouring ranks, in any order.
    """
    if level.where(F.col("upto") - F.col("pos") < length).limit(1).count() == 0:
        return settle(level.select("run", "s", "i", (F.col("c") - 1).alias("r")))
    with settle.scope() as keep:
        return keep(_merged_ranks(level, settle, length))


def _merged_ranks(level: DataFrame, settle: Settled, length: int) -> DataFrame:
    """The step of :func:`suffix_ranks`: sample, recursion, and the two sorts that merge."""
    place, residue = "over (partition by run, s order by i)", F.col("i") % 3
    triples = level.withColumns({"c1": F.expr(f"lead(c, 1, 0L) {place}"), "c2": F.expr(f"lead(c, 2, 0L) {place}"), "far": F.expr(f"lead(upto, 2, {_END}L) {place}")})
    named = ranked_runs(triples.where(residue != 0).drop("upto"), ["c", "c1", "c2"], ["run", "s", "i"], settle)
    deeper = named.select("run", (F.col("s") * 2 + residue - 1).alias("s"), F.floor(F.col("i") / 3).cast("int").alias("i"), (F.col("less0") + 1).alias("c"), "pos", F.col("far").alias("upto"))
    ranks = suffix_ranks(settle(deeper), settle, length)
    ranks = ranks.select("run", F.floor(F.col("s") / 2).cast("long").alias("s"), (F.col("i") * 3 + 1 + F.col("s") % 2).cast("int").alias("i"), (F.col("r") + 1).alias("r"))
    both = level.select("run", "s", "i", "c").join(ranks, ["run", "s", "i"], "left")
    both = settle(both.withColumns({"c1": F.expr(f"lead(c, 1, 0L) {place}"), "r1": F.expr(f"coalesce(lead(r, 1) {place}, 0L)"), "r2": F.expr(f"coalesce(lead(r, 2) {place}, 0L)")}))
    keys = ["run", "s", "i"]
    one = settle(ranked_runs(both.where(residue < 2), ["c", "r1"], keys, settle, kind=residue))
    rest = one.where(residue == 0).withColumn("below", F.col("less0") + F.col("less1")).select(*both.columns, "below").unionByName(both.where(residue == 2).withColumn("below", F.lit(0).cast("long")))
    two = ranked_runs(rest, ["c", "c1", "r2"], keys, settle, kind=residue / 2)
    zero = two.select(*keys, F.when(residue == 0, F.col("below") + F.col("less1")).otherwise(F.col("less0") + F.col("r") - 1).alias("r"))
    return settle(one.where(residue == 1).select(*keys, (F.col("less0") + F.col("r") - 1).alias("r")).unionByName(zero))


_PLACES = "r long, run long, pos long, low int, high int, before binary, head binary"


def _placed(length: int):
    """Every surviving place with its rank, the bytes before it in reverse, and the bytes from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PLACES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            rows = []
            for number, base, segment, *places_ in zip(*[b.column(c).to_pylist() for c in ("run", "base", "segment", "r", "pos", "low", "high")]):
                for r, pos, low, high in zip(*places_):
                    if low >= 0:
                        at = pos - base
                        rows.append((r, number, pos, low, high, segment[max(0, at - WINDOW + 1) : at][::-1], segment[at : at + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


_SORTED = "run long, pos long, low int, high int, twin boolean, before binary, reach int, levels array<int>, begins array<bigint>, part int, mark int, head binary"
_SORTED_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]


def _common(heads: list[bytes], length: int) -> np.ndarray:
    """Bytes that each of the prefixes, but the first, shares with the one before."""
    size = np.array([len(h) for h in heads])
    m = np.frombuffer(b"".join(h.ljust(length, b"\0") for h in heads), np.uint8).reshape(-1, length)
    other = m[1:] != m[:-1]
    first = np.where(other.any(1), other.argmax(1), length)
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


def _repeated(cluster: list[tuple], length: int) -> list[tuple]:
    """The strings of a cluster's places that repeat, as rows of the output: all of a twin's, some stretches of another's.

    ``cluster`` has output rows behind their places in the order, in that order. Two
    places share their strings from the rest they share to what they share before it.
    """
    place, rows = zip(*cluster)
    other = np.array([not x[4] for x in rows])
    out = [(*x[:5], *(None,) * 4, x[9], 0, None) for x in rows if x[4]]
    if len(rows) > 1 and other.any():
        i, j = np.triu_indices(len(rows), 1)
        some = other[i] | other[j]
        i, j = i[some], j[some]
        size = np.array([len(x[5]) for x in rows])
        m = np.frombuffer(b"".join(x[5].ljust(WINDOW, b"\0") for x in rows), np.uint8).reshape(-1, WINDOW)
        differs = m[i] != m[j]
        before = np.minimum(np.where(differs.any(1), differs.argmax(1), WINDOW), np.minimum(size[i], size[j]))
        after = []
        for a, b in zip(i.tolist(), j.tolist()):  # the least level that began behind the first of the two
            levels, begins = rows[b][7], rows[b][8]
            k = bisect_right(begins, place[a])
            after.append(levels[k] if k < len(levels) else length)
        from_ = length - np.array(after)
        for mine in (i, j):
            low, high = (np.array([x[c] for x in rows])[mine] for c in (2, 3))
            low, high = np.maximum(low, from_), np.minimum(high, before)
            for k in np.flatnonzero(other[mine] & (low <= high)).tolist():
                x = rows[mine[k]]
                out.append((x[0], x[1], int(low[k]), int(high[k]), True, *(None,) * 4, x[9], 0, None))
    return out


def _adjacent(length: int, floor: int):
    """Suffixes in order, each with the stretches of common prefixes it lies in.

    ``levels`` and ``begins`` are a stack: the stretch of suffixes that share t
    bytes with this one begins at the last entry whose level is below t. A stretch
    may begin in an earlier task, so nothing is entered for a task's first row.

    Equal suffixes are ordered by the bytes before them, so most places whose
    strings all repeat see it at a neighbour (``twin``). Only the first of such
    neighbours can be needed by others: by a place that is no twin and shares the
    rest of one of its strings. The next ones above and below tell; a place that
    none of them reaches goes without stack and bytes, as do its followers.

    Suffixes that share ``floor`` bytes with no other outside are a cluster. If it
    lies in one task and few of its places are left, these are compared here
    (:func:`_repeated`), and only stretches of repeated strings are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in _SORTED.split(", ")]
        levels: list[int] = []
        begins: list[int] = []
        waiting, n, first, last = None, 0, None, None
        above, pending, rows = length, [], []  # above: bytes shared with the last place that is no twin; unknown at first
        cluster: list[tuple] | None = None  # None: too large, or begun in an earlier task

        def keep(place: int, row: tuple) -> None:
            nonlocal cluster
            if cluster is not None and len(cluster) < PAIRED:
                cluster.append((place, row))
                return
            rows.extend(x for _, x in cluster or ())
            rows.append(row)
            cluster = None

        def bare(number: int, pos: int, low: int, high: int) -> tuple:
            return number, pos, low, high, True, None, None, None, None, part, 0, None

        def close(here: int, down: bool) -> None:
            nonlocal above
            number, pos, low, high, before, reach, stack, starts, up, spare, place = waiting
            if spare:
                rows.append(bare(number, pos, low, high))
                return
            row = (number, pos, low, high, up or down, before, max(reach, here), stack, starts, part, 0, None)
            if up or down:
                if above >= length - high:
                    keep(place, row)
                else:
                    heapq.heappush(pending, (high - length, place, row))
                if len(pending) <= PENDING:
                    return
            else:
                above = length
                keep(place, row)
            for x in pending:
                keep(*x[1:])
            pending.clear()

        def give() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SORTED_TYPES)], names=names)
                rows.clear()

        for b in batches:
            heads = b.column("head").to_pylist()
            if not heads:
                continue
            if first is None:
                first, shared = heads[0], [length, *_common(heads, length).tolist()]
            else:
                shared = _common([last, *heads], length).tolist()
            for k, (number, pos, low, high, before) in enumerate(zip(*[b.column(c).to_pylist() for c in ("run", "pos", "low", "high", "before")])):
                here = max(shared[k], floor)
                if n and here < length:
                    while levels and levels[-1] >= here:
                        levels.pop()
                        begins.pop()
                    levels.append(here)
                    begins.append((part << 33) + n)
                up = spare = False
                if waiting is not None:
                    up = here >= length - low and before[:high] == waiting[4][:high]
                    down = here >= length - waiting[2] and before[: waiting[3]] == waiting[4][: waiting[3]]
                    spare = up and (waiting[8] or down)
                    close(here, down)
                    above = min(above, here)
                    while pending and -pending[0][0] > here:
                        rows.append(bare(*heapq.heappop(pending)[2][:4]))
                    if here == floor:
                        rows.extend(_repeated(sorted(cluster, key=lambda x: x[0]), length) if cluster else ())
                        cluster = []
                stack = (None, None) if spare else (list(levels), list(begins))
                waiting = (number, pos, low, high, before, here, *stack, up, spare, (part << 33) + n)
                n += 1
            last = heads[-1]
            yield from give()
        if waiting is not None:
            none = (None,) * 7
            close(length, False)
            rows.extend(x[2] for x in pending)
            rows.extend(x for _, x in cluster or ())  # goes on in the next task, perhaps
            rows.extend([(*none, [], [], part, 1, first), (*none, list(levels), list(begins), part, 2, last)])
            yield from give()

    return run


def _carried(marks: list, length: int, floor: int) -> list[tuple[int, list[int], list[int]]]:
    """The stack that every task's first row stands on, from the tasks' outermost prefixes; one short row a task."""
    out, levels, begins, last = [], [], [], None
    tails = {m.part: m for m in marks if m.mark == 2}
    for m in sorted((m for m in marks if m.mark == 1), key=lambda m: m.part):
        here = floor if last is None else max(floor, int(_common([last, m.head], length)[0]))
        if here < length:
            keep = [k for k, v in enumerate(levels) if v < here]
            levels, begins = [levels[k] for k in keep] + [here], [begins[k] for k in keep] + [m.part << 33]
        out.append((m.part, list(levels), list(begins)))
        tail = tails[m.part]
        if tail.levels:
            keep = [k for k, v in enumerate(levels) if v < tail.levels[0]]
            levels, begins = [levels[k] for k in keep] + list(tail.levels), [begins[k] for k in keep] + list(tail.begins)
        last = tail.head
    return out


_FACTORS = np.random.default_rng(11).integers(0, 2**64, (WINDOW, 256), dtype=np.uint64)


def _hashes(before: list[bytes]) -> np.ndarray:
    """Column d: a hash of the d bytes before the place, which are given in reverse."""
    m = np.frombuffer(b"".join(x.ljust(WINDOW - 1, b"\0") for x in before), np.uint8).reshape(-1, WINDOW - 1)
    each = _FACTORS[np.arange(WINDOW - 1)[None, :], m]
    return _stirred(np.concatenate((np.zeros((len(m), 1), np.uint64), np.cumsum(each, axis=1, dtype=np.uint64)), axis=1) + np.arange(WINDOW, dtype=np.uint64) * _MIX[0])


def _strings_of(length: int):
    """Every string a place answers for: the stretch of suffixes that share its rest, and a hash of what is before the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                h = _hashes(b.column("before").to_pylist())
                runs, pos, low, high, reach = (b.column(c).to_numpy() for c in ("run", "pos", "low", "high", "reach"))
                low = np.maximum(low, length - reach)  # longer rests have no partner
                n = np.maximum(high - low + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                sizes = b.column("levels").value_lengths().to_numpy()
                ends = np.cumsum(sizes)
                levels = np.repeat(np.arange(len(sizes)), sizes) * (2 * length) + b.column("levels").flatten().to_numpy()  # all stacks behind each other
                under = np.searchsorted(levels, row * (2 * length) + length - d) - 1
                under = np.where(under < (ends - sizes)[row], ends[row] - 1, under)
                begin = b.column("begins").flatten().to_numpy()[under] if len(row) else under
                if len(row):
                    yield pa.RecordBatch.from_pydict({"run": runs[row], "p": pos[row] - d, "k1": begin, "k2": h[row, d].view(np.int64)})

    return run


def repeated_starts(texts: DataFrame, settle: Settled, length: int = LENGTH) -> DataFrame:
    """``digest, first, last``: stretches of starts of strings of ``length`` bytes that begin elsewhere too, in ``texts(digest, body)``."""
    spark = texts.sparkSession
    if length < LETTER:
        raise ValueError(f"strings of at least {LETTER} bytes")
    floor = length - WINDOW
    with settle.scope() as keep:
        with small_batches(spark, TEXTS_A_BATCH):
            sieved = settle(texts.mapInArrow(_sieve(length), "digest binary, pos long, h long"))
        alive = twin_rows(sieved, ["h"], ["digest", "pos"], settle).groupBy("digest").agg(F.collect_list("pos").alias("kept"))
        settle.drop(sieved)
        once = texts.groupBy("digest").agg(F.first("body").alias("body"))
        with small_batches(spark, TEXTS_A_BATCH):
            runs = keep(settle(once.join(alive, "digest").mapInArrow(_strings(length), _RUNS).withColumn("run", F.monotonically_increasing_id())))
    with settle.scope() as keep:
        letters = runs.select("run", "base", "segment", F.posexplode("pos").alias("i", "pos"), F.size("pos").alias("n"))
        letter = F.substring(F.col("segment"), (F.col("pos") - F.col("base") + 1).cast("int"), F.lit(letter_bytes(length)))
        upto = F.when(F.col("i") == F.col("n") - 1, F.lit(_END)).otherwise(F.col("pos") + letter_bytes(length))
        named = ranked_runs(letters.select("run", F.lit(0).cast("long").alias("s"), "i", letter.alias("letter"), "pos", upto.alias("upto")), ["letter"], ["run", "s", "i"], settle)
        ranks = keep(suffix_ranks(settle(named.select("run", "s", "i", (F.col("less0") + 1).alias("c"), "pos", "upto")), settle, length))
    with settle.scope() as keep:
        order = ranks.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("r"))
        with small_batches(spark, TEXTS_A_BATCH):
            each = runs.drop("digest").join(order, "run").mapInArrow(_placed(length), _PLACES)
            found = keep(settle(each.repartitionByRange("r", "before", "run", "pos").sortWithinPartitions("r", "before", "run", "pos").mapInArrow(_adjacent(length, floor), _SORTED)))
    settle.drop(ranks)
    carried = spark.createDataFrame(_carried(found.where("mark > 0").select("part", "mark", "levels", "begins", "head").collect(), length, floor), "part int, below array<int>, above array<bigint>")
    under = F.filter("below", lambda v: F.coalesce(v < F.get("levels", F.lit(0)), F.lit(True)))
    stacked = found.where("mark = 0 and before is not null").join(F.broadcast(carried), "part").withColumn("under", F.size(under))  # one row a task
    whole = stacked.select(
        "run", "pos", "low", "high", "before", "reach", F.concat(F.slice("below", F.lit(1), F.col("under")), "levels").alias("levels"), F.concat(F.slice("above", F.lit(1), F.col("under")), "begins").alias("begins")
    )
    strings = whole.mapInArrow(_strings_of(length), "run long, p long, k1 long, k2 long")
    single = twin_rows(strings, ["k2", "k1"], ["run", "p"], settle).select("run", "p")  # the hash first: sorting meets few ties
    island = single.withColumn("island", F.expr("p - row_number() over (partition by run order by p)")).groupBy("run", "island").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    starts = found.where("twin").select("run", (F.col("pos") - F.col("high")).alias("first"), (F.col("pos") - F.col("low")).alias("last")).unionByName(island.drop("island"))
    return starts.join(runs.select("run", "digest"), "run").select("digest", "first", "last")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``n_bytes, spans, kept``: whole texts as bytes, without every string of ``length`` bytes that also begins elsewhere.

    The suffix array stands on places chosen by content (the least gram hash of
    every 128 starts), whose letters are the 144 bytes from a place on, so it is a
    hundredth of the texts and still exact to the byte: a place answers for all
    strings that choose it. Places whose strings cannot repeat, by a hash of the
    bytes all of them share, are left out first. What remains is sorted by
    :func:`suffix_ranks`, neighbours' common prefixes are measured in bytes, and a
    string repeats if its beginning before the place and its stretch of suffixes
    behind it are another's too. Every task's first and last row alone are looked
    at from outside; groups of any size spread over tasks.

    ``spans`` are the removed runs ``(first, end)`` in order, ``kept`` the other
    bytes. Null texts are empty. Copies of texts of at least ``length`` bytes are
    removed whole, all of them; shorter texts stay whole. Rows without id and
    repeated rows are documents of their own, so equal ones are copies. Other
    columns are returned as they came, whatever their names: result columns of a
    name that exists get underscores in front. An empty table gives an empty table.
    """
    settle = Settled(docs.sparkSession, "suffixes")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    packed = packed.withColumns({"digest": F.unhex(F.md5("body")), "n_bytes": F.octet_length("body").cast("long")})
    long_ones = packed.where(F.col("n_bytes") >= length)
    copied = long_ones.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("n_bytes")).where("n > 1")
    parts = repeated_starts(long_ones.select("digest", "body"), settle, length).unionByName(copied.select("digest", F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - length).alias("last")))
    until = F.col("last") + length
    reach = f"max(last + {length}) over (partition by digest order by first, last rows between unbounded preceding and 1 preceding)"
    opens = parts.withColumn("opens", F.expr(f"case when coalesce({reach} >= first, false) then 0 else 1 end"))
    numbered = opens.withColumn("no", F.expr("sum(opens) over (partition by digest order by first, last rows between unbounded preceding and current row)"))
    merged = numbered.groupBy("digest", "no").agg(F.min("first").alias("first"), F.max(until).alias("end"))
    spans = settle(merged.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans")))
    joined = packed.join(spans.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left")
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    joined = joined.select("row", "body", "n_bytes", F.coalesce("spans", none).alias("spans"))
    gaps = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda k: F.struct(
        F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("spans"), k - 1)["end"]).alias("first"), F.coalesce(F.get(F.col("spans"), k)["first"], F.col("n_bytes")).alias("end")))
    kept = F.aggregate(gaps, F.lit(b""), lambda acc, g: F.concat(acc, F.substring(F.col("body"), (g["first"] + 1).cast("int"), (g["end"] - g["first"]).cast("int"))))
    names = {}
    for name in ("n_bytes", "spans", "kept"):
        names[name] = name
        while names[name] in docs.columns:
            names[name] = "_" + names[name]
    done = joined.select("row", "n_bytes", "spans", kept.alias("kept"))
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(names[c]) for c in names])

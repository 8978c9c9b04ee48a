"""Packing documents into windows by sum-of-squares placement."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
#: Open windows of a lane, at most; past it a document is cut to fill the fullest one.
MAX_OPEN = 256
LANE_BITS = 40

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

_CODERS: dict[tuple, "Coder"] = {}


class Coder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    ``path`` decides what the ids are. ``ranks_path`` may name the same byte-level
    vocabulary as a rank file: texts of Latin letters, digits, marks and plain
    white space are then encoded from it, which gives the same ids in a third of
    the time; all other texts, and any that may hold a special token, go by ``path``.
    """

    #: What only ``path`` encodes.
    OTHER = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u017f]|<\\|")
    SAMPLE = "It's 12 words,\n\n  or  fewer; naïve façade's (über) 'll?!\t End."

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.quick = Tokenizer.from_file(path), None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            if self(self.SAMPLE) != self.exact(self.SAMPLE):
                raise ValueError("the rank file and the tokenizer file hold different vocabularies")

    def exact(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.quick is None or self.OTHER.search(text):
            return self.exact(text)
        return array("I", self.quick.encode_ordinary(text)).tobytes()


def coder(*files: str | None) -> Coder:
    if files not in _CODERS:
        _CODERS[files] = Coder(*files)
    return _CODERS[files]


class Lane:
    """Windows being filled by one task: the level array and the pieces of each open window."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose move to ``level + size`` leaves the least sum of squared counts; ties go to the fullest."""
        room = self.window - size
        leave = 1 - 2 * self.count[: room + 1]
        leave[0] = 0
        arrive = 2 * self.count[size : self.window + 1] + 1
        arrive[-1] = 0  # a full window is no longer counted
        change = np.where(self.count[: room + 1] > 0, leave + arrive, np.iinfo(np.int64).max)
        change[0] = arrive[0]
        return room - int(change[::-1].argmin())

    def _move(self, level: int, piece: tuple) -> list | None:
        """Put a piece into a window of ``level``; the window if that fills it."""
        if level:
            windows = self.open[level]
            pieces = windows.pop()
            self.count[level] -= 1
            if not windows:
                del self.open[level]
        else:
            pieces = []
            self.n_open += 1
        pieces.append(piece)
        level += piece[2]
        if level == self.window:
            self.n_open -= 1
            return pieces
        self.open.setdefault(level, []).append(pieces)
        self.count[level] += 1
        return None

    def place(self, piece: tuple) -> Iterator[list]:
        """``piece``: (document, start, length, ids); yields the windows that it fills."""
        doc, start, length, ids = piece
        while length:
            take = min(length, self.window)
            level = self.level_for(take)
            if not level and take < self.window and self.n_open >= self.max_open:
                level = max(self.open)
                take = min(take, self.window - level)
            full = self._move(level, (doc, start, take, ids[: 4 * take]))
            if full:
                yield full
            start, length, ids = start + take, length - take, ids[4 * take :]

    def rest(self) -> Iterator[list]:
        """What is open at the end: joined, fullest first, cut into full windows, then powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        total = sum(p[2] for p in left)
        while total:
            size = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            room, pieces = size, []
            while room:
                doc, start, length, ids = left[0]
                take = min(room, length)
                pieces.append((doc, start, take, ids[: 4 * take]))
                left[0] = (doc, start + take, length - take, ids[4 * take :])
                if take == length:
                    left.pop(0)
                room -= take
            total -= size
            yield pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, pattern: str | None = None, window: int = WINDOW, end_id: int = 0, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of documents in windows of at most ``window`` ids, ``end_id`` after each document.

    Each input partition is a lane of its own, so nothing is shuffled, a lost task
    is redone alone and a window never spans tasks. Whole windows of a long
    document stand alone; the rest goes, online, to the fill level that leaves the
    least sum of squared counts of partially filled windows. At most ``max_open``
    windows are open: beyond that a document is cut to fill the fullest one. What
    is open at the end of a lane is joined and cut into full windows and, last,
    powers of two, so that no window needs padding.

    Columns: ``doc_id, start, length, ids`` (little-endian unsigned 32 bits),
    ``doc_tokens`` (with the end id), ``sequence_id`` (lane times 2**40 plus a
    number), ``offset`` in it.

    A null or empty text is the end id alone. Null and repeated ``doc_id`` are
    packed like any other row. An empty table gives an empty table; other columns
    are not read. ``window`` must be a power of two. ``ranks_path`` and ``pattern``: see
    :class:`Coder`.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lane = coder(tokenizer_path, ranks_path, pattern), Lane(window, max_open)
        sequence = TaskContext.get().partitionId() << LANE_BITS
        out: list[tuple] = []

        def lay(windows) -> None:
            nonlocal sequence
            for pieces in windows:
                offset = 0
                for (doc, total), start, length, ids in pieces:
                    out.append((doc, start, length, ids, total, sequence, offset))
                    offset += length
                sequence += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
            out.clear()
            return made

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                whole = total // window * window
                for at in range(0, whole, window):
                    lay([[((doc, total), at, window, ids[4 * at : 4 * (at + window)])]])
                    if len(out) >= 2000:
                        yield batch()
                lay(lane.place(((doc, total), whole, total - whole, ids[4 * whole :])))
                if len(out) >= 2000:
                    yield batch()
        lay(lane.rest())
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)

"""Rows in global order of their keys: how many are smaller, and which share their keys with another."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import Settled

_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_RANKED = "less0 long, less1 long, at_start boolean, part int, mark int, total0 long, total1 long"
_PAIRED = "twin boolean, at_start boolean, at_end boolean, part int, mark int"


def _differs(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """For every row but the first, whether it differs from the one before in any of the columns."""
    n = batch.num_rows
    out = np.zeros(max(n - 1, 0), bool)
    for name in names:
        c = batch.column(name)
        out |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _streamed(batches: Iterator[pa.RecordBatch], keys: list[str], ties: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Batches with whether each row's keys are new, and whether it is the last; the last row of a batch comes with the next one too.

    Rows equal in keys and ties are one.
    """
    held, held_new = None, True
    for b in batches:
        if not b.num_rows:
            continue
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        again = np.flatnonzero(np.concatenate(([True], _differs(t, [*keys, *ties]))))
        t = t if len(again) == t.num_rows else t.take(pa.array(again))
        new = np.concatenate(([held_new], _differs(t, keys)))
        yield t, new, False
        held, held_new = t.slice(t.num_rows - 1), bool(new[-1])
    if held is not None:
        yield held, np.array([held_new]), True


def _with(rows: pa.RecordBatch, added: str, values: list, keys: list[str], mark: int = 0) -> pa.RecordBatch:
    """Rows with further columns; a marker row keeps its keys only."""
    named = [x.split() for x in added.split(", ")]
    columns = rows.columns if not mark else [c if name in keys else pa.nulls(1, c.type) for name, c in zip(rows.schema.names, rows.columns)]
    more = [v if isinstance(v, pa.Array) else pa.array(v, _KINDS[kind]) for v, (_, kind) in zip(values, named)]
    return pa.RecordBatch.from_arrays([*columns, *more], names=[*rows.schema.names, *(name for name, _ in named)])


def _counted(keys: list[str], ties: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, base, less, runs = TaskContext.get().partitionId(), None, [0, 0], [0, 0], 0
        for t, new, done in _streamed(batches, keys, ties):
            first = t.slice(0, 1) if first is None else first
            n, kind = t.num_rows, t.column("kind").to_numpy()
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            smaller = [np.where(start >= 0, (base[k] + np.concatenate(([0], np.cumsum(kind == k)[:-1])))[start], less[k]) for k in (0, 1)]
            number = runs + np.cumsum(new)
            give = n if done else n - 1
            if give:
                none = pa.nulls(give, pa.int64())
                yield _with(t.slice(0, give), _RANKED, [smaller[0][:give], smaller[1][:give], number[:give] == 1, np.full(give, part, np.int32), np.zeros(give, np.int32), none, none], keys)
            less = [int(s[-1]) for s in smaller]
            if done:
                totals = [base[k] + int((kind == k).sum()) for k in (0, 1)]
                yield _with(first, _RANKED, [[0], [0], [None], [part], [1], [totals[0]], [totals[1]]], keys, 1)
                yield _with(t, _RANKED, [[less[0]], [less[1]], [None], [part], [2], [None], [None]], keys, 2)
            else:
                base = [base[k] + int((kind[:give] == k).sum()) for k in (0, 1)]
                runs = int(number[-1]) - int(new[-1])

    return run


def _paired(keys: list[str], ties: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, runs = TaskContext.get().partitionId(), None, 0
        for t, new, done in _streamed(batches, keys, ties):
            first = t.slice(0, 1) if first is None else first
            number, twin = runs + np.cumsum(new), ~new
            twin[:-1] |= ~new[1:]
            give = t.num_rows if done else t.num_rows - 1
            pick = np.arange(give) if done else np.flatnonzero(twin[:give] | (number[:give] == 1))
            if len(pick):
                yield _with(t.take(pa.array(pick)), _PAIRED, [twin[pick], number[pick] == 1, np.full(len(pick), done), np.full(len(pick), part, np.int32), np.zeros(len(pick), np.int32)], keys)
            if done:
                yield _with(first, _PAIRED, [[None], [None], [None], [part], [1]], keys, 1)
                yield _with(t, _PAIRED, [[None], [None], [None], [part], [2]], keys, 2)
            runs = int(number[-1]) - int(new[-1])

    return run


def _sorted(rows: DataFrame, keys: list[str], ties: list[str], settle: Settled, run: Callable, added: str) -> DataFrame:
    """One sort by range, streamed through ``run``: keys that very many rows share are dealt by their ties, so no key is one task's."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
    return settle(dealt.mapInArrow(run(keys, ties), f"{schema}, {added}"))


def ranked_runs(rows: DataFrame, keys: list[str], ties: list[str], settle: Settled, *, kind: Column | None = None) -> DataFrame:
    """``rows`` with ``less0`` and ``less1``: how many rows of kind 0 and 1 have smaller ``keys``; ``ties`` tell rows of equal keys apart.

    Rows equal in keys and ties are one. A task cannot see its neighbours' rows:
    two marker rows a task carry its totals and outermost keys, from which the
    counts are completed.
    """
    found = _sorted(rows.withColumn("kind", (kind if kind is not None else F.lit(0)).cast("int")), keys, ties, settle, _counted, _RANKED)
    marks = found.where("mark > 0").select("part", "mark", *keys, "less0", "less1", "total0", "total1")
    before = "coalesce(sum({0}) over (order by part rows between unbounded preceding and 1 preceding), 0)"
    offsets = marks.where("mark = 1").select("part", F.expr(before.format("total0")).alias("o0"), F.expr(before.format("total1")).alias("o1"))
    placed = marks.join(offsets, "part")
    same = placed.groupBy(*keys).agg(F.min(F.col("o0") + F.col("less0")).alias("s0"), F.min(F.col("o1") + F.col("less1")).alias("s1"))
    by_part = placed.where("mark = 1").join(same, keys).select("part", "o0", "o1", "s0", "s1")
    joined = found.where("mark = 0").drop("mark", "total0", "total1").join(F.broadcast(by_part), "part")  # one row a task
    less = [F.when(F.col("at_start"), F.col(f"s{k}")).otherwise(F.col(f"o{k}") + F.col(f"less{k}")).alias(f"less{k}") for k in (0, 1)]
    return joined.select(*rows.columns, *less)


def twin_rows(rows: DataFrame, keys: list[str], ties: list[str], settle: Settled) -> DataFrame:
    """The ``rows`` whose ``keys`` another row has too, told apart by ``ties``; rows equal in both are one."""
    found = _sorted(rows, keys, ties, settle, _paired, _PAIRED)
    marks = found.where("mark > 0").select("part", "mark", *keys)
    wide = marks.groupBy(*keys).agg((F.count_distinct("part") > 1).alias("wide"))
    by_part = marks.join(wide, keys).groupBy("part").agg(*[F.bool_or((F.col("mark") == m) & F.col("wide")).alias(name) for m, name in ((1, "wide_start"), (2, "wide_end"))])
    joined = found.where("mark = 0").join(F.broadcast(by_part), "part")  # one row a task
    return joined.where("twin or (at_start and wide_start) or (at_end and wide_end)").select(*rows.columns)

"""Helpers shared by the training-data operators: tables, settled intermediates, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspan.session import fresh_path

#: The six characters that separate words and are stripped from lines: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of an MD5 digest, the same in every engine."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def hex_bucket(digits: int, *parts: Column) -> Column:
    """A bucket from 0 to 16**digits - 1 by MD5, so that a hot group is dealt over many tasks."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("int")


def packed_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a table, whatever their names, as one struct beside an operator's own ones."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of the table."""
    while name in df.columns:
        name = "_" + name
    return name


def joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    """The arrays of a batch as one; an empty one if there are none."""
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class Settled:
    """Tables written to the shared folder to cut lineage; superseded ones can be removed.

    A reread table survives the loss of an executor, unlike a local checkpoint,
    and is computed once, unlike a checkpoint of an uncached plan.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    @contextmanager
    def scope(self):
        """Tables settled inside go at its end, but those handed to what it yields."""
        before, kept = set(self.paths), set()

        def keep(df: DataFrame) -> DataFrame:
            kept.add(id(df))
            return df

        yield keep
        for name in set(self.paths) - before - kept:
            self.drop(self.paths[name][0])

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later plan reads."""
        _, path = self.paths.pop(id(df))
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def whole_groups(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``column`` as tables of whole groups; small groups are joined up to ``least`` rows."""
    held, n, tail, group = [], 0, [], None
    for b in batches:
        keys = b.column(column).to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
        for start, end in zip(begins, [*begins[1:], len(keys)]):
            if keys[start] != group and tail:
                held, n, tail = held + tail, n + sum(map(len, tail)), []
                if n >= least:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            group = keys[start]
            tail.append(b.slice(start, end - start))
    if held or tail:
        yield pa.Table.from_batches(held + tail)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: members that are connected share the least label."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def pair_groups(rows: DataFrame, key: str, item: str, chunk: int) -> DataFrame:
    """``rows`` of keys with two items and more, under groups ``g`` in which every two items of a key meet.

    A key over ``chunk`` items is split by a hash of the item, and every two of its
    parts are a group of their own, so no key is one task however large.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = rows.join(sizes, key).withColumn("_parts", F.ceil(F.col("_n") / chunk).cast("int"))
    met = met.withColumn("_part", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda k: F.xxhash64(key, F.least(k, "_part"), F.greatest(k, "_part")))
    return met.select(*rows.columns, F.explode(groups).alias("g"))


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Jobs run inside hand at most ``rows`` rows at a time to Python, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, settle: Settled) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, component)``; the component is its least node.

    Alternating large and small stars: every node hands its larger neighbours,
    then all of them, to the least node it knows. The number of rounds grows with
    the logarithm of the longest path, minima combine before they are shuffled,
    and neither links nor components reach the driver, only a count and a checksum.
    """

    def sums(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = sums(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        settle.drop(current)
        current, before, mark = after, mark, sums(after)
        if mark == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Writers: versioned snapshots, CSV export, JSON reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from bidspan.operators import projections
from bidspan.session import exists, make_folder, move, remove


class Snapshot:
    """A table kept as whole versions plus a small log naming the current one.

    A version is written completely before its log row, so readers see either
    the old or the new table, and a failed or repeated write changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by or []

    def versions(self) -> DataFrame | None:
        log = f"{self.path}/_log"
        return self.spark.read.schema("version bigint").json(log) if exists(self.spark, log) else None

    def current(self) -> int | None:
        log = self.versions()
        return None if log is None else log.agg(F.max("version").alias("v")).first()["v"]

    def read(self, version: int | None = None) -> DataFrame | None:
        wanted = self.current() if version is None else version
        return None if wanted is None else self.spark.read.parquet(f"{self.path}/v={wanted}")

    def stage(self, df: DataFrame, version: int) -> DataFrame:
        """Write a version's data without making it current; repeating it is harmless."""
        writer = df.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/v={version}")
        return self.read(version)

    def commit(self, version: int) -> None:
        log = self.spark.range(1).select(F.lit(version).cast("long").alias("version"))
        log.coalesce(1).write.mode("append").json(f"{self.path}/_log")

    def write(self, df: DataFrame, version: int) -> bool:
        """Write ``version`` and make it current; a version already logged is left alone."""
        now = self.current()
        if now is not None and version <= now:
            return False
        self.stage(df, version)
        self.commit(version)
        return True

    def drop(self, version: int) -> None:
        """Remove a superseded version; one that is not there is no error."""
        remove(self.spark, f"{self.path}/v={version}")


class KeyedTable:
    """A table in a fixed number of partitions by the hash of its key.

    A batch reads and rewrites the partitions its keys fall into and no other. They
    are written beside the table (``stage``), once; ``commit`` writes the log row and
    moves their folders into the table, in place of those they replace. A commit
    that died half-way left the folders it had not moved, and the next one who
    opens the table finishes it. Readers that need one version read between commits.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 32):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self._recover()

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Partitions that the keys of ``batch`` fall into; at most as many numbers as there are partitions."""
        return sorted(r["part"] for r in batch.select(self.part().alias("part")).distinct().collect())

    def _rows(self, name: str):
        path = f"{self.path}/{name}"
        if not exists(self.spark, path):
            return None
        rows = self.spark.read.schema("version bigint, columns string, parts array<int>").json(f"{path}/*")
        return rows.orderBy(F.desc("version")).first()

    def current(self) -> int | None:
        row = self._rows("log")
        return None if row is None else row["version"]

    def read(self, parts: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its partitions: the files of others are not listed."""
        row = self._rows("log")
        if row is None:
            return None
        columns = StructType.fromJson(json.loads(row["columns"]))
        if parts is not None and not parts or not exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(StructType(columns.fields).add("part", IntegerType())).parquet(f"{self.path}/data")
        return (rows if parts is None else rows.filter(F.col("part").isin(list(parts)))).drop("part")

    def stage(self, rows: DataFrame, version: int, parts: Sequence[int] | None = None) -> DataFrame:
        """Write all rows of ``parts`` (of the whole table, if None) beside the table; repeating it is harmless."""
        path = f"{self.path}/staged/v={version}"
        rows.withColumn("part", self.part()).hint("rebalance", "part").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
        whole = list(range(self.parts)) if parts is None else list(parts)
        for part in whole:
            make_folder(self.spark, f"{path}/part={part}")  # one that got no row replaces what it held, too
        self._log("ready", version, rows, whole)
        return self._staged(version, rows.schema)

    def _staged(self, version: int, columns: StructType) -> DataFrame:
        return self.spark.read.schema(StructType(columns.fields).add("part", IntegerType())).parquet(f"{self.path}/staged/v={version}").drop("part")

    def _log(self, name: str, version: int, rows: DataFrame, parts: Sequence[int]) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(rows.schema.json()).alias("columns"), F.array(*[F.lit(p) for p in parts]).cast("array<int>").alias("parts"))
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}/{version}")

    def commit(self, version: int) -> None:
        """Make a staged version the table's: its log row comes first, as the promise that an interrupted move is finished."""
        row = self._rows("ready")
        before = self.current()
        columns = StructType.fromJson(json.loads(row["columns"]))
        self._log("log", version, self.spark.createDataFrame([], columns), row["parts"])
        if before is not None:
            remove(self.spark, f"{self.path}/log/{before}")
        self._publish(version, row["parts"])

    def _publish(self, version: int, parts: Sequence[int]) -> None:
        """Move the staged folders into the table: nothing is read or written again, and repeating it is harmless."""
        staged = f"{self.path}/staged/v={version}"
        for part in parts:
            source = f"{staged}/part={part}"
            if exists(self.spark, source):
                move(self.spark, source, f"{self.path}/data/part={part}")
        remove(self.spark, f"{self.path}/ready")
        remove(self.spark, f"{self.path}/staged")

    def _recover(self) -> None:
        ready, now = self._rows("ready"), self.current()
        if ready is not None and now is not None and ready["version"] == now:
            self._publish(now, ready["parts"])

    def write(self, rows: DataFrame, version: int, parts: Sequence[int] | None = None) -> bool:
        """Stage and commit; a version already logged is left alone."""
        now = self.current()
        if now is not None and version <= now:
            return False
        self.stage(rows, version, parts)
        self.commit(version)
        return True

    def merge(self, batch: DataFrame, version: int, apply: Callable[[DataFrame, DataFrame], DataFrame], keys: DataFrame | None = None) -> bool:
        """Replace what the batch touches by ``apply(held, batch)``; ``keys`` names further keys it speaks of."""
        named = batch.select(self.key) if keys is None else batch.select(self.key).unionByName(keys.select(self.key))
        parts = self.touched(named)
        return self.write(apply(self.read(parts), batch), version, parts)


def write_csv(bids: DataFrame, now: Column, path: str) -> None:
    """Spreadsheet export: BOM, header, CRLF, every cell quoted.

    Part files in order: the first holds the header, the others the rows, in the
    order of ``bids`` (sort it, and it is written by range, in as many tasks as
    it takes). Joined by name, for instance when they are sent, they are one file.
    """
    header = "\ufeff" + ";".join(name for name, _ in projections.csv_cells(now))
    top = bids.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    top.union(projections.csv_line(bids, now).select("value")).write.option("lineSep", "\r\n").text(path)


def report(df: DataFrame) -> DataFrame:
    """One JSON object from a one-row result."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    report(df).coalesce(1).write.text(path)

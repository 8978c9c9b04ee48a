"""Structured Streaming twins: pages into the catalogue, counters, states, days.

Every job is a file-source stream run with ``availableNow``: it takes what has
arrived, commits and stops, and resumes from its checkpoint next time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidspan.functions import scoring
from bidspan.operators import merge, projections, windows
from bidspan.session import LOCAL_ZONE, exists, settle
from bidspan.sources import readers, schemas
from bidspan.sources.sinks import KeyedTable, Snapshot


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that overwrites its own batch folder, so a repeated batch is harmless."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


def latest_batch(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key over update-mode output."""
    rows = spark.read.parquet(path)
    return windows.best_row(rows, keys, F.col("batch")).drop("batch")


_PAYLOAD = "key string, hash string, payload string"


def stream_pages(
    spark: SparkSession,
    path: str,
    catalog: KeyedTable,
    ledger: Snapshot,
    log_path: str,
    now: Column,
    checkpoint: str,
    seen_in_proposals: bool = True,
    policy: str = "todas",
    files_per_trigger: int | None = None,
    config: scoring.ScoreConfig = scoring.ScoreConfig(),
) -> None:
    """Merge listing pages as they arrive, each page once and in order.

    A trigger may hold many pages; they are merged together, and only the catalogue's
    partitions that their keys fall into are read and rewritten. A page that arrives before its
    predecessor waits in ``waiting`` under ``log_path`` and is merged when the gap
    closes; a repeated page has no effect. Nothing stops the stream and nothing
    vanishes: invalid pages and rows without identity go to ``rejected_pages`` and
    ``rejected_rows`` with the reason, and every version of a payload is appended
    once to ``payloads``, which lie in the catalogue's partitions too. The
    catalogue's log row commits the batch: all else is keyed by the batch id, so a
    batch that died half-way is simply repeated. Versions of the waiting pages and
    the ledger that it supersedes are removed.
    """
    waiting = Snapshot(spark, f"{log_path}/waiting")
    columns = list(spark.createDataFrame([], schemas.ENVELOPE).columns)

    def log(df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{log_path}/{name}/batch={batch}")

    def on_batch(df: DataFrame, batch: int) -> None:
        done = catalog.current()
        if batch <= done:
            return  # committed before a restart
        next_pages = ledger.read(done)
        judged = readers.page_quality(df)
        log(judged.filter(F.col("quality") == "invalida"), "rejected_pages", batch)
        pages = judged.filter(F.col("quality") != "invalida").select(*columns)
        if done >= 0:
            pages = pages.unionByName(waiting.read(done))
        decisions = merge.page_ledger(pages.select("segment_id", F.col("numeroPagina").alias("page")), next_pages)
        decisions = settle(decisions, "pages")  # page numbers only; asked three times below
        early = decisions.filter(F.col("decision") == "erro").select("segment_id", F.col("page").alias("numeroPagina"))
        waiting.stage(pages.join(early, ["segment_id", "numeroPagina"], "left_semi").select(*columns), batch)
        apply = decisions.filter(F.col("decision") == "aplicar").select("segment_id", "page")
        rows = readers.page_rows(pages).join(apply, ["segment_id", "page"], "left_semi")
        mapped = projections.map_header(rows, now, seen_in_proposals, config)
        valid, rejected = readers.quarantine(settle(mapped, "mapped", "zstd"), F.col("control_no"), "numeroControlePNCP ausente")
        log(rejected, "rejected_rows", batch)
        parts = catalog.touched(valid)
        held = catalog.read(parts).drop("action")
        # only keys that the batch repeats, few as a rule, are brought together; the rows of all others stay where they are
        repeated = settle(valid.groupBy("control_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("control_no"), "repeated")
        single, several = (valid.join(repeated, "control_no", how).select(*valid.columns) for how in ("left_anti", "left_semi"))

        counters = Observation(f"merge-{batch}")
        action = F.col("action")
        newest = single.unionByName(windows.dedup_batch(several))
        merged = merge.merge_catalog(held, newest, policy, now, unique=True).observe(
            counters,
            F.count_if(action.isNotNull()).alias("received"),
            F.count_if(action == "recusado").alias("refused"),
            F.count_if(action == "novo").alias("new"),
            F.count_if(action == "atualizado").alias("updated"),
            F.count_if(action == "ignorado").alias("ignored"),
        )
        staged = catalog.stage(merged.filter(F.coalesce("action", F.lit("")) != "recusado"), batch, parts)
        log(merge.history(staged, now), "history", batch)
        versions = single.unionByName(several.dropDuplicates(["control_no", "source_hash"]))
        fresh = versions.select(F.col("control_no").alias("key"), F.col("source_hash").alias("hash"), F.to_json(F.struct(*valid.columns)).alias("payload"))
        if done >= 0 and exists(spark, f"{log_path}/payloads"):
            kept = spark.read.schema(f"{_PAYLOAD}, part int, batch int").parquet(f"{log_path}/payloads")
            stored = kept.filter(F.col("part").isin(parts) & (F.col("batch") < batch)).select("key", "hash")
            fresh = fresh.join(stored, ["key", "hash"], "left_anti")
        fresh = fresh.withColumns({"part": F.pmod(F.xxhash64("key"), F.lit(catalog.parts)).cast("int"), "batch": F.lit(batch)})
        fresh.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{log_path}/payloads")
        names = ["received", "refused", "new", "updated", "ignored"]
        counted = counters.get if parts else dict.fromkeys(names, 0)  # without rows nothing is observed
        log(spark.range(1).select(*[F.lit(counted[n]).cast("long").alias(n) for n in names]), "counters", batch)
        moved = apply.groupBy("segment_id").agg((F.max("page") + 1).alias("next_page"))
        ledger.stage(merge.upsert_latest(next_pages, moved, ["segment_id"]), batch)
        catalog.commit(batch)
        for table in (ledger, waiting):
            table.drop(done)

    stream = file_stream(spark, path, schemas.ENVELOPE, "json", files_per_trigger)
    run_available(stream, on_batch, checkpoint)


# ------------------------------------------------------------------- late rows


def _newest(spark: SparkSession, path: str, batch: int):
    """Newest event time of the batches before, or None."""
    if not exists(spark, f"{path}/clock"):
        return None
    rows = spark.read.schema("newest timestamp, batch int").parquet(f"{path}/clock")
    return rows.filter(F.col("batch") < batch).agg(F.max("newest")).first()[0]


def run_with_late(stream: DataFrame, path: str, checkpoint: str, ts: str, delay: str, on_time: Callable[[DataFrame, int], None]) -> None:
    """Run ``on_time(rows, batch)`` on what is not behind the watermark; the rest is kept, not dropped.

    The watermark is the newest event time of earlier batches less ``delay``. Rows
    behind it are written under ``path/late``, by batch and day, for a later merge
    (see :func:`late_once`). Each batch overwrites its own folders and its clock
    row comes last, so a repeated batch changes nothing. Rows without a time are
    on time.
    """
    spark = stream.sparkSession

    def on_batch(df: DataFrame, batch: int) -> None:
        newest = _newest(spark, path, batch)
        rows = df.withColumn("day", F.to_date(ts))
        late = F.lit(False) if newest is None else F.coalesce(F.col(ts) < F.lit(newest) - F.expr(f"interval {delay}"), F.lit(False))
        rows.filter(late).write.mode("overwrite").partitionBy("day").parquet(f"{path}/late/batch={batch}")
        on_time(rows.filter(~late), batch)
        df.agg(F.max(ts).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/batch={batch}")

    run_available(stream, on_batch, checkpoint)


def _stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int, day date").parquet(f"{path}/{name}")


def _in_days(rows: DataFrame, other: DataFrame, delay: str) -> DataFrame:
    """``rows`` of the days that ``other`` spans, ``delay`` wider: other partitions are not read."""
    low, high, none = other.agg(F.min("day"), F.max("day"), F.count_if(F.col("day").isNull())).first()
    wide = F.expr(f"interval {delay}")
    inside = F.lit(False) if low is None else F.col("day").between((F.lit(low).cast("timestamp") - wide).cast("date"), (F.lit(high).cast("timestamp") + wide).cast("date"))
    return rows.filter(inside | F.col("day").isNull() if none else inside)


def stream_dedup(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, delay: str, then: Callable[[DataFrame, int], None] | None = None) -> None:
    """Rows once per key, under ``path/on_time``; ``then(rows, batch)`` gets each batch's new ones.

    Rows lie by day. A batch is compared with the days it spans, ``delay`` wider,
    so neither state nor reads grow with the age of the stream. A key whose
    repeats carry the same time, as replays do, is found whatever its age.
    """
    spark, schema = stream.sparkSession, ddl(stream)

    def on_time(rows: DataFrame, batch: int) -> None:
        fresh = settle(rows.dropDuplicates([key]), "fresh")
        if exists(spark, f"{path}/on_time"):
            earlier = _in_days(_stored(spark, path, "on_time", schema).filter(F.col("batch") < batch), fresh, delay)
            fresh = fresh.join(earlier.select(key), key, "left_anti")
        target = f"{path}/on_time/batch={batch}"
        fresh.write.mode("overwrite").partitionBy("day").parquet(target)
        if then:
            then(spark.read.schema(f"{schema}, day date").parquet(target), batch)

    run_with_late(stream, path, checkpoint, ts, delay, on_time)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def late_once(spark: SparkSession, path: str, schema: str, key: str, delay: str) -> DataFrame:
    """Late rows that no row on time has told already, once per key."""
    late = _stored(spark, path, "late", schema)
    told = _in_days(_stored(spark, path, "on_time", schema), late, delay)
    return late.dropDuplicates([key]).join(told.select(key), key, "left_anti")


def deduplicated(spark: SparkSession, path: str, schema: str, key: str, delay: str) -> DataFrame:
    """All rows of :func:`stream_dedup`, late ones merged in."""
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    return _stored(spark, path, "on_time", schema).select(*columns).unionByName(late_once(spark, path, schema, key, delay).select(*columns))


def stream_latest_state(stream: DataFrame, key: str, order: list[str], added: Column) -> DataFrame:
    """Membership per key replayed from an event log: the last event decides (update mode)."""
    return stream.groupBy(key).agg(F.max_by(added, F.struct(*order)).alias("member"))


def stream_metrics(stream: DataFrame, path: str, checkpoint: str, job: str, event: str, sums: dict[str, Column], ts: str, delay: str) -> None:
    """Additive counters per job, each event id counted once: one delta per batch under ``path/deltas``."""

    def add(rows: DataFrame, batch: int) -> None:
        rows.groupBy(job).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")

    stream_dedup(stream, path, checkpoint, event, ts, delay, add)


def metrics(spark: SparkSession, path: str, schema: str, job: str, event: str, sums: dict[str, Column], delay: str) -> DataFrame:
    """The counters of :func:`stream_metrics`: its deltas, and what late rows add."""
    deltas = spark.read.parquet(f"{path}/deltas").drop("batch")
    late = late_once(spark, path, schema, event, delay).groupBy(job).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return deltas.unionByName(late).groupBy(job).agg(*[F.sum(n).alias(n) for n in sums])


def stream_day_counts(stream: DataFrame, path: str, checkpoint: str, ts: str, delay: str = "2 days") -> None:
    """Rows per local day, one delta per batch under ``path/deltas``; clock changes of any year count."""

    def add(rows: DataFrame, batch: int) -> None:
        _per_day(rows, ts).write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")

    run_with_late(stream, path, checkpoint, ts, delay, add)


def _per_day(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.to_date(F.from_utc_timestamp(ts, LOCAL_ZONE)).alias("local_day")).agg(F.count(F.lit(1)).alias("n"))


def day_counts(spark: SparkSession, path: str, schema: str, ts: str) -> DataFrame:
    """``local_day, n`` of :func:`stream_day_counts`, late rows counted in."""
    deltas = spark.read.parquet(f"{path}/deltas").drop("batch")
    return deltas.unionByName(_per_day(_stored(spark, path, "late", schema), ts)).groupBy("local_day").agg(F.sum("n").alias("n"))


def merge_late(catalog: DataFrame, late: DataFrame, now: Column) -> DataFrame:
    """A late response is judged by its version and never dropped for its age."""
    return merge.result(merge.merge_catalog(catalog, late, "todas", now))

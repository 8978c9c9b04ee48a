"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_ZONE = "America/Sao_Paulo"

_made: list[str] = []  # paths given out by fresh_path


def configure(spark: SparkSession) -> SparkSession:
    """Instants are UTC everywhere; local days are derived with an explicit zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only on a local master that names none (unit tests on one machine) is a
    fresh temporary folder made and recorded, so later calls agree.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.environ.get("BIDSPAN_WORK") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
        named = spark.sparkContext.getCheckpointDir()
    return named


def kept_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder for a table that outlives one result, such as an index; its owner removes it."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nobody has used yet; :func:`clear_work` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_work(spark: SparkSession) -> None:
    """Remove all tables that this process has written to the shared folder; for callers whose results are stored."""
    while _made:
        remove(spark, _made.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it is stored; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder, unless it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another of the same store, which goes."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    files.delete(new, True)
    if not files.rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def settle(df, label: str, compression: str = "snappy"):
    """Cut lineage by writing a table to the shared folder and reading it back.

    Survives executor loss (unlike a local checkpoint) and gives the next stage
    exact file statistics, so Spark can decide broadcasts on a known size.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

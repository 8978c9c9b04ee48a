"""Readers of the fetcher's drop folder and of reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspan.functions import classify, geo, hashing
from bidspan.functions import text as tx
from bidspan.sources import schemas

LISTING_KINDS = {  # fixed values: listing endpoint -> (seen among open proposals, admission policy)
    "proposta": (True, "todas"),
    "publicacao": (False, "todas"),
    "atualizacao": (False, "abertas"),
}


def page_envelopes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Listing pages, one envelope per line (or per file with ``multi_line``).

    Unreadable text is kept in ``_corrupt_record`` instead of failing the job.
    """
    reader = spark.read.schema(schemas.ENVELOPE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("multiLine", multi_line).json(path).withColumn("file", F.input_file_name())


def page_quality(pages: DataFrame) -> DataFrame:
    """Attach ``quality`` (ok, vazia, invalida) and the ``reason``."""
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "corpo não é JSON de envelope")
        .when(F.coalesce("empty", F.lit(False)) & F.col("data").isNull(), F.lit(None))
        .when(F.col("data").isNull(), 'campo "data" ausente ou não é lista')
        .when(F.col("numeroPagina") != F.col("requestedPage"), "página recebida não é a pedida")
    )
    empty = F.col("data").isNull() | (F.size("data") == 0)
    quality = F.when(F.col("reason").isNotNull(), "invalida").when(empty, "vazia").otherwise("ok")
    return pages.withColumn("reason", reason).withColumn("quality", quality)


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of good pages with their page metadata; ``position`` is a total order of rows over pages and segments."""
    rows = pages.select("segment_id", "numeroPagina", "totalPaginas", F.posexplode("data").alias("_i", "_r"))
    position = F.struct("numeroPagina", "segment_id", "_i").alias("position")
    return rows.select("segment_id", F.col("numeroPagina").alias("page"), "totalPaginas", position, "_r.*")


def quarantine(rows: DataFrame, identity: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) over one scan; a row without identity never drops its page."""
    missing = identity.isNull()
    return rows.filter(~missing), rows.filter(missing).withColumn("reason", F.lit(reason))


def documents_array(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Bare JSON arrays of document metadata; each array element is a row."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", multi_line).json(path)


def items_array(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.ITEM).option("multiLine", multi_line).json(path)


def items_complete(items: DataFrame, page_size: int, max_pages: int) -> DataFrame:
    """``complete`` per bid: the last page read was short, or the page limit was not reached."""
    per_page = items.groupBy("bid_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    last = F.max_by("_n", "page")
    return per_page.groupBy("bid_id").agg(
        F.sum("_n").alias("items"), ((last < page_size) | (F.max("page") < max_pages)).alias("complete")
    )


def modalities(spark: SparkSession) -> DataFrame:
    """The modality domain: a fixed list of 19, all active."""
    rows = [(i, name, True) for i, name in enumerate(classify.MODALITIES, start=1)]
    return spark.createDataFrame(rows, schemas.MODALITY).orderBy("modality_id")


def modality_name(modality_id: Column) -> Column:
    """Name by id as an expression: the list is fixed and short, so no join is planned."""
    names = F.array(*[F.lit(n) for n in classify.MODALITIES])
    return F.when(modality_id.between(1, len(classify.MODALITIES)), F.element_at(names, modality_id.cast("int")))


def cities(spark: SparkSession, path: str) -> DataFrame:
    return checked_cities(spark.read.schema(schemas.CITY).option("header", True).csv(path))


def checked_cities(df: DataFrame) -> DataFrame:
    good = df["city_code"].rlike(r"^\d{7}$") & (F.length(df["uf"]) >= 2) & geo.valid_point(df["lat"], df["lon"])
    return df.filter(F.coalesce(good, F.lit(False)))


MAX_FILE_BYTES = 25 * 1024 * 1024  # fixed value


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored files of a folder with ``content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def binary_meta(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Size, digest, first 8 bytes and verdict; the content itself is dropped."""
    size = F.length("content")
    verdict = F.when(size == 0, "vazio").when(size > max_bytes, "grande_demais").otherwise("ok")
    kept = [c for c in files.columns if c != "content"]
    return files.select(
        *kept, size.cast("long").alias("bytes"), hashing.file_hash(F.col("content")).alias("sha256"),
        F.substring("content", 1, 8).alias("head"), verdict.alias("verdict"),
    )


def expected_files(expected: DataFrame, meta: DataFrame, key: str = "path") -> DataFrame:
    """Files that should be stored, with their verdict.

    Spark's file sources list no zero-length files, so an expected file that
    was not read is an empty one and says so.
    """
    joined = expected.select(key).join(meta, key, "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit("vazio"))).withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def payload_archive(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Payload rows to append: one per (key, hash), not stored yet."""
    from bidspan.operators.joins import anti_conflict

    return anti_conflict(new, stored, ["key", "hash"])

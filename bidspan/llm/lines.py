"""Line deduplication: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import BLANKS, ascii_lower, packed_row

#: A key counts from this many code points, in this many documents.
MIN_CHARS, MIN_DOCS = 40, 5
#: Tasks that the lines of one key are dealt to on their way back to the documents.
SALTS = 8


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Normalised lines are exploded and hashed (128 bits), distinct documents are
    counted for each hash, and lines at or over ``min_docs`` go from all documents
    but the one with the largest ``doc_id`` that holds them; what stays is put
    together again in order of position. Only hashes and positions are shuffled
    for the count; texts move once, for the reassembly. A line that stands in
    very many documents is pre-aggregated where it is read, and salted on its way
    back to the documents.

    A null or empty text is one empty line. A null ``doc_id`` is one document
    that ranks below all ids. Rows that repeat a ``doc_id`` count as one document.
    An empty table gives an empty table; further columns pass through unchanged,
    except that ones named as an added column are replaced.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    names = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    same_text = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = docs.select(packed_row(docs, names).alias("row"), "doc_id", text.alias("text"), same_text.alias("text_hash"))
    lines = (
        rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    shared = (
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("in_docs"), F.max("doc_id").alias("holder"))
        .where(F.col("in_docs") >= min_docs)
    )
    gone = (
        lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))
        .join(shared.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(SALTS))))), ["h1", "h2", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    )
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    cut = joined.select("row", "text", "gone", F.split("text", "\n", -1).alias("parts"))  # once a text, not once a line
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    done = cut.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n")).alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return done.select(*(F.col("row")[c].alias(c) for c in names), *added)


def without_shared_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the kept text as ``text`` (and its length as ``n_chars``); all other columns, whatever their names, as they were.

    Odd rows as in :func:`drop_shared_lines`; a null text becomes the empty one.
    """
    whole = docs.select(packed_row(docs).alias("row"), "doc_id", "text")
    kept = drop_shared_lines(whole, **how)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

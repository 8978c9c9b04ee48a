"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.llm.common import BLANKS, Settled, ascii_lower

#: Words of a shingle; one hash in SCALE, those below 2**64 / SCALE, is retained.
WIDTH, SCALE = 5, 8


def with_sketch(df: DataFrame, text: Column, name: str, *, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of ``text`` as column ``name``: a sorted array of distinct 64-bit hashes.

    A shingle starts at every word and has ``width`` words, fewer at the end of the
    text. Sketches of parts merge by union. A text of which no hash lies below the
    bound is represented by its least hash, so that short and empty texts have a
    fingerprint too.
    """
    words, shingles = f"_{name}_words", f"_{name}_shingles"
    df = df.withColumn(words, F.transform(F.split(F.btrim(ascii_lower(text), F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w)))
    df = df.withColumn(shingles, F.transform(words, lambda h, i: F.xxhash64(h, *(F.get(F.col(words), i + k) for k in range(1, width)))))
    low = F.filter(shingles, lambda h: (h >= 0) & (h < 2**64 // scale))
    df = df.withColumn(name, F.array_sort(F.array_distinct(F.when(F.exists(shingles, lambda h: (h >= 0) & (h < 2**64 // scale)), low).otherwise(F.array(F.array_min(shingles))))))
    return df.drop(words, shingles)


def fingerprint_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all (Jaccard)."""
    common = F.size(F.array_intersect(a, b))
    return (common / (F.size(a) + F.size(b) - common)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, however much larger it is."""
    return (F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def next_documents(docs: DataFrame, settle: Settled) -> DataFrame:
    """``doc_id, text_hash, next_id, next_hash, need``: who follows whom in descending id, the first after the last.

    Ids are dealt by range; inside a range the follower is the next row, and only
    the first row of each range is looked at across ranges. Rows with equal id and
    text are one document; null ids come last.
    """
    narrow = settle(docs.select("doc_id", "text_hash", (F.char_length("text") / 2).cast("long").alias("need")).distinct())
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash")]
    ranged = settle(narrow.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    by = "order by doc_id desc nulls last, text_hash"
    rows = ranged.withColumn("follower", F.expr(f"lead(struct(doc_id, text_hash)) over (partition by part {by})"))
    heads = ranged.withColumn("rn", F.expr(f"row_number() over (partition by part {by})")).where("rn = 1").select("part", F.struct("doc_id", "text_hash").alias("head"))
    heads = heads.select("part", F.expr("coalesce(lead(head) over (order by part), first(head) over (order by part rows between unbounded preceding and unbounded following))").alias("after"))
    follower = F.coalesce("follower", "after")
    return rows.join(heads, "part").select("doc_id", "text_hash", follower["doc_id"].alias("next_id"), follower["text_hash"].alias("next_hash"), "need")


def compare_edited(docs: DataFrame, *, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Every document against its edited text and against the next document.

    The edited text has the last half of its code points replaced by as many from
    the start of the next document. Columns: ``doc_id, n_chars, edited, sketch,
    edited_sketch, near_edited, near_next, held_by_edited`` (containment).

    Texts are shuffled once, by id; the rows that bring the start of the next
    document use the same shuffle and move half a text each.

    A null text is an empty one. Null ids come last; a table of one document has
    it as its own next. Rows that repeat id and text have the same result each.
    An empty table gives an empty table; other columns are not read.
    """
    settle = Settled(docs.sparkSession, "sketch")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    after = settle(next_documents(plain, settle))

    def key(doc_id: str, text_hash: str, as_: str) -> list[Column]:
        """Never null, so that joins on it use the partitions of the shuffle that is there."""
        parts = (F.coalesce(doc_id, F.lit(0)), F.col(doc_id).isNull(), F.col(text_hash))
        return [c.alias(f"{as_}{i}") for i, c in enumerate(parts)]

    dealt = with_sketch(plain, F.col("text"), "sketch", width=width, scale=scale).select("doc_id", "text", "sketch", *key("doc_id", "text_hash", "k")).repartition("k0", "k1", "k2")
    feeds = after.select(*key("next_id", "next_hash", "k"), *key("doc_id", "text_hash", "for"), "need")
    once = dealt.withColumn("rn", F.expr("row_number() over (partition by k0, k1, k2 order by doc_id)")).where("rn = 1")
    starts = once.join(feeds, ["k0", "k1", "k2"])
    starts = starts.select(*(F.col(f"for{i}").alias(f"k{i}") for i in range(3)), F.expr("substring(text, 1, int(need))").alias("start"), F.col("sketch").alias("next_sketch"))
    both = dealt.join(starts, ["k0", "k1", "k2"])
    n = F.char_length("text")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, char_length(text) - int(char_length(text) / 2))"), F.col("start")).alias("edited"), "sketch", "next_sketch")
    both = with_sketch(both, F.col("edited"), "edited_sketch", width=width, scale=scale)
    return both.select(
        "doc_id", "n_chars", "edited", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )

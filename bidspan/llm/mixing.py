"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidspan.llm.common import WORD, Settled, packed_row

#: Weights by rank of the source, repeating; share of all words that the mix takes; most takes of one word.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of one block of the schedule.
BLOCK_WORDS = 1024
#: Golden-ratio step of a 31-bit Weyl sequence: the odd number next to 2**31 / 1.618...; it visits all 2**31 points.
STEP, POINTS = 1327217885, 2**31
#: Documents of a source are ordered by 60 hash bits, of which the first 12 are the bucket that is summed on its own.
ORDER_BITS, BUCKET_BITS = 60, 12
#: Slots of the schedule beyond twice the number of blocks.
SPARE_SLOTS = 64
#: Slots whose ranks are counted together.
SLOT_CHUNK = 65536


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with ``rank``, ``weight`` and ``target``.

    The weighted shares are filled like water: sources by rising ``cap / weight``,
    so a source is full exactly if the level reaches its cap. From the first source
    that stays below its cap on, levels computed as if it were full only fall. The
    windows hold one row per source, the only thing here that is not partitioned.
    """
    ranked = sizes.withColumn("rank", F.expr("row_number() over (order by source nulls last)"))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights))).withColumn("cap", F.col("source_size") * most)
    level = (
        ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("filled", F.expr("coalesce(sum(cap) over (order by full_at, rank rows between unbounded preceding and 1 preceding), 0)"))
        .withColumn("open", F.expr("sum(weight) over (order by full_at, rank rows between current row and unbounded following)"))
        .withColumn("level", (F.expr("sum(source_size) over ()") * F.lit(float(share)) - F.col("filled")) / F.col("open"))
        .withColumn("level", F.expr("max(case when level <= full_at then level end) over ()"))
    )
    return level.select("source", "source_size", "rank", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def slot_schedule(spark, targets: DataFrame, n_slots: int) -> DataFrame:
    """``slot, rank, block``: slot i plays the next unplayed block of the source that its point falls on."""
    high = F.expr("sum(target) over (order by rank)") / F.expr("nullif(sum(target) over (), 0)")
    edges = targets.select("rank", high.alias("high")).agg(F.array_sort(F.collect_list(F.struct("rank", "high"))).alias("e"))
    edges = edges.select(F.transform("e", lambda x: x["high"])).scalar()
    point = (((F.col("id") + 1) % POINTS) * STEP % POINTS).cast("double") / POINTS
    slots = spark.range(n_slots).select("id", point.alias("point"), edges.alias("edges")).select(
        F.col("id").alias("slot"),
        F.least(F.size(F.filter("edges", lambda h: h <= F.col("point"))) + 1, F.size("edges")).alias("rank"),
        (F.col("id") / SLOT_CHUNK).cast("long").alias("chunk"),
    )
    before = "coalesce(sum(n) over (partition by rank order by chunk rows between unbounded preceding and 1 preceding), 0)"
    offsets = slots.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n")).select("rank", "chunk", F.expr(before).alias("before"))
    numbered = slots.withColumn("rn", F.expr("row_number() over (partition by rank, chunk order by slot)"))
    return numbered.join(offsets, ["rank", "chunk"]).select("slot", "rank", (F.col("before") + F.col("rn") - 1).alias("block"))


def mix_documents(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as pieces: which words of which document stand where in the schedule.

    Each source's documents, in hash order, form a line of words that is read
    over and over until the target is met, cut into blocks of ``block_words``.
    Golden-ratio points mapped through the cumulative targets say which source
    fills a slot, and the n-th slot of a source takes its n-th block, so any
    stretch of slots holds the sources near their shares. The schedule runs on
    until all sources have had their blocks (twice as many slots as blocks, and
    64); slots of a source that is through are skipped. Only a source whose share
    is less than about one such slot can have blocks left: they follow behind.

    Columns: ``doc_id, source, size, source_size, target``, ``text_hash, bucket,
    place`` (which tell repeated rows apart), and per piece ``epoch, first_word,
    n_words, block, slot``. A document of which nothing is taken has one row with
    ``n_words`` 0 and nulls.

    A null text has size 0. Null sources are one source, ranked last. A null
    ``doc_id`` is ordered like the empty text. Sources without words get target 0.
    An empty table gives an empty table. Texts are read once and never shuffled;
    a hot source is summed and ordered in 4096 hash buckets.
    """
    spark = docs.sparkSession
    settle = Settled(spark, "mixing")
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string")))
    rows = settle(
        docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long").alias("ord"))
        .withColumn("bucket", F.shiftright("ord", ORDER_BITS - BUCKET_BITS).cast("int"))
    )
    targets = settle(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most))
    n_slots = 2 * int(targets.agg(F.coalesce(F.sum(F.ceil(F.col("target") / block_words)), F.lit(0))).first()[0]) + SPARE_SLOTS
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = "coalesce(sum(n) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0)"
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.expr(before).alias("before"))
    inside = "over (partition by source, bucket order by ord, doc_id nulls first, size, text_hash rows between unbounded preceding and current row)"
    line = rows.withColumn("upto", F.expr(f"sum(size) {inside}")).withColumn("place", F.expr(f"row_number() {inside}"))
    line = line.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    named = targets.withColumnRenamed("source", "t_source").withColumn("want", F.round("target").cast("long"))
    line = line.join(named, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))

    def cut(epoch: int) -> Column:
        """Blocks that the document crosses when its line is read for the ``epoch``-th time."""
        a = F.col("source_size") * epoch + F.col("start")
        b = F.least(a + F.col("size"), F.col("want"))
        blocks = F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words))
        pieces = F.transform(
            blocks,
            lambda k: F.struct(
                F.lit(epoch).alias("epoch"), (F.greatest(a, k * block_words) - a).cast("long").alias("first_word"),
                (F.least(b, (k + 1) * block_words) - F.greatest(a, k * block_words)).cast("long").alias("n_words"), k.cast("long").alias("block"),
            ),
        )
        kind = T.ArrayType(T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("block", T.LongType())]))
        return F.when(b > a, pieces.cast(kind)).otherwise(F.array().cast(kind))

    pieces = line.select(
        "doc_id", "source", "size", "source_size", "target", "rank", "text_hash", "bucket", "place",
        F.inline_outer(F.concat(*(cut(e) for e in range(most)))),
    )
    slots = slot_schedule(spark, targets, n_slots)
    placed = pieces.join(slots, ["rank", "block"], "left")
    late = F.when(F.col("block").isNotNull(), F.lit(n_slots) + F.col("block"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "text_hash", "bucket", "place", "epoch", "first_word",
        F.coalesce("n_words", F.lit(0)).alias("n_words"), "block", F.coalesce("slot", late).alias("slot"),
    )


def taken_words(pieces: DataFrame) -> DataFrame:
    """One row per document from the pieces of :func:`mix_documents`: words taken, and the first slot that takes some."""
    slot = F.min(F.when(F.col("n_words") > 0, F.col("slot"))).alias("slot")
    return pieces.groupBy("doc_id", "source", "size", "source_size", "target", "text_hash", "bucket", "place").agg(F.sum("n_words").alias("taken"), slot)


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, joined by one space."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), n.cast("int")), " ")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, in the order of the schedule: one row of ``docs`` for each time that it is read, cut where the target ends.

    Rows of which nothing is taken go, null and blank texts among them; a row taken
    twice stands twice; the one row of a source in which the target is met keeps
    its first words. Rows are dealt and sorted by the slot in which a read begins,
    so a partition written from them holds a stretch of the schedule, in order.
    Other columns, whatever their names, come back as they were, and ``n_chars``
    follows the text.
    """
    key = ["doc_id", "source", "text_hash"]
    reads = mix_documents(docs, **how).where("n_words > 0")
    reads = reads.groupBy(*key, "size", "bucket", "place", "epoch").agg(F.min("slot").alias("slot"), F.sum("n_words").alias("n_words"))
    copies = reads.groupBy(*key, "size", "bucket", "place").agg(F.collect_list(F.struct("slot", "n_words")).alias("reads"))  # at most ``most`` each
    copies = copies.withColumn("copy", F.expr(f"row_number() over (partition by {', '.join(key)} order by bucket, place)"))
    rows = docs.select(packed_row(docs).alias("row"), F.col("doc_id").alias("r_id"), F.col("source").alias("r_source"), F.xxhash64("text").alias("r_hash"))
    rows = rows.withColumn("r_copy", F.expr("row_number() over (partition by r_id, r_source, r_hash order by r_hash)"))
    on = F.col("r_id").eqNullSafe(F.col("doc_id")) & F.col("r_source").eqNullSafe(F.col("source")) & (F.col("r_hash") == F.col("text_hash")) & (F.col("r_copy") == F.col("copy"))
    out = rows.join(copies, on).select("row", "size", F.inline("reads"))
    whole = F.col("row")["text"]
    text = F.when(F.col("n_words") < F.col("size"), first_words(whole, F.col("n_words"))).otherwise(whole)
    out = out.select("row", "slot", text.alias("mixed")).repartitionByRange("slot").sortWithinPartitions("slot")
    new = {"text": F.col("mixed"), "n_chars": F.char_length("mixed").cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

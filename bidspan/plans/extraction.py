"""Citation proof, excerpts, greedy packing and triage of extracted answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidspan.functions import classify, pieces
from bidspan.functions import text as tx
from bidspan.operators import windows
from bidspan.operators.joins import quote_matches

ITEM_SECTION = "habilitacao"  # fixed value: the section whose answers are items
MIN_QUOTE_CHARS = 12  # fixed value: shorter quotes occur anywhere and prove nothing


def cite_confirm(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach ``confirmed`` and the proving ``source_id`` to each quoted answer.

    Every fragment of the quote must occur in one source of the same bid. Cited
    sources come before others, and each kind in the order of ``ord``; a proof
    that was not cited replaces the citation.
    ``answers(answer_id, bid_id, quote, source_ids)``, ``sources(bid_id, source_id, ord, text)``.
    """
    quotes = answers.select(F.col("answer_id").alias("quote_id"), "bid_id", "quote")
    found = quote_matches(quotes, sources, on=["bid_id"], min_chars=MIN_QUOTE_CHARS)
    cited = answers.select(F.col("answer_id").alias("quote_id"), F.explode("source_ids").alias("source_id")).distinct()
    ranked = found.join(cited.withColumn("_cited", F.lit(0)), ["quote_id", "source_id"], "left").join(sources.select("source_id", "ord"), "source_id")
    first = ranked.groupBy("quote_id").agg(
        F.min_by("source_id", F.struct(F.coalesce("_cited", F.lit(1)), F.col("ord"), F.col("source_id"))).alias("proof")
    )
    joined = answers.join(first.withColumnRenamed("quote_id", "answer_id"), "answer_id", "left")
    fixed = F.when(
        F.col("proof").isNotNull() & ~F.coalesce(F.array_contains("source_ids", F.col("proof")), F.lit(False)),
        F.array(F.col("proof")),
    ).otherwise(F.col("source_ids"))
    return joined.withColumn("confirmed", F.col("proof").isNotNull()).withColumn("source_ids", fixed)


def drop_unproven(answers: DataFrame) -> DataFrame:
    """Negative answers without proof and quotes admitting silence become "not informed".

    Requirements of the ``habilitacao`` section are lists of items, not fields:
    they are confirmed or not, and never cleared.
    """
    kept = classify.keep_answer(F.col("value"), F.col("quote"), F.col("confirmed"))
    field = ~F.col("section").eqNullSafe(F.lit(ITEM_SECTION))
    return answers.withColumn("value", F.when(field, kept).otherwise(F.col("value")))


# ------------------------------------------------------------ greedy, in order


def _in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of a key in one partition, in order. Only ids and lengths travel."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def pack_batches(blocks: DataFrame, cap: int = pieces.BATCH_CHARS) -> DataFrame:
    """``blocks(bid_id, ord, length)`` with the greedy ``batch`` number.

    Packing depends on the previous block, so each bid is walked in order; rows
    stream through Arrow batches with two counters as state, nothing is held.
    """
    over = F.raise_error(F.concat(F.lit("block longer than a batch: "), F.col("length").cast("string")))
    guarded = blocks.withColumn("length", F.when(F.col("length") <= cap, F.col("length")).otherwise(over.cast("int")))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bid, used, number = None, 0, 0
        for pdf in batches:
            out = []
            for b, n in zip(pdf["bid_id"], pdf["length"]):
                if b != bid:
                    bid, used, number = b, 0, 0
                elif used + n > cap:
                    used, number = 0, number + 1
                used += n
                out.append(number)
            yield pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int32"))

    slim = guarded.select("bid_id", "ord", F.col("length").cast("int").alias("length"))
    types = dict(slim.dtypes)
    return _in_order(slim, ["bid_id"], ["ord"]).mapInPandas(walk, f"bid_id {types['bid_id']}, ord {types['ord']}, length int, batch int")


def running_budget(parts: DataFrame, budget: int) -> DataFrame:
    """``parts(bid_id, doc_order, ord, length)`` with ``kept`` under a shared budget.

    A piece that would overflow ends its document; later documents may still
    fit; a spent budget ends the bid.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bid = doc = None
        used, closed, spent = 0, False, False
        for pdf in batches:
            out = []
            for b, d, n in zip(pdf["bid_id"], pdf["doc_order"], pdf["length"]):
                if b != bid:
                    bid, doc, used, closed, spent = b, d, 0, False, False
                elif d != doc:
                    doc, closed, spent = d, False, spent or used >= budget
                fits = not spent and not closed and used + n <= budget
                closed = closed or not fits
                used += n if fits else 0
                out.append(fits)
            yield pdf.assign(kept=pd.Series(out, index=pdf.index, dtype=bool))

    slim = parts.select("bid_id", "doc_order", "ord", F.col("length").cast("int").alias("length"))
    t = dict(slim.dtypes)
    schema = f"bid_id {t['bid_id']}, doc_order {t['doc_order']}, ord {t['ord']}, length int, kept boolean"
    return _in_order(slim, ["bid_id"], ["doc_order", "ord"]).mapInPandas(walk, schema)


def anchor_windows(
    docs: DataFrame,
    patterns: list[str] | None = None,
    radius: int = pieces.ANCHOR_RADIUS,
    preamble: int | None = None,
    budget: int | None = None,
) -> DataFrame:
    """Excerpts around anchors, plus the opening of each document if ``preamble`` gives its length.

    All excerpts are returned; ``budget`` packs them into one prompt of so many
    characters a bid (see :func:`running_budget`), leaving out what does not fit.

    ``docs(bid_id, doc_id, doc_type, text)``; result ``(bid_id, doc_order, doc_id, ord, excerpt)``.
    Spans are found per text, merged with a window, packed on lengths only, and
    the text is cut from the document at the end.
    """
    clean = docs.select("bid_id", "doc_id", "doc_type", F.regexp_replace("text", "[ \t]+", " ").alias("text"))
    size = F.length("text")
    spans = clean.select("doc_id", size.alias("_n"), F.explode_outer(pieces.anchor_spans(F.col("text"), patterns)).alias("_s"))
    around = spans.filter(F.col("_s").isNotNull()).select(
        "doc_id",
        F.greatest(F.lit(0), F.col("_s.start") - radius).alias("start"),
        F.least(F.col("_n"), F.col("_s.start") + radius).alias("end"),
    )
    if preamble is not None:
        around = around.unionByName(clean.select("doc_id", F.lit(0).alias("start"), F.least(F.lit(preamble), size).alias("end")))
    merged = windows.interval_merge(around, ["doc_id"])

    weight = F.lit(9)
    for label, w in pieces.TYPE_ORDER.items():
        weight = F.when(F.col("doc_type") == label, w).otherwise(weight)
    order = F.concat_ws("-", weight.cast("string"), F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    cut = merged.join(clean.select("bid_id", "doc_id", order.alias("doc_order"), "text"), "doc_id")
    excerpt = tx.strip(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    cut = cut.select("bid_id", "doc_order", "doc_id", F.col("start").alias("ord"), excerpt.alias("excerpt"))
    if budget is None:
        return cut
    kept = running_budget(cut.withColumn("length", F.length("excerpt")), budget).filter("kept")
    return cut.join(kept.select("bid_id", "doc_order", "ord"), ["bid_id", "doc_order", "ord"], "left_semi")


# ---------------------------------------------------------------------- triage

# --- fixed values ---------------------------------------------------------------
MIN_PRICE_SHARE = 75.0
EXTRA_GUARANTEE_SHARE = 85.0
AMOUNT_TOLERANCE = 0.01
MISMATCH = "divergência de valor"


def triage_amounts(rows: DataFrame) -> DataFrame:
    """Amounts derived from the estimated value, and alerts where a stated one differs.

    ``rows(bid_id, value?, secret, proposal_pct?, contract_pct?, min_price_pct?,
    stated_proposal?, stated_contract?, stated_min_price?)``.
    """
    base = F.when(~F.coalesce("secret", F.lit(False)), F.col("value").cast("double"))
    cents = lambda c: F.round(c.cast("decimal(38,6)"), 2).cast("double")
    out = rows.withColumns(
        {
            "proposal_guarantee": cents(base * F.col("proposal_pct") / 100),
            "contract_guarantee": cents(base * F.col("contract_pct") / 100),
            "min_price": cents(base * F.coalesce("min_price_pct", F.lit(MIN_PRICE_SHARE)) / 100),
            "extra_guarantee_limit": cents(base * EXTRA_GUARANTEE_SHARE / 100),
        }
    )
    pairs = {"stated_proposal": "proposal_guarantee", "stated_contract": "contract_guarantee", "stated_min_price": "min_price"}
    alerts = [
        F.when(F.abs(F.col(stated) - F.col(own)) > AMOUNT_TOLERANCE + 1e-9, F.lit(f"{MISMATCH}: {own}"))
        for stated, own in pairs.items()
    ]
    return out.withColumn("alerts", F.array_compact(F.array(*alerts)))


def triage_verdict(statuses: list[Column]) -> Column:
    """Any blocking filter refuses; all OK recommends; otherwise with caveats."""
    blocking, fine = F.lit(False), F.lit(True)
    for s in statuses:
        blocking = blocking | F.coalesce(s == "IMPEDITIVO", F.lit(False))
        fine = fine & F.coalesce(s == "OK", F.lit(False))
    return F.when(blocking, "NAO_RECOMENDADO").when(fine, "RECOMENDADO").otherwise("PARTICIPAR_COM_RESSALVAS")

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=SCHEMA):
        """Documents from (doc_id, text) or whole rows."""
        full = [(*r, "en", f"s{(r[0] or 0) % 3}" if len(r) == 2 else r[2], len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null ids, texts and sources, empty and blank texts, repeated rows, a long text, and columns with clashing names."""
    from pyspark.sql import functions as F

    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n "), (5, "a b c"), (5, "a b c"), (None, "x y"), (None, None), (7, "word " * 30000), (8, "é<|endoftext|> ü"), (9, "A\x0bB C")]
    out = frame(rows).withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise(F.col("source")))
    clash = ["kept_text", "n_lines", "score", "shard", "slot", "size", "rank", "key", "row", "fp", "content", "bucket", "_h", "level", "start", "a.b"]
    return out.withColumns({c: F.lit("mine") for c in clash})


@pytest.fixture(scope="session")
def prose():
    """Random words; ``prose(seed, n)`` is the same each time."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))

    return make

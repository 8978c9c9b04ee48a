import hashlib

from pyspark.sql import functions as F

from bidspan.llm import sketch


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words)))}


def test_edited_texts_and_estimates(frame, prose):
    texts = {k: prose(k, 20 + 90 * (k % 9)) for k in range(40)}
    texts[21] = texts[20]
    rows = {r.doc_id: r for r in sketch.compare_edited(frame(list(texts.items()))).collect()}
    off = []
    for k, t in texts.items():
        n = texts[k - 1 if k else 39]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert rows[k].edited == edited and rows[k].n_chars == len(t)
        a, b = shingles(t), shingles(edited)
        off.append(rows[k].near_edited - len(a & b) / len(a | b))
    assert abs(sum(off) / len(off)) < 0.05 and max(map(abs, off)) < 0.45
    assert rows[21].near_next == 1.0 and rows[21].sketch == rows[20].sketch
    assert sum(rows[k].near_next for k in texts if k != 21) < 1


def test_sketch_keeps_all_hashes_below_the_bound(frame, prose):
    df = frame([(1, prose(1, 600)), (2, prose(2, 600))]).agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).withColumn("doc_id", F.lit(9))
    whole = sketch.with_sketch(df, F.col("text"), "s").first().s
    assert all(0 <= h < 2**61 for h in whole) and whole == sorted(set(whole)) and 100 < len(whole) < 200
    parts = sketch.with_sketch(frame([(1, prose(1, 600)), (2, prose(2, 600))]), F.col("text"), "s").collect()
    merged = set(parts[0].s) | set(parts[1].s)
    assert len(merged ^ set(whole)) <= 8  # shingles across the seam only


def test_odd_rows(odd, frame):
    rows = sketch.compare_edited(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    five = [r for r in rows if r.doc_id == 5]
    assert len(five) == 2 and five[0] == five[1]
    assert sketch.compare_edited(frame([])).count() == 0
    alone = sketch.compare_edited(frame([(1, "abcd")])).first()
    assert alone.edited == "abab" and alone.near_next == 1.0
    assert hashlib.sha256(alone.edited.encode()).hexdigest()

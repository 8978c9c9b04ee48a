import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidspan.llm import suffixes
from bidspan.llm.common import Settled
from bidspan.llm.sorted_runs import ranked_runs, twin_rows


def brute(texts, length):
    """Kept bytes and removed runs of every text, from all strings of the length."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        ends = [i + 1 for i in range(len(t)) if gone[i] and (i + 1 == len(t) or not gone[i + 1])]
        out.append((bytes(b for b, g in zip(t, gone) if not g), list(zip(spans, ends))))
    return out


def corpus(seed, noise):
    r = random.Random(seed)

    def text(n):
        return "".join(noise(r) for _ in range(n))

    passage, other = text(900), text(520)
    texts = [text(r.randint(0, 2500)) for _ in range(25)]
    texts += [text(r.randint(0, 300)) + passage[r.randint(0, 400) : 900 - r.randint(0, 300)] + text(r.randint(0, 300)) for _ in range(25)]
    texts += [text(50) + other + text(70) + passage + text(20) + other for _ in range(6)]
    texts += [passage[:400] + "!" + passage[400:799], passage[:399] + "?" + passage[399:], "", None, "a" * 1500, "a" * 900 + "b" + "a" * 399, "ab" * 450, "x" * 400]
    copy = text(700)
    texts += [copy] * 40 + [copy[:350] + "#" + copy[351:]] * 2
    long_ = text(9000)
    texts += [long_ + text(30), text(30) + long_, "é" * 300 + text(5) + "é" * 230]
    return texts


@pytest.mark.parametrize(("seed", "noise", "length"), [(1, lambda r: r.choice("abcdefgh ijklmnop"), 400), (3, lambda r: r.choice(["word ", "other ", "é"]), 300)])
def test_against_brute_force(spark, frame, seed, noise, length):
    texts = corpus(seed, noise)
    docs = frame(list(enumerate(texts)))
    found = suffixes.remove_repeats(docs, length=length).orderBy("doc_id").collect()
    expected = brute([(t or "").encode() for t in texts], length)
    assert [r.doc_id for r in found] == list(range(len(texts)))
    for r, t, (kept, spans) in zip(found, texts, expected):
        assert r.n_bytes == len((t or "").encode()) and [tuple(s) for s in r.spans] == spans and bytes(r.kept) == kept, r.doc_id


def test_odd_rows_and_clashing_columns(odd):
    wide = odd.withColumns({"digest": F.lit("mine"), "body": F.lit("mine"), "kept": F.lit("mine"), "spans": F.lit("mine")})
    out = suffixes.remove_repeats(wide)
    assert out.columns == [*wide.columns, "n_bytes", "_spans", "_kept"]
    rows = out.collect()
    assert len(rows) == wide.count() and all(r["digest"] == r["kept"] == r["spans"] == r["row"] == r["a.b"] == "mine" for r in rows)
    assert {bytes(r["_kept"]).decode() for r in rows if r.doc_id == 7} == {""}  # one word repeated covers itself
    assert sorted(bytes(r["_kept"]).decode() for r in rows if r.doc_id != 7) == sorted((r.text or "") for r in odd.collect() if r.doc_id != 7)


def test_no_documents(frame):
    assert suffixes.remove_repeats(frame([])).count() == 0


def test_ranks_equal_sorted_suffixes(spark):
    r = random.Random(5)
    strings = [[r.randint(1, 3) for _ in range(r.randint(1, 60))] for _ in range(20)] + [[1] * 40, [1] * 41, [2]]
    letters = sorted(c for s in strings for c in s)
    rows = [(k, 0, i, letters.index(c) + 1, i, i + 1 if i + 1 < len(s) else 2**62) for k, s in enumerate(strings) for i, c in enumerate(s)]
    level = spark.createDataFrame(rows, "run long, s long, i int, c long, pos long, upto long")
    for length in (4, 30):
        ranks = {(x.run, x.i): x.r for x in suffixes.suffix_ranks(level, Settled(spark, "test"), length).collect()}
        assert len(ranks) == len(rows)
        order = sorted(ranks, key=lambda x: (ranks[x], strings[x[0]][x[1] : x[1] + length]))
        prefixes = [strings[k][i : i + length] for k, i in order]
        assert prefixes == sorted(prefixes)


def test_smaller_rows_and_twins(spark):
    r = random.Random(9)
    rows = [(r.choice([0, 0, 0, 0, 1, 2, 3]) * r.choice([1, 1, 100]), i, i % 2) for i in range(3000)] + [(777, 9999, 0)]
    df = spark.createDataFrame([*rows, *rows[:50]], "k long, id long, side int").repartition(7)  # repeated rows are one
    settle = Settled(spark, "test")
    found = ranked_runs(df, ["k"], ["id"], settle, kind=F.col("side")).collect()
    count = Counter(k for k, _, _ in rows)
    assert len(found) == len(rows)
    want = {k: tuple(sum(x < k and s == side for x, _, s in rows) for side in (0, 1)) for k in count}
    assert all((x.less0, x.less1) == want[x.k] for x in found)
    assert sorted(x.id for x in twin_rows(df, ["k"], ["id"], settle).collect()) == sorted(i for k, i, _ in rows if count[k] > 1)
    assert twin_rows(df.limit(0), ["k"], ["id"], settle).count() == ranked_runs(df.limit(0), ["k"], ["id"], settle).count() == 0


def test_places_of_equal_strings_are_equal():
    r = np.random.default_rng(1)
    shared = r.integers(97, 105, 900).astype(np.uint8)
    found = []
    for n in (0, 33, 700):
        data = np.concatenate((r.integers(97, 105, n).astype(np.uint8), shared, r.integers(97, 105, 200).astype(np.uint8)))
        _, a, first, last = suffixes.places(data, suffixes._words(data), np.zeros(1, np.int64), np.array([len(data)]), 400)
        starts = {p: x - n for x, i, j in zip(a.tolist(), first.tolist(), last.tolist()) for p in range(i - n, j - n + 1)}
        assert sorted(starts) == list(range(-n, 900 + 200 - 400 + 1))  # every start has one place
        found.append([starts[p] for p in range(500)])
    assert found[0] == found[1] == found[2]


def test_beginnings_are_read_from_every_stack():
    import pyarrow as pa

    stacks = [[144, 150, 390], [144], [144, 399]]
    begins = [[10 * k + i for i in range(len(v))] for k, v in enumerate(stacks)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    rows = [[7, 8, 9], [900, 800, 700], [0, 3, 0], [255, 20, 2], [b"x" * 255] * 3, [400] * 3, stacks, begins]
    batch = pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names="run pos low high before reach levels begins".split())
    out = pa.Table.from_batches(suffixes._strings_of(400)(iter([batch])))
    want = []
    for k, (low, high) in enumerate(zip(rows[2], rows[3])):
        for d in range(low, high + 1):
            want.append((rows[0][k], rows[1][k] - d, begins[k][max(i for i, v in enumerate(stacks[k]) if v < 400 - d)]))
    assert list(zip(*(out.column(c).to_pylist() for c in ("run", "p", "k1")))) == want


def test_any_three_letters_cover_the_length():
    for length in (280, 300, 400, 1000):
        assert suffixes.letter_bytes(length) >= suffixes.LETTER and suffixes.letter_bytes(length) + 2 >= length  # so one level of recursion is enough


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_small_clusters_are_told_apart_in_pairs(letters):
    """Beginnings and rests of places of one cluster, against every string compared with every other."""
    r, length = random.Random(len(letters)), 400
    core = "".join(r.choice(letters) for _ in range(600))
    for _ in range(30):
        made = []
        for k in range(r.randint(1, 9)):
            before = core[r.randint(0, 250) : 255] if r.random() < 0.8 else core[:255]
            before = ("x" + before[1:]) if r.random() < 0.5 else before
            rest = core[255 : 255 + r.randint(250, 345)] + "".join(r.choice(letters) for _ in range(400))
            low = r.randint(0, min(20, len(before)))
            made.append((rest[:length].encode(), before[::-1].encode(), k, low, r.randint(low, len(before))))
        made.sort()
        levels, begins, cluster = [], [], []
        for n, (head, before, k, low, high) in enumerate(made):
            shared = suffixes._common([made[n - 1][0], head], length)[0] if n else 144
            if shared < length:
                while levels and levels[-1] >= shared:
                    levels.pop(), begins.pop()
                levels.append(int(shared)), begins.append(n)
            cluster.append((n, (k, 1000, low, high, False, before, length, list(levels), list(begins), 0, 0, None)))
        found = {(x[0], d) for x in suffixes._repeated(cluster, length) for d in range(x[2], x[3] + 1)}
        string = lambda x, d: x[1][:d][::-1] + x[0][: length - d]
        want = {(x[2], d) for x in made for d in range(x[3], x[4] + 1) if any(y is not x and len(y[1]) >= d and string(y, d) == string(x, d) for y in made)}
        assert found == want

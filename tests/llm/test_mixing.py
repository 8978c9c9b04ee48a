from collections import defaultdict

from pyspark.sql import functions as F

from bidspan.llm import mixing


def documents(frame, sizes):
    """Source -> word counts."""
    k, rows = 0, []
    for source, counts in sizes.items():
        for n in counts:
            rows.append((k, " ".join(["w"] * n), "en", source, 0))
            k += 1
    return frame(rows)


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing out, capping and sharing the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(map(sum, sizes.values())), {}, set(names)
    while free:
        part = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * part >= most * sum(sizes[s]) - 1e-9}
        if not over:
            return target | {s: weight[s] * part for s in free}
        for s in over:
            target[s] = most * sum(sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_taken_and_schedule(spark, frame):
    sizes = {"a": [40] * 90, "b": [700, 3, 0, 50], "c": [1] * 30, None: [2000, 5], "d": [13] * 200, "e": [0, 0]}
    pieces = mixing.mix_documents(documents(frame, sizes), block_words=64).collect()
    want, got, size = filled(sizes), defaultdict(int), {}
    per_doc = defaultdict(int)
    for p in pieces:
        assert abs(p.target - want[p.source]) < 1e-6
        got[p.source] += p.n_words
        per_doc[p.doc_id] += p.n_words
        size[p.doc_id] = p.size
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)
    assert all(per_doc[d] <= 2 * size[d] for d in size) and len(size) == sum(map(len, sizes.values()))
    blocks = defaultdict(int)
    for p in pieces:
        if p.block is not None:
            blocks[p.source, p.block, p.slot] += p.n_words
    assert len({(s, b) for s, b, _ in blocks}) == len(blocks)  # one slot a block
    for s in sizes:
        mine = sorted((b, n) for (x, b, _), n in blocks.items() if x == s)
        assert [b for b, _ in mine] == list(range(len(mine))) and all(n == 64 for _, n in mine[:-1])
    # in any first part of the schedule every source is near its share
    early = sum(n for (s, _, slot), n in blocks.items() if s == "a" and slot < len(blocks) // 2)
    assert abs(early / got["a"] - 0.5) < 0.1
    again = mixing.mix_documents(documents(frame, sizes).repartition(3), block_words=64).collect()
    assert sorted(map(str, pieces)) == sorted(map(str, again))


def test_mixed_rows_take_effect(frame):
    docs = documents(frame, {"a": [10] * 20, "b": [7] * 4})
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.mix_documents(docs)).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {d: n for d, n in taken.items() if n}


def test_rows_are_written_in_the_order_of_the_schedule(spark, frame):
    docs = documents(frame, {"a": [40] * 900, "b": [40] * 700, "c": [40] * 800}).repartition(5)
    parts = mixing.mixed_documents(docs, block_words=64).collect()
    total = defaultdict(int)
    for r in parts:
        total[r.source] += len(r.text.split())
    share = {s: n / sum(total.values()) for s, n in total.items()}
    first = defaultdict(int)
    for r in parts[:300]:  # the first windows
        first[r.source] += len(r.text.split())
    assert all(abs(first[s] / sum(first.values()) - share[s]) < 0.03 for s in share)
    pieces = mixing.mix_documents(docs, block_words=64).where("n_words > 0").collect()
    assert max(p.slot for p in pieces) < 1.2 * len({(p.source, p.block) for p in pieces})  # nothing waits behind the schedule


def test_odd_rows(odd, frame):
    rows = mixing.taken_words(mixing.mix_documents(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0) and sum(r.source is None for r in rows) == 1
    assert mixing.mixed_documents(odd).where("doc_id = 2").count() == 0
    mixed = mixing.mixed_documents(odd.withColumns({c: F.lit("mine") for c in ("_take", "reads", "copy", "r_id", "mixed")}))
    assert all(r[c] == "mine" for r in mixed.collect() for c in ("_h", "_take", "reads", "copy", "r_id", "mixed", "slot", "size", "a.b", "row"))
    assert mixing.mix_documents(frame([])).count() == 0
    assert mixing.mixed_documents(frame([])).count() == 0
    blank = mixing.taken_words(mixing.mix_documents(frame([(1, None), (2, "")]))).agg(F.sum("taken"), F.max("target")).first()
    assert tuple(blank) == (0, 0.0)

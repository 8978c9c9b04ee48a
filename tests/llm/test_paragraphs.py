import numpy as np

from bidspan.llm import paragraphs


def test_planted_passages_are_found_wherever_they_stand(frame, prose):
    passage, other = prose(1000, 52), prose(1001, 60)
    texts = {k: prose(k, 150 + k) for k in range(40)}
    for n, k in enumerate((3, 11, 30)):
        words = texts[k].split()
        at = 7 + 31 * n
        texts[k] = " ".join([*words[:at], passage.upper() if n else passage, *words[at:]])
    texts[5] += "\n" + other
    texts[6] = other + "\n" + texts[6]
    rows = paragraphs.shared_paragraphs(frame(list(texts.items()))).collect()
    assert {r.doc_id for r in rows} == {3, 11, 30, 5, 6}
    assert {(r.doc_id, r.kept_doc_id, r.removed) for r in rows} == {(3, 3, False), (11, 3, True), (30, 3, True), (5, 5, False), (6, 5, True)}
    for r in rows:
        words = texts[r.doc_id].lower().split()[r.start : r.start + r.n_words]
        assert sum(w in passage.split() or w in other.split() for w in words) >= 22
    kept = {r.doc_id: r.text for r in paragraphs.without_shared(frame(list(texts.items()))).collect()}
    assert kept[3] == texts[3] and len(kept[11].split()) < len(texts[11].split()) and kept[0] == texts[0]


def test_similar_paragraphs_are_verified(frame, prose):
    base = prose(1, paragraphs.LENGTH).split()
    near = [*base[:23], "changed"]  # 19 of 21 shingles in common
    far = [*base[:12], *prose(2, 12).split()]
    rows = paragraphs.shared_paragraphs(frame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, prose(5, 24))])).collect()
    assert {r.doc_id for r in rows} == {1, 2} and {r.kept_doc_id for r in rows} == {1}


def test_no_similar_pair_misses_a_band(frame, prose):
    texts, want = {}, {}
    for k in range(150):
        base = prose(500 + k, paragraphs.LENGTH).split()
        texts[4 * k], texts[4 * k + 1] = " ".join(base), " ".join(["first", *base[1:23], "last"])  # 18 of 22 shingles in common
        ring = prose(5000 + k, 16).split() * 2
        texts[4 * k + 2], texts[4 * k + 3] = " ".join(ring[:24]), " ".join([*ring[:20], *prose(9000 + k, 4).split()])  # 16 repeated ones of 20
        want |= {4 * k: 4 * k, 4 * k + 1: 4 * k, 4 * k + 2: 4 * k + 2, 4 * k + 3: 4 * k + 2}
    rows = paragraphs.shared_paragraphs(frame(list(texts.items()))).collect()
    assert {r.doc_id: r.kept_doc_id for r in rows} == want


def test_texts_cut_together_are_cut_as_each_alone(prose):
    texts = [prose(k, n) for k, n in enumerate((0, 5, 23, 24, 25, 46, 47, 48, 49, 300))] + ["w " * 200, "", "a b\tc " * 30, prose(7, 90) * 2]
    got = paragraphs._cut(list(range(len(texts))), [paragraphs._lowered(t) for t in texts], paragraphs.SIMILAR)
    want = set()
    for doc, text in enumerate(texts):
        _, starts, content = paragraphs.paragraphs_of(text)
        want |= {(doc, s, c) for s, c in zip(starts.tolist(), content.view(np.int64).tolist())}
    assert set(zip(*(got.column(k).to_pylist() for k in range(3)))) == want and got.num_rows == len(want)


def test_members_against_all_pairs():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[:-1], [99]])) for s in sets[:30]]
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for similar in (0.5, 0.8):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i].tolist(), sets[j].tolist()) >= similar}
        assert set(zip(*(x.tolist() for x in paragraphs.similar_members(sets, similar)))) == want and want


def test_large_bands_are_split_without_loss(frame, prose, monkeypatch):
    monkeypatch.setattr(paragraphs, "CHUNK", 4)
    base = prose(9, paragraphs.LENGTH).split()
    texts = [" ".join([*base[:23], f"end{k}"]) for k in range(40)]  # all alike, none equal
    rows = paragraphs.shared_paragraphs(frame(list(enumerate(texts)))).collect()
    assert {r.doc_id for r in rows} == set(range(40)) and {r.kept_doc_id for r in rows} == {0} and len({r.cluster for r in rows}) == 1


def test_variants_inside_two_documents_are_all_found(frame, prose):
    base = prose(21, 70).split()
    start = int(next(s for s in paragraphs.paragraph_starts(paragraphs.word_hashes(" ".join(base))) if s > 20))
    texts = {}
    for doc in (1, 2):
        parts = []
        for k in range(10):
            passage = list(base[: start + paragraphs.LENGTH])
            passage[-1] = f"end{doc}x{k}"
            parts += [prose(100 * doc + k, 30), *passage]
        texts[doc] = " ".join(parts)
    held = {}
    for doc, text in texts.items():
        words, starts, _ = paragraphs.paragraphs_of(text)
        held[doc] = {int(s): set(paragraphs._run_hash(words[s : s + paragraphs.LENGTH], paragraphs.WIDTH).tolist()) for s in starts}
    alike = lambda a, b: len(a & b) / len(a | b) >= paragraphs.SIMILAR
    want = {(d, s) for d in held for s, a in held[d].items() if any(alike(a, b) for b in held[3 - d].values())}
    assert len(want) >= 20
    assert want <= {(r.doc_id, r.start) for r in paragraphs.shared_paragraphs(frame(list(texts.items()))).collect()}  # others are linked through them


def test_a_band_waits_for_its_second_document(spark, frame, prose):
    base = prose(9, paragraphs.LENGTH).split()
    one = " ".join(" ".join([*base[:23], f"end{k}"]) for k in range(40))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        alone = paragraphs.band_pairs(frame([(1, one), (2, prose(3, 400))])).count()
        pairs = paragraphs.band_pairs(frame([(1, one), (2, one)])).select("band", "u").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words, starts, content = paragraphs.paragraphs_of(one)
    keys = paragraphs.band_hashes(words, starts)
    held = {}
    for c, row in zip(content.view("int64").tolist(), keys.view("int64").tolist()):
        for k in row:
            held.setdefault(k, set()).add(c)
    assert alone == 0 and pairs and set(map(tuple, pairs)) == {(k, c) for k, v in held.items() for c in v if c != min(v)}


def test_any_passage_of_fifty_words_holds_a_paragraph(prose):
    passage = paragraphs.word_hashes(prose(7, 50))
    inside = set()
    for seed in range(60):
        text = np.concatenate([paragraphs.word_hashes(prose(seed, 3 * seed)), passage, paragraphs.word_hashes(prose(seed + 99, 40))])
        starts = paragraphs.paragraph_starts(text) - 3 * seed
        inside.add(tuple(s for s in starts if 0 <= s <= 50 - paragraphs.LENGTH))
    assert set.intersection(*map(set, inside))


def test_short_texts_are_paragraphs(frame, prose):
    texts, want, pairs = {}, {}, 0
    for n in range(5, 24):
        base = prose(300 + n, n).split()
        near = [*base[: n - 1], "changed"]
        texts |= {10 * n: " ".join(base), 10 * n + 1: " \n ".join(base).upper(), 10 * n + 2: " ".join(near)}
        alike = (n - 5) / (n - 3) >= paragraphs.SIMILAR  # all shingles but the last
        want |= {10 * n + k: 10 * n for k in ((0, 1, 2) if alike else (0, 1))}
        pairs += alike
    ring = prose(77, 6).split() * 3
    texts |= {7: " ".join(ring), 8: " ".join([*ring, *ring[:2]]), 9: "four words are none", 10: "four words are none"}
    want |= {7: 7, 8: 7}  # 6 shingles, all in common
    edge = prose(5, 24).split()
    texts |= {20: " ".join(edge), 21: " ".join(edge[:23])}  # 19 of 20 shingles, one of them a text of 24 words
    want |= {20: 20, 21: 20}
    rows = paragraphs.shared_paragraphs(frame(list(texts.items()))).collect()
    assert pairs == 11 and {r.doc_id: r.kept_doc_id for r in rows} == want
    assert all(r.start == 0 and r.n_words == len(texts[r.doc_id].split()) for r in rows)
    kept = {r.doc_id: r.text for r in paragraphs.without_shared(frame(list(texts.items()))).collect()}
    assert kept[51] == "" and kept[50] == texts[50] and kept[10] == texts[10]


def test_odd_rows(odd, frame, prose):
    assert paragraphs.shared_paragraphs(odd).count() == 0  # a repeated row is one document
    assert paragraphs.shared_paragraphs(frame([])).count() == 0
    t = prose(3, 90)
    rows = paragraphs.shared_paragraphs(frame([(1, t), (1, t), (2, t + " " + t), (None, t), (3, "w " * 5000), (4, "w " * 9000)])).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4} and {r.kept_doc_id for r in rows} == {1, 3}
    assert set(paragraphs.without_shared(odd).columns) == set(odd.columns) and paragraphs.without_shared(odd).count() == odd.count()

import re

import numpy as np
import pytest
import xxhash

from bidspan.llm import simhash


def bits(text, width=4):
    """The fingerprint, one bit at a time."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps, radius=4):
    """Smallest id reachable, by comparing all pairs."""
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", None, "one", "A b C d", "É A é", "w " * 700, "a\x0bb c d e f", " x  y\tz\n"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == bits(text)


def test_components_match_all_pairs(frame, prose):
    rows = [(k, prose(k, 120)) for k in range(60)]
    for k in range(60, 140):
        words = rows[k % 20][1].split()
        for e in range(k % 4):
            words[(k * 31 + e * 17) % len(words)] = f"new{k}{e}"
        rows.append((k, " ".join(words)))
    rows += [(200, ""), (201, None), (202, " ")]
    found = {r.doc_id: r for r in simhash.simhash_components(frame(rows)).collect()}
    fps = [bits(t) for _, t in rows]
    assert [found[d].fp & (2**64 - 1) for d, _ in rows] == fps
    want = classes([d for d, _ in rows], fps)
    assert [found[d].component_id for d, _ in rows] == want
    assert 60 < len(set(want)) < 125
    kept = simhash.one_of_each(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_planes_find_every_pair():
    r = np.random.default_rng(1)
    f = r.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    f[100:200] = f[:100] ^ (1 << r.integers(0, 62, 100)) ^ (1 << r.integers(0, 62, 100))
    f[200:260] = f[5] ^ (1 << np.arange(60))
    f = np.unique(f)
    want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if (int(f[i]) ^ int(f[j])).bit_count() <= 4}
    got = set()
    for at in range(0, len(f), 64):
        i, j = simhash.close_pairs(f, at, min(len(f), at + 64), 4)
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == want


def test_hot_bucket_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    chain = [0]
    for k in range(199):
        chain.append(chain[-1] ^ 1 << k % 20)
    fps = sorted({x for x in chain})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(r.u, r.v) for r in simhash.linked_fingerprints(df).collect()]
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        up[root(u)] = root(v)
    want = classes(fps, fps)
    assert len({root(x) for x in fps}) == len(set(want))


def test_odd_rows(odd, frame):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None and r.fp] == [None]
    assert simhash.simhash_components(frame([])).count() == 0
    stays = simhash.one_of_each(odd)
    assert set(stays.columns) == set(odd.columns) and sorted(r.doc_id for r in stays.collect() if r.doc_id) == [1, 2, 7, 8, 9]
    with pytest.raises(ValueError):
        simhash.simhash_components(odd, radius=6)

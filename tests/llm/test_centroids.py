import hashlib
import itertools
import random

import numpy as np
import pytest

from bidspan.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, place string, v string"


def brute(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in kept)
    cs = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(cs)):
            mine = [v for (_, v), (_, at) in zip(kept, to) if at == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    total = sum(d for d, _ in to)
    out = []
    for (i, _), (d, j) in zip(kept, to):
        out.append((i, j, d, sum(e for e, m in to if m == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def vectors(n, dim, seed):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [[m + r.gauss(0, 0.1) for m in middles[i % 6]] for i in range(n)]


def test_against_brute_force(spark):
    dim = 8
    rows = [(i * 3, v) for i, v in enumerate(vectors(400, dim, 1))]
    rows += [(5000 + i, [0.5] * dim) for i in range(300)]  # copies
    rows += [(9000, None), (9001, [0.1] * (dim - 1)), (9002, [float("nan")] * dim), (9003, [None] * dim), (9004, [float("inf")] * dim), (None, [0.25] * dim), (3, [-0.3] * dim), (3, [-0.3] * dim)]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    found = sorted(map(tuple, centroids.cluster(df, dim=dim, k=9, rounds=4).collect()), key=str)
    assert found == brute(rows, 9, 4, dim)


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 4)], [(1, [0.5] * 4), (2, [0.5] * 4)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    found = sorted(map(tuple, centroids.cluster(df, dim=4, k=3, rounds=2).collect()), key=str)
    assert found == brute(rows, 3, 2, 4)


def test_too_wide_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 4, "x", "y", "z")], SCHEMA)
    with pytest.raises(ValueError):
        centroids.cluster(df, dim=4, k=1, rounds=1)


def test_the_curve_visits_neighbours_one_after_the_other():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = centroids.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_leave_only_centroids_that_can_be_nearest():
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(m, 3, (64, 5)) for m in (-500, 0, 500)]).astype(np.int64)
    cs = points[[5, 70, 150, 10, 99]]
    counted = 0
    for at in range(0, len(points), 64):
        m = points[at : at + 64]
        some = centroids.candidates(m.min(0), m.max(0), cs)
        counted += len(some)
        to, d = centroids.nearest(m, m.min(0), m.max(0), cs)
        full = np.square(m[:, None, :] - cs[None]).sum(2)
        assert (to == full.argmin(1)).all() and (d == full.min(1)).all()
    assert counted < 3 * len(cs) / 2

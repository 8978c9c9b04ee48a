import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from bidspan.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, path string, key string, depth string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, v in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, mine in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if p in ends else hashlib.sha256(b"").hexdigest()
        out.append((min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), len(children[p]), sum(not children[q] for q in under), saved, sha))
    return sorted(out, key=str)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", r.choice(["a", "b", "é" * 3])))
    rows += [(1000 + i, t, "user", "same") for i in range(60) for t in range(11)]  # many equal ones
    rows += [(2003, t, "user", f"{t}") for t in range(300)]  # a long one
    rows += [(3000, None, None, None), (3000, None, None, None), (3000, 4, "", "x"), (3001, -300, "user", None), (3001, 700, "user", "z"), (-7, 0, "user", "a"), (-5, 0, "user", "a"), (None, 1, "user", "a")]
    return rows


@pytest.mark.parametrize(("seed", "forest"), [(1, 7), (2, 40), (3, 20000)])
def test_against_brute_force(spark, seed, forest):
    rows = conversations(seed, 60)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = prefixes.prefix_trie(df, forest=forest)
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_no_rows(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "")], SCHEMA)).count() == 0


def test_a_conversation_left_without_turns_counts_at_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    found = prefixes.prefix_trie(spark.createDataFrame([(c, 0, "user", "a", "", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == brute([(c, 0, "user", "a")]) and found[0].n_leaves == 1

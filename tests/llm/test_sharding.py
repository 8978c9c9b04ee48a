from collections import Counter

from bidspan.llm import sharding
from bidspan.llm.sharding import Leaf


def placed(docs, tree, grown=None):
    return sharding.assign_shards(docs, tree, grown or tree).collect()


def test_growth_moves_rows_into_the_new_shard_only(frame):
    rows = placed(frame([(k, "x" * (k % 7)) for k in range(3000)]), sharding.uniform_tree(16), sharding.uniform_tree(17))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert 100 < sum(r.grown_shard == 16 for r in rows) < 260
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(16)) and min(counts.values()) > 120
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_weight_changes_confine_movement_to_their_subtree(frame):
    tree = [Leaf(0, "a", "r", 1), Leaf(1, "a", "r", 1), Leaf(2, "a", "s", 2), Leaf(3, "b", "r", 4)]
    moved = [Leaf(0, "a", "r", 0.5), Leaf(1, "a", "r", 1.5), *tree[2:]]
    rows = placed(frame([(k, "") for k in range(2000)]), tree, moved)
    assert any(r.shard != r.grown_shard for r in rows)
    assert all(r.shard == r.grown_shard or {r.shard, r.grown_shard} == {0, 1} for r in rows)
    counts = Counter(r.shard for r in rows)
    assert abs(counts[3] - 1000) < 100 and abs(counts[2] - 500) < 90
    none = placed(frame([(k, "") for k in range(200)]), [*tree[1:], Leaf(0, "a", "r", 0)])
    assert 0 not in {r.shard for r in none}


def test_odd_rows(odd, frame):
    rows = placed(odd, sharding.uniform_tree(4), sharding.uniform_tree(5))
    assert len(rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (2, 3)} == {(1, 0)}
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1 and len({r.slot for r in rows if r.doc_id == 5}) == 2
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert placed(frame([]), sharding.uniform_tree(4)) == []

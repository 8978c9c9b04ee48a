import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bidspan.llm import packing, queries
from bidspan.llm.queries import vocabulary


def rebuilt(pieces):
    """Ids of every document, put together again from its pieces; checks starts and offsets."""
    out, windows = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id is None, r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        out.setdefault(r.doc_id, []).append((r.start, ids))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW and at & (at - 1) == 0  # nothing to pad
    return out, windows


def test_round_trip_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack_documents(docs, **vocabulary()).collect()
    out, windows = rebuilt(pieces)
    tokenizer = Tokenizer.from_file(vocabulary()["tokenizer_path"])
    for r in docs.collect():
        want = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        assert np.concatenate([ids for _, ids in out[r.doc_id]]).tolist() == want
        assert [s for s, _ in out[r.doc_id]] == np.cumsum([0] + [len(i) for _, i in out[r.doc_id]])[:-1].tolist()
    digests = queries.QUERIES["op1_packing"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(r.ids) for r in pieces)


def test_odd_rows(odd, frame):
    out, _ = rebuilt(packing.pack_documents(odd.coalesce(1), **vocabulary()).collect())
    assert len(out[2]) == 1 and out[2][0][1].tolist() == [0]
    assert sum(len(i) for _, i in out[5]) == 2 * sum(len(i) for _, i in out[1])
    assert 50256 in np.concatenate([i for _, i in out[8]])
    assert packing.pack_documents(frame([]), **vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, window=1000, **vocabulary())


@pytest.mark.parametrize("text", ["It's  two\n\nlines ", "naïve don't 12,5\t", "中文 字", "a b", " lead", "x y", "<|endoftext|>", "end  \n", ""])
def test_rank_file_gives_the_tokenizer_s_ids(text):
    coder = packing.coder(vocabulary()["tokenizer_path"], vocabulary()["ranks_path"], vocabulary()["pattern"])
    assert coder(text) == coder.exact(text)


def test_level_minimises_the_sum_of_squares():
    r = np.random.default_rng(3)
    lane = packing.Lane(64, 1000)
    for _ in range(400):
        size = int(r.integers(1, 64))
        options = []
        for level in [0, *[k for k in range(1, 65 - size) if lane.count[k]]]:
            after = lane.count.copy()
            if level:
                after[level] -= 1
            if level + size < 64:
                after[level + size] += 1
            options.append((int((after[1:64] ** 2).sum()), -level))
        assert lane.level_for(size) == -min(options)[1]
        list(lane.place((0, 0, size, b"\0" * 4 * size)))


def test_open_windows_are_bounded_and_nothing_is_lost():
    lane, total, seen = packing.Lane(1024, 8), 0, 0
    for k in range(500):
        size = 600 + k % 3
        total += size
        for window in lane.place((k, 0, size, b"\0" * 4 * size)):
            assert sum(p[2] for p in window) == 1024
            seen += 1024
        assert lane.n_open <= 8
    for window in lane.rest():
        seen += sum(p[2] for p in window)
    assert seen == total

import time

from pyspark.sql import functions as F

from bidspan.llm import lines

LONG, OTHER = "this line is certainly forty characters long", "another line that is also over forty characters"


def test_shared_lines_stay_in_the_largest_id(frame):
    docs = frame([(k, f"own {k}\n  {LONG.upper() if k % 2 else LONG}\t\n{OTHER if k < 4 else 'short'}\n{LONG}") for k in range(6)])
    out = {r.doc_id: r for r in lines.drop_shared_lines(docs).collect()}
    assert all(out[k].n_dropped == 2 and LONG not in out[k].kept_text.lower() for k in range(5))
    assert out[5].n_dropped == 0 and out[5].kept_text.lower().count(LONG) == 2
    assert all(OTHER in out[k].kept_text for k in range(4))  # in four documents only
    assert out[0].kept_text == f"own 0\n{OTHER}" and out[0].n_lines == 4


def test_odd_rows(odd, frame):
    out = lines.drop_shared_lines(odd)
    assert set(out.columns) == {*odd.columns, "n_dropped"}
    rows = out.collect()
    assert len(rows) == odd.count()
    assert {(r.kept_text, r.n_lines) for r in rows if r.doc_id in (2, 3)} == {("", 1)}
    assert [r.n_lines for r in rows if r.doc_id == 4] == [2]
    wide = odd.withColumns({c: F.lit("mine") for c in ("gone", "gone_id", "gone_hash", "text_hash", "parts", "key")})
    assert all(r[c] == "mine" for r in lines.drop_shared_lines(wide).collect() for c in ("gone", "gone_id", "text_hash", "parts", "_h", "row", "a.b"))
    names = ("gone", "kept_text", "n_lines", "parts", "row")
    assert all(r[c] == "mine" for r in lines.without_shared_lines(wide).collect() for c in names)
    empty = lines.drop_shared_lines(frame([]))
    assert empty.count() == 0 and "kept_text" in empty.columns


def test_repeated_ids_are_one_document(frame):
    four = [(k, LONG) for k in (1, 2, 3, 4)]
    assert all(r.n_dropped == 0 for r in lines.drop_shared_lines(frame([*four, (4, LONG), (4, LONG)])).collect())
    out = lines.drop_shared_lines(frame([*four, (4, LONG + "\nx"), (None, LONG), (None, LONG)])).collect()
    assert {(r.doc_id, r.n_dropped) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 0), (None, 1)}
    assert all(r.n_dropped == 0 for r in lines.drop_shared_lines(frame([(None, LONG)] * 9)).collect())


def test_one_text_of_very_many_lines(frame):
    n = 50_000
    many = "\n".join(LONG if i % 10 == 0 else f"own line {i}" for i in range(n))
    docs = frame([(1, many), *[(k, LONG) for k in range(2, 7)]])
    began = time.time()
    found = {r.doc_id: r for r in lines.drop_shared_lines(docs).collect()}
    assert found[1].n_lines == n and found[1].n_dropped == n // 10
    assert found[1].kept_text == "\n".join(f"own line {i}" for i in range(n) if i % 10)
    assert time.time() - began < 60

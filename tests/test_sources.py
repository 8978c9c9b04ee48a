import glob
import json

from pyspark.sql import functions as F

from bidspan.operators import joins, projections
from bidspan.sources import readers, sinks


def test_csv_bytes(spark, tables, tmp_path):
    bids = joins.scalar_count(tables.bids.filter("bid_id < 5"), tables.docs).withColumn("object", F.lit('linha "1"\nlinha 2'))
    sinks.write_csv(bids.orderBy("bid_id"), tables.now, f"{tmp_path}/csv")
    raw = b"".join(open(part, "rb").read() for part in sorted(glob.glob(f"{tmp_path}/csv/part-*")))
    assert raw.startswith(b"\xef\xbb\xbfPNCP ID;") and raw.count(b"\r\n") == 6
    line = raw.decode("utf-8-sig").split("\r\n")[1]
    assert line.count('";"') == 17 and '"linha ""1"" linha 2"' in line


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 conteudo")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x" * 100)
    found = readers.binary_meta(readers.binary_files(spark, str(tmp_path)), 50)
    wanted = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.pdf", "b.pdf", "c.txt")], "path string")
    meta = {r["path"].rsplit("/", 1)[-1]: r for r in readers.expected_files(wanted, found).collect()}
    assert {k: v["verdict"] for k, v in meta.items()} == {"a.pdf": "ok", "b.pdf": "vazio", "c.txt": "grande_demais"}
    assert bytes(meta["a.pdf"]["head"]) == b"%PDF-1.7" and len(meta["a.pdf"]["sha256"]) == 64


def test_page_files_one_envelope_each(spark, tmp_path):
    pages = [
        {"data": [{"numeroControlePNCP": "A"}, {"numeroControlePNCP": " "}], "numeroPagina": 1, "requestedPage": 1, "totalPaginas": 2},
        {"data": [], "numeroPagina": 2, "requestedPage": 2, "empty": True}, {"numeroPagina": 3, "requestedPage": 3}, {"data": [], "numeroPagina": 4, "requestedPage": 5},
    ]
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(p, indent=1))
    (tmp_path / "9.json").write_text("<html>")
    got = readers.page_quality(readers.page_envelopes(spark, str(tmp_path), multi_line=True)).collect()
    assert sorted((r["numeroPagina"] or 0, r["quality"]) for r in got) == [(0, "invalida"), (1, "ok"), (2, "vazia"), (3, "invalida"), (4, "invalida")]


def test_unusable_document_sequences_are_rejected(spark):
    df = spark.createDataFrame([("1",), ("0",), ("1.5",), ("",), (None,), ("x",), ("12",)], "s string")
    assert [r[0] for r in df.select(projections.document_seq(F.col("s"))).collect()] == [1, None, None, None, None, None, 12]


def test_purchase_identity(spark):
    df = spark.createDataFrame([("12.abc/1", 2026, 5), ("", 2026, 5), ("1", None, 5), ("1", 2026, 0)], "c string, y int, s int")
    got = [r[0] for r in df.select(projections.purchase_identity(F.col("c"), F.col("y"), F.col("s"))).collect()]
    assert got[0]["cnpj"] == "0000000012ABC1" and got[1:] == [None, None, None]


def test_modality_domain(spark):
    rows = readers.modalities(spark).collect()
    assert len(rows) == 19 and rows[5]["modality"] == "Pregão - Eletrônico"
    assert [r[0] for r in spark.range(0, 21, 20).select(readers.modality_name(F.col("id"))).collect()] == [None, None]


def test_city_checks(spark):
    df = spark.createDataFrame([("3550308", "São Paulo", "SP", -23.5, -46.6), ("1", "x", "SP", 0.0, 0.0), ("3550309", "y", "SP", 95.0, 0.0), ("3550310", "z", "SP", None, 0.0)], "city_code string, city string, uf string, lat double, lon double")
    assert [r["city_code"] for r in readers.checked_cities(df).collect()] == ["3550308"]


def test_dirty_header_values(spark):
    df = spark.createDataFrame([("12",), ("12.9",), ("abc",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(projections.whole(F.col("v"))).collect()] == [12, 12, None, None, None]
    assert [str(r[0]) for r in df.select(projections.money(F.col("v"))).collect()] == ["12.0000", "12.9000", "None", "None", "None"]

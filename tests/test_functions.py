import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidspan.functions import classify, dates, geo, jsonx, scoring, vectors
from bidspan.functions import text as tx

UTC = dt.timezone.utc


def at(text):
    return F.lit(text).cast("timestamp")


def shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@pytest.mark.parametrize(
    "raw, clean",
    [
        ('"Edital"', "Edital"), ('""Edital""', "Edital"), ('"Edital', '"Edital'), ('"" Edital"', '" Edital'), ('"', '"'), ('""', ""), ('"""', '"'),
        ("orÃ§amentaria", "orçamentaria"), ("orçamento Ã", "orçamento Ã"), ("  a \n b  ", "a b"), ("€ orÃ§a", "€ orÃ§a"), (None, ""),
    ],
)
def test_clean_title(one, raw, clean):
    assert one(tx.clean_title, raw) == clean


@pytest.mark.parametrize(
    "raw, value",
    [
        ("R$ 1.000.000,00", 1000000.0), ("1000,50", 1000.5), ("1000.50", 1000.5), ("1.000", 1000.0), ("1.000.000", 1000000.0), ("10.5", 10.5),
        ("", None), ("sigiloso", None), ("1,2,3", None), (".", None),
    ],
)
def test_money_parse(one, raw, value):
    assert one(tx.money_parse, raw) == value


def test_money_and_distance_format(one):
    assert one(tx.money_format, 120684000.0) == "R$ 120.684.000,00"
    assert one(tx.money_format, -1.5) == "-R$ 1,50"
    assert one(lambda c: tx.money_format(F.lit(None).cast("double")), 1) == "Não informado"
    assert one(tx.distance_format, 45.25) == "45,3 km"
    assert one(tx.distance_format, 1234.0) == "1.234,0 km"
    assert one(lambda c: tx.distance_format(F.lit(None).cast("double")), 1) == "—"


def test_small_text_rules(one):
    assert one(tx.fold, "CONSTRUÇÃO de Ação ñ") == "construcao de acao n"
    assert one(tx.compare_form, "Paga-\n mento  de R$ 5%, à vista.") == "pagamento de r$ 5% a vista"
    assert one(tx.split_ellipsis, "um [x] dois (...) três… quatro...") == ["um", "dois", "tres", "quatro"]
    assert one(tx.strip_port, "https://h:1401/a:14010") == "https://h/a:14010"
    assert one(tx.filename_from_header, "attachment; filename=\"a+b.pdf\"") == "a b.pdf"
    assert one(tx.filename_from_header, "attachment; filename*=UTF-8''a%20%C3%A7+.pdf") == "a ç+.pdf"
    assert one(tx.filename_from_header, "attachment") is None
    assert one(tx.extension, "x.tar.GZ") == "gz" and one(tx.extension, "x") is None
    assert [one(tx.null_words, v) for v in (" - ", "N/A", "null", "não informado", "ok ")] == [None, None, None, None, "ok"]
    assert one(tx.duration, 61500) == "1m 1s" and one(tx.duration, -5) == "0s"
    assert one(tx.trim_null, " \n ") is None
    assert one(tx.squash_space, "a\x00 \n  b") == "a b"
    assert one(tx.card_title, "Pregão", " null ", "Unidade", "Órgão") == "Pregão · Unidade"
    assert one(tx.card_title, None, "", None, "Órgão") == "Órgão"
    assert one(lambda c: tx.contains_ci(c, "100%"), "desconto de 100% hoje") and not one(lambda c: tx.contains_ci(c, "1%0"), "100")


@pytest.mark.parametrize(
    "text, label",
    [
        ("Reforma de pavimentação", "Pavimentação"), ("CONSTRUCAO DE ESCOLA", "Obra nova"), ("Locação de veículos", "Outros"),
        ("Urbanização da orla", "Infraestrutura urbana"), ("", "Outros"),
    ],
)
def test_category(one, text, label):
    assert one(classify.category, text) == label


@pytest.mark.parametrize(
    "label, title, kind",
    [
        ("Outros Documentos", "edital52-26planilhaorçamentaria.pdf", "orcamento"), ("Outros Documentos", "edital52-26termodereferencia.pdf", "anexo"),
        ("Edital", "planilha.xlsx", "edital"), (None, "implantacao.pdf", "outro"), ("Aviso de Contratação Direta", "x", "edital"), ("Rótulo novo", "proj_01", "projeto"),
    ],
)
def test_document_type(one, label, title, kind):
    assert one(classify.document_type, label, title) == kind


def test_document_relevance(one):
    def rel(name, label, kind, active, url):
        return one(classify.document_relevance, name, label, kind, active, url, schema="c0 string, c1 string, c2 string, c3 boolean, c4 string")

    assert rel("Edital", None, "edital", False, "u") == -100
    assert rel("Edital", None, "edital", True, None) == -100
    assert rel("Recibo do edital", None, "edital", None, "u") == 1
    assert rel("Projeto Básico", None, "projeto", True, "u") == 100
    assert [rel("x", "y", k, True, "u") for k in ("edital", "projeto", "orcamento", "anexo", "outro")] == [90, 80, 70, 50, 10]


def test_file_type_and_states(one):
    kind = one(lambda h, c, b: classify.file_type(h, c, b), None, "lista.PDF", b"%PDF-1.7", schema="c0 string, c1 string, c2 binary")
    assert (kind["ext"], kind["mime"], kind["ok"], kind["name"]) == ("pdf", "application/pdf", True, "lista.PDF")
    kind = one(lambda h, c, b: classify.file_type(h, c, b), 'filename="a+b.txt"', "x", b"oi", schema="c0 string, c1 string, c2 binary")
    assert (kind["ext"], kind["mime"], kind["ok"], kind["name"]) == ("txt", None, False, "a b.txt")
    assert [one(classify.text_density_state, c, p) for c, p in ((400, 2), (399, 2), (10, 0))] == ["extraido", "sem_texto", "sem_texto"]
    bands = [one(classify.proximity, v) for v in (0.0, 100.0, 250.0, 250.1, float("nan"))]
    assert bands == ["muito_perto", "muito_perto", "media", "longe", "desconhecido"]


def test_checklist(one):
    got = one(lambda t, n: classify.checklist(t, n), ["projeto"], ["Memorial Descritivo", "Aviso"])
    assert (got["has_notice"], got["has_budget"], got["has_project"], got["has_memorial"], got["ready"]) == (True, False, True, True, 3)


def test_negative_answers(one):
    keep = lambda v, q, c: one(classify.keep_answer, v, q, c, schema="c0 string, c1 string, c2 boolean")
    assert keep("Não se exige", "texto qualquer", False) is None
    assert keep("Não se exige", "texto qualquer", True) == "Não se exige"
    assert keep("30 dias", "O edital não menciona prazo", True) is None
    assert keep("30 dias", None, None) == "30 dias"


def test_open_and_temporal_state(one):
    now = at("2026-01-10 12:00:00")

    def both(status, a, b):
        s = F.lit(status).cast("int")
        return one(lambda _: F.struct(dates.is_open(s, at(a), at(b), now).alias("o"), dates.temporal_state(s, at(a), at(b), now).alias("s")), 1)

    assert tuple(both(1, "2026-01-10 12:00:00", "2026-01-11 00:00:00")) == (True, "aberta")  # start inclusive
    assert tuple(both(1, "2026-01-01 00:00:00", "2026-01-10 12:00:00")) == (False, "encerrada")  # end exclusive
    assert tuple(both(1, "2026-01-11 00:00:00", "2026-01-12 00:00:00")) == (False, "nao_iniciada")
    assert tuple(both(1, None, "2026-01-12 00:00:00")) == (False, "indeterminada")
    assert tuple(both(1, "2026-01-13 00:00:00", "2026-01-12 00:00:00")) == (False, "inconsistente")
    assert tuple(both(2, "2026-01-01 00:00:00", "2026-01-12 00:00:00")) == (False, "nao_divulgada")
    assert tuple(both(None, "2026-01-01 00:00:00", "2026-01-12 00:00:00")) == (None, "nao_divulgada")
    assert tuple(both(None, None, None)) == (False, "indeterminada")


@pytest.mark.parametrize(
    "text, instant",
    [
        ("2026-09-14T09:00:00", "2026-09-14 12:00:00"), ("2026-09-14T09:00", "2026-09-14 12:00:00"), ("2026-09-14 09:00:30", "2026-09-14 12:00:30"),
        ("2026-09-14T09:00:00Z", "2026-09-14 09:00:00"), ("2026-09-14T09:00:00-0500", "2026-09-14 14:00:00"), ("2026-09-14T09:00:00+02:00", "2026-09-14 07:00:00"),
        ("2018-01-10T09:00:00", "2018-01-10 11:00:00"), ("ontem", None), ("2026-13-01T00:00:00", None), (None, None),
    ],
)
def test_local_to_utc(one, text, instant):
    assert one(lambda c: shown(dates.local_to_utc(c)), text) == instant


def test_calendar_rules(one):
    assert one(lambda _: F.date_format(dates.local_day(at("2026-09-15 02:59:59")), "yyyy-MM-dd"), 1) == "2026-09-14"
    assert one(lambda _: shown(dates.day_start(F.lit("2026-09-15"), 1)), 1) == "2026-09-16 03:00:00"
    assert one(lambda _: shown(dates.business_days_back(at("2026-09-21 15:00:00"))), 1) == "2026-09-16 21:00:00"
    assert one(lambda _: dates.days_left(at("2026-01-02 00:00:01"), at("2026-01-01 00:00:00")), 1) == 2
    d = lambda s: F.lit(s).cast("date")
    close = lambda a, b: one(lambda _: F.date_format(dates.closable_date(d(a), d(b), d("2026-09-15")), "yyyy-MM-dd"), 1)
    assert [close("2026-09-01", "2026-09-07"), close("2026-09-10", "2026-09-15"), close("2026-09-15", "2026-09-15")] == ["2026-09-07", "2026-09-14", None]
    assert one(dates.validate_range, "20260101", "20260230") == "data final inválida"
    assert one(dates.validate_range, "20260101", "20270101") is None
    assert one(dates.validate_range, "20260101", "20270102") == "intervalo maior que o permitido"
    fresh = lambda s, h: one(lambda _: dates.sync_fresh(F.lit(s), at("2026-01-01 00:00:00"), at(f"2026-01-01 0{h}:00:00")), 1)
    assert [fresh("concluido", 6), fresh("concluido", 7), fresh("falhou", 1)] == [True, False, False]


def test_haversine(one):
    km = lambda *p: one(geo.haversine, *[float(x) for x in p])
    assert km(-23.5, -46.6, -23.5, -46.6) == 0
    assert km(0, 0, 0, 180) == pytest.approx(20015.0868, abs=1e-3)
    assert km(-23.5505, -46.6333, -22.9068, -43.1729) == pytest.approx(360.75, abs=0.5)
    assert one(lambda a: geo.haversine(a, F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0)), 1.0) is None


def test_score(one):
    def score(text, modality, value, flags=()):
        c = classify.category(F.lit(text))
        has = {k: F.lit(k in flags) for k in scoring.DOCUMENT_SHARES}
        return one(lambda _: scoring.score(F.lit(text), F.lit(modality), F.lit(value).cast("double"), c, has), 1)

    assert score("Locação", "Dispensa", None) == 4  # 17 * .25 = 4.25
    assert score("Locação", "Dispensa", 0.0) == 4
    assert score("CONSTRUCAO DE ESCOLA com cobertura", "RDC", 1e6, ("projeto", "orcamento", "edital")) == 100
    assert score("Locação", "Concorrência - Eletrônica", 1e6) == 17  # the bonus needs the exact name
    assert score("reforma", "Dispensa", 300000.0, ("projeto",)) == 47  # 15 + 15 + 12.75 + 4 = 46.75


def test_rank_and_wait_rules(one):
    assert [one(scoring.backoff_ms, n) for n in (1, 2, 3, 9)] == [15000, 30000, 60000, 60000]
    assert one(scoring.rrf, 1) == pytest.approx(1 / 61) and one(lambda r: scoring.rrf(r, 0.5), 2) == pytest.approx(0.5 / 62)
    assert [one(scoring.percent, a, e) for a, e in ((1, 3), (5, 4), (1, 0))] == [33, 100, None]
    assert one(lambda _: vectors.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))), 1) == 1.0
    assert one(lambda _: vectors.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 1) is None


def test_json(one):
    assert one(jsonx.unwrap, '{"resultado": {"a":1}}') == '{"a":1}'
    assert one(jsonx.unwrap, '{"a":1}') == '{"a":1}'
    assert one(jsonx.unwrap, '{"resultado": "texto"}') == '{"resultado": "texto"}'
    assert one(lambda c: jsonx.typed(c, "a int"), "nada")["a"] is None


def test_fold_gives_the_table_for_every_letter(spark):
    source, target = tx._fold_table()
    texts = ["plain", "", "AÇÃO É ÓTIMA", "Ǿ e ñ ÿ", "co̧digo", "ß𝄞İ", None, *source]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~tx.fold(F.col("t")).eqNullSafe(F.translate(F.lower("t"), source, target))).count() == 0
    assert "contains" not in tx.fold(F.col("t"))._jc.toString() and "octet_length" in df.select(tx.fold(F.col("t")))._jdf.queryExecution().analyzed().toString()


def test_word_lists_tell_texts_without_the_stems_first(spark):
    from bidspan.plans import index

    df = spark.createDataFrame([(0, "Reforma da Escola"), (1, "escolas, construções urgentes"), (2, "construção de escola"), (3, "praça"), (4, None), (5, "escolar reformado")], "id int, t string")
    cond = index.all_any_none(F.col("t"), ["escola"], ["reforma", "construções"], ["urgente", "urgent"])
    assert [r["id"] for r in df.filter(cond).orderBy("id").collect()] == [0, 2]
    assert [r["id"] for r in df.filter(index.all_any_none(F.col("t"), phrase_="reforma da escola")).collect()] == [0]
    assert "contains" in df.filter(cond)._jdf.queryExecution().optimizedPlan().toString().lower()

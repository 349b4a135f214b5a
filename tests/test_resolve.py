import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from fiscalspark.functions import language as L
from fiscalspark.operators import containment
from fiscalspark.operators.containment import contained
from fiscalspark.plans import resolve as R


def _request(**given):
    filters = {f: given.pop(f, None) for f in R.FILTERS_TYPE.fieldNames()}
    return {"date_from": None, "date_to": None, "metrics": None, "group_by": None, **given, "filters": filters}


def _questions(spark, *rows):
    schema = f"query_id int, text_query string, explicit {R.REQUEST_TYPE.simpleString()}, patch {R.REQUEST_TYPE.simpleString()}"
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


def test_stems_and_terms(spark):
    texts = ["Сколько было потрачено за 2025 на авто тему", "Покажи расходы по Благовещенску", "территории школ 12 ab",
             "ремонт дорогами ремонт", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(L.search_terms(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [
        ["авто"], ["благовещенск"], ["территори", "школ"], ["ремонт", "дорог"], []]


def test_hints(spark):
    texts = ["остаток лимитов", "платежи по контрактам", "Расходы и лимиты", "без бо", "ничего"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        L.metric_hint(F.col("t")).alias("a"), L.interpretation_metric_hint(F.col("t")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [
        ("limits", "limits"), ("contract_amount", "contract_amount"), ("cash_payments", "limits"),
        ("obligations_without_bo", "obligations_without_bo"), (None, None)]


@pytest.mark.parametrize("text, year", [("за 2025", 2025), ("2025г", None), ("2024 и 2025", None), ("2025, 2025", 2025)])
def test_single_year(spark, text, year):
    assert spark.createDataFrame([(text,)], "t string").select(L.single_year(F.col("t"))).first()[0] == year


def test_explicit_beats_interpretation(spark):
    row = R.resolve(_questions(spark, (
        "Покажи расходы по Благовещенску по годам", _request(metrics=["limits"], source_groups=["rchb"], kfsr_code="0502"),
        _request(metrics=["cash_payments"], object_query="Благовещенск", group_by=["year"])))).first()
    resolved = row["resolved"]
    assert row["interpreted"] and row["warning"] is None
    assert (resolved["metrics"], resolved["group_by"]) == (["limits"], ["year"])
    assert resolved["filters"]["object_query"] == "Благовещенск"
    assert resolved["filters"]["source_groups"] == ["rchb"] and resolved["filters"]["kfsr_code"] == "0502"
    assert resolved["filters"]["text_search"] is None


def test_text_restricts_an_open_interpretation(spark):
    rows = R.resolve(_questions(
        spark,
        ("Сколько было потрачено за 2025 на авто тему", None, _request(metrics=["cash_payments"])),
        ("Покажи расходы по Благовещенску", None, _request(metrics=["cash_payments"], group_by=["month"])),
        ("   ", _request(metrics=["contract_amount"]), _request(metrics=["limits"])),
    )).orderBy("query_id").collect()
    first = rows[0]["resolved"]
    assert first["filters"]["text_search"] == "авто"
    assert (first["date_from"], first["date_to"]) == (date(2025, 1, 1), date(2025, 12, 31))
    assert rows[1]["resolved"]["filters"]["text_search"] == "благовещенск"
    assert rows[2]["text_query"] is None and not rows[2]["interpreted"]
    assert rows[2]["resolved"]["metrics"] == ["contract_amount"]


def test_unavailable_interpretation_keeps_explicit_values(spark):
    row = R.resolve(_questions(spark, (
        "Покажи лимиты по Благовещенску", _request(metrics=["limits"], object_query="Благовещенск"),
        _request(metrics=["cash_payments"]))), unavailable=True).first()
    assert not row["interpreted"] and row["warning"].startswith("LLM временно недоступен")
    assert row["resolved"]["metrics"] == ["limits"] and row["resolved"]["filters"]["text_search"] is None


def test_replies_are_coerced_and_completed(spark):
    replies = [
        ("лимиты по Зее", '```json\n{"metrics": ["LIMITS", "x", "limits"], "filters": {"object_query": ["", " Зея "], '
                          '"source_groups": "Rchb"}, "group_by": "month", "date_from": "2025-02-01"}\n```'),
        ("Покажи кассовые выплаты по Родникам по годам", '{"filters": {"organization_query": "Родник"}}'),
        ("данные", "нет ответа"),
        ("бюджет Зеи", '{"metrics": null, "filters": {}, "group_by": ["year", "bad"]}'),
    ]
    questions = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(replies)], "query_id int, text_query string, reply string")
    questions = questions.withColumn("explicit", F.lit(None).cast(R.REQUEST_TYPE))
    options = spark.createDataFrame(
        [("objects", "Родник"), ("organizations", "Администрация"), ("budgets", "Бюджет города Зеи"),
         ("metrics", "limits"), ("metrics", "cash_payments")], "field string, value string")
    metrics = F.array(F.lit("limits"), F.lit("cash_payments"))
    patched = R.parse_replies(questions, metrics, F.array(F.lit("rchb"), F.lit("gz")))
    rows = {r["query_id"]: r["patch"] for r in R.complete(patched, options, metrics).collect()}
    assert rows[0]["metrics"] == ["limits"] and rows[0]["filters"]["object_query"] == "Зея"
    assert rows[0]["filters"]["source_groups"] == ["rchb"] and rows[0]["group_by"] is None
    assert rows[0]["date_from"] == date(2025, 2, 1)
    assert rows[1]["filters"]["organization_query"] is None and rows[1]["filters"]["object_query"] == "Родник"
    assert rows[1]["metrics"] == ["cash_payments"] and rows[1]["group_by"] == ["year"]
    assert rows[2] is None
    assert rows[3]["group_by"] == ["year"] and rows[3]["filters"]["object_query"] == "бюджет"


def test_containment_agrees_with_brute_force(spark):
    options = ["бюджет города зеи", "родник", "abc", "xx yy zz", "бюджет города тынды", "ааааа"]
    needles = ["бюджет", "города з", "а", "yy z", "abcd", "тынды", "зее", "родник", "", "ааааааа", "бюдж", "города тынд"]
    found = contained(
        spark.createDataFrame([(n,) for n in needles * 2], "needle string"),
        spark.createDataFrame([(o, "ab"[i % 2]) for i, o in enumerate(options)], "option string, kind string"))
    assert {r["needle"]: r["kinds"] for r in found.collect()} == {
        n: sorted({"ab"[i % 2] for i, o in enumerate(options) if n in o}) for n in needles if n and any(n in o for o in options)}


def test_containment_where_most_options_share_every_head(spark):
    options = spark.range(3000).selectExpr(
        "if(id % 10 = 0, concat('другое ', id), concat('учреждение города №', id)) as option", "'k' as kind")
    needles = spark.createDataFrame(
        [("учреждение",), ("№17",), ("города №299",), ("города №5000",), ("другое 10",), ("нет",)], "needle string")
    found = {r["needle"] for r in contained(needles, options).collect()}
    assert found == {"учреждение", "№17", "города №299", "другое 10"}


@pytest.mark.parametrize("part_bytes", [1, 12, 1 << 17])
def test_containment_over_many_automata(spark, monkeypatch, part_bytes):
    rng = random.Random(part_bytes)
    monkeypatch.setattr(containment, "PART_BYTES", part_bytes)
    letters = "абaя€"
    needles = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    options = ["".join(rng.choice(letters + "ж") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    found = containment.occurrences(
        spark.createDataFrame([(n,) for n in needles] + [(None,), ("",)], "needle string"),
        spark.createDataFrame([(o, "k") for o in options], "option string, kind string"))
    assert {(r["needle"], r["option"]) for r in found.collect()} == {(n, o) for n in needles for o in options if o and n in o}


def test_flags(spark):
    rows = [("true", "a", "a"), ('"No"', "a", "b"), ('"maybe"', "a", " a "), ("null", "a", "b"), ("0", "a", "b")]
    df = spark.createDataFrame(rows, "j string, raw string, new string").select(
        R.flag(F.try_parse_json("j"), F.col("raw"), F.col("new")).alias("f"))
    assert [r["f"] for r in df.collect()] == [True, False, False, True, False]

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscalspark.operators import aggregates as A, charts as C, distinct as D
from fiscalspark.plans import analytics, examples
from fiscalspark.plans.request import Filters, Request, RequestError
from fiscalspark.schema import FACT_SCHEMA

CITY, OTHER = "Бюджет посёлка Лесной", "Бюджет села Озёрное"
ROWS = [
    ("limits", "410.50", date(2024, 4, 3), CITY, "rchb", "0709", None),
    ("limits", "89.50", date(2024, 6, 28), CITY, "rchb", "0709", None),
    ("limits", "75.00", date(2023, 6, 28), CITY, "rchb", "0113", None),
    ("cash_payments", "125.00", date(2024, 4, 17), CITY, "rchb", "0709", None),
    ("cash_payments", "310.25", date(2024, 5, 5), OTHER, "rchb", "0709", None),
    ("contract_amount", "64.75", date(2024, 9, 9), "Школа №3", "gz", None, "Д-88"),
]


@pytest.fixture(scope="module")
def facts(spark):
    data = []
    for i, (metric, value, day, name, group, kfsr, number) in enumerate(ROWS):
        given = {
            "batch_id": "batch-1", "source_group": group, "source_file": "test.csv", "row_number": i, "budget_name": name,
            "object_name": name, "organization_name": "Администрация", "document_number": number, "date": day,
            "year": day.year, "month": day.month, "kfsr_code": kfsr, "metric": metric, "value": Decimal(value), "raw_data": {},
        }
        data.append(tuple(given.get(f) for f in FACT_SCHEMA.fieldNames()))
    return spark.createDataFrame(data, FACT_SCHEMA)


def _summary(report):
    return {r["metric"]: str(r["value"]) for r in report.summary.collect()}


def test_limits_and_payments_of_one_object(facts):
    report = analytics.run(facts, Request(
        "batch-1", date_from=date(2024, 1, 1), date_to=date(2024, 12, 31), metrics=("limits", "cash_payments"),
        filters=Filters(object_query="лесно")))
    assert _summary(report) == {"limits": "500.00", "cash_payments": "125.00"}
    assert report.execution_percent.first()["execution_percent"] == Decimal("25.00")
    assert [tuple(map(str, r)) for r in report.page().collect()] == [
        ("2024", "4", "cash_payments", "125.00"), ("2024", "4", "limits", "410.50"), ("2024", "6", "limits", "89.50")]
    assert report.rows_count.first()[0] == 3
    assert sorted((r["period"], r["metric"]) for r in report.timeseries.collect()) == [
        ("2024-04", "cash_payments"), ("2024-04", "limits"), ("2024-06", "limits")]
    assert [r["value"] for r in report.sources.collect()] == ["rchb"]
    last = C.cumulative(report.timeseries).orderBy(F.desc("period")).first()
    assert last["cumulative"] == Decimal("625.00")


def test_code_filters_are_exact_unless_asked(facts):
    dotted = Request("batch-1", metrics=("cash_payments",), filters=Filters(kfsr_code="07.09", object_query="Озёрное"))
    assert _summary(analytics.run(facts, dotted)) == {}
    assert _summary(analytics.run(facts, dotted, normalize_codes=True)) == {"cash_payments": "310.25"}


def test_text_search_needs_every_term(facts):
    def found(text):
        return _summary(analytics.run(facts, Request("batch-1", filters=Filters(text_search=text))))

    assert found("расходы по Лесному") == {"limits": "575.00", "cash_payments": "125.00"}
    assert found("Лесной авто") == {}
    assert found("по за") == {"limits": "575.00", "cash_payments": "435.25", "contract_amount": "64.75"}


def test_values_options_stats_preview(facts):
    assert [r[0] for r in D.distinct_values(facts, "object_name", "посёл").collect()] == [CITY]
    options = {(r["field"], r["value"]) for r in D.filter_options(facts, 1).collect()}
    assert ("metrics", "cash_payments") in options and ("metrics", "limits") not in options
    stats = A.batch_stats(facts).first()
    assert (stats["date_min"], stats["date_max"], stats["rows_count"]) == (date(2023, 6, 28), date(2024, 9, 9), 6)
    assert [r["metric"] for r in analytics.preview(facts, "batch-1", 2).collect()] == ["limits", "limits"]


def test_prepared_examples(facts):
    subjects = (Filters(object_query="Лесной"), Filters(kfsr_code="0709"), Filters(source_groups=("gz",)))
    specs = [(p, t, replace(r, filters=f)) for (p, t, r), f in zip(examples.PREPARED, subjects)]
    sums = examples.prepared(facts, "batch-1", specs).where("part = 'rows'").groupBy("title").agg(F.sum("value").alias("v")).collect()
    assert {r["title"]: str(r["v"]) for r in sums} == {
        "Лимиты по Благовещенску": "575.00", "Кассовые выплаты по 0502": "435.25", "Контракты по gz": "64.75"}


def test_sheets_agree_with_rows(facts):
    report = analytics.run(facts, Request("batch-1", group_by=("month", "object_name")))
    sheets = report.sheets()
    assert list(sheets) == ["Параметры", "Сводка по объектам", "Итоги по объектам", "Динамика", "Детализация"]
    row = sheets["Итоги по объектам"].where(F.col("object") == CITY).first()
    assert (str(row["limits"]), str(row["execution_percent"]), str(row["row_total"]), row["period"]) == (
        "575.00", "21.74", "700.00", "Итого")
    pivoted = sheets["Сводка по объектам"].agg(F.sum("row_total")).first()[0]
    assert pivoted == report.rows.agg(F.sum("value")).first()[0] == Decimal("1075.00")
    parameters = {r["name"]: r["value"] for r in sheets["Параметры"].collect()}
    assert parameters["Источники"] == "Госзаказ, РЧБ" and parameters["Строк в результате"] == "6"


@pytest.mark.parametrize("bad", [
    {"metrics": ("nope",)}, {"group_by": ("nope",)}, {"limit": 0}, {"limit": 1001}, {"offset": -1}])
def test_bad_requests_fail_before_any_scan(bad):
    with pytest.raises(RequestError):
        Request("b", **bad)


def test_unknown_values_field(facts):
    with pytest.raises(RequestError):
        D.distinct_values(facts, "raw_data")


def test_first_wins_is_idempotent(facts):
    once = D.first_wins(facts, [F.col("metric")], ["source_file", "row_number"])
    assert once.count() == 3 and D.first_wins(once, [F.col("metric")], ["source_file", "row_number"]).count() == 3

"""Report sheets as tables over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.functions.labels import dimension_title, metric_label, source_label
from fiscalspark.functions.periods import period_label, range_label
from fiscalspark.operators.aggregates import ratio_percent, total
from fiscalspark.plans.request import Request, grouping_columns
from fiscalspark.schema import GROUP_BY_LABELS, METRIC_LABELS, SOURCE_GROUP_LABELS

# --- Fixed values: wording of the sheets -------------------------------------------------------
REPORT_METRICS = {
    "limits": "План / лимиты",
    "obligations": "Бюджетные обязательства",
    "cash_payments": "Кассовые выплаты",
    "agreement_amount": "Соглашения",
    "contract_amount": "Контракты / договоры",
    "contract_payment": "Платежи по контрактам",
    "remaining_limits": "Остаток лимитов",
}
OBJECT_TITLE, PERIOD_TITLE = "Объект / мероприятие", "Период"
PERCENT_TITLE, ROW_TOTAL_TITLE = "Исполнение, %", "Итого по строке"
METRIC_TITLE, VALUE_TITLE = "Показатель", "Значение"
ALL_OBJECTS, TOTAL_PERIOD = "Все объекты", "Итого"
SHEETS = ("Параметры", "Сводка по объектам", "Итоги по объектам", "Динамика", "Детализация")
# -----------------------------------------------------------------------------------------------


def _column(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def labelled(rows: DataFrame, request: Request) -> DataFrame:
    """Grouped rows with the object and period text a report shows for them."""
    anything = request.filters.object_query or ALL_OBJECTS
    period = period_label(
        _column(rows, "day"), _column(rows, "year"), _column(rows, "month"),
        F.lit(range_label(request.date_from, request.date_to)),
    )
    object_label = F.coalesce(F.nullif(_column(rows, "object_name"), F.lit("")), F.lit(anything))
    return rows.select(object_label.alias("object"), period.alias("period"), "metric", "value")


def _finish(pivoted: DataFrame) -> DataFrame:
    money = [F.col(m).cast("decimal(20,2)").alias(m) for m in REPORT_METRICS]
    row_total = sum((F.coalesce(F.col(m), F.lit(0)) for m in REPORT_METRICS), F.lit(0)).cast("decimal(20,2)")
    return pivoted.select(
        "object", "period", *money,
        ratio_percent(F.col("cash_payments"), F.col("limits")).alias("execution_percent"),
        row_total.alias("row_total"),
    )


def object_summary(rows: DataFrame, request: Request) -> DataFrame:
    """Seven metric columns per (object, period); the metric list is fixed, so no distinct job runs."""
    pivoted = labelled(rows, request).groupBy("object", "period").pivot("metric", list(REPORT_METRICS))
    return _finish(pivoted.agg(F.sum("value"))).orderBy("object", "period")


def object_totals(rows: DataFrame, request: Request) -> DataFrame:
    pivoted = labelled(rows, request).groupBy("object").pivot("metric", list(REPORT_METRICS))
    return _finish(pivoted.agg(F.sum("value")).withColumn("period", F.lit(TOTAL_PERIOD))).orderBy("object")


def dynamics(rows: DataFrame, request: Request) -> DataFrame:
    return labelled(rows, request).select(
        "object", "period", metric_label(F.col("metric")).alias("metric_label"), "value"
    ).orderBy("object", "period", "metric_label")


def detail(rows: DataFrame, request: Request) -> DataFrame:
    dimensions = list(grouping_columns(request.group_by))
    if "metric" in request.group_by:
        rows = rows.withColumn("metric_key", F.col("metric"))
        dimensions.append("metric_key")
    return rows.select(*dimensions, metric_label(F.col("metric")).alias("metric_label"), "value")


def combine_details(details: list[DataFrame]) -> DataFrame:
    """Details of several requests under the ordered union of their dimensions."""
    combined = details[0]
    for other in details[1:]:
        combined = combined.unionByName(other, allowMissingColumns=True)
    trailing = ["metric_label", "value"]
    return combined.select(*[c for c in combined.columns if c not in trailing], *trailing)


def parameters(request: Request, facts: DataFrame) -> DataFrame:
    """Name/value pairs that describe a report on the matching facts; ``position`` keeps the sheet's order.

    The facts are read once: rows of the report, then one row per metric, then one row, whose lists are as long as the
    vocabularies of metrics and sources.
    """
    keys = [F.col(source).alias(name) for name, source in grouping_columns(request.group_by).items()]
    rows = facts.groupBy(*keys, "metric").agg(total().alias("value"), F.collect_set("source_group").alias("sources"))
    metrics = rows.groupBy("metric").agg(
        total().alias("value"), F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"))
    one = metrics.agg(
        F.array_sort(F.collect_list(F.struct("metric", "value", "sources"))).alias("found"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("rows"))

    def listed(values: Column, vocabulary, label) -> Column:
        known = F.filter(F.array_sort(F.array_distinct(values)), lambda v: v.isin(*vocabulary))
        return F.array_join(F.transform(known, label), ", ")

    def of(metric: str) -> Column:
        return F.get(F.filter("found", lambda m: m["metric"] == metric), F.lit(0))["value"]

    filters = request.filters
    lines = [
        ("Отчёт", F.lit("Бюджетная аналитика")),
        ("Текстовый запрос", F.lit(request.text_query or "")),
        ("Пакет данных", F.lit(request.batch_id)),
        ("Период отчёта", F.lit(range_label(request.date_from, request.date_to))),
        ("Источники", listed(F.flatten("found.sources"), SOURCE_GROUP_LABELS, source_label)),
        ("Показатели", listed(F.col("found.metric"), METRIC_LABELS, metric_label)),
        ("Группировка интерфейса", F.lit(", ".join(GROUP_BY_LABELS[g] for g in request.group_by))),
        ("Объект", F.lit(filters.object_query or "")),
        ("Организация", F.lit(filters.organization_query or "")),
        ("Бюджет", F.lit(filters.budget_query or "")),
        ("Текстовый поиск", F.lit(filters.text_search or "")),
        ("КФСР", F.lit(filters.kfsr_code or "")),
        ("КЦСР", F.lit(filters.kcsr_code or "")),
        ("КВР", F.lit(filters.kvr_code or "")),
        ("Источник средств", F.lit(filters.funding_source or "")),
        ("Строк в результате", F.col("rows")),
        ("Строк в выгрузке", F.col("rows")),
        (PERCENT_TITLE, ratio_percent(of("cash_payments"), of("limits")).cast("string")),
    ]

    def line(position: int, name: Column, value: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), name.alias("name"), value.alias("value"))

    head = F.array(*[line(i, F.lit(name), value) for i, (name, value) in enumerate(lines)])
    sums = F.transform("found", lambda m: line(len(lines), metric_label(m["metric"]), m["value"].cast("string")))
    return one.select(F.explode(F.concat(head, sums)).alias("line")).select("line.*").orderBy("position", "name")


def titled(sheet: DataFrame) -> DataFrame:
    """The same sheet under the column titles readers see."""
    titles = {
        "object": OBJECT_TITLE, "period": PERIOD_TITLE, **REPORT_METRICS, "execution_percent": PERCENT_TITLE,
        "row_total": ROW_TOTAL_TITLE, "metric_label": METRIC_TITLE, "value": VALUE_TITLE,
        "metric_key": METRIC_TITLE + " (код)",
    }
    return sheet.toDF(*[titles.get(c) or dimension_title(c) for c in sheet.columns])

"""The same queries in plain SQL, for checking results with another engine."""

from __future__ import annotations

from fiscalspark.operators.report import REPORT_METRICS
from fiscalspark.plans.request import grouping_columns
from fiscalspark.schema import GROUP_BY_LABELS, METRIC_LABELS, SOURCE_GROUP_LABELS, TEXT_SEARCH_COLUMNS, VALUE_FIELDS

SQL: dict[str, str] = {}

_LINE = """
SELECT 'tpch' AS batch_id, 'rchb' AS source_group, 'lineitem' AS source_file,
       l_orderkey * 10 + l_linenumber AS row_number, r_name AS budget_name, n_name AS object_name,
       s_name AS organization_name, CAST(NULL AS VARCHAR) AS document_number, CAST(NULL AS VARCHAR) AS document_id,
       CAST(l_shipdate AS DATE) AS date, p_brand AS kfsr_code, p_type AS kcsr_code, l_returnflag AS kvr_code,
       l_linestatus AS kvsr_code, CAST(p_size AS VARCHAR) AS kesr_code, CAST(p_size AS VARCHAR) AS kosgu_code,
       o_orderpriority AS purpose_code, c_mktsegment AS funding_source,
       '{"part":"' || p_name || '"}' AS raw_text, l_linestatus AS ls,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS price, CAST(l_discount AS DECIMAL(3,2)) AS discount,
       CAST(l_tax AS DECIMAL(3,2)) AS tax
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
"""

_COLUMNS = (
    "batch_id, source_group, source_file, row_number, budget_name, object_name, organization_name, "
    "document_number, document_id, date, CAST(year(date) AS INTEGER) AS year, "
    "CAST(month(date) AS INTEGER) AS month, kfsr_code, kcsr_code, kvr_code, kvsr_code, kesr_code, "
    "kosgu_code, purpose_code, funding_source, raw_text, metric, value"
)


def _line_metric(metric: str, expression: str, condition: str = "TRUE") -> str:
    names = _COLUMNS.replace("metric, value", f"'{metric}' AS metric, CAST({expression} AS DECIMAL(20,2)) AS value")
    return f"SELECT {names} FROM line WHERE {condition}"


def _other(group: str, file: str, source: str, metric: str, value: str, condition: str = "TRUE", **given: str) -> str:
    text = "CAST(NULL AS VARCHAR)"
    columns = {
        "row_number": "NULL", "budget_name": text, "object_name": text, "organization_name": text,
        "document_number": text, "document_id": text, "date": "NULL", "kfsr_code": text, "kcsr_code": text,
        "kvr_code": text, "kvsr_code": text, "kesr_code": text, "kosgu_code": text, "purpose_code": text,
        "funding_source": text, "raw_text": text, **given,
    }
    inner = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return (
        f"SELECT {_COLUMNS} FROM (SELECT 'tpch' AS batch_id, '{group}' AS source_group, '{file}' AS source_file, "
        f"{inner}, '{metric}' AS metric, CAST({value} AS DECIMAL(20,2)) AS value FROM {source} WHERE {condition})"
    )


def _contract(metric: str, condition: str, **extra: str) -> str:
    return _other(
        "gz", "orders", "orders LEFT JOIN customer ON o_custkey = c_custkey", metric, "o_totalprice", condition,
        row_number="o_orderkey", document_id="CAST(o_orderkey AS VARCHAR)",
        document_number="'Ф.' || year(o_orderdate) || '.' || o_orderkey", date="CAST(o_orderdate AS DATE)",
        raw_text="""'{"priority":"' || o_orderpriority || '"}'""", **extra,
    )


def _event(metric: str, condition: str = "TRUE") -> str:
    return _other(
        "buau", "events", "events", metric, "value", condition, row_number="event_id", budget_name="'Events'",
        object_name="event_type", organization_name="'User ' || user_id", kfsr_code="event_type",
        purpose_code="json_extract_string(props, '$.k')", date="CAST(ts AS DATE)",
        raw_text="""'{"type":"' || event_type || '"}'""",
    )


_BRANCHES = [
    _line_metric("limits", "price"),
    _line_metric("obligations", "ROUND(price * (1 - discount), 2)"),
    _line_metric("obligations_without_bo", "ROUND(price * discount, 2)"),
    _line_metric("remaining_limits", "ROUND(price * tax, 2)"),
    _line_metric("cash_payments", "ROUND(price * (1 - discount), 2)", "ls = 'F'"),
    _contract("contract_amount", "TRUE", object_name="c_name", organization_name="c_name"),
    _contract("contract_payment", "o_orderstatus = 'F'"),
    _other(
        "agreements", "customer",
        "customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
        "agreement_amount", "c_acctbal", row_number="c_custkey", budget_name="r_name", object_name="c_name",
        organization_name="c_name", document_id="CAST(c_custkey AS VARCHAR)",
        date="CASE WHEN c_custkey % 10 <> 0 THEN DATE '1998-01-01' + CAST(c_custkey % 700 AS INTEGER) END",
        raw_text="""'{"segment":"' || c_mktsegment || '"}'""",
    ),
    _event("institution_payments_with_refund"),
    _event("institution_payments_execution", "event_type = 'purchase'"),
    _event("institution_payments_recovery", "event_type = 'error'"),
]
FACTS = (
    "line AS (" + _LINE + "), facts AS (SELECT * FROM (" + "\nUNION ALL\n".join(_BRANCHES) + ") WHERE value <> 0)"
)
MONEY = "CAST(SUM(value) AS DECIMAL(20,2))"
MONTH = "lpad(CAST(year AS VARCHAR), 4, '0') || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"


def on_facts(sql: str, *ctes: str) -> str:
    return "WITH " + ", ".join([FACTS, *ctes]) + " " + sql


def percent(cash: str, limits: str) -> str:
    return (
        f"CASE WHEN {limits} <> 0 THEN CAST(round_even(100 * CAST({cash} AS DOUBLE) / {limits}, 2) "
        "AS DECIMAL(20,2)) END"
    )


def labels(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


# --- Predicates --------------------------------------------------------------------------------

_HAYSTACK = "lower(concat_ws('|', " + ", ".join(TEXT_SEARCH_COLUMNS) + ", raw_text))"
_CONDITIONS = {
    "filter_date_range": "date >= DATE '1997-03-01' AND date <= DATE '1998-06-30'",
    "filter_metrics": "metric IN ('limits', 'contract_payment')",
    "filter_source_groups": "source_group IN ('gz', 'buau')",
    "filter_object_query": "(object_name ILIKE '%nation_1%' OR budget_name ILIKE '%nation_1%')",
    "filter_budget_query": "budget_name ILIKE '%a%'",
    "filter_organization_query": "organization_name ILIKE '%supplier#00000000%'",
    "filter_text_search": f"contains({_HAYSTACK}, 'brand') AND contains({_HAYSTACK}, 'ring')",
    "filter_exact_codes": "kfsr_code = 'Brand#7' AND kvr_code = 'R' AND kvsr_code = 'F'",
}
for _name, _condition in _CONDITIONS.items():
    SQL[_name] = on_facts(
        f"SELECT metric, COUNT(*) AS n, {MONEY} AS value FROM facts WHERE {_condition} GROUP BY metric"
    )

SQL["filter_each_exact_field"] = on_facts(" UNION ALL ".join(
    f"SELECT '{name}' AS field, metric, COUNT(*) AS n, {MONEY} AS value FROM facts WHERE {name} = '{value}' "
    "GROUP BY metric"
    for name, value in {
        "kcsr_code": "ECONOMY", "kesr_code": "11", "kosgu_code": "12", "purpose_code": "2-HIGH",
        "funding_source": "MACHINERY", "document_id": "7", "document_number": "Ф.1997.1",
    }.items()
))

# --- Totals and groupings ----------------------------------------------------------------------

SQL["summary_by_metric"] = on_facts(f"SELECT metric, {MONEY} AS value FROM facts GROUP BY metric")
SQL["by_metric"] = SQL["summary_by_metric"]


def grouped(*group_by: str) -> str:
    keys = grouping_columns(group_by)
    select = "".join(f"{source} AS {name}, " for name, source in keys.items())
    return f"SELECT {select}metric, {MONEY} AS value FROM facts GROUP BY {', '.join([*keys.values(), 'metric'])}"


for _dim in GROUP_BY_LABELS:
    SQL[f"rows_by_{_dim}"] = on_facts(grouped(_dim))
SQL["rows_by_month_object"] = on_facts(grouped("month", "object_name"))
SQL["rows_count"] = on_facts(f"SELECT COUNT(*) AS rows_count FROM ({grouped('month', 'object_name')})")
SQL["rows_page"] = on_facts(
    grouped("month", "object_name")
    + " ORDER BY year NULLS LAST, month NULLS LAST, object_name NULLS LAST, metric LIMIT 100 OFFSET 250"
)

SERIES = (
    f"series AS (SELECT {MONTH} AS period, metric, {MONEY} AS value FROM facts "
    "WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month, metric)"
)
SQL["timeseries"] = on_facts("SELECT * FROM series", SERIES)
SQL["timeseries_total"] = on_facts(f"SELECT period, {MONEY} AS value FROM series GROUP BY period", SERIES)
SQL["yearly_total"] = on_facts(f"SELECT period[1:4] AS year, {MONEY} AS value FROM series GROUP BY 1", SERIES)
SQL["cumulative_total"] = on_facts(
    "SELECT period, value, CAST(SUM(value) OVER (ORDER BY period) AS DECIMAL(20,2)) AS cumulative FROM "
    f"(SELECT period, {MONEY} AS value FROM series GROUP BY period)", SERIES)
SQL["cumulative_by_metric"] = on_facts(
    "SELECT metric, period, value, CAST(SUM(value) OVER (PARTITION BY metric ORDER BY period) AS DECIMAL(20,2)) "
    "AS cumulative FROM series", SERIES)
SQL["share_of_max"] = on_facts(
    "SELECT metric, value, ROUND(CAST(abs(value) AS DOUBLE) / greatest(CAST((SELECT max(abs(value)) FROM sums) "
    "AS DOUBLE), 1), 9) AS share FROM sums",
    f"sums AS (SELECT metric, {MONEY} AS value FROM facts GROUP BY metric)")
SQL["batch_stats"] = on_facts(
    "SELECT batch_id, MIN(date) AS date_min, MAX(date) AS date_max, COUNT(*) AS rows_count FROM facts GROUP BY 1")
SQL["batch_sources"] = on_facts("SELECT DISTINCT source_group AS value FROM facts WHERE source_group <> ''")


def _execution(keys: str = "") -> str:
    def of(metric: str) -> str:
        return f"CAST(SUM(CASE WHEN metric = '{metric}' THEN value END) AS DECIMAL(20,2))"

    select, group = (f"{keys}, ", f"GROUP BY {keys.split(' AS ')[0]}") if keys else ("", "")
    name = keys.split(" AS ")[-1] + ", " if keys else ""
    return on_facts(
        f"SELECT {name}limits, cash_payments, {percent('cash_payments', 'limits')} AS execution_percent FROM "
        f"(SELECT {select}{of('limits')} AS limits, {of('cash_payments')} AS cash_payments FROM facts "
        f"WHERE metric IN ('limits', 'cash_payments') {group})"
    )


SQL["execution_percent"] = _execution()
SQL["execution_percent_by_object_name"] = _execution("object_name")
SQL["execution_percent_by_day"] = _execution("date AS day")

_ALL = [c.split(" AS ")[-1].strip() for c in
        _COLUMNS.replace("CAST(year(date) AS INTEGER)", "").replace("CAST(month(date) AS INTEGER)", "").split(",")]
_FACT_COLUMNS = [c for c in _ALL if c != "raw_text"]
_FIRST = ["date", "source_file", "row_number", "metric"]
SQL["preview_page"] = on_facts(
    f"SELECT {', '.join(_FACT_COLUMNS)} FROM facts ORDER BY "
    + ", ".join(f"{c} NULLS LAST" for c in [*_FIRST, *[c for c in _FACT_COLUMNS if c not in _FIRST]])
    + " LIMIT 200 OFFSET 50")
SQL["facts_all_sources"] = on_facts(f"SELECT {', '.join(_FACT_COLUMNS)} FROM facts")

# --- Distinct values ---------------------------------------------------------------------------

SQL["distinct_values"] = on_facts(
    "SELECT DISTINCT organization_name AS value FROM facts WHERE organization_name <> '' ORDER BY 1 LIMIT 50")
SQL["distinct_values_search"] = on_facts(
    "SELECT DISTINCT document_number AS value FROM facts WHERE document_number ILIKE '%ф.1997.1%' ORDER BY 1 LIMIT 500")
OPTIONS = "options AS (" + " UNION ".join(
    f"SELECT '{field}' AS field, {column} AS value FROM facts WHERE {column} <> ''"
    for column, field in VALUE_FIELDS.items()
) + ")"
SQL["filter_options"] = on_facts(
    "SELECT field, value FROM options QUALIFY ROW_NUMBER() OVER (PARTITION BY field ORDER BY value) <= 200", OPTIONS)
SQL["filter_option_dates"] = on_facts("SELECT MIN(date) AS date_min, MAX(date) AS date_max FROM facts")

# --- Report sheets -----------------------------------------------------------------------------

_LABELLED = (
    f"labelled AS (SELECT coalesce(object_name, 'Все объекты') AS object, coalesce({MONTH}, '— — —') AS period, "
    "metric, value FROM facts WHERE source_group IN ('rchb', 'agreements', 'gz', 'buau'))"
)


def _pivot(keys: str) -> str:
    sums = ", ".join(
        f"CAST(SUM(CASE WHEN metric = '{m}' THEN value END) AS DECIMAL(20,2)) AS {m}" for m in REPORT_METRICS)
    row_total = " + ".join(f"coalesce({m}, 0)" for m in REPORT_METRICS)
    return (
        f"SELECT *, {percent('cash_payments', 'limits')} AS execution_percent, "
        f"CAST({row_total} AS DECIMAL(20,2)) AS row_total FROM (SELECT {keys}, {sums} FROM labelled GROUP BY ALL)"
    )


SQL["report_object_summary"] = on_facts(_pivot("object, period"), _LABELLED)
SQL["report_object_totals"] = on_facts(_pivot("object, 'Итого' AS period"), _LABELLED)
SQL["report_dynamics"] = on_facts(
    f"SELECT object, period, {labels('metric', METRIC_LABELS)} AS metric_label, {MONEY} AS value FROM labelled "
    "GROUP BY object, period, metric", _LABELLED)
SQL["report_detail"] = on_facts(
    f"SELECT year, month, object_name, CAST(NULL AS VARCHAR) AS kvr_code, {labels('metric', METRIC_LABELS)} "
    f"AS metric_label, {MONEY} AS value FROM facts GROUP BY year, month, object_name, metric UNION ALL "
    f"SELECT year, NULL, NULL, kvr_code, {labels('metric', METRIC_LABELS)}, {MONEY} FROM facts "
    "GROUP BY year, kvr_code, metric")
SQL["metric_labels"] = on_facts(
    f"SELECT {labels('source_group', SOURCE_GROUP_LABELS)} AS source_label, {labels('metric', METRIC_LABELS)} "
    f"AS metric_label, {MONEY} AS value FROM facts GROUP BY source_group, metric")
_REPORT_FACTS = "(SELECT * FROM facts WHERE source_group IN ('rchb', 'agreements', 'gz', 'buau'))"
_GROUP_COUNT = f"(SELECT COUNT(*) FROM (SELECT 1 FROM {_REPORT_FACTS} GROUP BY year, month, object_name, metric))"
SQL["report_parameters"] = on_facts(
    "SELECT CAST(position AS INTEGER) AS position, name, value FROM (VALUES (0, 'Отчёт', 'Бюджетная аналитика'), "
    "(1, 'Текстовый запрос', ''), (2, 'Пакет данных', 'tpch'), (3, 'Период отчёта', '— — —'), "
    "(6, 'Группировка интерфейса', 'Месяц, Объект'), (7, 'Объект', ''), (8, 'Организация', ''), (9, 'Бюджет', ''), "
    "(10, 'Текстовый поиск', ''), (11, 'КФСР', ''), (12, 'КЦСР', ''), (13, 'КВР', ''), (14, 'Источник средств', '')"
    ") AS t(position, name, value) UNION ALL "
    f"SELECT 4, 'Источники', string_agg({labels('s', SOURCE_GROUP_LABELS)}, ', ' ORDER BY s) FROM "
    f"(SELECT DISTINCT source_group AS s FROM {_REPORT_FACTS}) UNION ALL "
    f"SELECT 5, 'Показатели', string_agg({labels('m', METRIC_LABELS)}, ', ' ORDER BY m) FROM "
    f"(SELECT DISTINCT metric AS m FROM {_REPORT_FACTS}) UNION ALL "
    f"SELECT 15, 'Строк в результате', CAST({_GROUP_COUNT} AS VARCHAR) UNION ALL "
    f"SELECT 16, 'Строк в выгрузке', CAST({_GROUP_COUNT} AS VARCHAR) UNION ALL "
    f"SELECT 17, 'Исполнение, %', CAST({percent('c', 'l')} AS VARCHAR) FROM (SELECT "
    "SUM(CASE WHEN metric = 'cash_payments' THEN value END) AS c, "
    f"SUM(CASE WHEN metric = 'limits' THEN value END) AS l FROM {_REPORT_FACTS}) UNION ALL "
    f"SELECT 18, {labels('metric', METRIC_LABELS)}, CAST({MONEY} AS VARCHAR) FROM {_REPORT_FACTS} GROUP BY metric")

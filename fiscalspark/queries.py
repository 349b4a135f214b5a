"""Registered queries: each reads a driver directory and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscalspark.operators import aggregates as A, charts as C, distinct as D, report as R
from fiscalspark.operators.filters import matching
from fiscalspark.plans import analytics
from fiscalspark.plans.request import Filters, Request, grouping_columns
from fiscalspark.schema import GROUP_BY_LABELS, SUBJECT_FILTERS, TEXT_SEARCH_COLUMNS
from fiscalspark.sources import mart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BATCH = mart.BATCH


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return mart.facts(spark, sf_dir, {"batch_id", "metric", "value", *columns})


# --- Predicates --------------------------------------------------------------------------------

_FILTERS: dict[str, tuple[Request, tuple[str, ...]]] = {
    "filter_date_range": (
        Request(BATCH, date_from=date(1997, 3, 1), date_to=date(1998, 6, 30)), ("date",)),
    "filter_metrics": (Request(BATCH, metrics=("limits", "contract_payment")), ()),
    "filter_source_groups": (
        Request(BATCH, filters=Filters(source_groups=("gz", "buau"))), ("source_group",)),
    "filter_object_query": (
        Request(BATCH, filters=Filters(object_query="nation_1")), ("object_name", "budget_name")),
    "filter_budget_query": (Request(BATCH, filters=Filters(budget_query="a")), ("budget_name",)),
    "filter_organization_query": (
        Request(BATCH, filters=Filters(organization_query="supplier#00000000")), ("organization_name",)),
    "filter_text_search": (
        Request(BATCH, filters=Filters(text_search="Покажи лимиты: brand ring")),
        (*TEXT_SEARCH_COLUMNS, "raw_data")),
    "filter_exact_codes": (
        Request(BATCH, filters=Filters(kfsr_code="Brand#7", kvr_code="R", kvsr_code="F")),
        ("kfsr_code", "kvr_code", "kvsr_code")),
}


def _filtered(request: Request, columns: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = matching(_facts(spark, sf_dir, *columns), request)
        return kept.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), A.total().alias("value"))

    return run


for _name, (_request, _columns) in _FILTERS.items():
    QUERIES[_name] = _filtered(_request, _columns)


@query("filter_each_exact_field")
def filter_each_exact_field(spark, sf_dir):
    """The document, kcsr, kesr, kosgu, purpose and funding filters together on one frame each."""
    wanted = {
        "kcsr_code": "ECONOMY", "kesr_code": "11", "kosgu_code": "12", "purpose_code": "2-HIGH",
        "funding_source": "MACHINERY", "document_id": "7", "document_number": "Ф.1997.1",
    }
    parts = []
    for name, value in wanted.items():
        kept = matching(_facts(spark, sf_dir, name), Request(BATCH, filters=Filters(**{name: value})))
        parts.append(kept.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), A.total().alias("value"))
                     .select(F.lit(name).alias("field"), "metric", "n", "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- Totals and groupings ----------------------------------------------------------------------


@query("summary_by_metric")
def summary_by_metric(spark, sf_dir):
    return A.summary(_facts(spark, sf_dir))


def _grouped(group_by: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = grouping_columns(group_by).values()
        return A.grouped_rows(_facts(spark, sf_dir, *columns), group_by)

    return run


for _dim in GROUP_BY_LABELS:
    QUERIES[f"rows_by_{_dim}"] = _grouped((_dim,))
QUERIES["rows_by_month_object"] = _grouped(("month", "object_name"))


@query("rows_count")
def rows_count(spark, sf_dir):
    return A.row_count(_grouped(("month", "object_name"))(spark, sf_dir))


@query("rows_page")
def rows_page(spark, sf_dir):
    rows = _grouped(("month", "object_name"))(spark, sf_dir)
    return A.page(rows, ["year", "month", "object_name", "metric"], limit=100, offset=250)


@query("timeseries")
def timeseries(spark, sf_dir):
    return A.timeseries(_facts(spark, sf_dir, "year", "month"))


@query("by_metric")
def by_metric(spark, sf_dir):
    return A.by_metric(_facts(spark, sf_dir))


@query("batch_stats")
def batch_stats(spark, sf_dir):
    return A.batch_stats(_facts(spark, sf_dir, "date"))


@query("batch_sources")
def batch_sources(spark, sf_dir):
    return A.sources(_facts(spark, sf_dir, "source_group"))


@query("execution_percent")
def execution_percent(spark, sf_dir):
    return A.execution_percent(_facts(spark, sf_dir))


@query("execution_percent_by_object_name")
def execution_percent_by_object(spark, sf_dir):
    return A.execution_percent(_facts(spark, sf_dir, "object_name"), ("object_name",))


@query("execution_percent_by_day")
def execution_percent_by_day(spark, sf_dir):
    return A.execution_percent(_facts(spark, sf_dir, "date"), ("day",))


@query("timeseries_total")
def timeseries_total(spark, sf_dir):
    return C.timeseries_total(timeseries(spark, sf_dir))


@query("yearly_total")
def yearly_total(spark, sf_dir):
    return C.yearly_total(timeseries(spark, sf_dir))


@query("cumulative_total")
def cumulative_total(spark, sf_dir):
    return C.cumulative(timeseries(spark, sf_dir))


@query("cumulative_by_metric")
def cumulative_by_metric(spark, sf_dir):
    return C.cumulative(timeseries(spark, sf_dir), ("metric",))


@query("share_of_max")
def share_of_max(spark, sf_dir):
    shares = C.share_of_max(A.summary(_facts(spark, sf_dir)))
    return shares.select("metric", "value", F.round("share", 9).alias("share"))


@query("preview_page")
def preview_page(spark, sf_dir):
    page = analytics.preview(mart.facts(spark, sf_dir), BATCH, limit=200, offset=50)
    return page.drop("raw_data")


# --- Distinct values ---------------------------------------------------------------------------


@query("distinct_values")
def distinct_values(spark, sf_dir):
    return D.distinct_values(_facts(spark, sf_dir, "organization_name"), "organization_name", limit=50)


@query("distinct_values_search")
def distinct_values_search(spark, sf_dir):
    facts = _facts(spark, sf_dir, "document_number")
    return D.distinct_values(facts, "document_number", query="ф.1997.1", limit=500)


@query("filter_options")
def filter_options(spark, sf_dir):
    return D.filter_options(mart.facts(spark, sf_dir), limit=200).select("field", "value")


@query("filter_option_dates")
def filter_option_dates(spark, sf_dir):
    return D.date_bounds(_facts(spark, sf_dir, "date"))


# --- Report sheets -----------------------------------------------------------------------------

_REPORT = Request(
    BATCH, filters=Filters(source_groups=("rchb", "agreements", "gz", "buau")), group_by=("month", "object_name"))
_REPORT_COLUMNS = ("source_group", "year", "month", "object_name")


def _report(spark: SparkSession, sf_dir: str) -> analytics.Report:
    return analytics.run(_facts(spark, sf_dir, *_REPORT_COLUMNS), _REPORT)


@query("report_object_summary")
def report_object_summary(spark, sf_dir):
    return R.object_summary(_report(spark, sf_dir).rows, _REPORT)


@query("report_object_totals")
def report_object_totals(spark, sf_dir):
    return R.object_totals(_report(spark, sf_dir).rows, _REPORT)


@query("report_dynamics")
def report_dynamics(spark, sf_dir):
    return R.dynamics(_report(spark, sf_dir).rows, _REPORT)


@query("report_detail")
def report_detail(spark, sf_dir):
    """Details of two differently grouped reports under one set of columns."""
    facts = _facts(spark, sf_dir, "source_group", "year", "month", "object_name", "kvr_code")
    requests = [Request(BATCH, group_by=("month", "object_name")), Request(BATCH, group_by=("year", "kvr_code"))]
    return R.combine_details([R.detail(analytics.run(facts, r).rows, r) for r in requests])


@query("report_parameters")
def report_parameters(spark, sf_dir):
    return R.parameters(_REPORT, _report(spark, sf_dir).base)


@query("metric_labels")
def metric_labels(spark, sf_dir):
    from fiscalspark.functions.labels import metric_label, source_label

    sums = _facts(spark, sf_dir, "source_group").groupBy("source_group", "metric").agg(A.total().alias("value"))
    return sums.select(
        source_label(F.col("source_group")).alias("source_label"),
        metric_label(F.col("metric")).alias("metric_label"), "value",
    )


@query("facts_all_sources")
def facts_all_sources(spark, sf_dir):
    """Every fact of all four sources, one row each."""
    return mart.facts(spark, sf_dir).drop("raw_data")

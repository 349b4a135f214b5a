"""Totals, grouped rows, time series and execution percentages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.functions.periods import month_label
from fiscalspark.operators.distinct import distinct_values
from fiscalspark.plans.request import grouping_columns


def total(col: str = "value") -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("decimal(20,2)")


def summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("metric").agg(total().alias("value"))


def by_metric(facts: DataFrame) -> DataFrame:
    return summary(facts).orderBy("metric")


def grouped_rows(facts: DataFrame, group_by: Iterable[str]) -> DataFrame:
    """One row per (dimensions…, metric); ``month`` gives ``year`` and ``month``, ``day`` gives a date."""
    keys = [F.col(source).alias(name) for name, source in grouping_columns(group_by).items()]
    return facts.groupBy(*keys, "metric").agg(total().alias("value"))


def ordered(rows: DataFrame, keys: Iterable[str]) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


def page(rows: DataFrame, keys: Iterable[str], limit: int, offset: int = 0) -> DataFrame:
    """A sorted page: planned as a top-k per partition, never as a full sort of the input."""
    return rows.orderBy(*ordered(rows, keys)).offset(offset).limit(limit)


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows_count"))


def timeseries(facts: DataFrame) -> DataFrame:
    dated = facts.where(F.col("year").isNotNull() & F.col("month").isNotNull())
    return (
        dated.groupBy("year", "month", "metric")
        .agg(total().alias("value"))
        .select(month_label(F.col("year"), F.col("month")).alias("period"), "metric", "value")
    )


def ratio_percent(cash: Column, limits: Column) -> Column:
    """cash / limits in percent, half-even to two places; null without limits or without payments.

    Both sides are money (two decimals) before the division so that enough digits survive it.
    """
    limits, cash = limits.cast("decimal(20,2)"), cash.cast("decimal(20,2)")
    return F.when(limits != 0, F.bround(cash / limits * 100, 2)).cast("decimal(20,2)")


def execution_percent(facts: DataFrame, group_by: Iterable[str] = ()) -> DataFrame:
    keys = [F.col(source).alias(name) for name, source in grouping_columns(group_by).items()]
    wanted = facts.where(F.col("metric").isin("limits", "cash_payments"))

    def of(metric: str) -> Column:
        return F.sum(F.when(F.col("metric") == metric, F.col("value"))).cast("decimal(20,2)")

    sums = wanted.groupBy(*keys).agg(of("limits").alias("limits"), of("cash_payments").alias("cash_payments"))
    return sums.withColumn("execution_percent", ratio_percent(F.col("cash_payments"), F.col("limits")))


def batch_stats(facts: DataFrame) -> DataFrame:
    """First and last date and number of facts per batch."""
    return facts.groupBy("batch_id").agg(
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count(F.lit(1)).alias("rows_count")
    )


def sources(facts: DataFrame) -> DataFrame:
    return distinct_values(facts, "source_group")

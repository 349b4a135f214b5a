"""Chart series derived from the month timeseries.

Everything here starts from an aggregate with one row per month (and metric); its size depends on the
calendar span of the data, not on the number of facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fiscalspark.operators.aggregates import total


def timeseries_total(timeseries: DataFrame) -> DataFrame:
    return timeseries.groupBy("period").agg(total().alias("value"))


def yearly_total(timeseries: DataFrame) -> DataFrame:
    return timeseries.groupBy(F.substring("period", 1, 4).alias("year")).agg(total().alias("value"))


def cumulative(timeseries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Running total over periods, overall or per ``by``."""
    series = timeseries.groupBy(*by, "period").agg(total().alias("value"))
    running = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn("cumulative", F.sum("value").over(running).cast("decimal(20,2)"))


def share_of_max(totals: DataFrame) -> DataFrame:
    """Bar length of every total relative to the largest absolute one (never below 1)."""
    largest = totals.agg(F.greatest(F.max(F.abs("value")), F.lit(1)).cast("double")).scalar()
    return totals.withColumn("share", F.abs("value").cast("double") / largest)

"""Distinct values: single fields, whole filter catalogues, first/last-wins deduplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from fiscalspark.functions.text import is_usable
from fiscalspark.operators.filters import contains_ci
from fiscalspark.plans.request import RequestError
from fiscalspark.schema import VALUE_FIELDS


def distinct_values(facts: DataFrame, field: str, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Sorted distinct usable values of one field, optionally only those containing ``query``."""
    if field not in VALUE_FIELDS:
        raise RequestError(f"unknown values field: {field}")
    value = F.col(field)
    kept = facts.where(is_usable(value))
    if query:
        kept = kept.where(contains_ci(value, query))
    values = kept.select(value.alias("value")).distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


def catalogue(facts: DataFrame, fields: Sequence[str] = tuple(VALUE_FIELDS)) -> DataFrame:
    """All distinct usable (field, value) pairs in a single pass over the facts.

    Each task keeps the different pairs it meets, so what is shuffled follows the number of values, not that of their
    combinations, which may be nearly as many as the facts.
    """
    named = facts.select(*[F.col(name).alias(VALUE_FIELDS[name]) for name in fields])
    return named.unpivot([], named.columns, "field", "value").where(is_usable(F.col("value"))).distinct()


def _smallest(limit: int):
    """The first distinct values of every column of a task, as (field, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[str]] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns):
                found = pc.drop_null(pc.unique(column))
                held = best.get(name, [])
                if len(held) == limit:
                    found = found.filter(pc.less(found, held[-1]))
                if len(found):
                    best[name] = sorted({*held, *found.to_pylist()})[:limit]
        fields = [name for name, values in best.items() for _ in values]
        values = [value for values in best.values() for value in values]
        yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(values, pa.string())], ["field", "value"])
    return run


def filter_options(facts: DataFrame, limit: int | None = 200, fields: Sequence[str] = tuple(VALUE_FIELDS)) -> DataFrame:
    """The first ``limit`` values of every field.

    A task keeps the first values of each column while it reads, so at most ``limit`` values per field and task are
    shuffled, whatever the number of distinct ones; binary order is the same in both places.
    """
    if limit is None:
        return catalogue(facts, fields)
    usable = [F.when(is_usable(F.col(name)), F.col(name)).alias(VALUE_FIELDS[name]) for name in fields]
    values = facts.select(*usable).mapInArrow(_smallest(limit), "field string, value string").distinct()
    by_field = Window.partitionBy("field").orderBy("value")
    return values.withColumn("rank", F.row_number().over(by_field)).where(F.col("rank") <= limit)


def date_bounds(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def first_wins(df: DataFrame, keys: Sequence, order: Sequence[str]) -> DataFrame:
    """One whole row per key, the first in ``order``.

    An aggregate rather than a window: copies collapse inside each map task, so a key that owns a
    large share of all rows never gathers in one place. Null keys compare equal.
    """
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    grouped = df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(first.alias("_row"))
    return grouped.select("_row.*")


def last_value_wins(df: DataFrame, key: str, position: str, value: Sequence[str]) -> DataFrame:
    """One row per key: the values of its last occurrence at the position of its first."""
    return df.groupBy(key).agg(
        F.min(position).alias(position),
        *[F.max_by(v, position).alias(v) for v in value],
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key by ``order`` (all descending)."""
    newest = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")

"""Display labels for metrics, sources and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fiscalspark.schema import GROUP_BY_LABELS, METRIC_LABELS, SOURCE_GROUP_LABELS


def _lookup(labels: dict[str, str], key: Column) -> Column:
    # A constant map: Catalyst folds it into one literal, so no join is needed for a fixed vocabulary.
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def metric_label(key: Column) -> Column:
    return _lookup(METRIC_LABELS, key)


def source_label(key: Column) -> Column:
    return _lookup(SOURCE_GROUP_LABELS, key)


def dimension_title(name: str) -> str:
    return GROUP_BY_LABELS.get(name, name.replace("_", " ").title())

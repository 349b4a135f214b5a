"""Request predicates over the fact table."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalspark.functions.language import search_terms
from fiscalspark.functions.text import normalize_code
from fiscalspark.plans.request import Filters, Request
from fiscalspark.schema import EXACT_FILTERS, TEXT_SEARCH_COLUMNS

SUBSTRING_TARGETS = {
    "object_query": ("object_name", "budget_name"),
    "budget_query": ("budget_name",),
    "organization_query": ("organization_name",),
}
# Separates columns inside the search haystack; no search term can contain it.
_BREAK = "\x00"


def contains_ci(col: Column, query: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` of the query keep their LIKE meaning."""
    return col.ilike(f"%{query}%")


def haystack() -> Column:
    """All searchable text of a fact as one lower-cased string, built once per row for all terms."""
    return F.lower(F.concat_ws(_BREAK, *TEXT_SEARCH_COLUMNS, F.to_json("raw_data")))


def constant_terms(text: str) -> list[str]:
    """The subject terms of one text, worked out while planning: a local relation, so no job runs."""
    row = SparkSession.active().sql("SELECT text FROM VALUES (:text) AS t(text)", args={"text": text})
    return row.select(search_terms(F.col("text"))).collect()[0][0]


def text_search(text: str) -> Column:
    """Facts that mention every subject term of the text in any searchable column.

    The terms are literals of the plan; the haystack of a row is bound once for all of them.
    """
    terms = constant_terms(text)
    if not terms:
        return F.lit(True)
    return F.exists(F.array(haystack()), lambda h: reduce(and_, [F.contains(h, F.lit(t)) for t in terms]))


def _conditions(request: Request, normalize_codes: bool) -> list[Column]:
    filters: Filters = request.filters
    found = [F.col("batch_id") == request.batch_id]
    if request.date_from:
        found.append(F.col("date") >= F.lit(request.date_from))
    if request.date_to:
        found.append(F.col("date") <= F.lit(request.date_to))
    if request.metrics:
        found.append(F.col("metric").isin(list(request.metrics)))
    if filters.source_groups:
        found.append(F.col("source_group").isin(list(filters.source_groups)))
    for name, targets in SUBSTRING_TARGETS.items():
        query = getattr(filters, name)
        if query:
            found.append(reduce(or_, [contains_ci(F.col(t), query) for t in targets]))
    if filters.text_search:
        found.append(text_search(filters.text_search))
    for name in EXACT_FILTERS:
        value = getattr(filters, name)
        if value:
            as_code = normalize_codes and name.endswith("_code")
            found.append(F.col(name) == (normalize_code(F.lit(value)) if as_code else F.lit(value)))
    return found


def conditions(request: Request, normalize_codes: bool = False) -> Column:
    """What a fact of the request satisfies, as one condition."""
    return reduce(and_, _conditions(request, normalize_codes))


def matching(facts: DataFrame, request: Request, normalize_codes: bool = False) -> DataFrame:
    """Facts a request is about. Null columns never match a condition put on them."""
    return facts.where(conditions(request, normalize_codes))

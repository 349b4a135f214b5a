"""Declarative report requests, validated before any scan is planned."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from fiscalspark.schema import GROUP_BY_LABELS, METRICS

DEFAULT_GROUP_BY = ("month",)
MAX_PAGE = 1000


class RequestError(ValueError):
    """A request names something the fact table does not have."""


@dataclass(frozen=True)
class Filters:
    source_groups: tuple[str, ...] | None = None
    object_query: str | None = None
    budget_query: str | None = None
    organization_query: str | None = None
    text_search: str | None = None
    document_id: str | None = None
    document_number: str | None = None
    kfsr_code: str | None = None
    kcsr_code: str | None = None
    kvr_code: str | None = None
    kvsr_code: str | None = None
    kesr_code: str | None = None
    kosgu_code: str | None = None
    purpose_code: str | None = None
    funding_source: str | None = None


@dataclass(frozen=True)
class Request:
    batch_id: str
    text_query: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    metrics: tuple[str, ...] | None = None
    filters: Filters = field(default_factory=Filters)
    group_by: tuple[str, ...] = DEFAULT_GROUP_BY
    limit: int = 100
    offset: int = 0
    include_rows: bool = True
    include_charts: bool = True

    def __post_init__(self) -> None:
        unknown = [m for m in self.metrics or () if m not in METRICS]
        if unknown:
            raise RequestError(f"unknown metric(s): {', '.join(unknown)}")
        unknown = [g for g in self.group_by or () if g not in GROUP_BY_LABELS]
        if unknown:
            raise RequestError(f"unknown group_by field(s): {', '.join(unknown)}")
        if not 1 <= self.limit <= MAX_PAGE:
            raise RequestError(f"limit must be within 1..{MAX_PAGE}")
        if self.offset < 0:
            raise RequestError("offset must not be negative")
        if not self.group_by:
            object.__setattr__(self, "group_by", DEFAULT_GROUP_BY)


def grouping_columns(group_by) -> dict[str, str]:
    """Output name -> fact column for a ``group_by`` list; repeated columns collapse in order.

    ``month`` stands for the pair (year, month) and ``metric`` adds nothing, because every grouped
    row is already keyed by metric.
    """
    expansion = {
        "metric": {},
        "day": {"day": "date"},
        "month": {"year": "year", "month": "month"},
        "year": {"year": "year"},
    }
    columns: dict[str, str] = {}
    for name in group_by:
        if name not in GROUP_BY_LABELS:
            raise RequestError(f"unknown group_by field(s): {name}")
        columns.update({k: v for k, v in expansion.get(name, {name: name}).items() if k not in columns})
    return columns

"""A report request as a bundle of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from fiscalspark.operators import aggregates as A, report as R
from fiscalspark.operators.distinct import distinct_values
from fiscalspark.operators.filters import matching
from fiscalspark.plans.request import Request, grouping_columns


@dataclass(frozen=True)
class Report:
    """Every part is lazy; nothing is computed until one of them is read."""

    request: Request
    base: DataFrame
    summary: DataFrame
    execution_percent: DataFrame
    rows: DataFrame | None
    rows_count: DataFrame | None
    timeseries: DataFrame | None
    by_metric: DataFrame | None
    sources: DataFrame

    def page(self) -> DataFrame:
        keys = [*grouping_columns(self.request.group_by), "metric"]
        return A.page(self.rows, keys, self.request.limit, self.request.offset)

    def sheets(self, titles: bool = False) -> dict[str, DataFrame]:
        """The five report sheets, ordered, over all rows rather than one page; with ``titles`` under readers' titles."""
        if self.rows is None:
            raise ValueError("a report needs include_rows")
        shown = (
            R.parameters(self.request, self.base),
            R.object_summary(self.rows, self.request),
            R.object_totals(self.rows, self.request),
            R.dynamics(self.rows, self.request),
            R.detail(self.rows, self.request),
        )
        return dict(zip(R.SHEETS, map(R.titled, shown) if titles else shown))

    def release(self) -> None:
        self.base.unpersist()


def run(facts: DataFrame, request: Request, persist: bool = False, normalize_codes: bool = False) -> Report:
    """Plan a request. ``persist`` keeps the matching facts on executors when several parts are read;

    spilling to disk, so a broad request cannot exhaust memory.
    """
    base = matching(facts, request, normalize_codes)
    if persist:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    rows = A.grouped_rows(base, request.group_by) if request.include_rows else None
    return Report(
        request=request,
        base=base,
        summary=A.summary(base),
        execution_percent=A.execution_percent(base),
        rows=rows,
        rows_count=A.row_count(rows) if rows is not None else None,
        timeseries=A.timeseries(base) if request.include_charts else None,
        by_metric=A.by_metric(base) if request.include_charts else None,
        sources=distinct_values(base, "source_group"),
    )


def preview(facts: DataFrame, batch_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """First facts of a batch by date, then by where they came from and all remaining columns."""
    mine = facts.where(facts["batch_id"] == batch_id)
    rest = [c for c in mine.columns if c not in ("date", "source_file", "row_number", "metric", "raw_data")]
    return A.page(mine, ["date", "source_file", "row_number", "metric", *rest], limit, offset)

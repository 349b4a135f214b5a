"""Dates and reporting periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fiscalspark.functions.text import clean_text, fold_case

# Month-name stems in the order they are looked for.
MONTH_STEMS = {
    "январ": 1, "феврал": 2, "март": 3, "апрел": 4, "май": 5, "июн": 6,
    "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12,
}
COMPACT_DATE = r"на([0-9]{2})([0-9]{2})([0-9]{4})"


def day_text(col: Column) -> Column:
    """The part of a date cell that names the day."""
    return F.substring_index(clean_text(col), " ", 1)


def parse_day(day: Column) -> Column:
    """``dd.MM.yyyy``, ``yyyy-MM-dd`` or ``dd/MM/yyyy``; anything else is null.

    The layouts have different separators, so one parse per value is enough and failed attempts
    (an exception each inside the JVM) stay rare.
    """
    return (
        F.when(F.contains(day, F.lit(".")), F.try_to_date(day, "d.M.yyyy"))
        .when(F.contains(day, F.lit("/")), F.try_to_date(day, "d/M/yyyy"))
        .when(F.contains(day, F.lit("-")), F.try_to_date(day, "yyyy-M-d"))
    )


def parse_date(col: Column) -> Column:
    return parse_day(day_text(col))


def date_parts(date_col: Column) -> tuple[Column, Column]:
    return F.year(date_col), F.month(date_col)


def month_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"))


def period_label(day: Column, year: Column, month: Column, otherwise: Column) -> Column:
    """Finest period a row carries: day, else year-month, else year, else the request's range."""
    return F.coalesce(
        day.cast("string"),
        F.when(year.isNotNull() & month.isNotNull(), month_label(year, month)),
        year.cast("string"),
        otherwise,
    )


def range_label(date_from, date_to) -> str:
    return " — ".join(d.isoformat() if d else "—" for d in (date_from, date_to))


def _stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return fold_case(F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1"))


def file_name_date(path: Column) -> Column:
    """Period a file name states: ``наDDMMYYYY``, or a 20yy year with a month name (its first day)."""
    stem = _stem(path)
    compact = F.try_to_date(F.regexp_extract(stem, COMPACT_DATE, 0), "'на'ddMMyyyy")
    year = F.regexp_extract(stem, r"20[0-9]{2}", 0)
    month = F.coalesce(*[F.when(F.contains(stem, F.lit(s)), F.lit(m)) for s, m in MONTH_STEMS.items()])
    named = F.when((year != "") & month.isNotNull(), F.make_date(year.try_cast("int"), month, F.lit(1)))
    return F.when(stem.rlike(COMPACT_DATE), compact).otherwise(named)


def has_impossible_file_date(path: Column) -> Column:
    """True where a name spells a compact date that no calendar has, e.g. ``на99992025``."""
    return _stem(path).rlike(COMPACT_DATE) & file_name_date(path).isNull()

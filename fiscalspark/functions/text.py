"""Normalisers for messy accounting text, as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BOM = "\ufeff"


def strip(col: Column) -> Column:
    """Trim every kind of Unicode white space (``F.trim`` only knows the plain blank)."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def clean_text(col: Column) -> Column:
    return blank_to_null(strip(F.replace(col, F.lit(BOM), F.lit(""))))


def fold_case(col: Column) -> Column:
    """Lower case with ё folded to е."""
    return F.translate(F.lower(col), "ё", "е")


def search_text(col: Column) -> Column:
    return strip(fold_case(col))


def normalize_header(col: Column) -> Column:
    return F.regexp_replace(fold_case(col), "[^a-zа-я0-9]+", "")


def normalize_code(col: Column) -> Column:
    """``03.2.01.97002`` -> ``0320197002``."""
    return blank_to_null(F.translate(clean_text(col), " .", ""))


def parse_amount(col: Column) -> Column:
    """Money written with any grouping and a decimal comma or point, half-even to two places.

    The result is wider than the store's DECIMAL(20,2) so that oversized amounts stay visible to the
    quarantine check instead of silently turning into nulls.
    """
    digits = F.regexp_replace(F.translate(col, ",", "."), r"[^0-9.\-]", "")
    exact = digits.try_cast("decimal(38,10)")
    return F.bround(exact, 2).try_cast("decimal(28,2)")


def to_money(col: Column) -> Column:
    return col.try_cast("decimal(20,2)")


def has_amount(col: Column) -> Column:
    return col.isNotNull() & (col != 0)


def is_usable(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def normalize_columns(df, spec: dict[str, tuple[str, str]]):
    """Project a frame of messy strings: ``{output: (normaliser, input column)}``."""
    from fiscalspark.functions.periods import parse_date

    normalisers = {
        "text": clean_text,
        "header": normalize_header,
        "code": normalize_code,
        "amount": lambda c: to_money(parse_amount(c)),
        "date": parse_date,
        "search": search_text,
    }
    return df.select("*", *[normalisers[kind](F.col(source)).alias(name) for name, (kind, source) in spec.items()])

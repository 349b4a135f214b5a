"""Reading plain-language report questions with Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fiscalspark.functions.text import search_text

# --- Fixed values ------------------------------------------------------------------------------
# Words that carry no subject in a report question.
STOPWORDS = (
    "а", "был", "была", "были", "было", "в", "во", "выплат", "выплата", "выплаты", "где", "год", "года", "годам",
    "году", "данные", "для", "до", "за", "из", "и", "или", "источник", "источникам", "источники", "источнику",
    "итого", "как", "какая", "какие", "какой", "кассовые", "кассовых", "контракт", "контрактам", "контрактов",
    "лимит", "лимиты", "месяц", "месяцам", "на", "об", "от", "по", "покажи", "показать", "получено", "потрачен",
    "потрачено", "потраченные", "потратили", "оплат", "оплата", "платеж", "платежи", "про", "договор",
    "договоров", "обязательства", "остаток", "нибудь", "расход", "расходы", "сколько", "средств", "сумма",
    "суммарно", "суммы", "соглашений", "соглашения", "тема", "теме", "темой", "тему", "траты", "что", "это",
)

# Word endings removed by the stemmer, longer ones before the shorter ones they contain.
SUFFIXES = (
    "иями", "ями", "ами", "ого", "ему", "ыми", "ими", "ской", "скому", "ские", "ский", "ская", "ское", "его",
    "ому", "ой", "ей", "ая", "яя", "ое", "ее", "ые", "ие", "ом", "ем", "ам", "ям", "ах", "ях", "ов", "ев", "ий",
    "ый", "ую", "юю", "а", "я", "ы", "и", "у", "ю", "е", "о",
)

# Metric hints in order of precedence for a bare question.
METRIC_HINTS = {
    "cash_payments": ("кассов", "выбыти", "расход", "потра", "трат"),
    "limits": ("лимит",),
    "agreement_amount": ("соглаш",),
    "contract_amount": ("контракт", "договор"),
    "contract_payment": ("платеж", "оплат"),
    "obligations_without_bo": ("без бо",),
    "obligations": ("обязатель", "бо"),
    "remaining_limits": ("остаток лимит",),
}
# When completing an interpretation, limits are looked for before cash payments.
INTERPRETATION_ORDER = ("limits", "cash_payments")

GROUP_BY_HINTS = {
    "month": ("по месяц", "помесяч", "ежемесяч"),
    "year": ("по год", "ежегод"),
    "day": ("по дням", "по датам", "по дня"),
}
# -----------------------------------------------------------------------------------------------

WORD = "[A-Za-zА-Яа-яЁё0-9]+"
YEAR = r"(?<![\p{L}\p{N}_])(?:19[0-9]{2}|20[0-9]{2})(?![\p{L}\p{N}_])"
MIN_TERM = 3
MIN_STEM = 4


def stem(word: Column) -> Column:
    """Drop one known ending if at least four letters stay; one regex instead of a branch per ending."""
    return F.regexp_replace(word, f"^(.{{{MIN_STEM},}}?)(?:{'|'.join(SUFFIXES)})$", "$1")


def search_terms(text: Column) -> Column:
    """Distinct stemmed subject words of a text in order of appearance (ARRAY<STRING>)."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), search_text)
    subject = F.filter(
        words, lambda w: (F.length(w) >= MIN_TERM) & ~w.rlike("[0-9]") & ~w.isin(*STOPWORDS)
    )
    stems = F.filter(F.transform(subject, stem), lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(*STOPWORDS))
    return F.array_distinct(stems)


def _first_hint(text: Column, hints: dict[str, tuple[str, ...]]) -> Column:
    lowered = search_text(text)
    return F.coalesce(
        *[F.when(lowered.rlike("|".join(words)), F.lit(name)) for name, words in hints.items()]
    )


def metric_hint(text: Column) -> Column:
    return _first_hint(text, METRIC_HINTS)


def interpretation_metric_hint(text: Column) -> Column:
    order = [*INTERPRETATION_ORDER, *(m for m in METRIC_HINTS if m not in INTERPRETATION_ORDER)]
    return _first_hint(text, {m: METRIC_HINTS[m] for m in order})


def group_by_hint(text: Column) -> Column:
    return _first_hint(text, GROUP_BY_HINTS)


def single_year(text: Column) -> Column:
    """The year a text names, if it names exactly one (INT)."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({YEAR})"), 1))
    return F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("int"))


def year_range(text: Column) -> tuple[Column, Column]:
    year = single_year(text)
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))

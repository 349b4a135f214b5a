"""Data model: fact and side-table schemas, vocabularies and display labels."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)
RAW_DATA = T.MapType(T.StringType(), T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()

FACT_SCHEMA = _struct(
    ("batch_id", _S),
    ("source_group", _S),
    ("source_file", _S),
    ("row_number", _L),
    ("budget_name", _S),
    ("object_name", _S),
    ("organization_name", _S),
    ("document_number", _S),
    ("document_id", _S),
    ("date", _D),
    ("year", _I),
    ("month", _I),
    ("kfsr_code", _S),
    ("kcsr_code", _S),
    ("kvr_code", _S),
    ("kvsr_code", _S),
    ("kesr_code", _S),
    ("kosgu_code", _S),
    ("purpose_code", _S),
    ("funding_source", _S),
    ("metric", _S),
    ("value", MONEY),
    ("raw_data", RAW_DATA),
)

AGREEMENT_SCHEMA = _struct(
    ("source_file", _S), ("row_number", _L), ("document_id", _S), ("reg_number", _S), ("close_date", _D),
    ("budget_name", _S), ("recipient_name", _S), ("amount_1year", MONEY),
    ("kfsr_code", _S), ("kcsr_code", _S), ("kvr_code", _S), ("purpose_code", _S), ("raw_data", RAW_DATA),
)
CONTRACT_SCHEMA = _struct(
    ("source_file", _S), ("row_number", _L), ("con_document_id", _S), ("con_number", _S), ("con_date", _D),
    ("con_amount", MONEY), ("zakazchik_key", _S), ("raw_data", RAW_DATA),
)
CONTRACT_LINE_SCHEMA = _struct(
    ("source_file", _S), ("row_number", _L), ("con_document_id", _S), ("kfsr_code", _S), ("kcsr_code", _S),
    ("kvr_code", _S), ("kesr_code", _S), ("kvsr_code", _S), ("purpose_code", _S), ("raw_data", RAW_DATA),
)
PAYMENT_SCHEMA = _struct(
    ("source_file", _S), ("row_number", _L), ("con_document_id", _S), ("platezhka_key", _S),
    ("platezhka_num", _S), ("platezhka_paydate", _D), ("platezhka_amount", MONEY), ("raw_data", RAW_DATA),
)
INSTITUTION_PAYMENT_SCHEMA = _struct(
    ("source_file", _S), ("row_number", _L), ("budget_name", _S), ("date", _D), ("organization_name", _S),
    ("grantor_name", _S), ("kfsr_code", _S), ("kcsr_code", _S), ("kvr_code", _S), ("kosgu_code", _S),
    ("subsidy_code", _S), ("amount_with_refund", MONEY), ("amount_execution", MONEY),
    ("amount_recovery", MONEY), ("raw_data", RAW_DATA),
)

# --- Fixed values: vocabularies and their display labels ---------------------------------------

METRIC_LABELS = {
    "limits": "Лимиты",
    "obligations": "Подтв. лимитов по БО",
    "obligations_without_bo": "Подтв. лимитов без БО",
    "remaining_limits": "Остаток лимитов",
    "cash_payments": "Кассовые выплаты",
    "agreement_amount": "Сумма соглашений",
    "contract_amount": "Сумма контрактов",
    "contract_payment": "Платежи по контрактам",
    "institution_payments_with_refund": "Выплаты БУАУ с учетом возврата",
    "institution_payments_execution": "Выплаты БУАУ - исполнение",
    "institution_payments_recovery": "Восстановление выплат БУАУ",
}

SOURCE_GROUP_LABELS = {
    "rchb": "РЧБ",
    "agreements": "Соглашения",
    "gz": "Госзаказ",
    "buau": "БУАУ",
}

GROUP_BY_LABELS = {
    "day": "День",
    "month": "Месяц",
    "year": "Год",
    "budget_name": "Бюджет",
    "object_name": "Объект",
    "organization_name": "Организация",
    "source_group": "Источник",
    "metric": "Показатель",
    "kfsr_code": "КФСР",
    "kcsr_code": "КЦСР",
    "kvr_code": "КВР",
    "kvsr_code": "КВСР",
    "kesr_code": "КОСГУ/КЭСР",
    "kosgu_code": "КОСГУ",
    "purpose_code": "Код цели",
    "funding_source": "Источник средств",
}

METRICS = tuple(METRIC_LABELS)

# Filters compared with ``=``; every other scalar filter is a substring search.
EXACT_FILTERS = (
    "document_id", "document_number", "kfsr_code", "kcsr_code", "kvr_code", "kvsr_code",
    "kesr_code", "kosgu_code", "purpose_code", "funding_source",
)
SUBSTRING_FILTERS = ("object_query", "budget_query", "organization_query")
SUBJECT_FILTERS = (*SUBSTRING_FILTERS, "text_search", *EXACT_FILTERS)

# Fact columns whose distinct values can be listed, and the catalogue name of each.
VALUE_FIELDS = {
    "metric": "metrics",
    "source_group": "source_groups",
    "organization_name": "organizations",
    "object_name": "objects",
    "budget_name": "budgets",
    "kfsr_code": "kfsr_codes",
    "kcsr_code": "kcsr_codes",
    "kvr_code": "kvr_codes",
    "kvsr_code": "kvsr_codes",
    "kesr_code": "kesr_codes",
    "kosgu_code": "kosgu_codes",
    "purpose_code": "purpose_codes",
    "funding_source": "funding_sources",
    "document_number": "document_numbers",
    "document_id": "document_ids",
}

# Columns a free-text search looks into; ``raw_data`` is searched as JSON text.
TEXT_SEARCH_COLUMNS = (
    "object_name", "budget_name", "organization_name", "funding_source", "document_number",
    "document_id", "kfsr_code", "kcsr_code", "kvr_code", "kvsr_code", "kesr_code", "kosgu_code",
    "purpose_code", "source_file",
)

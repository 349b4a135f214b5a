"""Source records -> normalised entries -> facts and typed tables.

Which cell holds what is settled once per file (``place_columns``), so the work per record is plain
array indexing plus the normalisers. One pass produces *entries*; facts and the five typed tables are
projections of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.functions.periods import date_parts, day_text, file_name_date, has_impossible_file_date, parse_day
from fiscalspark.functions.text import (
    BOM, WHITESPACE, clean_text, fold_case, has_amount, normalize_code, normalize_header, parse_amount, to_money,
)
from fiscalspark.schema import (
    AGREEMENT_SCHEMA, CONTRACT_LINE_SCHEMA, CONTRACT_SCHEMA, FACT_SCHEMA, INSTITUTION_PAYMENT_SCHEMA,
    PAYMENT_SCHEMA,
)
from fiscalspark.sources.csv_tasks import header_key

# --- Fixed values: headers of the four accounting exports ---------------------------------------
# Entry field -> header, per kind of file.
COLUMNS = {
    "rchb": {
        "budget_name": "Бюджет", "organization_name": "Наименование КВСР", "date": "Дата проводки",
        "kfsr_code": "КФСР", "kcsr_code": "КЦСР", "kvr_code": "КВР", "kvsr_code": "КВСР",
        "kesr_code": "КОСГУ", "kosgu_code": "КОСГУ", "purpose_code": "Код цели",
        "funding_source": "Источник средств",
    },
    "agreement": {
        "budget_name": "caption", "organization_name": "dd_recipient_caption", "date": "close_date",
        "document_number": "reg_number", "document_id": "document_id", "kfsr_code": "kfsr_code",
        "kcsr_code": "kcsr_code", "kvr_code": "kvr_code", "purpose_code": "dd_purposefulgrant_code",
    },
    "contract": {
        "organization_name": "zakazchik_key", "date": "con_date", "document_number": "con_number",
        "document_id": "con_document_id",
    },
    "contract_line": {
        "document_id": "con_document_id", "kfsr_code": "kfsr_code", "kcsr_code": "kcsr_code",
        "kvr_code": "kvr_code", "kesr_code": "kesr_code", "kvsr_code": "kvsr_code",
        "purpose_code": "purposefulgrant",
    },
    "payment": {
        "date": "platezhka_paydate", "document_number": "platezhka_num", "document_id": "con_document_id",
        "other_party": "platezhka_key",
    },
    "institution": {
        "budget_name": "Бюджет", "organization_name": "Организация", "date": "Дата проводки",
        "other_party": "Орган, предоставляющий субсидии", "kfsr_code": "КФСР", "kcsr_code": "КЦСР",
        "kvr_code": "КВР", "kosgu_code": "КОСГУ", "purpose_code": "Код субсидии",
    },
}
# Metric -> whole header, per kind.
AMOUNT_COLUMNS = {
    "agreement": {"agreement_amount": "amount_1year"},
    "contract": {"contract_amount": "con_amount"},
    "payment": {"contract_payment": "platezhka_amount"},
}
# Metric -> part of a header (such headers carry a year), per kind.
AMOUNT_PARTS = {
    "rchb": {
        "limits": "лимиты пбс",
        "obligations": "подтв лимитов по бо",
        "obligations_without_bo": "подтв лимитов без бо",
        "remaining_limits": "остаток лимитов",
        "cash_payments": "всего выбытий",
    },
    "institution": {
        "institution_payments_with_refund": "выплаты с учетом возврата",
        "institution_payments_execution": "выплаты исполнение",
        "institution_payments_recovery": "выплаты восстановление",
    },
}
# Words of the whole path that tell the contract exports apart, in this order.
CONTRACT_FILE_WORDS = {
    "contract": ("контракт", "договор"), "contract_line": ("бюджетные",), "payment": ("платеж",),
}
TOTAL_ROW_WORDS = ("итого", "всего")
# -----------------------------------------------------------------------------------------------

TEXT_FIELDS = ("budget_name", "organization_name", "other_party", "document_number", "document_id", "funding_source")
CODE_FIELDS = ("kfsr_code", "kcsr_code", "kvr_code", "kvsr_code", "kesr_code", "kosgu_code", "purpose_code")
FIELDS = (*TEXT_FIELDS, *CODE_FIELDS, "date")
MAX_MONEY = 10**18
MAX_AMOUNTS = max(len(places) for places in (*AMOUNT_COLUMNS.values(), *AMOUNT_PARTS.values()))
CELL_BREAK = "\x1d"  # ends a physical line, so no cell contains it


def file_kind(group: Column, path: Column) -> Column:
    """Which normaliser a file needs; null for files that are only kept as raw rows."""
    lowered = fold_case(path)
    direct = {"rchb": "rchb", "agreements": "agreement", "buau": "institution"}
    by_group = [F.when(group == g, F.lit(kind)) for g, kind in direct.items()]
    by_word = [
        F.when((group == "gz") & lowered.rlike("|".join(words)), F.lit(kind))
        for kind, words in CONTRACT_FILE_WORDS.items()
    ]
    return F.coalesce(*by_group, *by_word)


def _layout(headers: Column) -> Column:
    """Distinct headers in order of first appearance, each with the position of its last one."""
    backwards = F.reverse(headers)
    return F.transform(
        F.array_distinct(headers),
        lambda h: F.struct(
            h.alias("header"), normalize_header(h).alias("key"),
            (F.size(headers) - F.array_position(backwards, h)).cast("int").alias("at"),
        ),
    )


def _named(layout: Column, header: str) -> Column:
    return F.try_element_at(F.filter(layout, lambda x: x["key"] == header_key(header)), F.lit(-1))["at"]


def _containing(layout: Column, part: str) -> Column:
    return F.try_element_at(F.filter(layout, lambda x: F.contains(x["key"], F.lit(header_key(part)))), F.lit(1))["at"]


def place_columns(profiles: DataFrame) -> DataFrame:
    """One row per file: its kind and the cell index of every field and amount."""
    files = profiles.select(
        "path", "source_group", file_kind(F.col("source_group"), F.col("path")).alias("kind"),
        _layout(F.col("headers")).alias("layout"), F.col("headers").alias("all_headers"),
    )
    layout, kind = F.col("layout"), F.col("kind")

    def position(field: str) -> Column:
        found = [F.when(kind == k, _named(layout, names[field])) for k, names in COLUMNS.items() if field in names]
        return F.coalesce(*found).alias(field)

    def amounts(k: str) -> Column:
        places = {m: _named(layout, h) for m, h in AMOUNT_COLUMNS.get(k, {}).items()}
        places.update({m: _containing(layout, p) for m, p in AMOUNT_PARTS.get(k, {}).items()})
        return F.array(*[F.struct(F.lit(m).alias("metric"), at.alias("at")) for m, at in places.items()])

    with_amounts = [F.when(kind == k, amounts(k)) for k in {**AMOUNT_COLUMNS, **AMOUNT_PARTS}]
    is_agreement = kind == "agreement"
    return files.select(
        "path", "source_group", "kind",
        F.struct(*[position(f) for f in FIELDS]).alias("place"),
        F.coalesce(*with_amounts).alias("amount_places"),
        F.col("layout.header").alias("headers"), F.col("layout.at").alias("cell_places"),
        (F.size("layout") == F.size("all_headers")).alias("plain_headers"),
        F.when(is_agreement, file_name_date(F.col("path"))).alias("file_date"),
        F.coalesce(is_agreement & has_impossible_file_date(F.col("path")), F.lit(False)).alias("bad_file_date"),
    )


def _violation() -> Column:
    """Why the store would refuse a record, which then fails its whole file."""
    needs_document = F.col("kind").isin("contract", "contract_line") & F.col("document_id").isNull()
    largest = F.greatest(*[F.abs(F.get("amounts", F.lit(i))["value"]) for i in range(MAX_AMOUNTS)])
    undated = F.col("bad_file_date") & F.col("own_date").isNull()
    return F.coalesce(
        F.when(needs_document, F.lit("con_document_id is missing")),
        F.when(largest >= MAX_MONEY, F.lit("amount does not fit DECIMAL(20,2)")),
        F.when(undated, F.lit("impossible date in the file name")),
    )


def _record_values() -> Column:
    """Cells in header order, padded and cut to the header.

    Only files with repeated headers need a lookup per cell; plain ones take the cells as they are.
    """
    width = F.size("headers")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    looked_up = F.transform("cell_places", lambda at: F.coalesce(F.get("cells", at), F.lit("")))
    return F.when(F.col("plain_headers"), padded).otherwise(looked_up)


def entries(records: DataFrame, placed: DataFrame) -> DataFrame:
    """Normalised entries of all kinds; blank rows and total rows are dropped.

    ``records`` is ``(path, row_number, cells)``. The per-file side holds one row per file and is
    broadcast: its size is estimated from the aggregate over all records, so without the hint Spark
    may broadcast the records instead, through the driver and whole into every task, or shuffle them
    by path, which puts a whole file into one task. The projections are staged so that no cell is
    cleaned twice.
    """
    present = records.where(F.ltrim(F.array_join("cells", ""), F.lit(WHITESPACE)) != "")
    joined = present.join(F.broadcast(placed), "path").withColumn("values", _record_values())

    first_value = F.substring_index(
        F.ltrim(F.array_join("values", CELL_BREAK), F.lit(WHITESPACE + BOM + CELL_BREAK)), CELL_BREAK, 1)
    is_total = F.coalesce(F.lower(clean_text(first_value)).isin(*TOTAL_ROW_WORDS), F.lit(False))

    def cell(at: Column) -> Column:
        return F.get("cells", at)

    def field(name: str) -> Column:
        value = cell(F.col(f"place.{name}"))
        return (normalize_code(value) if name in CODE_FIELDS else clean_text(value)).alias(name)

    def amount(i: int) -> Column:
        at = F.get("amount_places", F.lit(i))
        return F.struct(at["metric"].alias("metric"), parse_amount(cell(at["at"])).alias("value"))

    amounts = F.slice(F.array(*[amount(i) for i in range(MAX_AMOUNTS)]), F.lit(1), F.size("amount_places"))
    return (
        joined.where(~is_total)
        .select(
            F.col("path").alias("source_file"), "row_number", "source_group", "kind", "file_date", "bad_file_date",
            *[field(f) for f in FIELDS if f != "date"],
            day_text(cell(F.col("place.date"))).alias("day"),
            F.when(F.col("amount_places").isNotNull(), amounts).alias("amounts"),
            F.map_from_arrays("headers", "values").alias("raw_data"),
        )
        .withColumn("own_date", parse_day(F.col("day")))
        .withColumn("violation", _violation())
        .withColumn("date", F.coalesce("own_date", "file_date"))
        .drop("day", "own_date", "file_date", "bad_file_date")
    )


def normalized_rows() -> Column:
    """How many rows an entry adds to the facts and the typed tables."""
    facts = F.size(F.filter(F.coalesce("amounts", F.array()), lambda a: has_amount(a["value"])))
    return facts + F.coalesce(F.col("kind").isin(*TYPED_TABLES.values()), F.lit(False)).cast("int")


def raw_rows(entry: DataFrame) -> DataFrame:
    return entry.select("source_file", "row_number", F.col("raw_data").alias("data"))


def facts(entry: DataFrame, batch_id: str) -> DataFrame:
    """One row per record and metric with a non-zero amount."""
    kind = F.col("kind")
    organization, budget = F.col("organization_name"), F.col("budget_name")
    object_name = (
        F.when(kind.isin("rchb", "institution"), budget)
        .when(kind == "agreement", F.coalesce(organization, budget))
        .when(kind == "contract", organization)
    )
    year, month = date_parts(F.col("date"))
    derived = {
        "batch_id": F.lit(batch_id), "object_name": object_name, "year": year, "month": month,
        "metric": F.col("amount.metric"), "value": to_money(F.col("amount.value")),
    }
    # Not a filter: it would be pushed below entries that are not kept, and the kind worked out from the path of every record.
    counted = F.when(kind.isNotNull() & (kind != "contract_line"), F.col("amounts"))
    exploded = entry.withColumn("amount", F.explode(counted))
    return exploded.where(has_amount(F.col("amount.value"))).select(
        *[derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA]
    )


_RENAMED = {
    "agreement": (AGREEMENT_SCHEMA, {
        "reg_number": "document_number", "close_date": "date", "recipient_name": "organization_name",
        "amount_1year": 0}),
    "contract": (CONTRACT_SCHEMA, {
        "con_document_id": "document_id", "con_number": "document_number", "con_date": "date",
        "con_amount": 0, "zakazchik_key": "organization_name"}),
    "contract_line": (CONTRACT_LINE_SCHEMA, {"con_document_id": "document_id"}),
    "payment": (PAYMENT_SCHEMA, {
        "con_document_id": "document_id", "platezhka_key": "other_party", "platezhka_num": "document_number",
        "platezhka_paydate": "date", "platezhka_amount": 0}),
    "institution": (INSTITUTION_PAYMENT_SCHEMA, {
        "grantor_name": "other_party", "subsidy_code": "purpose_code", "amount_with_refund": 0,
        "amount_execution": 1, "amount_recovery": 2}),
}
TYPED_TABLES = {
    "agreements": "agreement", "contracts": "contract", "contract_budget_lines": "contract_line",
    "payments": "payment", "institution_payments": "institution",
}


def typed(entry: DataFrame, table: str) -> DataFrame:
    """One of the five detail tables."""
    kind = TYPED_TABLES[table]
    schema, sources = _RENAMED[kind]

    def column(name: str) -> Column:
        source = sources.get(name, name)
        return to_money(F.get("amounts", F.lit(source))["value"]) if isinstance(source, int) else F.col(source)

    return entry.where(F.col("kind") == kind).select(*[column(f.name).alias(f.name) for f in schema])

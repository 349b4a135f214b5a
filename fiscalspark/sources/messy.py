"""Driver tables dressed up as accounting exports: grouped amounts, dotted codes, three date layouts.

Gives the record normalisers inputs that grow with the tables and whose clean values are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalspark.sources.mart import LINE_METRICS, dealt, table
from fiscalspark.sources.tree import source_group

RCHB_HEADERS = (
    "Бюджет", "Дата проводки", "КФСР", "КЦСР", "КВР", "КВСР", "Наименование КВСР", "КОСГУ", "Код цели",
    "Источник средств", "Лимиты ПБС 2025 год", "Подтв. лимитов по БО 2025 год", "Подтв. лимитов без БО 2025 год",
    "Остаток лимитов 2025 год", "Всего выбытий (бух.уч.)",
)
AGREEMENT_HEADERS = (
    "caption", "document_id", "close_date", "reg_number", "amount_1year", "dd_recipient_caption", "kfsr_code",
    "kcsr_code", "kvr_code", "dd_purposefulgrant_code",
)
CONTRACT_HEADERS = ("con_document_id", "con_number", "con_date", "con_amount", "zakazchik_key")
LINE_HEADERS = (
    "con_document_id", "kfsr_code", "kcsr_code", "kvr_code", "kesr_code", "kvsr_code", "purposefulgrant")
PAYMENT_HEADERS = ("con_document_id", "platezhka_paydate", "platezhka_key", "platezhka_num", "platezhka_amount")
BUAU_HEADERS = (
    "Бюджет", "Дата проводки", "КФСР", "КЦСР", "КВР", "КОСГУ", "Код субсидии", "Организация",
    "Орган, предоставляющий субсидии", "Выплаты с учетом возврата", "Выплаты - Исполнение",
    "Выплаты - Восстановление выплат - год",
)


def messy_amount(value: Column) -> Column:
    """``1 234,56`` with a no-break space between groups; null stays blank."""
    return F.coalesce(F.translate(F.format_number(value.cast("decimal(20,2)"), 2), ",.", "\xa0,"), F.lit(""))


def messy_date(value: Column, key: Column) -> Column:
    layouts = {0: "dd.MM.yyyy", 1: "yyyy-MM-dd 00:00:00.000", 2: "dd/MM/yyyy"}
    return F.coalesce(*[F.when(key % 3 == i, F.date_format(value, f)) for i, f in layouts.items()], F.lit(""))


def _records(df: DataFrame, path: Column, row_number: Column, cells: list[Column]) -> DataFrame:
    text = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    return df.select(path.alias("path"), row_number.cast("long").alias("row_number"), text.alias("cells"))


def _files(records: DataFrame, headers: tuple[str, ...]) -> DataFrame:
    """Profiles as the file reader would give them: one row per path."""
    return records.groupBy("path").agg(F.count(F.lit(1)).alias("rows_count")).select(
        "path", source_group(F.col("path")).alias("source_group"),
        F.array(*[F.lit(h) for h in headers]).alias("headers"), "rows_count",
    )


def line_amounts() -> dict[str, Column]:
    price, discount, tax = (F.col(c).cast("decimal(20,2)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    obligations = F.round(price * (1 - discount), 2)
    paid = F.when(F.col("l_linestatus") == "F", obligations)
    return dict(zip(LINE_METRICS, (price, obligations, F.round(price * discount, 2), F.round(price * tax, 2), paid)))


def rchb_cells() -> list[Column]:
    date = F.col("l_shipdate").cast("date")
    return [
        F.concat(F.lit("  Бюджет "), F.col("l_suppkey"), F.lit("\xa0")), messy_date(date, F.col("l_orderkey")),
        F.format_string("05.%02d", "l_linenumber"), F.format_string("03.2.%d", "l_partkey"), F.col("l_returnflag"),
        F.lit("0 0 2"), F.concat(F.lit("\ufeffОрган "), F.col("l_linestatus")), F.lit("2.4.1"), F.lit(" . "),
        F.lit("Региональные средства"), *[messy_amount(v) for v in line_amounts().values()],
    ]


def rchb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    path = F.concat(F.lit("1. РЧБ/"), F.col("l_returnflag"), F.lit(".csv"))
    records = _records(lines, path, F.expr("l_orderkey * 10 + l_linenumber"), rchb_cells())
    return records, _files(records, RCHB_HEADERS)


def agreements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two monthly snapshots of the same agreements; every tenth has no close date of its own."""
    key = F.col("c_custkey")
    close = F.when(key % 10 != 0, F.expr("date_add(DATE'1998-01-01', CAST(c_custkey % 700 AS INT))"))
    cells = [
        F.lit("Областной бюджет"), key, messy_date(close, key), F.concat(F.lit("R-"), key),
        messy_amount(F.col("c_acctbal")), F.when(key % 7 != 0, F.col("c_name")), F.lit("04.07"),
        F.col("c_nationkey"), F.lit("6 1 1"), F.col("c_mktsegment"),
    ]
    customers = table(spark, sf_dir, "customer").withColumn(
        "snapshot", F.explode(F.array(F.lit("на01022026"), F.lit("на01032026"))))
    path = F.concat(F.lit("2. Соглашения/"), F.col("snapshot"), F.lit(".csv"))
    records = _records(customers, path, key, cells)
    return records, _files(records, AGREEMENT_HEADERS)


def contracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files by priority; those of priority 5-LOW miss a document id now and then and fail."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    document = F.when((priority != "5-LOW") | (key % 100 != 0), key)
    cells = [document, F.concat(F.lit("К-"), key), messy_date(F.col("o_orderdate"), key),
             messy_amount(F.col("o_totalprice")), F.col("o_custkey")]
    path = F.concat(F.lit("3. ГЗ/Контракты "), priority, F.lit(".csv"))
    records = _records(table(spark, sf_dir, "orders"), path, key, cells)
    return records, _files(records, CONTRACT_HEADERS)


def contract_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = [
        F.col("l_orderkey"), F.format_string("05.%02d", "l_linenumber"), F.format_string("01.%d", "l_partkey"),
        F.col("l_returnflag"), F.lit("2.2.5"), F.lit("002"), F.lit(""),
    ]
    path = F.lit("3. ГЗ/Бюджетные строки.csv")
    records = _records(
        dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"), path, F.expr("l_orderkey * 10 + l_linenumber"), cells)
    return records, _files(records, LINE_HEADERS)


def payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    cells = [key, messy_date(F.col("o_orderdate"), key), F.concat(F.lit("key"), key), F.concat(F.lit("№ "), key),
             messy_amount(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")))]
    records = _records(table(spark, sf_dir, "orders"), F.lit("3. ГЗ/Платежки.csv"), key, cells)
    return records, _files(records, PAYMENT_HEADERS)


def buau(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Some rows are totals and some are blank, as in real exports."""
    key, kind = F.col("event_id"), F.col("event_type")
    amount = F.col("value")
    is_total, is_blank = key % 50 == 0, key % 50 == 1
    cells = [
        F.when(is_total, "Итого").otherwise("Областной бюджет"), messy_date(F.col("ts"), key), F.lit("07.02"),
        F.lit("01.1"), F.lit("6.1.1"), F.lit("2.4.1"), F.get_json_object("props", "$.k"),
        F.concat(F.lit("Организация "), F.col("user_id")), kind, messy_amount(amount),
        messy_amount(F.when(kind == "purchase", amount).otherwise(F.lit(0))),
        messy_amount(F.when(kind == "error", amount)),
    ]
    path = F.concat(F.lit("4. Выгрузка БУАУ/"), kind, F.lit(".csv"))
    records = _records(
        table(spark, sf_dir, "events"), path, key, [F.when(~is_blank, c) for c in cells])
    return records, _files(records, BUAU_HEADERS)


ALL = {
    "rchb": rchb, "agreements": agreements, "contracts": contracts, "contract_lines": contract_lines,
    "payments": payments, "buau": buau,
}


def everything(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = profiles = None
    for make in ALL.values():
        r, p = make(spark, sf_dir)
        records, profiles = (r, p) if records is None else (records.unionByName(r), profiles.unionByName(p))
    return records, profiles

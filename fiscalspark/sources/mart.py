"""Fact mart over a star schema of orders, line items, customers and events.

Maps trade tables onto the fact schema so that every report can run on them: line items play the
budget ledger, orders the contracts, customers the agreements, events the institution payments.
Only the dimension tables a caller's columns need are joined: dimensions are keyed by their primary
key and joined LEFT, so leaving one out never changes the number of fact rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalspark.schema import FACT_SCHEMA

FACT_COLUMNS = tuple(FACT_SCHEMA.fieldNames())
BATCH = "tpch"

LINE_METRICS = ("limits", "obligations", "obligations_without_bo", "remaining_limits", "cash_payments")
CONTRACT_METRICS = ("contract_amount", "contract_payment")
EVENT_METRICS = (
    "institution_payments_with_refund", "institution_payments_execution", "institution_payments_recovery",
)
GROUP_METRICS = {
    "rchb": LINE_METRICS, "gz": CONTRACT_METRICS, "agreements": ("agreement_amount",), "buau": EVENT_METRICS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks by a key, whatever the size: for heavy work per row on files that cannot be split.

    With a stated number of partitions, as adaptive execution would put few bytes into one task however heavy their work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def money(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(20,2)")


def rounded(col: Column) -> Column:
    return F.round(col, 2).cast("decimal(20,2)")


def _with_calendar(columns: dict[str, Column], date: Column) -> dict[str, Column]:
    return {**columns, "date": date, "year": F.year(date), "month": F.month(date)}


def _shape(df: DataFrame, group: str, given: dict[str, Column], metrics: dict[str, Column],
           columns: tuple[str, ...]) -> DataFrame:
    types = {f.name: f.dataType for f in FACT_SCHEMA}
    constants = {"batch_id": F.lit(BATCH), "source_group": F.lit(group)}
    ids = [c for c in columns if c not in ("metric", "value")]
    wide = df.select(
        *[{**constants, **given}.get(c, F.lit(None)).cast(types[c]).alias(c) for c in ids],
        *[expr.alias(name) for name, expr in metrics.items()],
    )
    long = wide.unpivot(ids, list(metrics), "metric", "value").where(F.col("value") != 0)
    return long.select(*columns)


def _rchb(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    need = set(columns)
    df = table(spark, sf_dir, "lineitem")
    of_customer = need & {"object_name", "budget_name", "funding_source"}
    if of_customer or need & {"purpose_code"}:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if of_customer:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if need & {"object_name", "budget_name"}:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "budget_name" in need:
        df = df.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    if need & {"kfsr_code", "kcsr_code", "kesr_code", "kosgu_code", "raw_data"}:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "organization_name" in need:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")

    given = _with_calendar(
        {
            "source_file": F.lit("lineitem"),
            "row_number": F.expr("l_orderkey * 10 + l_linenumber"),
            "budget_name": F.expr("r_name"),
            "object_name": F.expr("n_name"),
            "organization_name": F.expr("s_name"),
            "kfsr_code": F.expr("p_brand"),
            "kcsr_code": F.expr("p_type"),
            "kvr_code": F.expr("l_returnflag"),
            "kvsr_code": F.expr("l_linestatus"),
            "kesr_code": F.expr("p_size"),
            "kosgu_code": F.expr("p_size"),
            "purpose_code": F.expr("o_orderpriority"),
            "funding_source": F.expr("c_mktsegment"),
            "raw_data": F.expr("map('part', p_name)"),
        },
        F.col("l_shipdate").cast("date"),
    )
    price, discount, tax = (
        money("l_extendedprice"), F.col("l_discount").cast("decimal(3,2)"), F.col("l_tax").cast("decimal(3,2)")
    )
    obligations = rounded(price * (F.lit(1) - discount))
    metrics = dict(zip(LINE_METRICS, (
        price, obligations, rounded(price * discount), rounded(price * tax),
        F.when(F.col("l_linestatus") == "F", obligations),
    )))
    return _shape(df, "rchb", given, metrics, columns)


def _gz(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """A payment has neither object nor organization, so the two metrics come from separate branches."""
    df = table(spark, sf_dir, "orders")
    if set(columns) & {"object_name", "organization_name"}:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    date = F.col("o_orderdate").cast("date")
    given = _with_calendar(
        {
            "source_file": F.lit("orders"),
            "row_number": F.expr("o_orderkey"),
            "document_number": F.concat(F.lit("Ф."), F.year(date), F.lit("."), F.col("o_orderkey")),
            "document_id": F.expr("o_orderkey"),
            "raw_data": F.expr("map('priority', o_orderpriority)"),
        },
        date,
    )
    owner = {"object_name": F.expr("c_name"), "organization_name": F.expr("c_name")}
    amount = money("o_totalprice")
    contracts = _shape(df, "gz", {**given, **owner}, {"contract_amount": amount}, columns)
    paid = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return contracts.unionByName(_shape(paid, "gz", given, {"contract_payment": amount}, columns))


def _agreements(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    if "budget_name" in columns:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
    date = F.expr(
        "CASE WHEN c_custkey % 10 <> 0 THEN date_add(DATE'1998-01-01', CAST(c_custkey % 700 AS INT)) END"
    )
    given = _with_calendar(
        {
            "source_file": F.lit("customer"),
            "row_number": F.expr("c_custkey"),
            "budget_name": F.expr("r_name"),
            "object_name": F.expr("c_name"),
            "organization_name": F.expr("c_name"),
            "document_id": F.expr("c_custkey"),
            "raw_data": F.expr("map('segment', c_mktsegment)"),
        },
        date,
    )
    return _shape(df, "agreements", given, {"agreement_amount": money("c_acctbal")}, columns)


def _buau(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    given = _with_calendar(
        {
            "source_file": F.lit("events"),
            "row_number": F.expr("event_id"),
            "budget_name": F.lit("Events"),
            "object_name": F.expr("event_type"),
            "organization_name": F.concat(F.lit("User "), F.col("user_id")),
            "kfsr_code": F.expr("event_type"),
            "purpose_code": F.get_json_object("props", "$.k"),
            "raw_data": F.expr("map('type', event_type)"),
        },
        F.col("ts").cast("date"),
    )
    amount, kind = money("value"), F.col("event_type")
    metrics = dict(zip(EVENT_METRICS, (
        amount, F.when(kind == "purchase", amount), F.when(kind == "error", amount),
    )))
    return _shape(table(spark, sf_dir, "events"), "buau", given, metrics, columns)


_BUILDERS = {"rchb": _rchb, "gz": _gz, "agreements": _agreements, "buau": _buau}


def facts(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None,
          groups: Iterable[str] = tuple(_BUILDERS)) -> DataFrame:
    """The fact table of a driver directory; ``columns``/``groups`` bound what has to be joined."""
    wanted = FACT_COLUMNS if columns is None else tuple(c for c in FACT_COLUMNS if c in set(columns))
    return reduce(DataFrame.unionByName, [_BUILDERS[g](spark, sf_dir, wanted) for g in groups])

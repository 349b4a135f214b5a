"""Registered queries for normalisers, record mappings and import bookkeeping."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.functions import periods as P, text as X
from fiscalspark.operators import bookkeeping as B, distinct as D, quarantine as Q, records as N
from fiscalspark.operators.aggregates import total
from fiscalspark.plans.ingest import count_rows, ingest_folder, materialize, normalize
from fiscalspark.queries import query
from fiscalspark.session import ensure_checkpoint_dir
from fiscalspark.sources import messy, tree
from fiscalspark.sources.mart import dealt, table


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")

# --- Scalar normalisers over messy text --------------------------------------------------------


@query("norm_clean_text")
def norm_clean_text(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, F.concat(F.lit("﻿\xa0 "), F.col("o_orderpriority"), F.lit(" \t"))) \
        .when(key % 4 == 1, F.lit(" \xa0\n")).otherwise(F.col("o_orderpriority"))
    texts = table(spark, sf_dir, "orders").select(text.alias("raw"))
    return X.normalize_columns(texts, {"cleaned": ("text", "raw")}).groupBy("cleaned").agg(_count())


@query("norm_header")
def norm_header(spark, sf_dir):
    raw = F.concat(F.lit("﻿Ёлка, "), F.upper("p_name"), F.lit(" (по БО) "), F.col("p_size"), F.lit(" год"))
    headers = table(spark, sf_dir, "part").select(raw.alias("raw"))
    return X.normalize_columns(headers, {"header": ("header", "raw")}).groupBy("header").agg(_count())


@query("norm_code")
def norm_code(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 1, F.lit(" . ")).otherwise(F.format_string(" 03.2. %d", "l_partkey"))
    codes = table(spark, sf_dir, "lineitem").select(raw.alias("raw"))
    return X.normalize_columns(codes, {"code": ("code", "raw")}).groupBy("code").agg(_count())


@query("norm_search_text")
def norm_search_text(spark, sf_dir):
    raw = F.concat(F.lit("\xa0ЁЖ "), F.col("c_mktsegment"), F.lit(" Ёё "))
    return X.normalize_columns(
        table(spark, sf_dir, "customer").select(raw.alias("raw")), {"text": ("search", "raw")}
    ).groupBy("text").agg(_count())


@query("parse_amount")
def parse_amount(spark, sf_dir):
    key = F.col("l_orderkey")
    amount = messy.messy_amount(F.col("l_extendedprice"))
    raw = F.when(key % 11 == 0, F.lit("1.2.3")).when(key % 11 == 1, F.lit("12-34")).when(key % 11 == 2, F.lit("-."))
    raw = raw.when(key % 11 == 3, F.concat(F.lit("-"), amount, F.lit(" руб"))).otherwise(amount)
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_returnflag", raw.alias("raw"))
    parsed = X.normalize_columns(lines, {"value": ("amount", "raw")})
    return parsed.groupBy("l_returnflag").agg(F.count("value").alias("parsed"), _count(), total().alias("value"))


@query("parse_amount_half_even")
def parse_amount_half_even(spark, sf_dir):
    """Halves of a cent go to the even cent, on both sides of zero."""
    key = F.col("o_orderkey")
    halves = F.get(F.array(*[F.lit(h) for h in ("005", "015", "125", "135", "995")]), (key % 5).cast("int"))
    raw = F.concat(F.when(key % 3 == 0, "-").otherwise(""), key, F.lit(","), halves)
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", X.parse_amount(raw).alias("value"))
    return parsed.groupBy((F.col("o_orderkey") % 100).alias("bucket")).agg(total().alias("value"))


@query("parse_date")
def parse_date(spark, sf_dir):
    key = F.col("l_orderkey")
    raw = F.when(key % 97 == 0, F.lit("31.02.1998")).when(key % 97 == 1, F.lit("not a date")) \
        .otherwise(messy.messy_date(F.col("l_shipdate"), key))
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(P.parse_date(raw).alias("day")).agg(_count())


@query("date_parts")
def date_parts(spark, sf_dir):
    day = P.parse_date(messy.messy_date(F.col("o_orderdate"), F.col("o_orderkey")))
    year, month = P.date_parts(F.when(F.col("o_orderkey") % 13 != 0, day))
    return table(spark, sf_dir, "orders").groupBy(year.alias("year"), month.alias("month")).agg(_count())


@query("period_label")
def period_label(spark, sf_dir):
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    label = P.period_label(
        F.when(key % 4 == 0, date), F.when(key % 4 < 3, F.year(date)), F.when(key % 4 < 2, F.month(date)),
        F.lit(P.range_label(None, None)))
    return table(spark, sf_dir, "orders").groupBy(label.alias("period")).agg(_count())


# --- Facts about paths -------------------------------------------------------------------------


@query("path_source_group")
def path_source_group(spark, sf_dir):
    prefixes = F.array(*[F.lit(p) for p in (
        "1. Данные/", "Выгрузка РЧБ ", "x/2. y/", "СОГЛАШЕНИЯ ", "a\\3.b ", "ГЗ ", "4.", "буау", "СКК/", "прочее ")])
    path = F.concat(F.get(prefixes, (F.col("o_orderkey") % 10).cast("int")), F.col("o_orderkey"), F.lit(".csv"))
    return table(spark, sf_dir, "orders").groupBy(tree.source_group(path).alias("source_group")).agg(_count())


@query("path_period")
def path_period(spark, sf_dir):
    key, ts = F.col("event_id"), F.col("ts")
    months = F.array(*[F.lit(s) for s in P.MONTH_STEMS])
    path = F.when(key % 3 == 0, F.concat(F.lit("dir.v1/Отчёт на"), F.date_format(ts, "ddMMyyyy"), F.lit(".csv"))) \
        .when(key % 3 == 1, F.concat(F.get(months, F.month(ts) - 1), F.lit("ь"), F.year(ts), F.lit(".CSV"))) \
        .otherwise(F.concat(F.lit("на9999"), F.year(ts), F.lit(".csv")))
    return table(spark, sf_dir, "events").groupBy(
        P.file_name_date(path).alias("period"), P.has_impossible_file_date(path).alias("impossible")).agg(_count())


@query("file_admission")
def file_admission(spark, sf_dir):
    """Which files of a listing are registered, and which of those are skipped."""
    suffixes = F.array(*[F.lit(s) for s in (".csv", ".XLSX", ".xls", ".pdf", ".txt", "")])
    path = F.concat(F.lit("x/f"), F.col("o_orderkey"), F.get(suffixes, (F.col("o_orderkey") % 6).cast("int")))
    files = table(spark, sf_dir, "orders").select(path.alias("path"), F.lit(1).alias("size_bytes"))
    registered = tree.register(files.withColumn("extension", tree.extension(F.col("path"))))
    return registered.groupBy("extension", "status", "error_message").agg(_count())


# --- Records -> facts and typed tables ---------------------------------------------------------


def _read_once(source, spark, sf_dir) -> DataFrame:
    """Entries that one output reads: they pass from task to task, and none is held."""
    records, profiles = source(spark, sf_dir)
    return N.entries(records, N.place_columns(profiles))


def _entries(source, spark, sf_dir) -> DataFrame:
    """Entries as an import keeps them: persisted lazily, so that no normaliser is computed once per output."""
    return materialize(_read_once(source, spark, sf_dir), "entries")


def _facts(source, spark, sf_dir) -> DataFrame:
    return N.facts(_entries(source, spark, sf_dir), "tpch")


@query("unpivot_rchb")
def unpivot_rchb(spark, sf_dir):
    keys = ["source_file", "organization_name", "kfsr_code", "kvr_code", "kvsr_code", "kesr_code", "kosgu_code",
            "purpose_code", "funding_source", "year", "month", "metric"]
    facts = N.facts(_read_once(messy.rchb, spark, sf_dir), "tpch").select(
        *keys, "value", F.length("object_name").alias("object_length"), F.length("kcsr_code").alias("kcsr_length"))
    return facts.groupBy(*keys).agg(
        _count(), total().alias("value"), F.sum("object_length").alias("object_letters"),
        F.sum("kcsr_length").alias("kcsr_letters"))


@query("raw_rows_rchb")
def raw_rows_rchb(spark, sf_dir):
    """Verbatim records: what the cells of every header say, counted."""
    raw = N.raw_rows(_read_once(messy.rchb, spark, sf_dir))
    cells = raw.select("source_file", F.col("data")["КФСР"].alias("kfsr"), F.size("data").alias("width"))
    return cells.groupBy("source_file", "kfsr", "width").agg(_count())


@query("agreement_facts")
def agreement_facts(spark, sf_dir):
    return _facts(messy.agreements, spark, sf_dir).select(
        "source_file", "row_number", "budget_name", "object_name", "organization_name", "document_number",
        "document_id", "date", "kfsr_code", "kcsr_code", "kvr_code", "purpose_code", "metric", "value")


@query("contract_facts")
def contract_facts(spark, sf_dir):
    return _facts(messy.contracts, spark, sf_dir).select(
        "source_file", "row_number", "object_name", "organization_name", "document_number", "document_id", "date",
        "metric", "value")


@query("contract_budget_lines")
def contract_budget_lines(spark, sf_dir):
    lines = N.typed(_entries(messy.contract_lines, spark, sf_dir), "contract_budget_lines")
    return lines.groupBy("kfsr_code", "kcsr_code", "kvr_code", "kesr_code", "kvsr_code", "purpose_code").agg(
        _count(), F.min("con_document_id").alias("first_document"))


@query("payment_facts")
def payment_facts(spark, sf_dir):
    return _facts(messy.payments, spark, sf_dir).select(
        "source_file", "row_number", "object_name", "document_number", "document_id", "date", "metric", "value")


@query("unpivot_buau")
def unpivot_buau(spark, sf_dir):
    facts = _facts(messy.buau, spark, sf_dir)
    return facts.groupBy("source_file", "object_name", "organization_name", "kfsr_code", "purpose_code", "metric").agg(
        _count(), total().alias("value"))


@query("institution_payments")
def institution_payments(spark, sf_dir):
    rows = N.typed(_entries(messy.buau, spark, sf_dir), "institution_payments")
    sums = [F.sum(c).cast("decimal(20,2)").alias(c) for c in ("amount_with_refund", "amount_execution", "amount_recovery")]
    return rows.groupBy("budget_name", "grantor_name", "kcsr_code", "kosgu_code").agg(_count(), *sums)


@query("dedup_agreements")
def dedup_agreements(spark, sf_dir):
    rows = N.typed(_entries(messy.agreements, spark, sf_dir), "agreements")
    return Q.dedup_agreements(rows).drop("raw_data")


@query("dedup_agreement_facts")
def dedup_agreement_facts(spark, sf_dir):
    facts = Q.dedup_agreement_facts(_facts(messy.agreements, spark, sf_dir))
    return facts.select("source_file", "row_number", "document_id", "date", "object_name", "metric", "value")


@query("dedup_last_wins")
def dedup_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return D.last_value_wins(orders, "o_custkey", "o_orderkey", ["o_orderpriority"])


@query("file_quarantine")
def file_quarantine(spark, sf_dir):
    """Contracts left per file, and the reason for files that contribute nothing."""
    records, profiles = messy.contracts(spark, sf_dir)
    out = normalize(records, profiles, "tpch")
    kept = B.count_by_file(out.tables["contracts"], "contracts")
    return profiles.select("path").join(kept, "path", "left").join(out.problems, "path", "left").select(
        "path", F.coalesce("contracts", F.lit(0)).alias("contracts"), "message")


def _import_counts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A listing with non-CSV files among the exports, and the registry after importing it."""
    records, profiles = messy.everything(spark, sf_dir)
    profiles = materialize(profiles, "profiles")
    problems, counts = count_rows(records, profiles)
    others = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("прочее/"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ".pdf").otherwise(".txt"))
        .alias("path"))
    files = profiles.select("path").unionByName(others).select(
        "path", F.lit(1).cast("long").alias("size_bytes")).withColumn("extension", tree.extension(F.col("path")))
    profile = profiles.select("path", F.lit("utf-8-sig").alias("encoding"), F.lit(";").alias("delimiter"),
                              F.lit(0).alias("header_row_index"), "rows_count")
    registry = B.file_registry(tree.register(files), profile, problems, counts)
    return files, materialize(registry, "registry")


@query("file_counts")
def file_counts(spark, sf_dir):
    return _import_counts(spark, sf_dir)[1].where("extension = '.csv'").select(
        "relative_path", "status", "rows_count", "raw_rows_imported", "normalized_rows_imported")


@query("batch_rollup")
def batch_rollup(spark, sf_dir):
    files, registry = _import_counts(spark, sf_dir)
    return B.batch_rollup(files, registry, "tpch").drop("finished_at")


@query("files_listing")
def files_listing(spark, sf_dir):
    registry = _import_counts(spark, sf_dir)[1]
    return B.files_listing(registry).select("relative_path", "original_name", "extension", "source_group", "status")


@query("errors_listing")
def errors_listing(spark, sf_dir):
    """The error log of two imports of the contracts, the first one's errors first."""
    records, profiles = messy.contracts(spark, sf_dir)
    problems = count_rows(records, profiles)[0]
    logs = [Q.error_log(problems, batch).withColumn("created_at", F.lit(at).cast("timestamp"))
            for batch, at in (("second", "2026-02-01 00:00:00"), ("first", "2026-01-01 00:00:00"))]
    listed = B.errors_listing(logs[0].unionByName(logs[1]))
    return listed.select("batch_id", "path", "level", "message", F.col("context")["relative_path"].alias("context_path"),
                         F.col("created_at").cast("date").alias("created_on"))


@query("latest_batch")
def latest_batch(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(
        F.col("o_orderpriority").alias("input_type"), F.col("o_custkey").alias("original_name"),
        F.col("o_orderdate").cast("date").alias("created_at"), F.col("o_orderkey").alias("id"))
    return D.latest_per_key(batches, ["input_type", "original_name"], ["created_at", "id"])


@query("ingest_files")
def ingest_files(spark, sf_dir):
    """Ledger exports written as real CSV files, then read back through the whole import."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fiscalspark/exports-{uuid.uuid4()}"
    cells = [c.alias(h) for h, c in zip(messy.RCHB_HEADERS, messy.rchb_cells())]
    exports = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.concat(F.lit("1. РЧБ "), F.col("l_returnflag")).alias("source"), *cells)
    exports.write.partitionBy("source").option("header", "true").option("sep", ";").csv(root)
    done = ingest_folder(spark, root, "tpch", hash_files=False)
    return done.facts.groupBy("kfsr_code", "kvr_code", "year", "metric").agg(_count(), total().alias("value"))

"""A file with one refused record contributes nothing; duplicates across snapshots count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.operators.distinct import first_wins

SNAPSHOT_ORDER = ("source_file", "row_number")


def file_problems(files: DataFrame, read_problems: DataFrame | None = None) -> DataFrame:
    """One row per failed file, (path, message), from the per-file row of its entries."""
    found = files.where(F.col("message").isNotNull()).select("path", "message")
    if read_problems is None:
        return found
    return found.unionByName(read_problems).groupBy("path").agg(F.min("message").alias("message"))


def without_failed_files(entry: DataFrame, problems: DataFrame) -> DataFrame:
    failed = problems.select(F.col("path").alias("source_file"))
    return entry.join(failed, "source_file", "left_anti").drop("violation")


def error_log(problems: DataFrame, batch_id: str) -> DataFrame:
    return problems.select(
        F.lit(batch_id).alias("batch_id"), "path", F.lit("error").alias("level"), "message",
        F.create_map(F.lit("relative_path"), F.col("path")).alias("context"),
        F.current_timestamp().alias("created_at"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def agreement_keys() -> list[Column]:
    return [_text("document_id"), _text("reg_number"), F.col("close_date"), F.col("amount_1year"),
            _text("recipient_name"), _text("budget_name")]


def agreement_fact_keys() -> list[Column]:
    return [_text("document_id"), _text("document_number"), F.col("date"), F.col("value"),
            _text("object_name"), _text("budget_name"), _text("metric")]


def agreement_key_columns() -> list[Column]:
    """The dedup keys under names of their own."""
    return [key.alias(f"k{i}") for i, key in enumerate(agreement_keys())]


def agreement_fact_key_columns() -> list[Column]:
    return [key.alias(f"k{i}") for i, key in enumerate(agreement_fact_keys())]


def dedup_agreements(agreements: DataFrame) -> DataFrame:
    return first_wins(agreements, agreement_keys(), SNAPSHOT_ORDER)


def first_snapshots(agreement_facts: DataFrame) -> DataFrame:
    return first_wins(agreement_facts, agreement_fact_keys(), SNAPSHOT_ORDER)


def dedup_agreement_facts(facts: DataFrame) -> DataFrame:
    """Only agreement facts repeat across monthly snapshots; all others pass untouched."""
    repeats = (F.col("source_group") == "agreements") & (F.col("metric") == "agreement_amount")
    return facts.where(~repeats).unionByName(first_snapshots(facts.where(repeats)))

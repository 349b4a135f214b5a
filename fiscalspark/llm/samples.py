"""Bounded training samples and the split of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SLOTS = 1 << 40


def held_out(identifier: Column) -> Column:
    """Documents whose labels no model may see: crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 3 == 1, F.lit(False))


def about(df: DataFrame, identifier: str, most: int, total: int) -> DataFrame:
    """Rows whose hashed identifier falls below the share that gives ``most`` rows of ``total`` on average; all rows if
    there are fewer. The choice hangs on the identifier alone, not on partitions or order."""
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(identifier).cast("string"), F.lit("sample")), F.lit(SLOTS)) < SLOTS * most // total)


def visible_labels(labels: DataFrame, column: str, id_column: str = "doc_id") -> DataFrame:
    """``id, label`` of the documents that may be learned from; of several labels of a document the largest counts, null
    identifiers and labels do not."""
    rows = labels.select(F.col(id_column).alias("id"), F.col(column).cast("int").alias("label"))
    rows = rows.where("id is not null and label is not null").where(~held_out(F.col("id")))
    return rows.groupBy("id").agg(F.max("label").alias("label"))

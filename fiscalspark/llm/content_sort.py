"""Exact deduplication by sorting contents.

Every text is normalised, keyed by the first bytes of the result followed by its digest, and sent to one of many
ranges whose borders are sampled keys. Inside a range an external sort places equal texts side by side; each row is
compared in full with its neighbour, and the first row of a run has the smallest identifier. The identifier is the
last part of the key, so a text with very many copies is spread over as many ranges as it needs; only the runs at the
two ends of a range can go on in another range, and these few are put together by their digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fiscalspark.llm import scratch

SPACE = r"[\x20\x09-\x0D]+"
PREFIX_BYTES = 16
#: Sampled keys for each range, and the most that are sampled at all.
KEYS_PER_RANGE = 40
MOST_KEYS = 400_000


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _ordered_id(df: DataFrame, column: str) -> Column:
    """A string that sorts as the identifier does (null last)."""
    if isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        shifted = F.col(column).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        text = F.lpad(shifted.cast("string"), 20, "0")
    else:
        text = F.col(column).cast("string")
    return F.coalesce(text, F.lit("\U0010ffff"))


def range_of(key: Column, borders: list[str]) -> Column:
    """Number of borders at or below the key, found in two steps of about the square root of their number."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))

    def strings(values: list[str]) -> Column:
        return F.split(F.lit(",".join(values)), ",")  # constant: folded once by the optimiser

    at = F.size(F.filter(strings(borders[::step]), lambda b: b <= key))
    pieces = F.split(F.lit(";".join(",".join(borders[i + 1:i + step]) for i in range(0, len(borders), step))), ";")
    inside = F.filter(F.split(F.element_at(pieces, at), ","), lambda b: (b != "") & (b <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * step + 1 + F.size(inside)).cast("int")


def sample_borders(keyed: DataFrame, key: str, ranges: int, total: int) -> list[str]:
    wanted = min(KEYS_PER_RANGE * ranges, MOST_KEYS)
    fraction = min(1.0, 1.2 * wanted / max(total, 1))
    sampled = sorted({row[0] for row in keyed.sample(fraction, seed=7).select(key).collect()})
    return [sampled[len(sampled) * i // ranges] for i in range(1, ranges)] if len(sampled) > ranges else sampled


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 ranges: int | None = None) -> DataFrame:
    """One row per input row: ``<id>, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. Of rows that repeat an identifier and a text, one is kept. A row without identifier
    sorts behind all others; it is kept only if its whole group has none, and then one such row is. Other columns of
    the input are not read. An empty table gives an empty result. ``ranges`` is the number of sort ranges.
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = normalised(F.col(text_column))
    base = docs.select(F.col(id_column).alias("id"), norm.alias("norm")).withColumn("sha", F.sha2("norm", 256))
    head = F.rpad(F.hex(F.substring(F.col("norm").cast("binary"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "-")
    ident = F.regexp_replace(_ordered_id(base, "id"), "[,;]", ".")
    border_key = F.concat(head, F.col("sha"), ident)
    borders = sample_borders(base.select(border_key.alias("key")), "key", ranges, docs.count())
    keyed = base.select("id", "norm", "sha", head.alias("head"), range_of(border_key, borders).alias("part"))

    sort = Window.partitionBy("part").orderBy("head", "sha", "norm", F.col("id").asc_nulls_last())
    starts = keyed.select(
        "part", "head", "sha", "id",
        F.coalesce(F.lag("norm").over(sort) != F.col("norm"), F.lit(True)).alias("starts"),
        F.row_number().over(sort).alias("place"))
    in_order = Window.partitionBy("part").orderBy("place")
    runs = starts.select(
        "part", "sha", "id", "starts",
        F.sum(F.col("starts").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    whole, run = Window.partitionBy("part"), Window.partitionBy("part", "run")
    measured = runs.select(
        "part", "sha", "id", "starts",
        F.min("id").over(run).alias("run_min"), F.count(F.lit(1)).over(run).alias("run_size"),
        ((F.col("run") == 1) | (F.col("run") == F.max("run").over(whole))).alias("at_end"))
    rows = scratch.keep(measured, "content-sort")

    # At most two runs of each range: a few rows however many copies there are.
    first = F.min(F.struct(F.col("run_min").isNull().alias("missing"), F.col("run_min").alias("id"), "part"))
    joined = rows.where(F.col("at_end") & F.col("starts")).groupBy("sha").agg(
        first.alias("first"), F.sum("run_size").alias("all_size"))
    out = rows.join(F.broadcast(joined.withColumn("at_end", F.lit(True))), ["sha", "at_end"], "left")
    head_part = F.coalesce(F.col("first.part"), F.col("part"))
    return out.select(
        F.col("id").alias(id_column),
        F.when(F.col("at_end"), F.col("first.id")).otherwise(F.col("run_min")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("starts") & (F.col("part") == head_part)).alias("kept"),
        F.col("sha").alias("text_sha256"))

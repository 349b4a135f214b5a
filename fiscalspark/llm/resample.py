"""Target-distribution importance resampling of documents by hashed n-grams, drawn by a distributed quickselect.

Counts of hashed features over all documents and over all target texts give one gain per bucket; these few numbers are an
array that every task holds. A document's weight is the floored mean of its features' gains, and Gumbel noise derived from
its identifier turns weights into keys whose largest ones are a weighted draw without replacement. The k-th key is found
without sorting: each round takes some random keys of the range still open as pivots, counts exactly how many rows lie
below, at and between them, and goes on in the one gap that holds the k-th. Only the winners are sorted and ranked.

Rows that agree in all that the result says are one row with a count until the end, so no repeated key is a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fiscalspark.llm import scratch, words as W

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Pivots of one round; a round leaves about one part in so many of the open rows.
PIVOTS = 31
#: Copies of one row that are written out at a time, so that a row repeated without end is dealt over tasks.
COPIES_AT_ONCE = 10_000
#: A round of vector operations takes about so many bytes of text.
ROUND_BYTES = W.ROUND_BYTES


def _features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of some texts, the text of each, and the number of words of each text."""
    split = [t.translate(W.BY_ALNUM).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for s in split for w in s]
    owner = np.repeat(np.arange(len(split)), sizes)
    single = list(map(crc32, words))
    # crc32 of "a b" goes on from that of "a ".
    double = list(map(crc32, words[1:], map(crc32, repeat(b" "), single)))
    inside = owner[1:] == owner[:-1]
    found = np.concatenate([np.array(single, np.int64), np.array(double, np.int64)[inside]]) % buckets
    return found, np.concatenate([owner, owner[1:][inside]]), sizes


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (v or b"" for v in column.cast(pa.binary()).to_pylist())


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_column: str = "text") -> DataFrame:
    """``bucket, n`` of all features of the texts; one array a task is added up before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in W.rounds(_texts(batch.column(0))):
                total += np.bincount(_features(texts, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, floor(1000 ln of the smoothed ratio of target to documents). ``buckets`` rows come to the driver."""
    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(df, buckets).collect():
            out[bucket] = n
        return out

    s, t = counts(docs), counts(target)
    ratio = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(identifier: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the identifier's hash; a missing identifier counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``<id>, n_words, n_features, weight``, one row per document; a text without words weighs 0."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            parts = []
            for _, texts in W.rounds(_texts(batch.column(1))):
                found, owner, n_words = _features(texts, len(table))
                n = np.bincount(owner, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, owner, table[found])
                parts.append((n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumnRenamed("id", id_column)


# --- Quickselect -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Border:
    """The k-th key in order, as the values of its columns, and how many rows with this very key are among the first k."""

    key: tuple
    taken: int


def _literal(key: tuple, schema) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, schema)])


def kth_key(rows: DataFrame, key: str, weight: str, k: int, pivots: int = PIVOTS) -> Border:
    """The key (a struct without nulls) that the k-th row has in ascending order, a row counting ``weight`` times.

    ``rows`` holds at least k rows, 1 <= k; it should be a written table, as each round reads it. A round is two small
    aggregates; the driver sees the pivots and their counts, never the keys between them.
    """
    schema = rows.schema[key].dataType.fields
    low = high = None
    wanted, seed = k, 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.where(F.col(key) > _literal(low, schema))
        if high is not None:
            inside = inside.where(F.col(key) < _literal(high, schema))
        # Random keys: those with the least hash, each key once (the sort keeps `pivots` rows a task).
        drawn = inside.select(F.col(key).alias("p"), F.xxhash64(key, F.lit(seed)).alias("h")).orderBy("h").limit(pivots)
        at = sorted({tuple(r["p"]) for r in drawn.collect()})
        listed = F.array(*[_literal(p, schema) for p in at])
        below = F.size(F.filter(listed, lambda p: p < F.col(key)))
        equal = F.exists(listed, lambda p: p == F.col(key))
        counts = {(r["below"], r["equal"]): r["n"] for r in inside.groupBy(
            below.alias("below"), equal.alias("equal")).agg(F.sum(weight).alias("n")).collect()}
        for i in range(len(at) + 1):
            before = counts.get((i, False), 0)
            if wanted <= before:  # in the gap before pivot i
                low, high = at[i - 1] if i else low, at[i] if i < len(at) else high
                break
            wanted -= before
            same = counts.get((i, True), 0)
            if wanted <= same:
                return Border(at[i], wanted)
            wanted -= same
        seed += 1


def _spread(df: DataFrame, copies: str) -> DataFrame:
    """Each row ``copies`` times, with its number ``copy`` from 0."""
    starts = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1, F.lit(COPIES_AT_ONCE).cast("bigint"))))
    last = F.least(F.col("_from") + COPIES_AT_ONCE, F.col(copies)) - 1
    return starts.withColumn("copy", F.explode(F.sequence(F.col("_from"), last))).drop("_from")


def draw(weighed: DataFrame, id_column: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS,
         seed: int = SEED) -> DataFrame:
    """``<id>, n_features, weight, score, rank`` for every row of `weigh`; rank is null where the row is not drawn.

    Drawn are floor(percent * N / 100) of the N rows with enough words: those of the highest score, then of the smallest
    identifier (a missing one last), then of the fewest features; rows that agree in all of these share their ranks out.
    """
    spark = weighed.sparkSession
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(id_column), seed))
    fit = (F.col("n_words") >= least_words).alias("fit")
    grouped = scored.groupBy(F.col(id_column).alias("id"), fit, "n_features", "weight", "score").agg(
        F.count(F.lit(1)).alias("copies"))
    key = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("m"),
                   F.coalesce(F.col("id"), F.lit("0").cast(grouped.schema["id"].dataType)).alias("i"), F.col("n_features").alias("f"))
    rows, path = scratch.keep_at(grouped.withColumn("key", key), "scored")
    total = rows.where("fit").agg(F.sum("copies")).first()[0] or 0
    k = percent * total // 100
    if not k:
        out = _spread(rows, "copies").withColumn("rank", F.lit(None).cast("bigint"))
        return _shown(out, id_column)

    border = kth_key(rows.where("fit"), "key", "copies", k)
    last = _literal(border.key, rows.schema["key"].dataType.fields)
    wins = F.when(F.col("fit") & (F.col("key") < last), F.col("copies")).when(
        F.col("fit") & (F.col("key") == last), F.lit(border.taken).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    judged = rows.withColumn("wins", wins)
    # Winners in order: ranges of keys, rows before each range from its counts, places inside a range by a window.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    winners = judged.where("wins > 0").repartitionByRange(width, "key").withColumn("range", F.spark_partition_id())
    winners, _ = scratch.keep_at(winners, "winners")
    before = winners.groupBy("range").agg(F.sum("wins").alias("in_range")).select(
        "range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("before"))
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = winners.join(F.broadcast(before), "range").withColumn(
        "first", F.col("before") + F.sum("wins").over(inside) - F.col("wins") + 1)
    ranked = _spread(placed, "wins").withColumn("rank", F.col("first") + F.col("copy"))
    left = judged.where("copies > wins").withColumn("left", F.col("copies") - F.col("wins"))
    undrawn = _spread(left, "left").withColumn("rank", F.lit(None).cast("bigint"))
    return _shown(ranked, id_column).unionByName(_shown(undrawn, id_column))


def _shown(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Draw documents as the target's texts are distributed: ``<id>, n_features, weight, score, rank``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; features are words and
    pairs of neighbours. Null and empty texts have no features and are never drawn (unless ``least_words`` is 0). Rows
    without identifier take part with the noise of an empty one; other columns are not read; an empty table of documents
    gives an empty result, an empty target gains from the documents' own counts alone.
    """
    named = docs.select(id_column, F.col(text_column).alias("text"))
    gain = gains(named, target.select(F.col(text_column).alias("text")), buckets)
    return draw(weigh(named, gain, id_column), id_column, percent, least_words, seed)

"""Benchmark decontamination: find, flag and cut passages of benchmark items in training documents.

The windows of thirteen words of all items (or the whole of a shorter item) form a hash set that every task holds; a
task hashes all windows of its documents in numpy, looks them up, and compares the words of each hit. The set is
broadcast only up to ``WINDOWS_AT_ONCE`` windows. A larger benchmark is split by item into blocks below that bound,
each of which is held against all documents; the hits of the blocks are joined by identifier and digest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fiscalspark.llm import words as W

WINDOW = 13
#: Most windows of benchmark items in one broadcast (about 250 bytes each with their words).
WINDOWS_AT_ONCE = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class WindowSet:
    """Windows of benchmark items by hash, each with its words and the items that hold it."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        found: dict[int, dict[int, dict[bytes, set]]] = {}
        for item, text in items:
            w = W.split([text], W.BY_ALNUM)
            size = min(window, len(w.hashes))
            if not size:
                continue
            for i, h in enumerate(W.ngrams(w.hashes, size).tolist()):
                key = b" ".join(w.text(j) for j in range(i, i + size))
                found.setdefault(size, {}).setdefault(h, {}).setdefault(key, set()).add(item)
        self.by_size = found
        self.filters = {}
        for size, table in found.items():
            bits = np.zeros(1 << max(16, (len(table) * 16).bit_length()), bool)
            hashes = np.fromiter(table, np.uint64, len(table))
            bits[hashes & np.uint64(len(bits) - 1)] = True
            self.filters[size] = bits

    def hits(self, w: W.Words) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of every occurrence; a window never reaches over the end of a text."""
        text_of = None
        for size, table in self.by_size.items():
            bits, grams = self.filters[size], W.ngrams(w.hashes, size)
            maybe = np.flatnonzero(bits[grams & np.uint64(len(bits) - 1)])
            if not len(maybe):
                continue
            if text_of is None:
                text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
            for i in maybe[text_of[maybe] == text_of[maybe + size - 1]].tolist():
                same_hash = table.get(int(grams[i]))
                if same_hash and (items := same_hash.get(b" ".join(w.text(j) for j in range(i, i + size)))):
                    yield i, size, items


def _spans(held: WindowSet, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[list, list, set]]]:
    """Number of words of each text, and its merged hit spans in words (starts, ends) with the items that occur."""
    counts = np.zeros(len(texts), np.int64)
    spans: list[tuple[list, list, set]] = [([], [], set()) for _ in texts]
    for begin, some in W.rounds(texts):
        w = W.split(some, W.BY_ALNUM)
        counts[begin:begin + len(some)] = np.diff(w.first)
        for i, size, items in sorted(held.hits(w), key=lambda x: x[:2]):
            k = int(np.searchsorted(w.first, i, side="right")) - 1
            starts, ends, seen = spans[begin + k]
            at = i - int(w.first[k])
            if ends and at <= ends[-1]:
                ends[-1] = max(ends[-1], at + size)
            else:
                starts.append(at)
                ends.append(at + size)
            seen |= items
    return counts, spans


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _scanner(windows):
    """Rows ``id, n_words, starts, ends, items``: merged hit spans in words, and the items that occur."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = windows.value
        for batch in batches:
            counts, spans = _spans(held, _bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts),
                pa.array([s[0] for s in spans], pa.list_(pa.int64())), pa.array([s[1] for s in spans], pa.list_(pa.int64())),
                pa.array([sorted(str(x) for x in s[2] if x is not None) for s in spans], pa.list_(pa.string())),
            ], ["id", "n_words", "starts", "ends", "items"])
    return scan


def _clean(windows, place: int, least_share: int):
    """The rows whose text, in the column of that place, is not contaminated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = windows.value
        for batch in batches:
            counts, spans = _spans(held, _bytes(batch.column(place)))
            hit = np.array([sum(ends) - sum(starts) for starts, ends, _ in spans], np.int64)
            yield batch.filter(pa.array((hit == 0) | (least_share * hit < counts)))
    return run


def _blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The items in as few blocks as keep each below the bound of windows, dealt by the hash of their text."""
    windows = F.greatest(F.lit(1), F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))
    total = benchmark.agg(F.sum(windows)).first()[0] or 0
    n = -(-2 * total // most) if total > most else 1
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _merge(spans):
    """SQL lambda steps that join overlapping or touching spans, given as sorted structs (s, e)."""
    start = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(spans, start, step)


def _held(benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text", window: int = WINDOW,
          windows_at_once: int = WINDOWS_AT_ONCE) -> list:
    """The windows of each block of items, as broadcasts."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    return [context.broadcast(WindowSet([(r["item"], r["text"].encode()) for r in block.collect()], window))
            for block in _blocks(items, windows_at_once)]


def _digest(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def _found(docs: DataFrame, held: list, id_column: str, text_column: str) -> DataFrame:
    """``id, digest, n_words, spans, items``; the digest of the text is null if one block holds the benchmark."""
    one = len(held) == 1
    rows = docs.select(F.struct(
        F.col(id_column).alias("id"), (F.lit(None).cast("string") if one else _digest(text_column)).alias("digest")).alias("id"),
        F.col(text_column).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"
    pairs = F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))
    parts = [rows.mapInArrow(_scanner(block), kind).select("id", "n_words", pairs.alias("spans"), "items") for block in held]
    found = parts[0]
    if not one:
        rest = parts[1]
        for part in parts[2:]:
            rest = rest.unionByName(part)
        # Equal rows have equal hits: one list of each block is enough, and each row of the first block meets one list.
        rest = rest.where(F.size("spans") > 0).groupBy("id").agg(
            F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
        rest = rest.select(F.col("id.id").alias("other"), F.col("id.digest").alias("other_digest"), "more_spans", "more_items")
        same = F.col("id.id").eqNullSafe(F.col("other")) & (F.col("id.digest") == F.col("other_digest"))
        found = found.join(rest, same, "left").select(
            "id", "n_words",
            F.when(F.col("other_digest").isNull(), F.col("spans")).otherwise(
                _merge(F.sort_array(F.concat("spans", "more_spans")))).alias("spans"),
            F.when(F.col("other_digest").isNull(), F.col("items")).otherwise(
                F.sort_array(F.array_distinct(F.concat("items", "more_items")))).alias("items"))
    return found.select("id.id", "id.digest", "n_words", "spans", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              **of_benchmark) -> DataFrame:
    """``<id>, n_words, spans array<struct<s,e>>, items array<string>`` for every row of ``docs``.

    ``spans`` are the hit words as half-open ranges of word numbers, merged; ``items`` the sorted identifiers of the
    items that occur. Null and empty texts have no words; an item without words is never found; an item without an
    identifier is found but not listed. Rows that repeat an identifier, or an identifier and a text, each give a row,
    whatever the size of the benchmark. Other columns are not read. Without items every document comes back without hits. ``of_benchmark``: the columns, window and block size of `_held`.
    """
    found = _found(docs, _held(benchmark, **of_benchmark), id_column, text_column)
    return found.select(F.col("id").alias(id_column), "n_words", "spans", "items")


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["e"] - x["s"])


def _contaminated(least_share: int) -> Column:
    return (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, least_share: int = 20, **columns) -> DataFrame:
    """Counts per document; contaminated if at least one in ``least_share`` of its words is hit."""
    hits = find_hits(docs, benchmark, **columns)
    return hits.withColumn("n_hit", _n_hit()).select(
        hits.columns[0], "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated(least_share).alias("contaminated"))


def without_documents(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      least_share: int = 20, **of_benchmark) -> DataFrame:
    """The rows that are not contaminated, with all their columns; each is judged by its own text.

    While the benchmark fits one block, rows are dropped in the pass that scans them. Otherwise they are matched with the
    contaminated ones by identifier and digest of the text.
    """
    held = _held(benchmark, **of_benchmark)
    if len(held) == 1:
        return docs.mapInArrow(_clean(held[0], docs.columns.index(text_column), least_share), docs.schema)
    bad = _found(docs, held, id_column, text_column).withColumn("n_hit", _n_hit()).where(_contaminated(least_share))
    bad = bad.select(F.col("id").alias("_bad"), F.col("digest").alias("_bad_text")).distinct()
    same = docs[id_column].eqNullSafe(bad["_bad"]) & (_digest(text_column) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")


def _cut(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the words of the spans; what stands between words stays."""
    if not starts:
        return text
    raw = text.encode()
    w, pieces, at = W.split([raw], W.BY_ALNUM), [], 0
    for start, end in zip(starts, ends, strict=True):
        pieces.append(raw[at:w.starts[start]])
        at = w.ends[end - 1]
    return b"".join([*pieces, raw[at:]]).decode()


def _cutter(windows):
    """Rows ``id, text`` from ``id, text``, scanned and cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = windows.value
        for batch in batches:
            _, spans = _spans(held, _bytes(batch.column(1)))
            out = [_cut(text, s[0], s[1]) for text, s in zip(batch.column(1).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])
    return run


def _cut_given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``id, text`` from ``id, text, spans``."""
    for batch in batches:
        out = [_cut(text, [x["s"] for x in spans or ()], [x["e"] for x in spans or ()])
               for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])


def without_spans(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  **of_benchmark) -> DataFrame:
    """``<id>, <text>`` of every row with the hit words cut out of its own text; null stays null.

    While the benchmark fits one block, a row is cut in the pass that scans it. Otherwise the spans are matched by
    identifier and digest of the text.
    """
    held = _held(benchmark, **of_benchmark)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, text string"
    if len(held) == 1:
        cut = rows.mapInArrow(_cutter(held[0]), kind)
    else:
        hits = _found(docs, held, id_column, text_column).where(F.size("spans") > 0).groupBy("id", "digest").agg(
            F.first("spans").alias("spans")).select(F.col("id").alias("_id"), "digest", "spans")
        same = rows["id"].eqNullSafe(hits["_id"]) & (_digest("text") == hits["digest"])
        cut = rows.join(hits, same, "left").select("id", "text", "spans").mapInArrow(_cut_given, kind)
    return cut.select(F.col("id").alias(id_column), F.col("text").alias(text_column))

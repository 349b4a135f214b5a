"""Removal of repeated passages by recompression (Jeż, 2012) of token sequences.

Every text is rewritten in rounds. A round of runs replaces each maximal run of one symbol by a symbol of its own; a round
of pairs splits the alphabet in two by a bit of each symbol's name and replaces every left symbol that a right one follows,
with it, by one symbol. A new name is a hash of what it stands for, so names agree in all texts of the table without a
dictionary. Wherever a passage occurs, its symbols are the same in every round but for those at its ends, which may have
joined with something outside: popping these leaves the passage's interior, which hangs on its own words alone.

For each window the last round with a non-empty interior gives its anchor, the interior symbol of the least name, here with
the words on its longer side. Equal windows have equal anchors. Neighbouring windows with the same anchor form a unit.

* A unit whose whole content occurs twice settles all of its windows at once (content by digest of its words).
* A unit whose anchor no other content has holds no repeated window.
* For the others the windows themselves are compared, by anchor and digest of their words.

Tasks first compare within a round of texts: what repeats there is decided there, and one row for all is handed on, so that
a passage that a third of all texts share makes a few rows a round and no hot key. Texts are known by 91 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fiscalspark.llm import scratch, words as W

WINDOW = 35
#: Rounds at most. After these a symbol stands for several words and a window of 35 has still some in its interior; more
#: rounds would make anchors rarer but units shorter.
ROUNDS = 4
#: Each so many rounds one of runs, the others of pairs.
RUNS_EVERY = 4
#: Rows of windows that a task holds before it hands them on.
WINDOW_ROWS = 50_000
_PLAIN = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_A, _B, _PAIR, _RUN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))
_TOP = np.uint64(63)


def normal(text: bytes) -> bytes:
    """Words joined by one space."""
    return b" ".join(text.split())


# --- Rounds --------------------------------------------------------------------------------------


def run_round(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new names, new index of every symbol); a run of one symbol keeps its name."""
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(first)
    lengths = np.diff(at, append=len(names)).astype(np.uint64)
    new = names[at]
    many = np.flatnonzero(lengths > 1)
    new[many] = W.mix(new[many] * _A + lengths[many] * _B + _RUN)
    return new, np.cumsum(first) - 1


def pair_round(names: np.ndarray, docs: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new names, new index of every symbol, which symbols are left ones)."""
    left = (W.mix(names + np.uint64(number * int(_B) % (1 << 64))) >> _TOP) == 0
    pair = left[:-1] & ~left[1:] & (docs[1:] == docs[:-1])
    stays = np.ones(len(names), bool)
    stays[1:] = ~pair
    index = np.cumsum(stays) - 1
    new = names[stays]
    at = np.flatnonzero(pair)
    new[index[at]] = W.mix(names[at] * _A + names[at + 1] * _B + _PAIR)
    return new, index, left


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the least name in each [low, high), the first of equals."""
    best, width = low.copy(), high - low
    open_, step = np.flatnonzero(width > 1), 1
    while len(open_):
        other = low[open_] + step
        better = names[other] < names[best[open_]]
        best[open_[better]] = other[better]
        step += 1
        open_ = open_[width[open_] > step]
    return best


def anchors(words: W.Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """For every window of every text: its first word, and the name, round, first word and end of its anchor."""
    counts = np.diff(words.first)
    windows = np.maximum(counts - window + 1, 0)
    first = np.repeat(words.first[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    docs = np.repeat(np.arange(len(counts)), counts)
    names, starts = words.hashes, np.arange(len(words.hashes))
    low, high, live = first.copy(), first + window, np.arange(len(first))
    name, (level, place, stop) = np.zeros(len(first), np.uint64), np.zeros((3, len(first)), np.int64)

    def settle(which: np.ndarray, number: int) -> None:
        best = _least(names, low[which], high[which])
        at = live[which]
        name[at], level[at], place[at] = names[best], number, starts[best]
        stop[at] = np.append(starts, len(words.hashes))[best + 1]

    for number in range(rounds):
        if not len(live):
            return first, name, level, place, stop
        if number % RUNS_EVERY == 0:
            new, index = run_round(names, docs)
            next_low, next_high = index[low] + 1, index[high - 1]
            kept = np.ones(len(names), bool)
            kept[1:] = np.diff(index) > 0
        else:
            new, index, left = pair_round(names, docs, number)
            inner_low, inner_high = low + ~left[low], high - left[high - 1]
            some = inner_low < inner_high
            next_low = index[np.where(some, inner_low, low)]
            next_high = np.where(some, index[np.where(some, inner_high, high) - 1] + 1, next_low)
            kept = np.ones(len(names), bool)
            kept[1:] = np.diff(index) > 0
        going = next_low < next_high
        settle(np.flatnonzero(~going), number)
        low, high, live = next_low[going], next_high[going], live[going]
        names, starts, docs = new, starts[kept], docs[kept]
    settle(np.arange(len(live)), rounds)
    return first, name, level, place, stop


class Spans:
    """Hashes of any span of words, from sums of all words before each place."""

    def __init__(self, words: W.Words):
        size = len(words.hashes)
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(size, _INVERSE)))
        powers = np.cumprod(np.append(np.uint64(1), np.full(size, _A)))
        self.sums = np.append(np.uint64(0), np.cumsum(words.hashes * powers[:size]))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def units(words: W.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first word (in all words), number of windows, name of the anchor.

    A window that reaches at least as many words to the right of its symbol as to the left has them in its anchor, at least
    half of its words beyond the symbol; any other has those to the left.
    """
    first, name, level, place, stop = anchors(words, window)
    if not len(first):
        return first, first, first, name
    text = np.searchsorted(words.first, first, "right") - 1
    outside = window - (stop - place)
    right = first + window - stop >= (outside + 1) // 2
    new = np.ones(len(first), bool)
    new[1:] = ((text[1:] != text[:-1]) | (level[1:] != level[:-1]) | (place[1:] != place[:-1]) | (right[1:] != right[:-1]))
    at = np.flatnonzero(new)
    place, stop, outside, right, spans = place[at], stop[at], outside[at], right[at], Spans(words)
    begin, end = np.where(right, stop, place - outside // 2 - 1), np.where(right, stop + (outside + 1) // 2, place)
    longer = W.mix(name[at] * _A + spans.of(begin, end) * _B + right.astype(np.uint64))
    return text[at], first[at], np.diff(at, append=len(first)), longer


def _digest(words: W.Words, start: int, size: int) -> int:
    content = words.joined[words.starts[start]:words.ends[start + size - 1]]
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


# --- Spark steps ---------------------------------------------------------------------------------

#: Kinds of rows between the steps; a unit's spot is where it starts and how many windows it has, a window's where it starts.
UNIT, OPENED, SETTLED, LONE, SEVERAL, MARK, ASK = range(7)
_ROW = "kind int, anchor bigint, content bigint, k1 bigint, spot bigint"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_CHECK_BITS, _SIZE_BITS = 27, 6
_CHECK = (1 << _CHECK_BITS) - 1


def _spots(starts: np.ndarray, check: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (starts << (_CHECK_BITS + _SIZE_BITS)) | ((check & _CHECK) << _SIZE_BITS) | sizes


def _spot(start: int, check: int, size: int) -> int:
    return (start << (_CHECK_BITS + _SIZE_BITS)) | ((check & _CHECK) << _SIZE_BITS) | size


def _texts(column: pa.Array) -> list[bytes]:
    return [normal(v) if v else b"" for v in column.cast(pa.binary()).to_pylist()]


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    """Columns from parts (kind, anchor, content, k1, spot), each of arrays of one length but for the kind."""
    parts = [p for p in parts if len(p[1])]
    kinds = [np.full(len(p[1]), p[0], np.int32) for p in parts]
    columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (kinds, *([p[i] for p in parts] for i in range(1, 5)))]
    return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns[1:])], _NAMES)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each row's group, whether it is the group's first row) of rows with equal keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    sizes, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
    sizes[order], first[order] = np.bincount(group, minlength=1)[group] if len(order) else 0, new
    return sizes, first


def _window_parts(found: list[tuple[int, int, int, int, bool]]) -> list[tuple]:
    """Rows of single windows (anchor, words, k1, spot, whether only others want it); those that repeat here are marked here."""
    anchor, content, k1, spot, witness = (np.array([r[i] for r in found], np.int64) for i in range(5))
    sizes, first = _groups(anchor, content)
    lone, many = sizes == 1, sizes > 1
    heads = many & first
    marked = many & (witness == 0)
    zero = np.zeros(marked.sum(), np.int64)
    seen = lone & (witness == 1)
    return [(LONE, *(c[lone & ~seen] for c in (anchor, content, k1, spot))), (SEVERAL, *(c[heads | seen] for c in (anchor, content, k1, spot))),
            (MARK, zero, zero, k1[marked], spot[marked])]


def _unit_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for begin, texts in W.rounds(_texts(batch.column(2))):
                yield _rows(_round_parts(W.split(texts, _PLAIN), k1[begin:begin + len(texts)], k2[begin:begin + len(texts)], window))
    return run


def _round_parts(words: W.Words, k1: np.ndarray, k2: np.ndarray, window: int) -> list[tuple]:
    """Rows of the units of some texts, after comparing them with each other."""
    text, first, n, name = units(words, window)
    if not len(text):
        return []
    anchor, offset = name.view(np.int64), first - words.first[text]
    content = np.array([_digest(words, s, m + window - 1) for s, m in zip(first.tolist(), n.tolist())], np.int64)
    key, spot = k1[text], _spots(offset, k2[text], n)
    copies, head = _groups(anchor, content)
    same = copies > 1
    zero = np.zeros(same.sum(), np.int64)
    parts = [(MARK, zero, zero, key[same], spot[same])]
    # One unit of each content goes on; anchors with several contents here are opened: their windows go on instead.
    one = np.flatnonzero(head)
    contents, leader = _groups(anchor[one])
    opened = one[contents > 1]
    leaders = one[(contents > 1) & leader]
    parts.append((OPENED, anchor[leaders], content[leaders], key[leaders], spot[leaders]))
    for kind, some in ((UNIT, one[(contents == 1) & ~same[one]]), (SETTLED, one[(contents == 1) & same[one]])):
        parts.append((kind, anchor[some], content[some], key[some], spot[some]))
    found = [(a, _digest(words, s + k, window), h, _spot(o + k, c, 1), w) for a, s, o, m, h, c, w in zip(
        *(x[opened].tolist() for x in (anchor, first, offset, n, key, k2[text], same))) for k in range(m)]
    return parts + (_window_parts(found) if found else [])


def _judged(rows: DataFrame) -> DataFrame:
    """Units against all others: settled ones become marks, those to compare window by window are asked for."""
    units_only = F.col("kind") <= SETTLED
    # What is no unit only passes through: dealt by itself, in no group.
    dealt = rows.withColumn("deal", F.when(units_only, F.col("anchor")).otherwise(F.xxhash64("k1", "spot"))).repartition("deal")
    same, group = Window.partitionBy("deal", "content"), Window.partitionBy("deal")
    seen = dealt.select(
        "*", (F.count(F.lit(1)).over(same) > 1).alias("copied"), (F.max((F.col("kind") == SETTLED).cast("int")).over(same) > 0).alias("settled"),
        F.min(F.when(F.col("kind") != OPENED, F.col("k1"))).over(same).alias("least"),
        ((F.min("content").over(group) < F.max("content").over(group)) | (F.max((F.col("kind") == OPENED).cast("int")).over(group) > 0)).alias("open"))
    repeated = F.col("copied") | F.col("settled")
    is_unit = F.col("kind") == UNIT
    as_mark = F.when(is_unit & repeated, F.lit(MARK))
    wanted = F.col("kind").isin(UNIT, SETTLED) & F.col("open") & (~F.col("copied") | (F.col("k1") == F.col("least")))
    # A settled unit is a witness for others: its content says so to the step that compares windows.
    as_ask = F.when(wanted, F.lit(ASK))
    kept = F.when(F.col("kind") > SETTLED, F.col("kind"))
    kinds = F.filter(F.array(as_mark, as_ask, kept), lambda k: k.isNotNull())
    return seen.select(F.explode(kinds).alias("kind"), "anchor", F.when(units_only, repeated.cast("bigint")).otherwise(F.col("content")).alias("content"),
                       "k1", "spot")


def _window_rows(window: int):
    """The windows of the units that are asked for, compared within a batch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for k1, k2, text, asked in zip(*(batch.column(i).to_pylist() for i in (1, 2)), _texts(batch.column(3)), batch.column(4).to_pylist()):
                words = None
                for a in asked:
                    spot = a["spot"]
                    start, n = spot >> (_CHECK_BITS + _SIZE_BITS), spot & ((1 << _SIZE_BITS) - 1)
                    if (spot >> _SIZE_BITS) & _CHECK == k2 & _CHECK:
                        words = words or W.split([text], _PLAIN)
                        found += [(a["anchor"], _digest(words, start + k, window), k1, _spot(start + k, k2, 1), a["content"]) for k in range(n)]
                if len(found) > WINDOW_ROWS:
                    yield _rows(_window_parts(found))
                    found = []
        if found:
            yield _rows(_window_parts(found))
    return run


def _marks(known: DataFrame, window: int) -> DataFrame:
    """``k1, marks``: the spots of repeated units and windows of the texts in ``known`` (``id, k1, k2, text``)."""
    judged = scratch.keep(_judged(known.select("k1", "k2", "text").mapInArrow(_unit_rows(window), _ROW)), "units")
    asked = judged.where(F.col("kind") == ASK).groupBy("k1").agg(F.collect_list(F.struct("anchor", "content", "spot")).alias("asked"))
    more = known.join(asked, "k1").select("id", "k1", "k2", "text", "asked").mapInArrow(_window_rows(window), _ROW)
    windows = judged.where(F.col("kind").isin(LONE, SEVERAL, MARK)).unionByName(more)
    single = windows.where(F.col("kind") != MARK).repartition("anchor", "content")
    group = Window.partitionBy("anchor", "content")
    again = single.select("kind", "k1", "spot", ((F.count(F.lit(1)).over(group) > 1) | (F.max("kind").over(group) == SEVERAL)).alias("again"))
    marks = again.where(F.col("again") & (F.col("kind") == LONE)).select("k1", "spot").unionByName(
        windows.where(F.col("kind") == MARK).select("k1", "spot"))
    return marks.groupBy("k1").agg(F.collect_set("spot").alias("marks"))


def _covered(marks: list[int], k2: int, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a marked window."""
    spots = np.array(marks, np.int64)
    spots = spots[(spots >> _SIZE_BITS) & _CHECK == k2 & _CHECK]
    starts = spots >> (_CHECK_BITS + _SIZE_BITS)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + (spots & ((1 << _SIZE_BITS) - 1)) + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k2, text, marks in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = (text or b"").split()
                removed = _covered(marks, k2, len(words), window) if marks else None
                kept = words if removed is None else [words[i] for i in np.flatnonzero(~removed)]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))],
                ["id", "n_words", "n_removed", "kept"])
    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``<id>, n_words, n_removed, kept``; ``kept`` are the remaining words joined by one space (UTF-8).

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of ``window`` words (at most 63)
    around it has another occurrence in any row, this one included. Null and empty texts have no words; texts of fewer words
    than a window lose nothing; repeated rows count as occurrences of each other; identifiers are not looked at, other
    columns not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    known = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    out = known.join(_marks(known, window), "k1", "left").select("id", "k2", "text", "marks").mapInArrow(
        _cut(window), f"id {kind}, n_words bigint, n_removed bigint, kept binary")
    return out.withColumnRenamed("id", id_column)

"""What has to be known of a block of a CSV file before it can be parsed, computed on whole batches of bytes.

Whether a line starts inside a quoted cell depends on all quotes before it. A line turns the state it starts in (outside or
inside a quoted cell) into the one it ends in; such functions of two states compose associatively, and a prefix composition
over a batch needs only the place of the last line whose end does not depend on its start and the parity of the state changes
since. Lines without quotes change nothing. Quotes of all quoted lines are followed together, one quote of each a step:
outside, a quote opens a cell only behind a delimiter or at the line's start; inside, a doubled quote is a letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

DELIMITERS = (";", ",", "\t")
_EXTRA_BREAKS = re.compile(rb"(?:[\x0b\x0c\x1c-\x1e]|\xe2\x80[\xa8\xa9])\n?")
_QUOTE, _NEWLINE = 34, 10


@dataclass(frozen=True)
class Limits:
    """Bounds of the reader. Records searched for the header, characters the delimiter is guessed from, and the longest cell:
    a file with a longer one is refused and reported."""

    header_window: int = 80
    sniff_chars: int = 10_000
    cell_chars: int = 131_072


DEFAULT_LIMITS = Limits()

SUMMARY_FIELDS = (
    "path string, block long, bytes long, utf8 boolean, undefined_1251 boolean, head array<binary>, "
    "head_is_whole boolean, records array<long>, ends_open array<boolean>"
)
_SUMMARY = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("utf8", pa.bool_()),
    ("undefined_1251", pa.bool_()), ("head", pa.list_(pa.binary())), ("head_is_whole", pa.bool_()),
    ("records", pa.list_(pa.int64())), ("ends_open", pa.list_(pa.bool_())),
])


def physical_lines(lines: list[bytes]) -> bytes:
    """Lines of the text source, each ended by a line feed; form feeds and their kin end a line too."""
    joined = b"\n".join(lines) + b"\n"
    return _EXTRA_BREAKS.sub(b"\n", joined) if _EXTRA_BREAKS.search(joined) else joined


def _ends(data: np.ndarray, quotes: np.ndarray, first: np.ndarray, last: np.ndarray, starts: np.ndarray, delimiter: int,
          inside: bool) -> np.ndarray:
    """Which lines end inside a quoted cell, if all start in this state. Line i has the quotes ``first[i]`` to ``last[i]``."""
    is_open = np.full(len(first), inside)
    at = first.copy()
    going = np.flatnonzero(at < last)
    while len(going):
        quote = quotes[at[going]]
        now = is_open[going]
        opens = ~now & ((quote == starts[going]) | (data[quote - 1] == delimiter))
        doubled = now & (data[quote + 1] == _QUOTE)
        is_open[going] = (now & doubled) | (~now & opens)
        at[going] += 1 + doubled
        going = going[at[going] < last[going]]
    return is_open


def states_before(from_outside: np.ndarray, from_inside: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """State before each line, and after the last, by prefix composition of the lines' functions."""
    fixed = from_outside == from_inside
    changes = np.cumsum(from_outside & ~from_inside)
    latest = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = latest >= 0
    base = np.where(known, from_outside[np.maximum(latest, 0)], start)
    since = changes - np.where(known, changes[np.maximum(latest, 0)], 0)
    after = base ^ (since % 2 == 1)
    return np.append(np.array([start]), after[:-1]), bool(after[-1])


class Block:
    """The profile of one block, fed batch by batch: for every delimiter and starting state the records that start in the
    block and the state at its end."""

    def __init__(self, limits: Limits):
        self.limits, self.variants = limits, [(ord(d), start) for d in DELIMITERS for start in (False, True)]
        self.is_open = [start for _, start in self.variants]
        self.records, self.cell_chars = [0] * len(self.variants), [0] * len(self.variants)
        self.size, self.utf8, self.undefined = 0, True, False
        self.head: list[bytes] = []
        self.head_chars, self.keeps_head = 0, True

    def add(self, lines: list[bytes]) -> None:
        text = physical_lines(lines)
        if self.utf8:
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                self.utf8 = False
        self.undefined = self.undefined or b"\x98" in text
        data = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(data == _NEWLINE)
        starts = np.append(0, ends[:-1] + 1)
        quotes = np.flatnonzero(data == _QUOTE)
        first, last = np.searchsorted(quotes, starts), np.searchsorted(quotes, ends)
        quoted = np.flatnonzero(last > first)
        given = (data, quotes, first[quoted], last[quoted], starts[quoted])
        wanted = np.zeros(len(ends), bool)
        reached = np.append(0, ends + 1)
        for i, (delimiter, start) in enumerate(self.variants):
            before = np.full(len(ends), self.is_open[i])
            ends_open = self.is_open[i]
            if len(quoted):
                effect = [_ends(*given, delimiter, state) for state in (False, True)]
                of_quoted, ends_open = states_before(*effect, self.is_open[i])
                # Between quoted lines the state stays as it is.
                after = np.append(of_quoted[1:], ends_open)
                previous = np.searchsorted(quoted, np.arange(len(ends)), "left") - 1
                before = np.where(previous >= 0, after[np.maximum(previous, 0)], self.is_open[i])
            if not start and self.keeps_head:
                wanted |= self._within(before, ends_open, reached, i)
            if ends_open:  # characters since the last line that ended outside a cell
                outside = np.flatnonzero(~np.append(before[1:], True))
                self.cell_chars[i] = int(reached[-1] - reached[outside[-1] + 1]) if len(outside) else self.cell_chars[i] + int(reached[-1])
            else:
                self.cell_chars[i] = 0
            self.records[i] += int((~before).sum())
            self.is_open[i] = bool(ends_open)
        if self.keeps_head:
            wanted |= self.head_chars + reached[:-1] < 4 * self.limits.sniff_chars
            stop = int(np.argmin(wanted)) if not wanted.all() else len(wanted)
            self.head += text[:reached[stop]].split(b"\n")[:-1]
            self.head_chars += int(reached[stop])
            self.keeps_head = stop == len(wanted)
        self.size += len(text)

    def _within(self, before: np.ndarray, ends_open: bool, reached: np.ndarray, i: int) -> np.ndarray:
        """Lines up to the end of the header window, unless inside a cell beyond the limit."""
        records = self.records[i] + np.cumsum(~before) - ~before
        outside = np.where(before, -1, np.arange(len(before)))
        since = np.maximum.accumulate(outside)
        chars = np.where(since >= 0, reached[:-1] - reached[np.maximum(since, 0)], self.cell_chars[i] + reached[:-1])
        chars = np.where(before, chars, 0)
        return (records <= self.limits.header_window) & (chars <= self.limits.cell_chars)

    def row(self, path: str, block: int) -> tuple:
        return path, block, self.size, self.utf8, self.undefined, self.head, self.keeps_head, self.records, self.is_open


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes]]]:
    """Lines of one block in a batch, in order."""
    block = batch.column(1).to_numpy()
    path = batch.column(0).dictionary_encode().indices.to_numpy()
    cuts = (1 + np.flatnonzero((block[1:] != block[:-1]) | (path[1:] != path[:-1]))).tolist()
    for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.column(0)[begin].as_py(), int(block[begin]), batch.column(2).slice(begin, end - begin).to_pylist()


def summarize(limits: Limits = DEFAULT_LIMITS):
    """(path, block, line) in reading order -> one row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(place: tuple, found: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(found.row(*place), _SUMMARY)], schema=_SUMMARY)

        place, found = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for path, block, lines in _runs(batch):
                if place != (path, block):
                    if found is not None:
                        yield packed(place, found)
                    place, found = (path, block), Block(limits)
                found.add(lines)
        if found is not None:
            yield packed(place, found)
    return run

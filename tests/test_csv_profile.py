"""Block profiles against the csv module, line by line."""

import csv
import random
import re

import pyarrow as pa
import pytest

from fiscalspark.sources import csv_profile as P

_BREAKS = re.compile(rb"[\x0b\x0c\x1c-\x1e]|\xe2\x80[\xa8\xa9]")


def leaves_open(text, delimiter, is_open):
    return len(list(csv.reader(('"' + text if is_open else text, "end"), delimiter=delimiter))) == 1


def by_hand(lines, limits):
    parts = []
    for raw in lines:
        cut = _BREAKS.split(raw)
        parts += cut[:-1] if len(cut) > 1 and not cut[-1] else cut
    records, ends, heads = [], [], 0
    for delimiter in P.DELIMITERS:
        for start in (False, True):
            is_open, n, within = start, 0, 0
            for i, line in enumerate(parts):
                if not start and n <= limits.header_window:
                    within = i + 1
                n += not is_open
                is_open = leaves_open(line.decode("latin1"), delimiter, is_open)
            records.append(n)
            ends.append(is_open)
            heads = max(heads, within)
    size, by_size = 0, 0
    for i, line in enumerate(parts):
        by_size = i + 1 if size < 4 * limits.sniff_chars else by_size
        size += len(line) + 1
    return records, ends, size, parts[:max(heads, by_size)]


def profile(lines, batch_rows, limits=P.DEFAULT_LIMITS):
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("line", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(["p"] * len(part)), pa.array([7] * len(part), pa.int64()), pa.array(part, pa.binary())],
                                          schema=schema) for part in (lines[i:i + batch_rows] for i in range(0, len(lines), batch_rows))]
    row, = [r for b in P.summarize(limits)(batches) for r in b.to_pylist()]
    return row


@pytest.mark.parametrize("alphabet", ['a";', 'ab"";;,"\t', 'a"', '";\x0c"я', 'a;,\t '])
def test_random_quotes(alphabet):
    rng = random.Random(alphabet)
    for _ in range(150):
        lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))).encode(rng.choice(["utf-8", "cp1251"])) for _ in range(rng.randint(1, 30))]
        row = profile(lines, rng.randint(1, 31))
        records, ends, size, head = by_hand(lines, P.DEFAULT_LIMITS)
        assert (row["records"], row["ends_open"], row["bytes"], row["head"]) == (records, ends, size, head)


def test_head_ends_with_the_header_window():
    rng = random.Random(2)
    limits = P.Limits(header_window=5, sniff_chars=20)
    for _ in range(100):
        lines = [("".join(rng.choice('xy;"') for _ in range(rng.randint(0, 30)))).encode() for _ in range(60)]
        row = profile(lines, rng.randint(1, 40), limits)
        assert row["head"] == by_hand(lines, limits)[3] and row["head_is_whole"] == (len(row["head"]) == 60)


def test_long_cells_and_bytes_of_other_encodings():
    lines = [b'a;"' + b"x" * 300_000, b"y" * 300_000, b'z";b', b"\x98\xff"]
    row = profile(lines, 2)
    assert row["records"][0] == 2 and not row["ends_open"][0] and not row["utf8"] and row["undefined_1251"]

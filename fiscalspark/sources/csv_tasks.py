"""What a Python worker does with the physical lines of one file block.

A file is read as line-aligned blocks, so a file of any size is spread over many tasks. Two things
then have to be known about a block before it can be parsed: how many records precede it, and whether
it starts inside a quoted cell that an earlier block opened. ``summarize`` states both as a function
of the unknown starting state (see `csv_profile`), ``index_blocks`` chains these functions along each file
(a few numbers per block), and ``parse`` reads the records.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

from fiscalspark.sources.csv_profile import DEFAULT_LIMITS, DELIMITERS, Limits

MIN_HEADER_CELLS = 5
REQUIRED_HEADERS = {"бюджет", "датапроводки"}
HEADER_FIRST_GROUPS = ("agreements", "gz")
HASH_PIECE = 1 << 20
OUTPUT_ROWS = 4_096
ARCHIVE_CHUNK = 32 << 20

_EXTRA_BREAKS = re.compile(rb"[\x0b\x0c\x1c-\x1e]|\xe2\x80[\xa8\xa9]")
_END = "\x03end of block\x03"

BLOCK_FIELDS = (
    "path string, block long, encoding string, delimiter string, starts_open boolean, first_record long, "
    "header_row_index long, headers array<string>, records_total long, problem string"
)
RECORD_FIELDS = "path string, record long, block long, cells array<string>, is_fragment boolean, problem string"
RECORD_ARROW = pa.schema([
    ("path", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("cells", pa.list_(pa.string())),
    ("is_fragment", pa.bool_()), ("problem", pa.string()),
])
CHUNK_FIELDS = "archive string, path string, block long, size long, content binary, problem string"
CHUNK_ARROW = pa.schema([
    ("archive", pa.string()), ("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()),
    ("content", pa.binary()), ("problem", pa.string()),
])


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, OUTPUT_ROWS)):
        columns = zip(*chunk)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(columns, schema)], schema=schema
        )


def _lines(line: bytes) -> list[bytes]:
    """Form feeds and their kin end a line too."""
    parts = _EXTRA_BREAKS.split(line)
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    return parts


def header_key(text: str) -> str:
    return re.sub("[^a-zа-я0-9]+", "", text.lower().replace("ё", "е"))


def _delimiter_of(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return max(DELIMITERS, key=sample.count)


def _header_index(window: list[list[str]], group: str) -> int:
    if group in HEADER_FIRST_GROUPS:
        return 0
    by_name = (i for i, row in enumerate(window) if REQUIRED_HEADERS <= {header_key(cell) for cell in row})
    by_width = (i for i, row in enumerate(window) if sum(bool(cell.strip()) for cell in row) >= MIN_HEADER_CELLS)
    return next(itertools.chain(by_name, by_width, [0]))


def index_blocks(limits: Limits = DEFAULT_LIMITS):
    """Block summaries of one file -> encoding, delimiter, header and the state every block starts in."""
    return lambda pdf: _index_file(pdf, limits)


def _index_file(pdf, limits: Limits):
    import pandas as pd

    csv.field_size_limit(limits.cell_chars)
    pdf = pdf.sort_values("block")
    if pdf["utf8"].all():
        encoding = "utf-8-sig"
    else:
        encoding = "latin1" if pdf["undefined_1251"].any() else "cp1251"
    head: list[bytes] = []
    for lines, whole in zip(pdf["head"], pdf["head_is_whole"]):
        head.extend(lines)
        if not whole:
            break
    text = [line.decode(encoding) for line in head]
    delimiter = _delimiter_of("\n".join(text)[:limits.sniff_chars])
    problem = None
    rows: list[list[str]] = []
    try:
        rows = list(itertools.islice(csv.reader(text, delimiter=delimiter), limits.header_window))
    except csv.Error as error:
        problem = str(error)
    header = _header_index(rows, pdf["source_group"].iloc[0])
    headers = [cell.strip() or f"column_{i + 1}" for i, cell in enumerate(rows[header])] if rows else []

    which = 2 * DELIMITERS.index(delimiter)
    is_open, total, starts = False, 0, []
    for records, ends_open, size in zip(pdf["records"], pdf["ends_open"], pdf["bytes"]):
        starts.append((is_open, total))
        state = which + is_open
        if is_open and records[state] == 0 and ends_open[state] and size > limits.cell_chars:
            problem = problem or f"field larger than field limit ({limits.cell_chars})"
        total += int(records[state])
        is_open = bool(ends_open[state])
    count = len(starts)
    return pd.DataFrame({
        "path": pdf["path"].to_list(), "block": pdf["block"].to_list(), "encoding": encoding,
        "delimiter": delimiter, "starts_open": [s for s, _ in starts], "first_record": [n for _, n in starts],
        "header_row_index": header, "headers": [headers] + [None] * (count - 1),
        "records_total": total, "problem": problem,
    })


def _parse_block(path: str, block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    first = next(rows)
    _, _, _, encoding, delimiter, starts_open, number, header = first
    pending: list[str] = []

    def feed() -> Iterator[str]:
        if starts_open:
            yield '"'
        for row in itertools.chain([first], rows):
            for line in _lines(row[2]):
                text = line.decode(encoding)
                pending.append(text)
                yield text
        pending.append(_END)
        yield _END

    number -= bool(starts_open)
    continues = starts_open
    try:
        for cells in csv.reader(feed(), delimiter=delimiter):
            lines = pending[:]
            pending.clear()
            if lines[-1] is _END:
                if len(lines) > 1:  # the block ends inside a quoted cell
                    yield path, number, block, lines[:-1], True, None
                break
            if continues:
                yield path, number, block, lines, True, None
            elif number > header:
                yield path, number, block, [cell.strip() for cell in cells], False, None
            continues = False
            number += 1
    except csv.Error as error:
        yield path, number, block, None, False, str(error)
        for _ in rows:  # leave the iterator at the next block
            pass


def parse(limits: Limits = DEFAULT_LIMITS):
    """(path, block, line, encoding, delimiter, starts_open, first_record, header) -> records."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(limits.cell_chars)
        groups = itertools.groupby(_rows(batches), key=lambda row: row[:2])
        rows = (record for (path, block), group in groups for record in _parse_block(path, block, group))
        yield from _emit(rows, RECORD_ARROW)
    return run


def join_fragments(limits: Limits = DEFAULT_LIMITS):
    """(path, record, lines, delimiter) of a record cut by block borders -> that record."""
    return lambda batches: _join_fragments(batches, limits)


def _join_fragments(batches, limits: Limits) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(limits.cell_chars)

    def rows() -> Iterator[tuple]:
        for path, record, lines, delimiter in _rows(batches):
            try:
                cells = next(csv.reader(lines, delimiter=delimiter), [])
                yield path, record, None, [cell.strip() for cell in cells], False, None
            except csv.Error as error:
                yield path, record, None, None, False, str(error)

    yield from _emit(rows(), RECORD_ARROW)


def hash_files(batches) -> Iterator[pa.RecordBatch]:
    """(path, address) -> (path, SHA-256), read in pieces from any store that pyarrow's file systems open."""
    from urllib.parse import unquote

    schema = pa.schema([("path", pa.string()), ("sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        for path, address in _rows(batches):
            place = re.sub("^file:/*", "/", address)
            files, name = (fs.LocalFileSystem(), unquote(place)) if place != address else fs.FileSystem.from_uri(address)
            digest = hashlib.sha256()
            with files.open_input_stream(name) as stream:
                while piece := stream.read(HASH_PIECE):
                    digest.update(piece)
            yield path, digest.hexdigest()

    yield from _emit(rows(), schema)


def _escapes(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    depth = 0
    for part in parts:
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            return True
    return name.startswith(("/", "\\")) or re.match("[A-Za-z]:", name) is not None


def _expand(archive: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as opened:
            members = [m for m in opened.infolist() if not m.is_dir()]
            unsafe = [m.filename for m in members if _escapes(m.filename)]
            if unsafe:
                yield archive, unsafe[0], 0, 0, None, f"unsafe archive path: {unsafe[0]}"
                return
            for member in members:
                with opened.open(member) as stream:
                    offset, rest = 0, b""
                    while True:
                        data = stream.read(ARCHIVE_CHUNK)
                        if not data:
                            break
                        chunk, newline, rest_of = (rest + data).rpartition(b"\n")
                        rest = rest_of
                        if newline:
                            yield archive, member.filename, offset, member.file_size, chunk + newline, None
                            offset += len(chunk) + 1
                    if rest or not offset:
                        yield archive, member.filename, offset, member.file_size, rest, None
    except zipfile.BadZipFile as error:
        yield archive, None, 0, 0, None, str(error)


def expand_archives(batches) -> Iterator[pa.RecordBatch]:
    """(archive, content) -> newline-aligned chunks of the members; an unsafe archive gives one error row."""
    for row in _rows(batches):
        for out in _expand(*row):  # a chunk is large: one row per batch
            yield from _emit(iter([out]), CHUNK_ARROW)


def chunk_lines(batches) -> Iterator[pa.RecordBatch]:
    """(path, block, content) -> (path, block, line, seq)."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("line", pa.binary()), ("seq", pa.int64())])

    def rows() -> Iterator[tuple]:
        for path, block, content in _rows(batches):
            if block == 0 and content.startswith(b"\xef\xbb\xbf"):
                content = content[3:]
            for i, line in enumerate(content.splitlines()):
                yield path, block, line, i

    yield from _emit(rows(), schema)

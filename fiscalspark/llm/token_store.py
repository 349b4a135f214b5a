"""Token identifiers in binary files, in the order of the document identifiers.

Documents are range-partitioned and sorted by identifier; each partition is encoded and written as one file of
independent Zstandard frames, one document each, followed by a frame with the document identifiers and the seek table.
Only one summary row per file goes through a window to give each file the number of identifiers before it. Readers
take any frames of any file by the seek table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fiscalspark.llm import scratch, zframes
from fiscalspark.llm.byte_bpe import byte_characters

#: Pre-tokens, and chunks between spaces, in one generation of a task's memory; the one before is kept, too.
REMEMBERED = 300_000
#: Documents that one read task's unit holds at most, and identifiers in one batch of rows.
UNIT_DOCS = 2_000
BATCH_IDS = 1 << 20
END_ID = 0


class _RunOfSpaces(Exception):
    """A space that does not stand alone."""


class Memory:
    """Encodings seen lately: when a generation is full it becomes the old one, and what is met again moves on."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def find(self, piece: str) -> bytes | None:
        found = self.new.get(piece)
        if found is None and (found := self.old.get(piece)) is not None:
            self.put(piece, found)
        return found

    def put(self, piece: str, encoding: bytes) -> bytes:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[piece] = encoding
        return encoding


class PieceEncoder:
    """A tokenizers file, encoded pre-token by pre-token with a memory of those seen.

    ``pattern`` is the splitting pattern of the file's pre-tokenizer; each pre-token then goes straight to the library's
    model. If the file is not of this kind (byte-level, no prefix space, its own pattern, no normaliser) or cuts a probe
    otherwise, no pattern is used. A text that holds an added token, and every text without a pattern, goes to the library
    whole.
    """

    #: Letters, digits, signs, contractions and white space of several kinds, for the comparison of patterns.
    PROBE = "It's  they'LL we'd\t12ab34 é日本 \n\n x,y;.. \u00a0\u2003z²½ \U0001f600!  "

    _made: dict = {}

    def __init__(self, path: str, pattern: str | None):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(pattern).findall if pattern and self._is_of(pattern) else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.shown = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.space = chr(self.shown[32])
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known, self.chunks = Memory(REMEMBERED), Memory(REMEMBERED)

    def _is_of(self, pattern: str) -> bool:
        """Does the file's pre-tokenizer cut as the pattern does?"""
        import json

        import regex

        stated = json.loads(self.tokenizer.to_str())
        before = stated.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or stated.get("normalizer"):
            return False
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.PROBE)]
        return spans == [m.span() for m in regex.finditer(pattern, self.PROBE)]

    @classmethod
    def shared(cls, path: str, pattern: str | None) -> PieceEncoder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, piece: str) -> bytes:
        found = self.known.find(piece)
        if found is None and piece[0] == " ":
            found = self.chunks.find(piece[1:])
        return self.known.put(piece, self._merge(piece) if found is None else found)

    def _merge(self, piece: str) -> bytes:
        ids = self.ids
        return b"".join([ids[t.id] for t in self.merge(piece.encode().decode("latin-1").translate(self.shown))])

    def _cut(self, text: str) -> bytes:
        known, learn = self.known.new, self._learn
        return b"".join([known.get(p) or learn(p) for p in self.cut(text)])

    def _learn_chunk(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _RunOfSpaces
        if (out := self.chunks.find(chunk)) is not None:
            return out
        word, end = chunk[:-1], chunk[-1]
        if chunk.isalpha():  # one pre-token; plain letters stand for themselves
            ids = self.ids
            out = b"".join([ids[t.id] for t in self.merge(self.space + chunk)]) if chunk.isascii() else self._merge(f" {chunk}")
        elif end in ",." and word.isalpha():  # two
            out = self._learn_chunk(word) + (self.known.new.get(end) or self._learn(end))
        else:
            out = self._cut(f" {chunk}")
        return self.chunks.put(chunk, out)

    def encode(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers.

        No pre-token reaches over the begin of a space that stands between two other characters, so what such spaces
        part is looked up as a whole first. A text with longer runs of white space is cut by the pattern alone."""
        if not self.cut or any(t in text for t in self.added):
            return self._whole(text)
        head, *rest = text.split(" ")
        if rest and (not head or head[-1].isspace()):
            return self._cut(text)
        chunks, learn = self.chunks.new, self._learn_chunk
        try:
            return self._cut(head) + b"".join([chunks.get(c) or learn(c) for c in rest])
        except _RunOfSpaces:
            return self._cut(text)


def _writer(folder: str, path: str, pattern: str | None, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, attempt = PieceEncoder.shared(path, pattern), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, ids, n_tokens = f"part-{part:05d}.ids.zst", [], 0
        with zframes.part_file(folder, name, attempt) as out:
            while first is not None:
                ids.append(first.column(0))
                for text in first.column(1).to_pylist():
                    data = encoder.encode(text or "") + end
                    out.add(data)
                    n_tokens += len(data) // 4
                first = next(batches, None)
            sink = pa.BufferOutputStream()
            listed = pa.table([pa.chunked_array(ids)], ["id"])
            with pa.ipc.new_stream(sink, listed.schema) as stream:
                stream.write_table(listed)
            out.add(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([listed.num_rows], pa.int64()),
            pa.array([n_tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])
    return write


def write(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str | None = None, id_column: str = "doc_id",
          text_column: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write the files; returns one row per file: ``shard, path, n_docs, n_tokens, start``.

    ``start`` is the number of identifiers in all files before. Null text is empty and gets the end identifier alone;
    a null document identifier sorts first; rows that repeat an identifier are all written, in the order of their
    texts' hashes. An empty table gives no file. Other columns are not read. ``files`` is the number of ranges.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("h"))
    ordered = rows.repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    schema = "shard int, path string, n_docs bigint, n_tokens bigint"
    shards = scratch.keep(ordered.mapInArrow(_writer(folder, tokenizer_path, pattern, end_id), schema), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(id_type: pa.DataType):
    def batch_of(ids: list, starts: list, data: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["id", "start", "ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                with zframes.open_frames(unit["path"]) as frames:
                    listed = pa.ipc.open_stream(frames.frame(len(frames) - 1)).read_all().column("id")
                    begin, end = unit["first"], min(unit["first"] + UNIT_DOCS, len(listed))
                    names = listed.slice(begin, end - begin).to_pylist()
                    before = np.cumsum(frames.sizes // 4) - frames.sizes // 4
                    ids, starts, data, held = [], [], [], 0
                    for k, name in enumerate(names, begin):
                        ids.append(name)
                        starts.append(unit["start"] + int(before[k]))
                        data.append(frames.frame(k))
                        held += len(data[-1]) // 4
                        if held >= BATCH_IDS:
                            yield batch_of(ids, starts, data)
                            ids, starts, data, held = [], [], [], 0
                    yield batch_of(ids, starts, data)
    return read


def read(spark: SparkSession, shards: DataFrame, id_type: str, id_column: str = "doc_id") -> DataFrame:
    """``<id>, start, ids binary`` of every document of the files, ids as little-endian unsigned 32-bit integers."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    units = shards.select("path", "start", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("n_docs") - 1, F.lit(0)), F.lit(UNIT_DOCS).cast("bigint"))).alias("first"))
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first")
    kind = to_arrow_type(_parse_datatype_string(id_type))
    return units.mapInArrow(_reader(kind), f"id {id_type}, start bigint, ids binary").withColumnRenamed("id", id_column)


def fetch(address: str, wanted: set) -> dict:
    """Identifiers of some documents of one file, decompressing no other frames."""
    with zframes.open_frames(address) as frames:
        listed = pa.ipc.open_stream(frames.frame(len(frames) - 1)).read_all().column("id").to_pylist()
        return {name: np.frombuffer(frames.frame(k), "<u4").tolist() for k, name in enumerate(listed) if name in wanted}

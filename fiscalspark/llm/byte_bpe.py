"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every token of the vocabulary becomes a piece whose characters stand for its bytes, one printable character per byte
value, with the negative rank as score; the normaliser is the identity. Merging the best-scored neighbours is then
merging by lowest rank. Texts are cut by the pattern first, each cut is encoded on its own, and a cut that is itself
a token is that token, as rank-based encoders have it. Decoding maps identifiers back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Distinct pre-tokens whose encoding a task remembers; then it starts anew.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte value: itself where it is printable Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | bool | str) -> bytes:
    """A protocol-buffer field: lengths for strings and messages, varints for numbers."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model of a vocabulary in rank order; the unknown piece has the identifier after the last."""
    import struct

    shown = byte_characters()
    unknown = len(tokens)

    def piece(text: str, score: float, kind: int) -> bytes:
        # Fixed field numbers of the public model format: piece 1, score 2 (32-bit float), type 3.
        return _field(1, _field(1, text) + b"\x15" + struct.pack("<f", score) + _field(3, kind))

    normal, unk = 1, 2
    pieces = b"".join(piece("".join(shown[b] for b in t), -float(rank), normal) for rank, t in enumerate(tokens))
    # Trainer: model_type 3 = BPE (2), unk_id 40, bos_id 41, eos_id 42, pad_id 43; no word-boundary treatment.
    trainer = _field(3, 2) + _field(24, False) + _field(40, unknown) + b"".join(_field(n, -1) for n in (41, 42, 43))
    # Normaliser: name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5.
    normaliser = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return pieces + piece("<unk>", 0.0, unk) + _field(2, trainer) + _field(3, normaliser)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, in the order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have gaps")
    return [token for _, token in ranked]


class Codec:
    """Encodes and decodes with one model; made once in each Python worker."""

    _made: dict = {}

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        shown = byte_characters()
        self.shown = {b: ord(c) for b, c in enumerate(shown)}
        self.cut = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.by_text = {str(i): t for i, t in enumerate(tokens)}
        self.known: dict[str, str] = {}

    @classmethod
    def shared(cls, key: object, tokens: list[bytes], pattern: str) -> Codec:
        if key not in cls._made:
            cls._made[key] = cls(tokens, pattern)
        return cls._made[key]

    def _learn(self, piece: str) -> str:
        raw = piece.encode()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        whole = self.ids.get(raw)
        ids = [whole] if whole is not None else self.sp.encode(raw.decode("latin-1").translate(self.shown))
        out = self.known[piece] = " ".join(map(str, ids))
        return out

    def encode(self, text: str) -> str:
        """Decimal identifiers joined by one space."""
        known, learn = self.known, self._learn
        return " ".join([known.get(p) or learn(p) for p in self.cut(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split()))


def _mapper(vocabulary, path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared((path, pattern), vocabulary.value, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                encoded = codec.encode(text or "")
                counts.append(encoded.count(" ") + 1 if encoded else 0)
                if digests:
                    ids.append(hashlib.sha256(encoded.encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(encoded)).hexdigest())
                else:
                    ids.append([int(x) for x in encoded.split()])
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])
    return run


def _decoder(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value
        for batch in batches:
            out = [None if ids is None else b"".join(tokens[i] for i in ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])
    return run


def _vocabulary(spark: SparkSession, path: str):
    """The tokens in a broadcast: its size is that of the rank file, whatever the corpus."""
    return spark.sparkContext.broadcast(read_ranks(path))


def _rows(docs: DataFrame, id_column: str, value_column: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_column).alias("id"), F.col(value_column).alias("value"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """``<id>, ids array<int>`` per row, in any order of rows. Null and empty texts give an empty array; repeated rows
    repeat; other columns are not read. A text of any length is one row."""
    rows, kind = _rows(docs, id_column, text_column)
    run = _mapper(_vocabulary(docs.sparkSession, ranks_path), ranks_path, pattern, digests=False)
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``<id>, decoded binary`` per row of identifiers; null stays null, an identifier outside the vocabulary fails."""
    rows, kind = _rows(encoded, id_column, ids_column)
    run = _decoder(_vocabulary(encoded.sparkSession, ranks_path))
    return rows.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_column)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """``<id>, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes what it encoded, and keeps only digests, so that
    no identifiers leave the task. Nulls, empties and repeats as in `encode`."""
    rows, kind = _rows(docs, id_column, text_column)
    run = _mapper(_vocabulary(docs.sparkSession, ranks_path), ranks_path, pattern, digests=True)
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)

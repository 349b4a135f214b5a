import base64
import hashlib

import numpy as np
import pytest

from fiscalspark.llm import byte_bpe, scratch, token_store, zframes
from tests.llm import cases

P = pytest.importorskip("public_tokenizers")


def test_bpe_is_that_of_the_rank_library(spark):
    import tiktoken

    docs = cases.documents(spark)
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in docs.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert cases.rows_of(byte_bpe.round_trip_digests(docs, path, P.PATTERN)) == sorted(expected, key=repr)
    encoded = byte_bpe.encode(docs, path, P.PATTERN)
    decoded = byte_bpe.decode(encoded, path)
    assert sorted(bytes(r["decoded"]) for r in decoded.collect()) == sorted((r["text"] or "").encode() for r in docs.collect())
    assert byte_bpe.round_trip_digests(docs.where("false"), path, P.PATTERN).collect() == []


def test_every_token_of_the_vocabulary_encodes_to_itself():
    path = P.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(byte_bpe.read_ranks(path), P.PATTERN)
    for i in range(0, len(codec.tokens), 37):
        try:
            text = codec.tokens[i].decode()
        except UnicodeDecodeError:
            continue
        if len(codec.cut(text)) == 1:
            assert codec.encode(text) == str(i)


def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    docs, folder = cases.documents(spark), scratch.new_folder(spark, "test-ids")
    shards = token_store.write(docs, folder, P.path("byte_bpe_50k.json"), P.PATTERN, files=3)
    got = token_store.read(spark, shards, "bigint").selectExpr("doc_id", "start", "ids").collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(
        [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert found == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert in_order == sorted(in_order)
    path = shards.where("n_docs > 0").first()["path"]
    some = next(r for r in got if r["doc_id"] == 12)
    hits = [token_store.fetch(r["path"], {some["doc_id"]}) for r in shards.collect()]
    assert [h[12] for h in hits if h] == [np.frombuffer(some["ids"], "<u4").tolist()] and path.endswith(".ids.zst")


def test_token_files_of_an_empty_table(spark):
    docs, folder = cases.documents(spark).where("false"), scratch.new_folder(spark, "test-ids")
    shards = token_store.write(docs, folder, P.path("byte_bpe_50k.json"), P.PATTERN, files=3)
    assert token_store.read(spark, shards, "bigint").collect() == []


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "  two  spaces ", "don't 's x'll", "\x00\x1c a", "x,y. z,", "½Ⅷ² 1a", ""])
def test_pieces_are_encoded_as_the_whole(text):
    encoder = token_store.PieceEncoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert encoder.encode(text) == encoder._whole(text)


def test_frames_are_found_checked_and_plain_zstandard(tmp_path):
    import io

    import zstandard

    with zframes.part_file(f"file://{tmp_path}", "x.zst", 0) as out:
        for i in range(5):
            out.add(bytes([i]) * (i * 1000))
    raw = (tmp_path / "x.zst").read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(bytes([i]) * (i * 1000) for i in range(5))
    reader = zframes.FrameReader(io.BytesIO(raw))
    assert reader.frame(3) == bytes([3]) * 3000 and reader.frame(0) == b"" and len(reader) == 5
    table = bytearray(raw)
    table[-9 - 12 + 8] ^= 1  # the checksum of the last frame
    with pytest.raises(ValueError):
        zframes.FrameReader(io.BytesIO(bytes(table))).frame(4)
    assert [p.name for p in tmp_path.iterdir()] == ["x.zst"]


def test_memory_of_two_generations_and_the_check_of_the_pattern(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from fiscalspark.llm import token_store

    monkeypatch.setattr(token_store, "REMEMBERED", 3)
    encoder, library = token_store.PieceEncoder(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = "one two, three. four.\nFive two, one seven é日 one. two\nthree  four one"
    for part in (text, text[::-1], text):
        ids = library.encode(part, add_special_tokens=False).ids
        assert encoder.encode(part) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert len(encoder.chunks.new) <= 3 and len(encoder.chunks.old) <= 3
    assert encoder.cut and token_store.PieceEncoder(P.path("byte_bpe_50k.json"), r"\S+|\s+").cut is None
    assert token_store.PieceEncoder(P.path("word_bpe_49k.json"), P.PATTERN).cut is None

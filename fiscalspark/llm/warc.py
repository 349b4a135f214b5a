"""Web archives (WARC 1.1) in seekable Zstandard bundles.

Every row becomes a response record, or a revisit record that refers to the record with the same payload and the
smallest identifier. Records are grouped into independent frames; a seek table ends each file, and the index maps a
record identifier to its file, frame and offset inside the frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscalspark.llm import scratch, zframes

#: Payloads below this size are never replaced by a reference.
LEAST_SHARED = 100
#: Bytes of records after which a frame is closed; frames that one unit of reading holds.
FRAME_BYTES = 1 << 18
UNIT_FRAMES = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, path string, frame int, offset int, length int"


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    name = f"urn:page:{quote(record_id, safe='') if record_id is not None else ''}"
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else name
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        lines[2:2] = [("WARC-Refers-To", f"<urn:page:{quote(refers_to, safe='')}>"), ("WARC-Profile", PROFILE)]
    return _header(lines, "WARC/1.1") + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset, and the offset behind it."""
    from urllib.parse import unquote

    def name(value: str) -> str | None:
        return unquote(value[len("<urn:page:"):-1]) or None

    def headers(begin: int, end: int) -> tuple[str, dict]:
        first, *rest = data[begin:end].decode().split("\r\n")
        return first, dict(line.split(": ", 1) for line in rest)

    body = data.index(b"\r\n\r\n", at)
    version, lines = headers(at, body)
    if version != "WARC/1.1":
        raise ValueError("no record here")
    body += 4
    end = body + int(lines["Content-Length"])
    payload_at = data.index(b"\r\n\r\n", body, end) + 4
    _, http = headers(body, payload_at - 4)
    kind = lines["WARC-Type"]
    return {
        "record_id": name(lines["WARC-Record-ID"]), "url": lines["WARC-Target-URI"], "record_type": kind,
        "refers_to": name(lines["WARC-Refers-To"]) if "WARC-Refers-To" in lines else None,
        "stated_bytes": int(http["Content-Length"]), "stated_digest": lines["WARC-Payload-Digest"].partition(":")[2],
        "payload": data[payload_at:end] if kind == "response" else None,
    }, end + 4


def _writer(folder: str, date: str, frame_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.warc.zst"
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with zframes.part_file(folder, name, context.taskAttemptId()) as out:
            held, index, size = [], [], 0
            while batch is not None:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for record_id, url, payload, digest, refers_to in rows:
                    data = record(record_id, url, payload, digest, refers_to, date)
                    if held and size + len(data) > frame_bytes:
                        out.add(b"".join(held))
                        held, size = [], 0
                    index.append((record_id, f"{folder}/{name}", len(out.entries), size, len(data)))
                    held.append(data)
                    size += len(data)
                if index:
                    columns = list(zip(*index, strict=True))
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["record_id", "path", "frame", "offset", "length"])
                    index = []
                batch = next(batches, None)
            out.add(b"".join(held))
    return write


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
          date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write one archive per partition; returns the index: ``record_id, path, frame, offset, length``.

    Null html is an empty payload. Of equal payloads of at least ``LEAST_SHARED`` bytes the one with the smallest
    identifier is the response, the others revisit it; rows that repeat this identifier are responses, and so are all
    rows of a group without identifiers. A missing url is replaced by the record's own name. An empty table gives no
    file. The shared payloads are found by an aggregate on digests; its few repeated digests are joined back from a
    written table, so that a digest with very many rows can be split.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    shared = scratch.keep(shared.select("digest", "first"), "shared-payloads")
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    linked = rows.join(shared, "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", refers_to.cast("string").alias("refers_to"))
    return scratch.keep(linked.mapInArrow(_writer(folder, date, frame_bytes), INDEX), "warc-index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(),
             "stated_bytes": pa.int64(), "stated_digest": pa.string(), "payload": pa.binary()}
    for batch in batches:
        for unit in batch.to_pylist():
            with zframes.open_frames(unit["path"]) as frames:
                for k in range(unit["first"], min(unit["first"] + UNIT_FRAMES, len(frames))):
                    data, at, found = frames.frame(k), 0, []
                    while at < len(data):
                        one, at = parse(data, at)
                        found.append(one)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in found], t) for n, t in kinds.items()], list(kinds))


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the indexed archives: ``record_id, url, record_type, refers_to, stated_bytes, stated_digest,
    payload`` (no payload for revisits). Units of some frames are dealt over all tasks."""
    units = index.groupBy("path").agg(F.max("frame").alias("last")).select(
        "path", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(UNIT_FRAMES))).alias("first"))
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first")
    return units.mapInArrow(_reader, "record_id string, url string, record_type string, refers_to string, "
                                     "stated_bytes bigint, stated_digest string, payload binary")


def fetch(path: str, frame: int, offset: int) -> dict:
    """One record by its place in the index; only its frame is decompressed."""
    with zframes.open_frames(path) as frames:
        return parse(frames.frame(frame), offset)[0]

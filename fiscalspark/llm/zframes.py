"""Files of independent Zstandard frames with a seek table at the end (the public seekable format).

The seek table is a skippable frame that lists, per frame, the compressed size, the size of the contents and the low
half of their 64-bit xxHash; its last nine bytes give the number of frames, a flag byte and a magic number. Any
Zstandard reader can read such a file from front to back; `FrameReader` reads chosen frames only.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
import zstandard
from pyarrow import fs as pafs

# Fixed values of the format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    def __init__(self, sink: io.RawIOBase, level: int = 3):
        self.sink = sink
        self.entries: list[tuple[int, int, int]] = []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def add(self, data: bytes) -> int:
        """Write one frame; returns its number."""
        packed = self.pack.compress(data)
        self.sink.write(packed)
        self.entries.append((len(packed), len(data), checksum(data)))
        return len(self.entries) - 1

    def finish(self) -> None:
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size) + table)
        self.sink.write(FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE))


class FrameReader:
    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < FOOTER.size + 8:
            raise ValueError("no seek table")
        source.seek(size - FOOTER.size)
        count, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        source.seek(size - FOOTER.size - 12 * count)
        self.entries = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.sizes = self.entries[:, 1].astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def frame(self, i: int) -> bytes:
        self.source.seek(int(self.offsets[i]))
        data = self.unpack.decompress(self.source.read(int(self.entries[i, 0])), max_output_size=int(self.sizes[i]) or 1)
        if len(data) != self.sizes[i] or checksum(data) != int(self.entries[i, 2]):
            raise ValueError(f"frame {i} is damaged")
        return data


@contextmanager
def part_file(folder: str, name: str, attempt: int, level: int = 3) -> Iterator[FrameWriter]:
    """A file of the folder (any address that pyarrow's file systems open), whole or not there at all.

    It is written under the attempt's own name and renamed at the end, so a task that is run again or twice at a time
    leaves the same file."""
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/_{name}.{attempt}") as sink:
        writer = FrameWriter(sink, level)
        yield writer
        writer.finish()
    files.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")


@contextmanager
def open_frames(address: str) -> Iterator[FrameReader]:
    files, path = pafs.FileSystem.from_uri(address)
    with files.open_input_file(path) as source:
        yield FrameReader(source)

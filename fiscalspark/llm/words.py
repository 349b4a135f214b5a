"""Words of many texts at once as 64-bit hashes, in numpy, for use inside Spark tasks.

Texts are handled as UTF-8 bytes. A 256-byte table lower-cases A-Z and turns every separator into a space; bytes of
characters beyond ASCII are word bytes, so that byte-wise and character-wise splitting agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
BY_SPACE = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in _LOWER)
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
BY_ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)

_FACTOR = 0x9E3779B97F4A7C15
#: Bytes of text that one round of vector operations takes; a longer text is a round of its own.
ROUND_BYTES = 1 << 21
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors by position in an n-gram.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_FACTOR)) | np.uint64(1)


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        factors = np.full(max(size, 1 << 12), _FACTOR, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors)
    return _powers


@dataclass
class Words:
    """Words of some texts: those of text i are ``hashes[first[i]:first[i + 1]]``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    joined: bytes

    def text(self, i: int) -> bytes:
        return self.joined[self.starts[i]:self.ends[i]]


def split(texts: list[bytes], table: bytes) -> Words:
    joined = (b" ".join(texts) + b" ").translate(table)
    codes = np.frombuffer(joined, np.uint8)
    inside = codes != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    at = np.flatnonzero(inside)
    if len(at):
        position = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = (codes[at].astype(np.uint64) + np.uint64(1)) * _power_table(int(lengths.max()))[position]
        hashes = mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths))
    else:
        hashes = np.zeros(0, np.uint64)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, joined)


def rounds(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `ROUND_BYTES`, each with the index of its first."""
    begin, held, size = 0, [], 0
    for text in texts:
        if held and size + len(text) > ROUND_BYTES:
            yield begin, held
            begin, held, size = begin + len(held), [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield begin, held


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out += hashes[j:j + size] * PLACES[j]
    return mix(out)

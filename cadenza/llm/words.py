"""Vectorised word work on Arrow text batches, shared by the operators on whole texts.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; those
separators are ASCII, so splitting UTF-8 bytes splits code points alike.  Texts of a
batch are handled together, as one byte array with offsets; every hash is a 64-bit
polynomial over random byte codes, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at a time; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class Words:
    """The words of the texts of one chunk.

    ``data``: bytes; ``offs``: text offsets; ``start``, ``end``: byte ranges of words;
    ``first``: index of each text's first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offs = offs.astype(np.int64)
        inside = ~_SPACE[data]
        before = np.empty(len(data) + 1, bool)
        before[:-1] = inside
        before[-1] = False
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            prev = np.empty(len(data), bool)
            prev[0], prev[1:] = False, inside[:-1]
            heads = self.offs[:-1]
            prev[heads[heads < len(data)]] = False
            after = before[1:].copy()
            tails = self.offs[1:]
            after[tails[tails > 0] - 1] = False
            opens &= ~prev
            closes &= ~after
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offs)

    @property
    def n_texts(self) -> int:
        return len(self.offs) - 1

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def spans_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each range."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U64)
            np.cumsum(_BYTE_CODE[self.data] * _power(_BASE, n), out=total[1:])
            own = (total[end] - total[start]) * _power(_BASE_INV, n + 1)[start]
            return mix(own + (end - start).astype(U64) * U64(_STEP))

    def hashes(self) -> np.ndarray:
        return self.spans_hash(self.start, self.end)

    def code_points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        heads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=heads[1:])
        return heads[end] - heads[start]


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; shorter than h by n - 1 (runs may cross texts)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out *= U64(_STEP)
            out += h[j : j + m]
    return mix(out)


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct, sorted n-word shingle hashes of one text; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, U64)
    return np.unique(roll(h, min(n, len(h))))


def chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about limit bytes; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b

"""Words of whole text columns as numpy arrays, batch by batch.

Texts stay in the buffers Arrow delivers; words are found and hashed for many
documents at once. Work arrays are a few times `BLOCK` bytes, or as large as the
longest single document needs for its word positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer document is hashed in such blocks.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240817)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 4 + 3
_UNBASE = pow(_BASE, -1, 1 << 64)
_ROLL = int(_rng.integers(1 << 60, 1 << 62)) * 4 + 3
_UNROLL = pow(_ROLL, -1, 1 << 64)

_codes = np.arange(256)
#: Bytes that separate words: space and the control characters 9 to 13.
SPACES = (_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D))
#: Bytes outside digits, ASCII letters and multi-byte characters.
PUNCTUATION = (_codes < 0x80) & ~(
    ((_codes >= 0x30) & (_codes <= 0x39))
    | ((_codes >= 0x41) & (_codes <= 0x5A))
    | ((_codes >= 0x61) & (_codes <= 0x7A))
)
_LOWER = _codes + 32 * ((_codes >= 0x41) & (_codes <= 0x5A))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 4096), base, np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if n <= 2 * BLOCK:
            _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of consecutive documents. `first[d]:first[d + 1]` are those of document d."""

    data: np.ndarray  # bytes of the texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # documents + 1

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z taken as a-z if `lower`."""
        table = _BYTES[_LOWER] if lower else _BYTES
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            origin = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, origin + BLOCK, "right")))
            start, end = self.start[at:upto] - origin, self.end[at:upto] - origin
            n = int(end[-1])
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[self.data[origin : origin + n]] * powers(_BASE, n), out=sums[1:])
            out[at:upto] = (sums[end] - sums[start]) * powers(_UNBASE, n)[start]
            at = upto
        return mix(out)

    def windows(self, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every k consecutive words of a document."""
        at = self.inside(k)
        return at, rolling(hashes, k, salt)[at]

    def inside(self, k: int) -> np.ndarray:
        """First words of the runs of k words that lie in one document."""
        if len(self) < k:
            return np.empty(0, np.int64)
        inside = np.ones(len(self) - k + 1, bool)
        for cut in range(1, k):  # a run that starts `cut` words before a document's end
            ends = self.first[1:] - cut
            inside[ends[(ends >= 0) & (ends < len(inside))]] = False
        return np.flatnonzero(inside)


def rolling(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive words, across documents too."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    salted = mix(hashes ^ np.uint64(salt)) if salt else hashes
    np.cumsum(salted * powers(_ROLL, len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_UNROLL, len(hashes))[: len(hashes) - k + 1])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets.astype(np.int64)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about `size` bytes: first, last + 1, bytes, offsets in them."""
    if not len(column):
        return
    data, offsets = texts(column)
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        upto = min(upto, len(offsets) - 1)
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def split(data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = SPACES) -> Words:
    """The words of the documents that lie at `offsets` in `data`."""
    inside = ~delimiters[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets, "left"))


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)

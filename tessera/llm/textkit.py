"""Array kernels over Arrow text columns: word boundaries and 64-bit word hashes without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text is taken in blocks of about so many bytes, so that temporaries stay small; a longer single text is a block.
BLOCK_BYTES = 2 << 20

_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_split_table() -> np.ndarray:
    """Byte -> lower-cased byte, 0 for the six white-space bytes; NUL, which is a word byte, -> 256."""
    t = _lower_table().astype(np.uint16)
    t[0] = 256  # NUL is not white space
    t[_SPACE] = 0
    return t


def space_table() -> np.ndarray:
    """As ``space_split_table``, with letters as they are."""
    t = np.arange(256, dtype=np.uint16)
    t[0] = 256
    t[_SPACE] = 0
    return t


def alnum_table() -> np.ndarray:
    """Byte -> lower-cased byte for 0-9, a-z, A-Z and all bytes of non-ASCII characters, else 0."""
    t = _lower_table().astype(np.uint16)
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    t[~keep] = 0
    return t


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93 | 1
_FIRST, _LENGTH, _PREFIX = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D, 0xDB4F0B9175AE2165))
#: Masks of the first 0 to 8 bytes of a little-endian word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows of about ``limit`` bytes together."""
    if len(col) == 0:
        return
    data, off = text_buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of consecutive rows: byte starts ``s`` and last bytes ``e``, first word of each row in ``edge`` (one more than rows).

    ``low`` holds the folded bytes. A word's hash is a sum over its blocks of eight bytes, each scrambled with its place before
    it is added, so no pattern of letters cancels out as it does in a polynomial of the letters.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        n = len(data)
        if n == 0:
            self.s = self.e = np.empty(0, np.int64)
            self.edge = np.zeros(len(off), np.int64)
            self.low, self.inside = np.zeros(8, np.uint8), np.empty(0, bool)
            return
        folded = table[data]
        inside = folded > 0
        first = np.zeros(n + 1, bool)
        first[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.s, self.e = np.flatnonzero(begins), np.flatnonzero(ends)
        self.edge = np.searchsorted(self.s, off)
        self.low, self.inside = np.zeros(n + 8, np.uint8), inside
        self.low[:n] = folded.astype(np.uint8)  # a word byte that the table marks as 256 is NUL

    def _load(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The first ``size`` (at most 8) folded bytes from each place, as a number."""
        every = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return every[at] & _MASK[size]

    def hashes(self) -> np.ndarray:
        if not len(self.s):
            return np.empty(0, np.uint64)
        size = self.e - self.s + 1
        with np.errstate(over="ignore"):
            h = mix(self._load(self.s, np.minimum(size, 8)) ^ _FIRST)
            long = np.flatnonzero(size > 8)
            if len(long):
                more = (size[long] - 1) // 8
                at = np.cumsum(more) - more
                j = np.arange(more.sum()) - np.repeat(at, more) + 1
                whose = np.repeat(long, more)
                block = mix(self._load(self.s[whose] + 8 * j, np.minimum(size[whose] - 8 * j, 8)) ^ _FIRST)
                h[long] += np.add.reduceat(mix(block ^ mix(j.astype(np.uint64))), at)
            return mix(h ^ size.astype(np.uint64) * _LENGTH)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of the words longer than size bytes, hashes of their first size bytes, of which there are at most 8)."""
        at = np.flatnonzero(self.e - self.s + 1 > size)
        with np.errstate(over="ignore"):
            return at, mix(mix(self._load(self.s[at], size) ^ _PREFIX) + np.uint64(size) * _LENGTH)

    def strings(self) -> pa.StringArray:
        """The folded words as an Arrow column."""
        off = np.concatenate([[0], np.cumsum(self.e - self.s + 1)])
        bytes_ = pa.py_buffer(self.low[: len(self.inside)][self.inside].tobytes())
        kind, width = (pa.StringArray, np.int32) if off[-1] < 1 << 31 else (pa.LargeStringArray, np.int64)
        return kind.from_buffers(len(self.s), pa.py_buffer(off.astype(width)), bytes_)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the index of each row's first word (one more entry than rows), and byte starts of the words."""
    w = Words(data, off, table)
    return w.hashes(), w.edge, w.s


def ngrams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k consecutive entries."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(seed + k))
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(_BASE)
            out ^= out >> np.uint64(29)
    return mix(out)

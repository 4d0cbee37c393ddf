"""Vectorised words, word hashes and word-gram hashes over Arrow text batches.

A batch of texts is one byte buffer with offsets.  Words are found with byte
tables, hashed with a polynomial over 2**64 and mixed; n-gram hashes are the
same polynomial over word hashes.  Work is cut into runs of documents of about
``GROUP_BYTES`` so that memory in a task does not follow the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 2 << 20
_SEGMENT = 1 << 18
#: Bits of a place in the keys that winnowing compares.
_PLACE = 24
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1

#: The separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NON_WORD = np.zeros(256, dtype=bool)
NON_WORD[0x00:0x30] = True
NON_WORD[0x3A:0x61] = True
NON_WORD[0x7B:0x80] = True
NON_WORD[0x41:0x5B] = False  # A-Z count as a-z
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (64-bit avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to a segment's worth is kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _SEGMENT + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 8 * _SEGMENT:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(at: np.ndarray, limit: int = GROUP_BYTES):
    """Runs [i, j) of documents of about ``limit`` bytes; a longer one stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    trim()


def trim() -> None:
    """Give freed memory back to the system: a reused Python worker otherwise keeps
    the most that any batch of any stage took, beside the executor's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table`` (of one-byte values) at each byte; ``take`` would first widen every byte to an index of eight."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def word_bounds(data: np.ndarray, at: np.ndarray, separators: np.ndarray):
    """Starts and ends of words as byte positions, and the first word of each text (n + 1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~mapped(data, separators)
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    first = at[:-1][at[:-1] < len(data)]
    edge[first] = True
    bounds = np.flatnonzero(edge)
    is_word = inside[bounds]
    ends = np.append(bounds[1:], len(data))[is_word]
    starts = bounds[is_word]
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, after ``fold`` (a byte table) if given."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    pw = powers(_BASE, _SEGMENT)
    ipw = powers(inverse(_BASE), _SEGMENT)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > len(pw):  # one very long word
            pw, ipw = powers(_BASE, hi - lo), powers(inverse(_BASE), hi - lo)
        part = data[lo:hi]
        if fold is not None:
            part = mapped(part, fold)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * pw[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * ipw[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


class Grams:
    """Hashes of any run of words in O(1) each, from prefix sums over one group of documents."""

    def __init__(self, hashes: np.ndarray, base: int = _GRAM):
        n = len(hashes)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(hashes * powers(base, n), out=self.total[1:])
        self.ipw = powers(inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.ipw[start] ^ (end - start).astype(np.uint64))


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """The words at which a run of n words of one document starts."""
    here = np.arange(first[-1])
    return here[here + n <= np.repeat(first[1:], np.diff(first))]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i with a full window."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(hashes: np.ndarray, first: np.ndarray, n: int, w: int) -> np.ndarray:
    """Words at which the kept n-grams start: of every w consecutive n-grams of a
    document the least hash, the rightmost of equals.  ``hashes`` has one n-gram
    hash per word of the group; those that leave their document are ignored.
    Two documents that share n + w - 1 consecutive words keep a common n-gram."""
    total = len(hashes)
    if total < n + w - 1:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << _PLACE) - 1)
    starts = gram_starts(first, n + w - 1)
    kept = np.zeros(total, dtype=bool)
    size = (1 << _PLACE) - w
    for lo in range(0, total, size):  # places count within a slice, so that ties are broken alike in texts of any length
        part = hashes[lo : lo + size + w - 1]
        least = sliding_min((part & ~mask) | (mask - np.arange(len(part), dtype=np.uint64)), w)
        mine = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + size)] - lo
        kept[lo + (mask - (least[mine] & mask)).astype(np.int64)] = True
    return np.flatnonzero(kept)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and list lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))

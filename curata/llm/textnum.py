"""Words and windows of Arrow text batches as numpy arrays.

A batch is worked on in pieces of a few MB, whole documents each, so memory is bounded by ``PIECE``
or one document. Hashes are polynomials modulo 2**64 over well mixed word numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Odd multipliers of the polynomials, one for each lane.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null is an empty text."""
    a = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if a.null_count:
        a = a.fill_null("")
    n = len(a)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE):
    """Ranges [i, j) of documents with about ``most`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**0.. and its inverses, at least n of each."""
    got = _POWERS.get(lane)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base, out = BASES[lane], []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1] = np.uint64(b)
            done = 2
            while done < size:
                step = np.uint64(pow(b, done, 1 << 64))
                more = min(done, size - done)
                p[done:done + more] = p[:more] * step
                done += more
            out.append(p)
        got = _POWERS[lane] = tuple(out)
    return got


def prefix(values: np.ndarray, lane: int = 0) -> np.ndarray:
    """Sums of values[k] * base**k, starting with 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(max(1, len(values)), lane)[0][:len(values)], out=out[1:])
    return out


def windows(pre: np.ndarray, at: np.ndarray, size, lane: int = 0) -> np.ndarray:
    """Hash of the ``size`` values from each position ``at``."""
    return mix((pre[at + size] - pre[at]) * powers(len(pre), lane)[1][at])


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each document's words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # a document's end ends its last word
    before = np.r_[False, inside[:-1]]
    start = inside & (~before | edge[:-1])
    starts = np.flatnonzero(start)
    after = np.r_[~inside[1:], True]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words one after another, each byte's place in its word, and each word's first byte there."""
    size = ends - starts
    total = np.r_[0, np.cumsum(size)].astype(np.int64)
    at = np.arange(total[-1]) - np.repeat(total[:-1], size)
    return data[np.repeat(starts, size) + at], at, total[:-1]


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE, lower: np.ndarray | None = None):
    """Starts, ends and 64-bit numbers of all words, and the n + 1 offsets of each document's words."""
    if lower is not None:
        data = lower[data]
    starts, ends, word_off = spans(data, off, separator)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), word_off
    byte, at, first = letters(data, starts, ends)
    p = powers(int(at.max()) + 2)[0]
    return starts, ends, mix(np.add.reduceat((byte.astype(np.uint64) + np.uint64(1)) * p[at], first)), word_off


#: Drawn numbers of a byte at a place of its word, for words of up to 256 bytes, by lane.
_DRAWN: dict[int, np.ndarray] = {}


def _drawn(cell: np.ndarray, lane: int) -> np.ndarray:
    return mix(mix(cell.astype(np.uint64) + np.uint64(BASES[lane])) + np.uint64(lane + 1))


def drawn(byte: np.ndarray, at: np.ndarray, first: np.ndarray, lane: int) -> np.ndarray:
    """64-bit numbers of words as sums of a number drawn for each byte and place.

    Unlike a polynomial modulo 2**64, which strings built for it (Thue-Morse) defeat whatever the base, such
    sums have no structure that a text could follow; numbers of two lanes are independent."""
    if not len(first):
        return np.zeros(0, np.uint64)
    if at.max() < 256:
        cell = (at.astype(np.uint16) << 8) | byte
    else:
        cell = at.astype(np.int64) * 256 + byte
        return mix(np.add.reduceat(_drawn(cell, lane), first))
    if lane not in _DRAWN:
        _DRAWN[lane] = _drawn(np.arange(1 << 16), lane)
    return mix(np.add.reduceat(_DRAWN[lane][cell], first))

"""Words of whole texts as numpy arrays, straight from an Arrow column's buffers.

A word is a run of bytes of one class; both classes used here end a word only at ASCII bytes, so
UTF-8 bytes of other characters never split one. Documents lie side by side in the buffer, and no
word or window crosses from one into the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The ASCII bytes that end a word of each class.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Odd multipliers of the polynomial hashes (modulo 2**64) and the mixer's constants.
_R, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at once.
_CHUNK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def in_word(ends: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(ends)] = False
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(n, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        _powers[int(base)] = have
    return have[:n]


_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))


class Words:
    """The words of an Arrow string or binary column; a null text has none.

    ``start`` and ``end`` index ``data``; the words of row ``i`` are ``first[i]:first[i + 1]``.
    """

    def __init__(self, column: pa.Array, word_byte: np.ndarray, fold: np.ndarray = SAME):
        if column.null_count:
            column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        n, at = len(column), column.offset
        bound = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[bound[0] : bound[-1]] if data is not None and bound[-1] > bound[0] else np.zeros(0, np.uint8)
        bound = bound - bound[0]
        self.data, self.bound, self.rows = fold[raw], bound, n
        inside = word_byte[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = bound[1:-1]
        edge = edge[(edge > 0) & (edge < len(raw))]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bound)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.count)

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial over its bytes, mixed with its length."""
        out = np.empty(len(self), np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(self):
                a = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.end, a + _CHUNK, "right")))
                b = self.end[j - 1]
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * powers(_R, b - a), out=total[1:])
                s, e = self.start[i:j] - a, self.end[i:j] - a
                out[i:j] = (total[e] - total[s]) * powers(_R_INV, b - a)[s] + (e - s).astype(np.uint64) * _Q
                i = j
            return mixed(out)

    def windows(self, k: int) -> np.ndarray:
        """The first words of all windows of ``k`` words that lie in one row, in order."""
        if not len(self):
            return np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.count)
        at = np.arange(len(self))
        return at[at + k <= last]


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each window of ``k`` words starting at ``at``; order of words counts."""
    with np.errstate(over="ignore"):
        out, weight = np.zeros(len(at), np.uint64), np.uint64(1)
        for j in range(k):
            out += hashes[at + j] * weight
            weight = weight * _Q
        return mixed(out + np.uint64(k))

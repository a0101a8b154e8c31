"""Words, lines and runs of words of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``: its ends are ASCII bytes, so words are found on bytes.  Hashes are sums of
random 64-bit byte values times powers of an odd number, modulo 2^64, from running sums, finished by a mixer:
one pass of NumPy for a whole block of texts, equal for equal bytes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); bijective for each salt."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, BLOCK_BYTES + 65536)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTE_POWERS = _Powers(0xD1342543DE82EF95)
_WORD_POWERS = _Powers(0x2545F4914F6CDD1D)
_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 7)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``most`` bytes, one row at least."""
    data, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions in the block) and row of each word."""
    on = ~_SPACE[data]
    before, after = np.zeros_like(on), np.zeros_like(on)
    before[1:], after[:-1] = on[:-1], on[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range of the block."""
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def grams(word_hash: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each run of k words within one row, and the run's hash (before ``mix``)."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.upto(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hash * up[:n], out=run[1:])
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
    return at, (run[at + k] - run[at]) * down[at]


def joined(data: np.ndarray, end: np.ndarray, start: np.ndarray, row: np.ndarray, keep: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row, joined by one space: bytes, and the n + 1 offsets of the rows."""
    start, end, row = start[keep], end[keep], row[keep]
    cover = np.zeros(len(data) + 2, np.int8)
    cover[start] += 1
    cover[end] -= 1
    mask = np.cumsum(cover[:-1], dtype=np.int8).astype(bool)
    more = end[:-1][row[:-1] == row[1:]] if len(row) else end
    out = np.append(data, np.uint8(32))
    out[more], mask[more] = 32, True
    return out[mask], np.concatenate([[0], np.cumsum(np.bincount(row, end - start, n_rows).astype(np.int64) + np.maximum(np.bincount(row, minlength=n_rows) - 1, 0))])


def counts(row: np.ndarray, n_rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, n_rows).astype(np.int64)


def repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, key): whether an earlier one is equal, and whether any other is."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    later, either = np.zeros_like(same), np.zeros_like(same)
    later[order] = same
    same[:-1] |= same[1:]
    either[order] = same
    return later, either

"""Vectorised words and shingles of a whole Arrow batch.

Texts arrive as UTF-8 bytes. All words of a batch are cut and hashed with a few numpy passes over the bytes; words are
known by a 64-bit hash from here on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes whose temporaries are held at once.
PIECE_BYTES = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers for a stretch of bytes, made once in each process that cuts words."""
    return _powers(_R, _STEP), _powers(pow(_R, -1, 2**64), _STEP)


class Words:
    """A rule for words: which bytes belong to one, after A-Z become a-z. ``space``: all but blanks; else letters, digits and bytes from 0x80."""

    def __init__(self, space: bool = True, fold: bool = True):
        b = np.arange(256)
        self.inside = ~(((b >= 9) & (b <= 13)) | (b == 32)) if space else ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
        folded = np.where((b >= 65) & (b <= 90), b + 32, b) if fold else b
        self.values = mix(folded.astype(U) + U(0x51ED270B))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the row it is in."""
        inside = self.inside[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        first[-1] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:-1]
        end = inside
        end[:-1] &= ~inside[1:] | first[1:-1]
        begin = np.flatnonzero(start)
        return begin, np.flatnonzero(end) + 1, np.searchsorted(offsets, begin, "right") - 1

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word that does not depend on where it stands."""
        out = np.empty(len(begin), U)
        i = 0
        while i < len(begin):
            base = begin[i]
            j = max(i + 1, int(np.searchsorted(end, base + _STEP, "right")))
            n = int(end[j - 1] - base)
            up, down = _tables() if n <= _STEP else (_powers(_R, n), _powers(pow(_R, -1, 2**64), n))
            total = np.zeros(n + 1, U)
            np.cumsum(self.values[data[base : base + n]] * down[:n], out=total[1:])
            at = begin[i:j] - base
            out[i:j] = (total[end[i:j] - base] - total[at]) * up[at]
            i = j
        return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary Arrow column; null rows are empty."""
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; a longer row is a batch of its own."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


class Tokens:
    """Word hashes of a batch, row after row."""

    def __init__(self, rule: Words, column: pa.Array):
        data, offsets = buffers(column)
        begin, end, self.row = rule.spans(data, offsets)
        self.hash = rule.hashes(data, begin, end)
        self.rows = len(offsets) - 1
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.begin, self.end, self.data = begin, end, data


def shingle_sets(tokens: Tokens, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, row after row, and the row offsets.

    A row with fewer than ``width`` words has its whole sequence as one shingle; a row without words has none.
    """
    w, row, n = tokens.hash, tokens.row, tokens.count
    factor = mix(np.arange(1, width + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    if len(w) >= width:
        total = w[: len(w) - width + 1] * factor[0]
        for k in range(1, width):
            total += w[k : len(w) - width + 1 + k] * factor[k]
        whole = row[: len(total)] == row[width - 1 :]
        value = mix(total[whole])
    else:
        value = np.zeros(0, U)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    raw = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(raw)])
    owner = np.repeat(np.arange(tokens.rows), raw)
    out = np.empty(cut[-1], U)
    short = n[owner] < width
    out[~short] = value
    for size in range(1, width):
        rows = np.flatnonzero(n == size)
        if len(rows):
            total = np.full(len(rows), size, U)
            for k in range(size):
                total += w[first[rows] + k] * factor[k]
            out[cut[rows]] = mix(mix(total) ^ U(size))
    for i in np.flatnonzero(raw > 1):
        out[cut[i] : cut[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    value, owner = out[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=tokens.rows))]).astype(np.int64)


def windows_of(tokens: Tokens, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``length`` words inside one row."""
    n = len(tokens.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    factor = mix(np.arange(1, length + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
    total = np.full(n, length, U)
    for k in range(length):
        total += tokens.hash[k : n + k] * factor[k]
    at = np.flatnonzero(tokens.row[:n] == tokens.row[length - 1 :])
    return at, mix(total[at])


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values; unsigned 64-bit values keep their bits as signed ones."""
    values = values.view(np.int64) if values.dtype == U else values
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))

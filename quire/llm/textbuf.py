"""Vectorised words, shingles and hashes over whole Arrow batches of text.

A batch's texts lie in one byte buffer. Words (``[^\\x20\\x09-\\x0D]+``), their 64-bit hashes and the hashes of
word windows are found with numpy over that buffer, without a Python step per document or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier for byte positions, and one for words in a window.
P = U(0x9E3779B97F4A7C15)
Q = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Texts are handled in runs of about so many bytes; a longer text is a run of its own.
RUN = 1 << 20


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free in this process back to the system: a worker that waits for its next task shall be small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * P)
BYTE_2 = mix(np.arange(257, 513, dtype=U) * P)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n at least."""
    have = _POW.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, RUN + 1)
        up, down = np.full(size, P, U), np.full(size, U(pow(int(P), -1, 1 << 64)), U)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * RUN:  # those of one giant text aren't kept
            _POW[0] = have
    return have


class Texts:
    """Some documents' bytes: ``data``, and where each begins in it (``at``, one more at the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    def words(self) -> "Texts":
        """Finds ``start`` and ``end`` of every word, and ``of``: the words of document d are of[d] to of[d + 1]."""
        inside = np.empty(len(self.data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(SPACE[self.data], out=inside[1:-1])
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.at] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.of = np.searchsorted(self.start, self.at)
        self.n_words = np.diff(self.of)
        return self

    def hashed(self, start: np.ndarray, end: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte span; ``second``: another one."""
        up, down = powers(len(self.data) + 1)
        rolled = np.zeros(len(self.data) + 1, U)
        table = BYTE_2 if second else BYTE
        table = table[LOWER] if lower else table
        np.cumsum(table[self.data] * up[: len(self.data)], out=rolled[1:])
        return mix((rolled[end] - rolled[start]) * down[start] + (end - start).astype(U))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k values in a row (len(h) - k + 1 of them): a polynomial in Q, built by doubling."""
    if len(h) < k:
        return np.empty(0, U)
    out, covered, power, width, piece = None, 0, None, 1, h
    q = int(Q)
    while True:
        if k & width:
            if out is None:
                out, covered = piece, width
            else:
                n = len(h) - covered - width + 1
                shift = U(pow(q, width, 1 << 64))
                out, covered = out[:n] * shift + piece[covered : covered + n], covered + width
        if covered == k:
            return mix(out)
        shift = U(pow(q, width, 1 << 64))
        piece = piece[: len(piece) - width] * shift + piece[width:]
        width *= 2


def window_starts(of: np.ndarray, n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each k-word window that lies in one document, and each document's window count."""
    per = np.maximum(n_words - k + 1, 0)
    total = int(per.sum())
    first = np.repeat(of[:-1] - np.concatenate(([0], np.cumsum(per)[:-1])), per)
    return first + np.arange(total), per


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(batch: pa.RecordBatch, column: str = "text", most: int = RUN) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch whose texts have about ``most`` bytes together, each with its texts."""
    data, at = buffer_of(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        upto = min(upto, batch.num_rows)
        yield batch.slice(row, upto - row), Texts(data[at[row] : at[upto]], at[row : upto + 1] - at[row])
        row = upto
    release()


def sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The sum of values of[d] to of[d + 1] for each d, also where that is empty."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[of[1:]] - total[of[:-1]]


def packed(values: np.ndarray, of: np.ndarray) -> pa.Array:
    """A binary column of each document's slice of ``values``."""
    raw, wide = np.ascontiguousarray(values), values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(of) - 1, [None, pa.py_buffer((of * wide).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())

"""Hashes of the words of many texts at once, in numpy; for models and filters, not for deciding that texts are equal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, byte: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and the end) of UTF-8 ``data`` cut into texts at ``offsets``.

    ``space`` tells which bytes lie between words; bytes with one value in ``byte`` count as equal.
    """
    inside = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    places = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.searchsorted(places, starts)
    lengths = np.diff(at, append=len(places))
    within = np.arange(len(places)) - np.repeat(at, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    sums = np.add.reduceat(byte[data[places]] * powers[within], at)
    return _mixed(sums + lengths.astype(np.uint64) * _M2), np.searchsorted(starts, offsets)


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts, without a copy; null texts are empty."""
    array = batch.column(column)
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets

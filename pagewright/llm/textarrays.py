"""Texts of an Arrow column as one array of bytes: lines, words and their hashes without a loop over them."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Lower case for A-Z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: The polynomial hash: an odd base, and a fixed random number for each byte.
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text k is bytes[offsets[k]:offsets[k + 1]]. The column has no nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each line: the parts between newlines, one at least for each text."""
    breaks = np.flatnonzero(data == 10)
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    end = np.where(last, offsets[text + 1], np.append(start[1:], 0)[: len(text)] - 1)
    return text, start, end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each run without ASCII white space."""
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]])[: len(data)] | edge[:-1]))
    end = np.flatnonzero(solid & (np.append(~solid[1:], True)[: len(data)] | edge[1:])) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        power = np.ones(n, np.uint64)
        for k in range(bits):
            power[1 << k : 2 << k] = power[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        out.append(power)
    return out[0], out[1]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each part of data, the same wherever it stands; 0 only by chance."""
    up, down = _powers(max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    value = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    return value

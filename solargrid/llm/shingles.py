"""Hashed word shingles of many texts at once, by numpy over Arrow's string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers; all arithmetic wraps at 2 ^ 64.
P = 0x9E3779B97F4A7C15
Q = np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 20
#: ASCII white space ends a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((P, pow(P, -1, 1 << 64))):
                step = np.full(size, base, dtype=np.uint64)
                step[0] = 1
                _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i], times P^-i, the hash of data[i:j]."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=c[1:])
    return c


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes; a longer text is a range of its own."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
        yield start, stop
        start = stop


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text of a block, the sorted distinct hashes of its shingles of `size` words.

    A text of fewer words has one shingle of them all; a text without words has none.
    """
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    at = offsets - base
    n = len(at) - 1
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    c = prefix_sums(data)
    word = mix((c[ends] - c[starts]) * powers(len(data) + 1)[1][starts])
    first = np.searchsorted(starts, at)  # words before each text
    total = len(word)
    h = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        h = h * Q + word[k : total - size + 1 + k]
    h = mix(h) if len(h) else h
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = x * Q + word[k]
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

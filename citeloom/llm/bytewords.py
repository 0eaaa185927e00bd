"""Words of many texts at once, as 64-bit hashes, with numpy over one byte buffer.

A chunk is the UTF-8 texts of some rows joined by a byte that no word holds. All work is on
whole arrays: a lower-casing table, word borders by comparing neighbours, and word hashes from
prefix sums of a polynomial modulo 2**64, so the cost per byte is the same for short and long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` at least; kept for the process."""
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK_BYTES * 2, n)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n <= CHUNK_BYTES * 2:
            _powers[:] = out
        return out[0], out[1]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: Bytes that are white space, and bytes that stand outside words of letters and digits (after lower-casing A-Z).
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, byte strings) of consecutive rows of a column of texts; null counts as empty.

    Only one chunk's texts are Python objects at a time, however large the batch is.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, [t or b"" for t in column.slice(first, end - first).cast(pa.binary()).to_pylist()]
        first = end
    pa.default_memory_pool().release_unused()  # a worker outlives its task, and others run beside it


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The buffer, each text after one space, and the place of each text's first byte and of the end."""
    buffer = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    places = np.empty(len(texts) + 1, dtype=np.int64)
    places[0] = 1
    np.cumsum(lengths + 1, out=places[1:])
    places[1:] += 1
    return buffer, places


def word_hashes(texts: list, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and for each text where its words begin (one more for the end)."""
    buffer, places = joined(texts)
    low = LOWER[buffer]
    inside = ~outside[low]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(buffer) + 1)
    sums = np.empty(len(buffer) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, places)


def string_hashes(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each string in ``buffer``, which begin and end at ``bounds``."""
    power, inverse = _power_tables(len(buffer) + 1)
    lengths = np.diff(bounds).astype(np.uint64)
    out = []
    for table in (np.arange(256, dtype=np.uint64) + np.uint64(1), mix(np.arange(1, 257, dtype=np.uint64))):
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(table[buffer] * power[: len(buffer)], out=sums[1:])
        out.append(mix((sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]] + lengths * np.uint64(0xD6E8FEB86659FD93)))
    return out[0], out[1]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; places whose words cross a text's end mean nothing."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(h) - n + 1
    g = np.full(m, np.uint64(n * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    for j in range(n):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + h[j : j + m]
    return mix(g)

"""Vectorised words and word shingles of a batch of texts: numpy over the UTF-8 bytes, no Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D, so UTF-8 characters are never cut. A word is known by a
64-bit fingerprint: a polynomial in its bytes modulo 2^64, then mixed. Two different words or shingles of a corpus share a
fingerprint with a chance of about 2^-64 per pair, which is taken as never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text worked on at once; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers["up"]) < n:
        for name, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all its bits (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `size` bytes each."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte and end byte of every word, and the index of the first word of each text (one more entry at the end)."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = np.unique(cuts[inside[cuts].astype(bool) & inside[cuts + 1].astype(bool)])  # a word of one text runs into the next text's
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(start, offsets)


def fingerprints(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the byte ranges given."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of `size` words, text by text, and where each text's begin. A text of fewer words gives
    its whole sequence as one, one without words gives none."""
    raw = LOWER[raw] if lower else raw
    start, end, first = words(raw, offsets)
    one = fingerprints(raw, start, end)
    n = np.diff(first)
    whole = np.zeros(max(0, len(one) - size + 1), np.uint64)
    for j in range(size):
        whole = whole * STEP + one[j : j + len(whole)]
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    out = np.zeros(at[-1], np.uint64)
    full = n >= size
    begin = np.repeat(first[:-1][full] - at[:-1][full], count[full])
    place = np.repeat(full, count)
    out[place] = mix(whole[np.flatnonzero(place) + begin] + np.uint64(size))
    for i in np.flatnonzero((n > 0) & ~full):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in one[first[i] : first[i + 1]]:
                value = value * STEP + x
            out[at[i]] = mix(np.array([value + np.uint64(n[i])]))[0]
    return out, at

"""Word shingles of many texts at once, as 64-bit hashes, computed on the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from labelyard.llm.workers import per_worker

WORDS_PER_SHINGLE = 4
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n (modulo 2^64), and a 64-bit value for each byte."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        up[filled:filled + step] = up[:step] * np.uint64(pow(BASE, filled, 1 << 64))
        down[filled:filled + step] = down[:step] * np.uint64(pow(inverse, filled, 1 << 64))
        filled += step
    lowered = np.arange(256)
    lowered[65:91] += 32
    return up, down, mixed(lowered.astype(np.uint64) + np.uint64(1))


def byte_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of ``data`` from starts to stops, A-Z as lower case."""
    n = len(data)
    size = 1 << max(20, n.bit_length())
    up, down, values = per_worker(("byte_powers", size), lambda: _powers(size))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * down[:n], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * up[starts] + (stops - starts).astype(np.uint64))


def blanks() -> np.ndarray:
    """Which bytes separate words: 0x20 and 0x09-0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def word_hashes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` (bytes), and how many words start before each bound.

    Words are runs of bytes that do not separate. ``bounds`` are the texts' offsets into ``data``,
    first and last included; no word crosses one.
    """
    n = len(data)
    solid = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    after = np.concatenate([solid[1:], [False]]) if n else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    stops = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return byte_hashes(data, starts, stops), np.searchsorted(starts, bounds)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets, first and last included; null is empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def shingle_sets(texts: pa.Array, k: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text with fewer words has its whole sequence as one shingle; without words, or null, none.
    """
    if not len(texts):
        return
    data, offsets = raw(texts)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    words, at = word_hashes(data, offsets, blanks())
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    if len(words) >= k:
        joined = words[:len(words) - k + 1] * weights[0]
        for i in range(1, k):
            joined = joined + words[i:len(words) - k + 1 + i] * weights[i]
        joined = mixed(joined)
    for ok, start, stop in zip(valid.tolist(), at[:-1].tolist(), at[1:].tolist()):
        n = stop - start
        if not ok or n == 0:
            yield np.zeros(0, np.uint64)
        elif n < k:
            one = np.array([n], np.uint64)
            for i in range(start, stop):
                one = mixed(one * weights[0] + words[i:i + 1])
            yield one
        else:
            yield np.unique(joined[start:stop - k + 1])

"""Vectorised hashing of the words of a text, and of runs of words.

Words are the runs of bytes between ASCII white space (0x20, 0x09 to 0x0D). All hashes are unsigned
64-bit integers, the same on every machine.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _STEP)
_DOWN = _powers(_INVERSE, _STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, A to Z taken as a to z."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    start, end = word_spans(data)
    if not len(start):
        return np.empty(0, np.uint64)
    # A polynomial in _BASE: the prefix sums of all bytes give each word's value by one subtraction.
    # Powers repeat every _STEP bytes, so that their tables stay small; a word is shifted to the
    # first power, and one that crosses a border is hashed in its two or more parts.
    n = len(data)
    power = _UP[np.arange(n) % _STEP] if n > _STEP else _UP[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    out = (sums[end] - sums[start]) * _DOWN[start % _STEP]
    if n > _STEP:
        for i in np.flatnonzero(start // _STEP != (end - 1) // _STEP):
            word = data[start[i] : end[i]].astype(np.uint64) + np.uint64(1)
            total = np.uint64(0)
            for at in range(0, len(word), _STEP):
                part = word[at : at + _STEP]
                total = total * np.uint64(31) * np.uint64(at > 0) + (part * _UP[: len(part)]).sum(dtype=np.uint64)
            out[i] = total
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; fewer words count as one run."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    runs = max(1, n - k + 1)
    out = np.full(runs, min(n, k), np.uint64)
    for i in range(min(n, k)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + runs])
    return np.unique(out)

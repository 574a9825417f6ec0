"""Texts as arrays of code points, with tables of letters and lower case."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLANK = 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter, digit = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalnum() or c.isdigit():
            letter[ord(c)], digit[ord(c)] = c.isalpha(), c.isdigit()
            if len(c.lower()) == 1:  # one code point for another, so that places stay
                lower[ord(c)] = ord(c.lower())
    return letter, letter | digit, lower


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def plain(text: str, digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words of letters (and digits) with one blank between, and each one's place in the text."""
    letter, alnum, lower = _tables()
    points = code_points(text)
    inside = (alnum if digits else letter)[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first character after a word stands for the blank
    at = np.flatnonzero(keep)
    out = np.where(inside[at], lower[points[at]], np.uint32(BLANK))
    if len(out) and out[-1] == BLANK:
        out, at = out[:-1], at[:-1]
    return out, at


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n characters at each place."""
    places = len(points) - n + 1
    if places <= 0:
        return np.empty(0, np.uint64)
    out = np.full(places, n, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += points[i : i + places]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out

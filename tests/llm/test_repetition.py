"""Repetitive documents and items, and which passages are found, against a search over all windows."""

import time

import numpy as np
import pytest

from sensorloom.llm import decontaminate as d
from sensorloom.llm.chars import plain


def edits_anywhere(window, text):
    """Fewest edits of window against any part of text."""
    cost = np.zeros(len(text) + 1, np.int64)
    columns = np.arange(len(text) + 1)
    for c in window:
        new = cost + 1
        new[1:] = np.minimum(new[1:], cost[:-1] + (text != c))
        cost = np.minimum.accumulate(new - columns) + columns
    return cost.min()


def brute(text, items):
    points, _ = plain(text, digits=True)
    out = {}
    for item_id, whole in items:
        if len(whole) >= d.LEAST_CHARS:
            best = min((edits_anywhere(whole[a : a + n], points), d.budget(n)) for a, n in d.windows_of(len(whole))) if len(points) else (99, 0)
            hits = [edits_anywhere(whole[a : a + n], points) for a, n in d.windows_of(len(whole)) if edits_anywhere(whole[a : a + n], points) <= d.budget(n)] if best else []
            if hits:
                out[item_id] = min(hits)
    return out


@pytest.mark.parametrize("matches", [1 << 20, 300])
def test_the_same_items_as_a_search_over_all_windows(monkeypatch, matches):
    monkeypatch.setattr(d, "MATCHES", matches)
    rng = np.random.default_rng(3)
    words = ["ab", "ac", "river", "stone", "of", "the", "green"]
    found_some = 0
    for _ in range(12):
        items = []
        for i in range(4):
            unit = list(rng.choice(words, int(rng.integers(1, 5))))
            text = " ".join((unit * 60)[: int(rng.integers(12, 60))]) if i % 2 else " ".join(rng.choice(words, 40))
            items.append((i, plain(text, digits=True)[0]))
        pieces = [" ".join(rng.choice(words, 30))]
        for _, points in items:
            part = "".join(map(chr, points))
            a = int(rng.integers(0, max(1, len(part) - 70)))
            part = list(part[a : a + int(rng.integers(40, 140))])
            for _ in range(int(rng.integers(0, 6))):
                part[int(rng.integers(0, len(part)))] = "x"
            pieces += ["".join(part), " ".join(rng.choice(words, 20))]
        text = " ".join(pieces)
        items = [x for x in items if len(x[1]) >= d.LEAST_CHARS]
        found = {k: int(e) for k, e, _, _ in d.find_passages(text, d.build_index(items))}
        want = brute(text, items)
        assert found == want
        found_some += len(want)
    assert found_some > 10


@pytest.mark.parametrize("unit", ["ab ", "a ", "river stone of "])
def test_repetitive_texts_take_little_time(unit):
    items = [(i, plain((unit * 400)[i : i + 300 + i], digits=True)[0]) for i in range(20)]
    index = d.build_index(items)
    start = time.perf_counter()
    found = d.find_passages(unit * (60_000 // len(unit)), index)
    assert time.perf_counter() - start < 6 and len(found) == 20
    for _, edits, begin, end in found:
        assert edits == 0 and begin < 10 and end > 59_980
    assert d.find_passages("zz " * 20_000, index) == []


def test_repetition_with_typos_ends():
    items = [(i, plain("ab ab ab ab ab ab ax ab " * 12, digits=True)[0]) for i in range(3)]
    start = time.perf_counter()
    found = d.find_passages("ab " * 7_000, d.build_index(items))
    assert time.perf_counter() - start < 20 and [x[:2] for x in found] == [(0, 2), (1, 2), (2, 2)]

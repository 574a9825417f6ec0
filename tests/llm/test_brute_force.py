"""License scan against containment in every window, and the labels of the quality model against plain expectation-maximisation."""

import math
import re

import numpy as np

from sensorloom.llm import license_scan as ls
from sensorloom.llm import quality


def windows(text, notice):
    """Largest share of the notice's shingles in one of the windows that hold all the required ones."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda words: [" ".join(words[i : i + ls.SHINGLE]) for i in range(len(words) - ls.SHINGLE + 1)]
    template, own = set(grams(cut(notice))), grams(cut(text))
    required = {s for s in template if re.search(ls.VARIANT, s)}
    length = ls.FIRST_CLASS * 2 ** max(0, math.ceil(math.log2(len(template) / ls.FIRST_CLASS)))
    best = 0.0
    for a in range(0, max(1, len(own)), length // 2):
        part = set(own[a : a + length + length // 2])
        if required <= part:
            best = max(best, len(template & part) / len(template))
    return best


def test_notices_against_all_windows(spark):
    rng = np.random.default_rng(12)
    filler = "some words that say nothing about any of it at all".split()
    texts = {}
    for i, notice in enumerate([*ls.NOTICES.values()] * 2):
        words = notice.split()
        for _ in range(int(rng.integers(0, 3)) if i >= len(ls.NOTICES) else 0):
            words[int(rng.integers(0, len(words)))] = "other"
        before, after = (" ".join(rng.choice(filler, int(rng.integers(0, 90)))) for _ in range(2))
        texts[i] = f"{before} {' '.join(words)} {after}"
    found = ls.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    hits = {(r["doc_id"], r["license"]): r["containment"] for r in found}
    want = {(i, k): windows(t, n) for i, t in texts.items() for k, n in ls.NOTICES.items()}
    want = {key: x for key, x in want.items() if x >= ls.LEAST}
    # Each hit is one of brute force with its containment; each text with any has one at least.
    assert all(abs(want[key] - x) < 1e-9 for key, x in hits.items())
    assert {i for i, _ in want} == {i for i, _ in hits} and len(want) >= len(ls.NOTICES)
    names = list(ls.NOTICES)
    assert all((i, names[i]) in hits for i in range(len(names)))


def test_labels_against_expectation_maximisation_over_single_texts():
    rng = np.random.default_rng(1)
    n = len(quality.LABELLERS)
    truth = rng.random(400) < 0.6
    votes = np.array([[(quality.GOOD if (rng.random() < 0.85) == t else quality.BAD) if rng.random() < 0.7 else quality.NONE for _ in range(n)] for t in truth])
    codes = np.array([quality._code(v.tolist()) for v in votes])
    patterns, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    found, _ = quality.label_patterns(patterns, counts)
    p = np.array([((v == quality.GOOD).sum() + 0.5) / ((v != quality.NONE).sum() + 1) for v in votes])
    for _ in range(quality.ROUNDS):
        likely = np.zeros((2, len(votes)))
        for c, w in enumerate((1 - p, p)):
            likely[c] += math.log((w.sum() + 1) / (len(votes) + 2))
            for i in range(n):
                said = {v: w[votes[:, i] == v].sum() + 0.5 for v in (quality.GOOD, quality.BAD)}
                total = sum(said.values()) + 0.5
                for v, x in said.items():
                    likely[c][votes[:, i] == v] += math.log(x / total)
        p = 1 / (1 + np.exp(likely[0] - likely[1]))
    np.testing.assert_allclose(found[which], p, atol=1e-9)
    assert np.mean((found[which] > 0.5) == truth) > 0.95

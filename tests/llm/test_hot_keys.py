"""Conversations of many chunks, and candidates of the n-gram join at and below the threshold."""

import hashlib

import numpy as np
import pytest

from sensorloom.llm import chat_format, ngram_join

ROWS = "conv_id long, turn long, role string, text string"


def test_a_long_conversation_takes_many_rows(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 2_000)
    rng = np.random.default_rng(8)
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} [INST] " + "é" * int(rng.integers(0, 60))) for c, n in ((1, 400), (2, 3), (None, 200), (4, 1)) for t in range(n)]
    rows += [(1, 401, "assistant", "y" * 9_000), (1, None, None, None)]
    found = chat_format.format_chats(spark.createDataFrame(rows, ROWS).repartition(6))
    sizes = [(r["conv_id"], r["chunk"], len(r["formatted"]), r["n_turns"]) for r in found.collect()]
    assert len({x[:2] for x in sizes}) == len(sizes) and sum(x[3] for x in sizes) == len(rows)
    assert sum(x[0] == 1 for x in sizes) > 10 and sorted(x[2] for x in sizes)[-2] < 3_000  # only the one turn is longer
    digests = {r["conv_id"]: r for r in chat_format.chat_digests(found).collect()}
    for conv in (1, 2, None, 4):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        d = digests[conv]
        assert (d["n_turns"], d["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (d["loss_chars"], d["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def pairs(rng, n, percent):
    """Sorted random sets of about n that are just alike enough."""
    while True:
        shared = rng.integers(0, 2**63, n).astype(np.uint64)
        most = n * (100 - percent) // percent  # |union| <= 100 * n / percent
        left = int(rng.integers(0, most + 1))
        a, b = (np.unique(np.append(shared, rng.integers(0, 2**63, k).astype(np.uint64))) for k in (left, most - left))
        yield a, b


@pytest.mark.parametrize(("percent", "sizes", "times"), [(90, (1, 2, 5, 9, 20, 50, 200, 1_000), 1_500), (80, (5, 30, 65, 70, 100, 250), 3_000)])
def test_linked_sets_share_a_hash(percent, sizes, times):
    rng = np.random.default_rng(percent)
    for n in sizes:
        for _, (a, b) in zip(range(times if n < 500 else 200), pairs(rng, n, percent), strict=False):
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            assert len(np.intersect1d(ngram_join.part_hashes(a, percent), ngram_join.part_hashes(b, percent)))


@pytest.mark.parametrize("n", [40, 1_000])
def test_random_sets_share_no_hash(n):
    rng = np.random.default_rng(n)
    hashes = np.concatenate([ngram_join.part_hashes(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), 90) for _ in range(4_000)])
    assert len(np.unique(hashes)) == len(hashes)


def test_bounds_leave_rings_out_and_lose_nothing(spark, monkeypatch):
    """Vectors around centres: most rings are left out, and the answers are those of a full comparison."""
    from pyspark.sql import functions as F

    from sensorloom.llm import topk_index

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 2_000)] + rng.normal(scale=0.05, size=(2_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []
    visits = topk_index._visits
    monkeypatch.setattr(topk_index, "_visits", lambda index, keys, k, later: (seen.append(index), visits(index, keys, k, later))[1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_index.top_k(rows, F.col("vec_id") % 100 == 0).collect()}
    whole = np.floor(1024 * x).astype(np.int64)
    kth = []
    for q in range(0, 2_000, 100):
        score = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(2_000), -score)) if i != q][:10]
        assert [found[q, n] for n in range(1, 11)] == [(i, score[i]) for i in best]
        kth.append(score[best[-1]])
    share = topk_index.visited_share(seen[-1], whole[::100].astype(float), np.array(kth, float))
    assert share < 0.2

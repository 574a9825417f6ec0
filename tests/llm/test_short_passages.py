"""Short passages of benchmark items, and short items."""

import numpy as np
import pytest

from sensorloom.llm.chars import plain
from sensorloom.llm.decontaminate import LEAST_PASSAGE, Q, budget, build_index, contaminations, find_passages, windows_of


def item_of(seed, n):
    rng = np.random.default_rng(seed)
    text = "".join(chr(97 + x) if x < 26 else " " for x in rng.integers(0, 30, 2 * n))
    return " ".join(text.split())[:n].strip()


def index_of(*items):
    return build_index([(i, plain(x, digits=True)[0]) for i, x in enumerate(items)])


@pytest.mark.parametrize("n", [61, 99, 133, 233, 384])
def test_any_passage_of_the_least_length_is_found(n):
    item = item_of(n, n)
    index = index_of(item)
    for begin in range(len(item) - LEAST_PASSAGE + 1):
        text = f"{item_of(begin, 300)} {item[begin : begin + LEAST_PASSAGE].strip()} {item_of(begin + 1, 300)}"
        if len(item[begin : begin + LEAST_PASSAGE].strip()) == LEAST_PASSAGE:
            assert [x[0] for x in find_passages(text, index)] == [0]


def test_bound_of_shared_grams_is_positive():
    assert all(n - Q + 1 - Q * budget(n) > 0 for m in range(40, 500) for _, n in windows_of(m))


def test_short_items_are_found_whole(spark):
    items = ["Paris 1789", "今天天气很好我们去公园散步吧", "Answer: forty-two!", "cat"]
    docs = [
        "It was in PARIS, 1789, they say",
        "他说今天天气很好我们去公园散步吧。",
        "the answer -- forty two",
        "concatenate paris 17890",
        "paris",
        "cat",
        "x " * 30_000 + "cat " + "y " * 600_000 + "a cat.",
        "...",
        "",
    ]
    index = index_of(*items)
    found = [sorted(find_passages(d, index)) for d in docs]
    assert [[x[0] for x in f] for f in found] == [[0], [1], [2], [], [], [3], [3], [], []]
    assert docs[0][found[0][0][2] : found[0][0][3]] == "PARIS, 1789" and docs[1][found[1][0][2] : found[1][0][3]] == items[1]
    assert found[6][0][1:] == (0, 60_000, len(docs[6]) - 1)
    benchmark = spark.createDataFrame([*enumerate(items), (9, "!?")], "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminations(rows, benchmark).collect()} == {(0, 0), (1, 1), (2, 2), (5, 3), (6, 3)}

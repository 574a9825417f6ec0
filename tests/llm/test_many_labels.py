"""More than 64 languages, and pages with deep nesting, marked inline elements and media."""

import time

import numpy as np
import pytest

from sensorloom.llm import html_text, language_id


def test_more_languages_than_bits_in_a_word(spark):
    rng = np.random.default_rng(6)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for i in range(150)}
    text = lambda lang: " ".join(rng.choice(words[lang], 30))
    train = spark.createDataFrame([(text(lang), lang) for lang in words for _ in range(3)], "text string, lang string")
    model = language_id.fit_languages(train)
    assert len(model.languages) == 150 and model.slots.shape[1] == 3
    rows = spark.createDataFrame([(text(lang), lang) for lang in words] + [(None, "und"), ("123", "und")], "text string, lang string")
    found = language_id.identify_languages(rows, model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)


def test_n_grams_against_sets(spark, sf):
    """Every n-gram that the exact sets give to a language has its bit; few others do."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("text", "lang").limit(60)
    model = language_id.fit_languages(rows)
    counts: dict[int, dict[str, int]] = {}
    for r in rows.collect():
        points = language_id.padded(r["text"])
        for n in language_id.GRAMS:
            for g in language_id.gram_hashes(points, n).tolist():
                own = counts.setdefault(g, {})
                own[r["lang"]] = own.get(r["lang"], 0) + 1
    total = {k: sum(c.get(k, 0) for c in counts.values()) for k in model.languages}
    grams = np.array(list(counts), np.uint64)
    masks, wrong = model.masks(grams), 0
    for g, mask in zip(grams.tolist(), masks.tolist(), strict=True):
        rate = {k: n / total[k] for k, n in counts[g].items()}
        want = {k for k, x in rate.items() if x >= language_id.LEAST_RATE and x >= language_id.NEAR * max(rate.values())}
        has = {k for i, k in enumerate(model.languages) if mask >> i & 1}
        assert want <= has
        wrong += has != want
    assert wrong < 0.05 * len(grams)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p>x<span class="ad">buy <b>now</b></span> y', "x y"),
        ('<p>one <a class="share" href="#">Share <span>it</span></a>two<p>three', "one two\nthree"),
        ('<p>a<span class="promo">b<p>c', "a\nc"),
        ('<div><span class="ad">b<div>inner</div></span>kept</div><p>c', "kept\nc"),
        ("<p>v<video src=x>No video support</video> w<canvas>no</canvas><audio>no</audio>", "v w"),
        ("<p>q<datalist><option>a<option>b</datalist> r<label for=x>Name</label><input id=x>", "q r"),
    ],
)
def test_marked_inline_elements_are_no_text(source, text):
    page = html_text.parse(source)
    gone, main, _ = html_text.marked(page)
    assert html_text.main_text(page, gone, main) == text


def test_deep_nesting_takes_little_time():
    page = html_text.parse("<div>some text " * 8_000)
    start = time.perf_counter()
    keys = html_text.subtree_keys(page, "h")
    assert time.perf_counter() - start < 1 and len(set(keys)) == len(keys) == 8_001


def test_equal_subtrees_have_equal_keys_wherever_they_stand():
    part = '<div class="box"><p>one<p>two</div>'
    page = html_text.parse(f"<p>before{part}<p>between{part}<div class=box><p>one</div>")
    keys = [k for k, e in zip(html_text.subtree_keys(page, "h"), page.elements, strict=True) if e.tag == "div"]
    assert keys[0] == keys[1] != keys[2]

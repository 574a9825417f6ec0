"""Each operator against brute force, and on null, empty, very long, tied and repeated rows."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import chat_format, decontaminate, html_text, language_id, license_scan, mixing, ngram_join, quality, token_files, topk_index
from sensorloom.llm.components import components
from sensorloom.llm.pipeline import decontamination, language, mixing as mixing_stage, near_copies, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} text{i % 131}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (3, None, "en", "a", 1),
    (4, "", None, "b", 1),
    (5, " \n\t ", "en", None, 1),
    (6, LONG, "en", "b", 1),
    (7, LONG + " more", "en", "a", 1),
    (None, "a row without an id", "en", "a", 1),
    (8, "two words", "en", "a", 1),
    (8, "two words", "en", "a", 1),
    (9, "$$$ 123 !!!", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Further columns carry names that operators use.
    return spark.createDataFrame(ROWS, DOC).withColumns({c: F.lit(7) for c in ("component_id", "copy", "band", "tile", "n", "score")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and both:
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_join_equals_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 4)  # many tiles in one cluster
    rng = np.random.default_rng(5)
    texts, base = {}, [f"w{x}" for x in rng.integers(0, 400, 120)]
    for i in range(150):
        words = list(base) if i % 3 else [f"v{x}" for x in rng.integers(0, 50, rng.integers(1, 60))]
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, len(words)))] = f"z{rng.integers(0, 9)}"
        texts[i] = " ".join(words[: len(words) - int(rng.integers(0, 3))])
    found = ngram_join.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts, k, percent)


def test_join_of_odd_rows(docs, none):
    rows = ngram_join.ngram_join(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows}
    assert found[1] == (10, 1, 1) and found[2] == (10, 1, 1)
    assert found[3] == (0, 3, 0) and found[5] == (0, 5, 0)
    assert found[7][1] == 6 and found[8] == (1, 8, 1) and found[None][1] is None
    assert ngram_join.ngram_join(none).count() == 0


def test_components_of_chain_hub_and_odd_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit_languages(docs.where(~language_id.held_out()))
    rows = language_id.identify_languages(docs.where(language_id.held_out()), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(docs, none):
    model = language_id.fit_languages(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, model).collect()}
    assert found[3] == found[4] == found[5] == found[9] == "und" and found[1] == "en"
    assert language_id.identify_languages(none, model).count() == 0
    assert language_id.fit_languages(none).predict("text") == ("und", 0.0)


def test_poisson_means_and_odd_rows(spark, docs, none):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"))
    sizes = {r["source"]: r["count"] for r in mixing.mix_sources(many, {"hot": 1, "0": 2, "1": 1}, 12_000).groupBy("source").count().collect()}
    assert set(sizes) == {"hot", "0", "1"}
    assert abs(sizes["hot"] - 3000) < 250 and abs(sizes["0"] - 6000) < 350 and abs(sizes["1"] - 3000) < 250
    rows = mixing.mix_sources(docs, total=5_000).collect()
    assert {r["source"] for r in rows} == {"a", "b", None} and len({(r["doc_id"], r["source"], r["copy"], r["mix_key"]) for r in rows if r["doc_id"] != 8}) == len([r for r in rows if r["doc_id"] != 8])
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31])
def test_packed_ids_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 20_011).astype(np.uint32)
    writer = token_files.SegmentWriter(bits)
    cuts = [0, 0, 5, 9_000, 20_011]
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        writer.add(i or None, ids[a:b])
    segment = token_files.Segment(writer.payload())
    assert [segment.document(i).tolist() for i in range(4)] == [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert segment.nulls.tolist() == [1, 0, 0, 0] and segment.read(8_190, 16_400).tolist() == ids[8_190:16_400].tolist()
    assert len(segment.data) <= len(ids) * bits // 8 + 16 * 8


def test_token_files_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    rows = token_files.token_files(docs, TOKENIZER).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()
    library, start = Tokenizer.from_file(TOKENIZER), 0
    assert [r["doc_id"] for r in rows] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x or 0))
    for r in rows:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"])
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["crc"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(none, TOKENIZER).count() == 0


def edits(window, region):
    cost = [0] * (len(region) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(region, 1):
            new.append(min(cost[j - 1] + (c != d), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = rng.integers(97, 101, 40).astype(np.uint32)
        middle = [c for c in window.tolist() if rng.random() > 0.05]
        for _ in range(int(rng.integers(0, 4))):
            middle.insert(int(rng.integers(0, len(middle))), int(rng.integers(97, 101)))
        region = np.array([*rng.integers(97, 101, 9).tolist(), *middle, *rng.integers(97, 101, 9).tolist()], np.uint32)
        best, found = edits(window.tolist(), region.tolist()), decontaminate.align(window, region, 6)
        assert (found is None) == (best > 6)
        if found:
            assert found[0] == best and edits(window.tolist(), region[found[1] : found[2]].tolist()) == best


def test_passages_with_edits_are_found_and_clean_ones_left(spark, docs, none):
    rng = np.random.default_rng(9)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]
    items = [" ".join(rng.choice(words, 40)) for _ in range(6)]
    clean = [" ".join(rng.choice(words, 300)) for _ in range(6)]
    # A letter put in after every 40th, capitals, marks and line ends.
    dirty = [f"{c[:500]} {'x'.join(re.findall('.{1,40}', i))} {c[500:]}".upper().replace(" ", ",\n ") for c, i in zip(clean, items, strict=True)]
    benchmark = spark.createDataFrame([*enumerate(items), (0, items[0]), (7, None), (None, items[1]), (8, "short")], "item_id long, text string")
    rows = spark.createDataFrame([*enumerate(clean), *((100 + i, d) for i, d in enumerate(dirty))], "doc_id long, text string")
    found = decontaminate.contaminations(rows, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(100 + i, i) for i in range(6)}
    for r in found:
        span = dirty[r["item_id"]][r["begin"] : r["end"]]
        assert abs(len(re.sub(r"[\W]", "", span)) - len(items[r["item_id"]].replace(" ", ""))) < 20
    assert decontaminate.without_contaminated(rows, benchmark).count() == 6
    assert decontaminate.contaminations(docs, benchmark).count() == 0 and decontaminate.without_contaminated(docs, benchmark).count() == len(ROWS)
    assert decontaminate.contaminations(none, benchmark).count() == 0 and decontaminate.contaminations(rows, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("ring_rows", [2_000, 5])
def test_top_k_equals_brute_force(spark, ring_rows, monkeypatch):
    monkeypatch.setattr(topk_index, "RING_ROWS", ring_rows)
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=6).round(2).tolist()) for i in range(160)] + [(i, [0.5] * 6) for i in range(160, 200)]
    odd = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (None, [1.0] * 6), (304, [1.0, 2.0]), (5, good[5][1])]
    found = topk_index.top_k(spark.createDataFrame(good + odd, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7).collect()
    x = np.floor(1024 * np.array([v for _, v in good])).astype(int)
    want = {(q, n, int(j), int(x[q] @ x[j])) for q in range(0, 200, 20) for n, j in enumerate([j for j in np.lexsort((np.arange(200), -(x @ x[q]))) if j != q][:7], 1)}
    assert {tuple(r) for r in found} == want
    assert topk_index.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_chats_come_back(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BUFFER", 200)
    bad = "\\ \\\\ <s> [\\INST] [INST] <|im_end|> <|im_\\end|> é\n" + "".join(chat_format.CONTROLS)
    turns = [(c, t, ("user", "assistant", "system", None, "<|im_sep|>")[(c + t) % 5], (bad, None, "", "ö" * 300, f"text {c} {t}")[(c * t) % 5]) for c in range(12) for t in range(c % 7 + 1)]
    turns += [(None, 0, "assistant", "x"), (3, None, "assistant", bad), (3, 0, *turns[4][2:])]
    rows = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))).collect()
    assert len(rows) == 13
    for r in rows:
        own = sorted([t for t in turns if t[0] == r["conv_id"]], key=lambda t: [(x is not None, x or 0) if i < 2 else (x is not None, x or "") for i, x in enumerate(t)])
        assert chat_format.read_chat(r["formatted"]) == [(t[2] or "", t[3] or "") for t in own] and r["n_turns"] == len(own)
        learned = "".join(chat_format.unescape(r["formatted"][a:b]) for a, b in zip(r["loss_begin"], r["loss_end"], strict=True))
        assert learned == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert not re.search(r"\[/?INST\]|</?s>", r["formatted"])
    digest = next(r for r in chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame([(1, 0, "assistant", bad)], "conv_id long, turn long, role string, text string"))).collect())
    assert digest["turns_sha256"] == hashlib.sha256(f"assistant\n{bad}\n".encode()).hexdigest() and digest["loss_chars"] == len(bad)
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>A<li>B</ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post with-sidebar"><h1>One &amp; two</h1><p><b>First   part<br><p>Second&nbsp;part</p><aside>Side</aside><form>Mail <button>Go</button></form>
<div class="tagline">Same on all pages</div><p>Released under the MIT License.</p><section id="comments"><p>Nice</p></section></article><div>Stray</div><footer>&copy; 1</footer>"""


def test_main_text(spark):
    pages = [(i, "http://h.example/x", PAGE.replace("One", f"No {i}")) for i in range(8)] + [(20, None, None), (21, "::", ""), (22, "http://h.example/", "<p>a<p>b < c &lt;x&gt; <b>d</b>e"), (23, "http://other.example", PAGE), (24, "http://h.example/y", "a" * 500_000)]
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert found[3] == "No 3 & two\nFirst part\nSecond part\nReleased under the MIT License."
    assert found[23] == "One & two\nFirst part\nSecond part\nSame on all pages\nReleased under the MIT License."  # alone on its host
    assert found[20] == found[21] == "" and found[22] == "a\nb < c <x> de" and len(found[24]) == 500_000
    copies = spark.createDataFrame([(i, "http://c.example", PAGE) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_text(copies).collect()} == {found[23]}  # copies are no template
    assert html_text.extract_text(copies.limit(0)).count() == 0


def test_articles_of_given_pages_and_the_way_without_broadcast(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    one = {tuple(r) for r in html_text.extract_text(pages).select("page_id", "text").collect()}
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert one == {tuple(r) for r in html_text.extract_text(pages).select("page_id", "text").collect()}
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for page_id, text in one:
        article = re.search(r"(?s)<article>(.*)</article>", source[page_id])[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert text == "\n".join(b for b in blocks if b)


def test_licenses(spark, docs, none):
    filler = "some words that say nothing about any of it "
    texts = {i: filler * i + v.upper().replace(" ", "\n") + " " + filler * 3 for i, v in enumerate(license_scan.NOTICES.values(), 1)}
    texts |= {50: "Released under the GPL", 51: filler * 50, 52: "Licensed under the Apache License, Version 1"}
    found = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("license", F.lit("x"))).collect()
    assert {(r["doc_id"], r["license"]) for r in found} - {(52, "Apache-2.0")} == set(enumerate(license_scan.NOTICES, 1))
    assert all(r["containment"] >= 0.8 for r in found)
    assert license_scan.scan_licenses(docs).count() == 0 and license_scan.scan_licenses(none).count() == 0


def test_quality_against_true_labels(spark, sf, docs, none):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(rows)
    scored = quality.score_quality(rows, model).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "truth"), "doc_id").collect()
    assert np.mean([(r["quality"] >= 0.5) == (r["truth"] == 1) for r in scored]) > 0.9
    assert all(0 <= r["quality"] <= 1 for r in quality.score_quality(docs, model).collect())
    assert quality.score_quality(none, quality.fit_quality(none)).count() == 0


def test_stages_keep_columns_and_take_effect(spark, sf, docs, none):
    columns = [c for c, _ in spark.createDataFrame([], DOC).dtypes]
    rows = docs.select(columns)
    kept = language(spark, rows, sf)  # fitted on the few of these rows that are not held out
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and {6, 7, 8} <= ids and not ids & {3, 4, 5, 9}
    single = near_copies(spark, rows.where("doc_id is null or doc_id in (1, 2, 6, 7, 8)"), sf)
    assert single.columns == columns and sorted(r["doc_id"] or 0 for r in single.collect()) == [0, 1, 6, 8]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    more = single.unionByName(spark.createDataFrame([(70, f"Before it. {item} After it.", "en", "a", 1)], DOC))
    assert {r["doc_id"] for r in decontamination(spark, more, sf).collect()} == {1, 6, 8, None}
    assert mixing_stage(spark, more, sf).columns == columns
    assert tokens(spark, more, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    for stage in (language, near_copies, decontamination, mixing_stage, tokens):
        assert stage(spark, none, sf).count() == 0

"""Quality rules and periodic runs against brute force, and on null, empty, long, tied and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import periodic_runs, quality_rules, queries

WORD = r"[^\x20\x09-\x0d]+"


def counts(text):
    words = re.findall(WORD, text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rng = np.random.default_rng(2)
    prose = " ".join(rng.choice(["the", "of", "a", "river", "stone", "was", "and", "green", "slow", "house", "under", "light"], 80))
    texts = [None, "", " \n\t\x0b ", "a b c", "a a a a", "é ü a b é ü a", prose, prose + "\n" + prose, "# " * 90 + prose, "x\n x\nx\n\nx" * 30, "one two three " * 40]
    texts += [" ".join(rng.choice(list("abcde"), int(rng.integers(1, 60)))) for _ in range(40)] + [" ".join(f"w{i % 4001}" for i in range(60_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose), (6, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("kept", "n_words", "_qr_at", "base_failed")})
    found = quality_rules.judge(df).collect()
    assert len(found) == len(rows) and sorted(found[0].asDict()) == sorted(set(found[0].asDict()))
    for r in found:
        n, *_, repeated = want = counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert r["kept"] == (not r["failed_rules"]) and not (r["kept"] and r["base_failed"])
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[6]["kept"] and "symbols" in by_id[8]["failed_rules"] and "duplicate_lines" in by_id[9]["failed_rules"]
    assert by_id[0]["failed_rules"] == ["words"] and not by_id[0]["kept"]
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_rules_run_in_one_stage_without_user_functions(spark, sf):
    plan = queries.op12_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def runs_of(words):
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    t, out = [codes[w] for w in words], []
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(t[i + k] == t[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = np.random.default_rng(7)
    for _ in range(120):
        words, letters = [], [f"w{i}" for i in range(int(rng.choice([1, 2, 3, 6, 60])))]
        for _ in range(int(rng.integers(0, 9))):
            unit = list(rng.choice(letters, int(rng.integers(1, 9))))
            words += unit * int(rng.integers(1, 7)) + unit[: int(rng.integers(0, len(unit) + 1))]
        yield "\t".join(words)


@pytest.mark.parametrize("piece", [1 << 21, 300])
def test_runs_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", piece)
    texts = [*periodic_texts(), None, "", " \n ", "a", " a\x0ba \x0ca\ra\na a ", "Ab ab Ab ab Ab ab Ab ab"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n": F.lit(2)})
    found = periodic_runs.periodic_runs(df.withColumn("again", F.col("text"))).collect()
    assert len(found) == len(rows)
    for r in found:
        words = re.findall(WORD, r["again"] or "")
        runs = runs_of(words)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed(words, runs)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_long_periodic_texts_take_little_time():
    for ids in (np.zeros(400_000, np.int64), np.tile(np.arange(1_000), 400), np.tile([0, 0, 1], 130_000)):
        which, begin, length, period = periodic_runs.find_runs(ids, 1_000, np.array([len(ids)]))
        assert (which.tolist(), begin.tolist(), length.tolist()) == ([0], [0], [len(ids)]) and period[0] in (1, 3, 1_000)


def test_given_documents(spark, sf):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf).collect()}
    some = 0
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words, h = re.findall(WORD, row["text"] or ""), zlib.crc32(str(row["doc_id"]).encode())
        if len(words) > 800:
            continue
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_of(words)
        some += len(runs)
        best = None
        for r in runs:
            best = r if best is None or r[1] * best[2] > best[1] * r[2] else best
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), collapsed(words, runs))]
        assert found[row["doc_id"]] == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)
    assert some

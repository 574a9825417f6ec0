"""Conversation repair against a search over all edits, and with blocks, groups and copies of any size."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import chat_repair, queries

ROWS = "conv_id long, turn long, role string, text string"


def cheapest(symbols):
    """(cost, audit) by Dijkstra over (turns done, state), the audit compared as text."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        state = out[-2:]
        if at == len(symbols) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, out
        if (at, state, len(out) == 0) in seen:
            continue
        seen.add((at, state, len(out) == 0))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[out[-1:]]
        for r in "ua":
            if r in legal:
                heapq.heappush(heap, (cost + 3, audit + "I", at, out + r))
        if at < len(symbols):
            c = symbols[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
            if c != "x":
                more = 3 * c.isupper()
                if c.lower() in legal:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, out + c.lower()))
                for r in "ua":
                    if r in legal:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, out + r))


def brute(rows):
    """What the query has to give for the damaged rows of a conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    symbols, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] = faults.get(fault, 0) + 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    cost, audit, out = cheapest(symbols)
    at, made, kept = 0, 0, []
    for e in audit:
        name = {"s": "system", "u": "user", "a": "assistant"}[out[made]] if e != "D" and made < len(out) else ""
        if e == "I":
            kept.append((name, ""))
        elif e != "D":
            kept.append((rows[at][1] if e == "K" else name, rows[at][2]))
        made += e != "D"
        at += e != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def answers(spark, rows, tmp_path):
    spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("cost", "place", "symbol")}).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: tuple(r)[1:] for r in queries.op11_chat_repair(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize(("block", "fan", "copies"), [(1024, 2048, 4096), (4, 2, 3)])
def test_repair_equals_a_search_over_all_edits(spark, tmp_path, monkeypatch, block, fan, copies):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    monkeypatch.setattr(chat_repair, "FAN", fan)
    monkeypatch.setattr(chat_repair, "COPIES", copies)
    rng = np.random.default_rng(4)
    roles = ["system", "user", "assistant", "tool", None, "user", "assistant"]
    rows = []
    for c in range(70):
        n = int(rng.integers(1, 40 if c % 10 == 0 else 9))
        for t in range(n):
            role = roles[int(rng.integers(0, 7))] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = [f"text {rng.integers(0, 4)}.", "no end", "ends! \n", "", None, " \t", f"t{t}?"][int(rng.integers(0, 7))]
            rows.append((c if c else None, None if rng.random() < 0.04 else t + int(rng.integers(0, 3)), role, text))
    rows += [(500, 1, "user", "again.")] * 11 + [(501, None, None, None)] + [(502, 9, "user", "x" * 300_000)]
    found = answers(spark, rows, tmp_path)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(found) == set(groups)
    for c, group in groups.items():
        assert found[c] == brute(damage(group)), c


def test_no_rows(spark, tmp_path):
    assert answers(spark, [], tmp_path) == {}


def test_given_conversations(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append(tuple(r[c] for c in ("conv_id", "turn", "role", "text")))
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_chat_repair(spark, sf).collect()}
    assert found == {c: brute(damage(g)) for c, g in rows.items()}

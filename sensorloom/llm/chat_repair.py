"""Repair of damaged conversations by the cheapest edits, on a grammar shared by all conversations.

Every turn becomes a symbol of its role and fault. The symbols of a conversation, in blocks of at most
BLOCK different turns, are compressed by rules that the most frequent pairs of all blocks give (Re-Pair,
several pairs a round, counted by Spark). What the cheapest edits of a stretch cost, from each state of
the wanted role order to each other, is a matrix of four by four; the matrix of a rule is the min-plus
product of its parts' matrices, computed once and used by all conversations. Beside its costs a matrix
holds, for each begin, the order of the audits of its ends, and which state lies between the two parts:
the audit is a rope that is only spelled out for the cells that the cheapest repair passes.

Audits of the same stretch from one state never begin with each other, since each ends with the edit of
the last turn. So ties are settled by the order of the first parts, and those by the order within a part.

Conversations may have any number of turns: matrices of blocks are multiplied in groups of at most FAN,
level by level, and the states are handed down the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import map_arrow
from sensorloom.sources.scratch import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns that differ in a block, copies of a turn that one row stands for, and blocks in a group.
BLOCK, COPIES, FAN = 1024, 4096, 2048
#: Rounds of the grammar and new rules a round: what the driver and the tasks hold of it at most.
ROUNDS, RULES = 10, 128

#: x must go; the others are the initials of the roles, in capitals if the turn is truncated.
SYMBOLS = "xsuaoSUAO"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("user", "user", "assistant", "user")  # that of the turn which may come next
FAR = 1 << 50  # the cost of what can't be
WHITE = " \t\n\x0b\x0c\r"


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _leaves() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Costs, ranks and audits of one turn of each symbol, with what is inserted before it."""
    cost = np.full((len(SYMBOLS), 4, 4), FAR, np.int64)
    audit = [[[""] * 4 for _ in range(4)] for _ in SYMBOLS]
    for c, symbol in enumerate(SYMBOLS):
        for i in range(4):
            state, before = i, ""
            for _ in range(3):
                edits = [("D", state, DELETE)]
                if symbol != "x":
                    more = TRUNCATED if symbol.isupper() else 0
                    edits.append(("R", _next(state), REROLE + more))
                    role = symbol.lower()
                    if (role, state) == ("s", START):
                        edits.append(("K", SYSTEM, KEEP + more))
                    elif role == ROLES[state][0]:
                        edits.append(("K", _next(state), KEEP + more))
                for letter, end, price in edits:
                    one = (price + INSERT * len(before), before + letter)
                    if one < (cost[c, i, end], audit[c][i][end] or "~"):
                        cost[c, i, end], audit[c][i][end] = one
                state, before = _next(state), before + "I"
    rank = np.full(cost.shape, 4, np.int64)
    for c in range(len(SYMBOLS)):
        for i in range(4):
            ends = sorted((audit[c][i][j], j) for j in range(4) if cost[c, i, j] < FAR)
            for n, (_, j) in enumerate(ends):
                rank[c, i, j] = n
    return cost, rank, [audit[c][i][j] for c in range(len(SYMBOLS)) for i in range(4) for j in range(4)]


LEAF_COST, LEAF_RANK, LEAF_AUDIT = _leaves()


def multiply(cost: np.ndarray, rank: np.ndarray, cost2: np.ndarray, rank2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, ranks and middle states of the products of two arrays of matrices."""
    total = cost[:, :, :, None] + cost2[:, None, :, :]  # begin, middle, end
    middle = np.argmin(total * 8 + rank[:, :, :, None], axis=2)
    best = np.minimum(np.take_along_axis(total, middle[:, :, None, :], 2)[:, :, 0, :], FAR)
    first = np.take_along_axis(rank, middle, 2)
    second = np.take_along_axis(rank2, middle, 1)
    order = np.where(best < FAR, first * 8 + second, 64)
    return best, np.where(best < FAR, np.argsort(np.argsort(order, axis=2, kind="stable"), axis=2), 4), middle


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(of, np.arange(n))


class Grammar:
    """Rules by round, with the matrix of each symbol."""

    def __init__(self) -> None:
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []  # sorted codes of the pairs, new symbols
        self.left = self.right = np.full(len(SYMBOLS), -1, np.int64)
        self.cost, self.rank = LEAF_COST, LEAF_RANK
        self.middle = np.zeros_like(LEAF_COST)

    def add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The new symbols for pairs of symbols."""
        new = len(self.left) + np.arange(len(left))
        cost, rank, middle = multiply(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.cost, self.rank = np.concatenate([self.cost, cost]), np.concatenate([self.rank, rank])
        self.middle = np.concatenate([self.middle, middle])
        return new

    def copy(self) -> Grammar:
        other = Grammar()
        other.__dict__.update(self.__dict__)
        return other

    def add_round(self, pairs: list[tuple[int, int]]) -> None:
        left, right = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        order = np.argsort(left << 32 | right)
        left, right = left[order], right[order]
        self.rounds.append((left << 32 | right, self.add(left, right)))

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in the grammar, and the text of each."""
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        table = np.zeros(256, np.int64)
        table[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
        seq = table[data]
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for codes, symbols in self.rounds:
            if len(seq) < 2:
                break
            code, _ = _pair_codes(seq, of)
            at = np.clip(np.searchsorted(codes, code), 0, len(codes) - 1)
            hit = np.flatnonzero(codes[at] == code)
            keep = np.ones(len(seq), bool)
            keep[hit + 1] = False
            seq = seq.copy()
            seq[hit] = symbols[at[hit]]
            seq, of = seq[keep], of[keep]
        return seq, of

    def close(self, seq: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """One symbol for each text, by rules that pair neighbours until one is left."""
        while True:
            place = np.arange(len(seq)) - _starts(of, n)[of]
            left = np.flatnonzero((place[:-1] % 2 == 0) & (of[:-1] == of[1:])) if len(seq) else np.empty(0, int)
            if not len(left):
                return seq
            new = self.add(seq[left], seq[left + 1])
            keep = np.ones(len(seq), bool)
            keep[left + 1] = False
            seq = seq.copy()
            seq[left] = new
            seq, of = seq[keep], of[keep]

    def spell(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves (places in LEAF_AUDIT) of the ropes of some cells in order, and the cell of each."""
        of = np.arange(len(symbol))
        while True:
            inner = symbol >= len(SYMBOLS)
            if not inner.any():
                return (symbol * 4 + begin) * 4 + end, of
            middle = self.middle[symbol, begin, end]
            rows = np.repeat(np.arange(len(symbol)), 1 + inner)
            second = np.zeros(len(rows), bool)
            second[1:] = rows[1:] == rows[:-1]
            split = inner[rows]
            symbol, old = np.where(split, np.where(second, self.right[symbol[rows]], self.left[symbol[rows]]), symbol[rows]), rows
            begin = np.where(split & second, middle[old], begin[old])
            end = np.where(split & ~second, middle[old], end[old])
            of = of[rows]


def _pair_codes(seq: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the pair at each place, -1 where there is none; in a row of one symbol every other counts."""
    code = seq[:-1] << 32 | seq[1:]
    code[of[:-1] != of[1:]] = -1
    same = np.zeros(len(code), bool)
    same[1:] = code[1:] == code[:-1]
    runs = np.flatnonzero(~same)
    odd = (np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))) % 2 == 1
    code[odd] = -1
    return code, odd


def fit_grammar(blocks: DataFrame) -> Grammar:
    """A grammar of the distinct values of column symbols of a written table.

    Each round counts all pairs and takes the most frequent that can't overlap: no symbol is the left of
    one and the right of another. It ends when no pair occurs twice, after ROUNDS rounds at the latest;
    what is not in the rules stays as it is.
    """
    grammar = Grammar()
    blocks = blocks.select("symbols").distinct()
    for _ in range(ROUNDS):
        known = grammar.copy()

        def count(batches: Iterator[pa.RecordBatch], known: Grammar = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seq, of = known.parse(batch.column(0).to_pylist())
                if len(seq) > 1:
                    code, _ = _pair_codes(seq, of)
                    code, n = np.unique(code[code >= 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        found = map_arrow(blocks, count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where("n > 1")
        pairs, lefts, rights = [], set(), set()
        for row in found.orderBy(F.desc("n"), "code").limit(4 * RULES).collect():
            a, b = row["code"] >> 32, row["code"] & 0xFFFFFFFF
            if a in rights or b in lefts or (a == b and (a in lefts or b in rights)) or len(pairs) == RULES:
                continue
            pairs.append((a, b))
            lefts.add(a)
            rights.add(b)
        if not pairs:
            break
        grammar.add_round(pairs)
    return grammar


def _end(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int]:
    """The state in which the cheapest repair ends its last turn, and the cost with what is inserted then."""
    price = cost + np.array([0, 2 * INSERT, INSERT, 0])
    state = min(range(4), key=lambda j: (price[j], rank[j]))
    return state, int(price[state])


#: Inserted behind the last turn, by the state after it.
TAIL = ("", "II", "I", "")


def made(audit: str, state: int) -> list[tuple[str, str | None]]:
    """The turns that the edits of one turn give: edit, and the role unless it is kept."""
    out: list[tuple[str, str | None]] = []
    for edit in audit:
        if edit != "D":
            out.append((edit, None if edit == "K" else ROLES[state]))
            state = _next(state)
    return out


@dataclass
class Repair:
    """Tables of repaired conversations.

    conversations: conv_id, blank, duplicate, truncated, illegal, gaps, cost and audit.
    turns: conv_id, place, part (these two in order), edit (K, R or I), turn, role and text.
    """

    conversations: DataFrame
    turns: DataFrame


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of left with the other columns of right, null keys being equal."""
    right = right.select(*[F.col(c).alias(f"_{c}_right") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}_right")) for c in on))
    return left.join(right, same, how).drop(*[f"_{c}_right" for c in on])


def _ordered(df: DataFrame) -> DataFrame:
    """Written: each distinct turn with its copies, fault, symbol and place in the order of conversations."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    turns = df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = written(turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")))
    turns = turns.withColumn("_digest", F.sha2("text", 256))
    # The first of all equal turns has the least turn, null before others.
    first = turns.groupBy("conv_id", "role", "_digest").agg(
        F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_least")
    )
    first = first.select("conv_id", "role", "_digest", F.expr("if(_null, null, _least)").alias("turn"), F.lit(True).alias("_first"))
    turns = _join(turns, first, ["conv_id", "turn", "role", "_digest"], "left").drop("_digest")
    turns = turns.withColumn("_first", F.coalesce("_first", F.lit(False)))
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.coalesce(F.expr("case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) end"), F.lit("o"))
    fault = (
        F.when(F.length(bare) == 0, "blank")
        .when(~F.col("_first"), "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    turns = turns.withColumns({"initial": initial, "fault": fault}).drop("_first")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial"))
    turns = turns.withColumn("symbol", symbol.otherwise(F.col("initial")))
    # A row stands for COPIES copies at most; only the first of all copies is no duplicate.
    pieces = F.expr(f"sequence(0L, (n - 1) div {COPIES})")
    turns = turns.withColumn("piece", F.explode(pieces)).withColumn("n", F.expr(f"least({COPIES}, n - piece * {COPIES})"))
    turns = turns.withColumn("symbol", F.expr("if(piece = 0, symbol, 'x')"))
    turns = turns.withColumn("_head", F.left("text", F.lit(64)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartitionByRange(parts, "conv_id", "turn", "role", "_head").drop("_head")
    turns = turns.sortWithinPartitions("conv_id", "turn", "role", "text", "piece")
    return written(turns.withColumn("place", F.monotonically_increasing_id()))


def _blocks(turns: DataFrame) -> DataFrame:
    """Symbols, places and initials of BLOCK turns of a conversation at most."""
    block = F.shiftright("place", BLOCK.bit_length() - 1)
    rows = F.sort_array(F.collect_list(F.struct("place", "n", "symbol", "initial")))
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(rows.alias("rows"))
    text = F.transform("rows", lambda r: F.concat(r["symbol"], F.repeat(F.lit("x"), (r["n"] - 1).cast("int"))))
    # Copies of a turn follow each other with the same role; so do the pairs of neighbours.
    pair = F.transform("rows", lambda r, i: F.concat(r["initial"], F.get(F.col("rows"), i + 1)["initial"]))
    wrong = F.filter(pair, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))
    copies = F.aggregate("rows", F.lit(0).cast("long"), lambda total, r: total + r["n"] - 1)
    return blocks.select(
        "conv_id",
        "block",
        F.concat_ws("", text).alias("symbols"),
        F.transform("rows", lambda r: r["place"]).alias("places"),
        F.transform("rows", lambda r: r["n"].cast("int")).alias("copies"),
        (copies + F.size(wrong)).alias("illegal"),
        F.col("rows")[0]["initial"].alias("first"),
        F.element_at("rows", -1)["initial"].alias("last"),
    )


_MATRIX = "cost array<long>, rank array<int>, illegal long, first string, last string"


def _evaluate(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """conv_id, block and the matrix of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("symbols").dictionary_encode()
            distinct = texts.dictionary.to_pylist()
            own = grammar.copy()
            roots = own.close(*own.parse(distinct), len(distinct))[texts.indices.to_numpy()]
            n = len(roots)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * 16)
            cost = pa.ListArray.from_arrays(offsets, pa.array(own.cost[roots].reshape(-1)))
            rank = pa.ListArray.from_arrays(offsets, pa.array(own.rank[roots].reshape(-1).astype(np.int32)))
            rest = ("illegal", "first", "last")
            columns = [batch.column("conv_id"), batch.column("block"), cost, rank, *[batch.column(c) for c in rest]]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "cost", "rank", *rest])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    rows = blocks.select("conv_id", "block", "symbols", "illegal", "first", "last")
    return map_arrow(rows, run, f"conv_id {kind}, block long, {_MATRIX}")


def _matrices(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    cost = np.stack(rows["cost"].to_numpy()).reshape(-1, 4, 4).astype(np.int64)
    return cost, np.stack(rows["rank"].to_numpy()).reshape(-1, 4, 4).astype(np.int64)


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for the blocks of a group, in order."""
    rows = rows.sort_values("ordinal")
    cost, rank = _matrices(rows)
    while len(cost) > 1:
        even = len(cost) // 2 * 2
        two = multiply(cost[0:even:2], rank[0:even:2], cost[1:even:2], rank[1:even:2])
        cost, rank = np.concatenate([two[0], cost[even:]]), np.concatenate([two[1], rank[even:]])
    first, last = rows["first"].to_numpy(), rows["last"].to_numpy()
    between = sum(a + b not in ("su", "ua", "au") for a, b in zip(last[:-1], first[1:], strict=True))
    return pd.DataFrame(
        {
            "conv_id": rows["conv_id"].iloc[:1].to_numpy(),
            "ordinal": [int(rows["group"].iloc[0])],
            "cost": [cost[0].reshape(-1).tolist()],
            "rank": [rank[0].reshape(-1).tolist()],
            "illegal": [int(rows["illegal"].sum() + between)],
            "first": [first[0]],
            "last": [last[-1]],
        }
    )


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """Begin and end state of each block of a group, from those of the group."""
    rows = rows.sort_values("ordinal")
    cost, rank = _matrices(rows)
    state = int(rows["group_begin"].iloc[0])
    total, order = np.full(4, FAR, np.int64), np.full(4, 4, np.int64)
    total[state], order[state] = 0, 0
    back = []
    for m, r in zip(cost, rank, strict=True):
        best, new, middle = multiply(total[None, None], order[None, None], m[None], r[None])
        total, order = best[0, 0], new[0, 0]
        back.append(middle[0, 0])
    ends, state = [], int(rows["group_end"].iloc[0])
    for middle in reversed(back):
        ends.append((int(middle[state]), state))
        state = int(middle[state])
    ends.reverse()
    return pd.DataFrame(
        {
            "conv_id": rows["conv_id"].to_numpy(),
            "ordinal": rows["ordinal"].to_numpy(),
            "begin": [b for b, _ in ends],
            "end": [e for _, e in ends],
        }
    )


def _close_conversations(matrices: DataFrame) -> DataFrame:
    """conv_id, cost, illegal and the end state of rows that hold a whole conversation each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = np.array(batch.column("cost").to_pylist(), np.int64).reshape(-1, 4, 4)[:, START]
            rank = np.array(batch.column("rank").to_pylist(), np.int64).reshape(-1, 4, 4)[:, START]
            ends = [_end(c, r) for c, r in zip(cost, rank, strict=True)]
            columns = [batch.column("conv_id"), pa.array([p for _, p in ends], pa.int64()), batch.column("illegal"), pa.array([s for s, _ in ends], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "cost", "illegal", "end"])

    kind = matrices.schema["conv_id"].dataType.simpleString()
    return map_arrow(matrices.select("conv_id", "cost", "rank", "illegal"), run, f"conv_id {kind}, cost long, illegal long, end int")


def _solve(matrices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written: the whole conversations, and begin, end and tail of each block."""
    kind = matrices.schema["conv_id"].dataType.simpleString()
    counts = matrices.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"))
    joined = _join(matrices, counts, ["conv_id"])
    single = joined.where("blocks = 1")
    whole = _close_conversations(single)
    ends = single.select("conv_id", "block")
    closed = written(whole)
    ends = _join(ends, closed, ["conv_id"]).select("conv_id", "block", F.lit(START).alias("begin"), "end", F.lit(True).alias("is_last"))

    many = joined.where("blocks > 1").drop("blocks")
    if many.isEmpty():
        return closed, written(ends)
    # Blocks of a partition of the sort follow each other without gaps, so counts by partition number them.
    part = F.shiftright("block", 33 - (BLOCK.bit_length() - 1))
    many = many.withColumn("_part", part)
    spans = many.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("least"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("n")
    spans = spans.select("conv_id", "_part", "least", before.alias("before"))
    ordinal = (F.col("before") + F.col("block") - F.col("least")).alias("ordinal")
    many = _join(many, spans, ["conv_id", "_part"]).select("conv_id", "block", ordinal, "cost", "rank", "illegal", "first", "last")
    levels = [written(many)]
    while True:
        below = levels[-1].withColumn("group", F.expr(f"ordinal div {FAN}"))
        above = below.select("conv_id", "group", "ordinal", "cost", "rank", "illegal", "first", "last").groupBy("conv_id", "group")
        levels.append(written(above.applyInPandas(_product, f"conv_id {kind}, ordinal long, {_MATRIX}")))
        if levels[-1].where("ordinal > 0").isEmpty():
            break
    top = written(_close_conversations(levels[-1]))
    states = top.select("conv_id", F.lit(0).cast("long").alias("ordinal"), F.lit(START).alias("begin"), "end")
    for below in reversed(levels[:-1]):
        above = states.select("conv_id", F.col("ordinal").alias("group"), F.col("begin").alias("group_begin"), F.col("end").alias("group_end"))
        rows = below.select("conv_id", "ordinal", "cost", "rank").withColumn("group", F.expr(f"ordinal div {FAN}"))
        rows = _join(rows, above, ["conv_id", "group"])
        states = written(rows.groupBy("conv_id", "group").applyInPandas(_states, f"conv_id {kind}, ordinal long, begin int, end int"))
    last = levels[0].groupBy("conv_id").agg(F.max("ordinal").alias("ordinal"), F.lit(True).alias("is_last"))
    states = _join(levels[0].select("conv_id", "block", "ordinal"), states, ["conv_id", "ordinal"])
    states = _join(states, last, ["conv_id", "ordinal"], "left").select(
        "conv_id", "block", "begin", "end", F.coalesce("is_last", F.lit(False)).alias("is_last")
    )
    return closed.unionByName(top), written(ends.unionByName(states))


def _edits(blocks: DataFrame, states: DataFrame, grammar: Grammar) -> DataFrame:
    """Written: audit of each block, and for each of its rows the place and the turns that come of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("symbols").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            own = grammar.copy()
            roots = own.close(*own.parse(distinct), len(distinct))[coded.indices.to_numpy()]
            begin, end = batch.column("begin").to_numpy(), batch.column("end").to_numpy()
            leaves, of = own.spell(roots, begin, end)
            starts = np.append(_starts(of, len(roots)), len(leaves))
            audits, places, edits, roles = [], [], [], []
            copies, where, last = (batch.column(c).to_pylist() for c in ("copies", "places", "is_last"))
            for i in range(len(roots)):
                own_leaves = leaves[starts[i] : starts[i + 1]].tolist()
                tail = TAIL[end[i]] if last[i] else ""
                audits.append("".join(LEAF_AUDIT[x] for x in own_leaves) + tail)
                at = 0
                for place, n in zip(where[i], copies[i], strict=True):
                    out = [turn for x in own_leaves[at : at + n] for turn in made(LEAF_AUDIT[x], x // 4 % 4)]
                    at += n
                    if at == len(own_leaves):
                        out += made(tail, int(end[i]))
                    if out:
                        places.append(place)
                        edits.append([e for e, _ in out])
                        roles.append([r for _, r in out])
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [
                    _pad(batch.column("conv_id"), n),
                    _pad(batch.column("block"), n),
                    pa.array(audits + [None] * n, pa.string()),
                    pa.array([None] * len(audits) + places, pa.int64()),
                    pa.array([None] * len(audits) + edits, pa.list_(pa.string())),
                    pa.array([None] * len(audits) + roles, pa.list_(pa.string())),
                ],
                names=["conv_id", "block", "audit", "place", "edits", "roles"],
            )

    kind = blocks.schema["conv_id"].dataType.simpleString()
    rows = _join(blocks, states, ["conv_id", "block"]).select("conv_id", "block", "symbols", "places", "copies", "begin", "end", "is_last")
    return written(map_arrow(rows, run, f"conv_id {kind}, block long, audit string, place long, edits array<string>, roles array<string>"))


def _pad(column: pa.Array, n: int) -> pa.Array:
    return pa.concat_arrays([column, pa.nulls(n, column.type)])


def repair(df: DataFrame) -> Repair:
    """Repaired conversations of rows (conv_id, turn, role, text); further columns are left out.

    Turns are taken by turn (null first), then role and text; equal rows follow each other. A null role or
    text counts as one blank, rows with a null conv_id are one conversation. A turn's first fault counts:
    blank, duplicate (of an earlier turn's role and text), truncated (no end mark). Blank turns and
    duplicates are deleted (4); other turns are kept (0), given the role user or assistant (3) or deleted
    (4); empty turns of a user or an assistant are inserted anywhere (3); a truncated turn that stays costs
    3. The roles of the result are nothing, or an optional system turn and pairs of user and assistant. Of
    the cheapest repairs the one whose audit (initials of the edits) comes first is taken. Roles are told
    apart by their first letter (s, u or a); a turn of another role can't be kept.
    """
    turns = _ordered(df)
    blocks = written(_blocks(turns))
    grammar = fit_grammar(blocks)
    whole, states = _solve(written(_evaluate(blocks, grammar)))
    edits = _edits(blocks, states, grammar)

    def n_of(fault: str) -> Column:
        return F.sum(F.expr(f"if(fault = '{fault}', if(fault = 'truncated', 1L, n), 0L)")).alias(fault)

    # Copies behind the first of a turn that is no duplicate itself are duplicates.
    more = F.sum(F.expr("if(fault in ('blank', 'duplicate'), 0L, if(piece = 0, n - 1, n))")).alias("more")
    counted = turns.withColumn("fault", F.expr("if(piece > 0 and fault = 'truncated', '', fault)"))
    counts = counted.groupBy("conv_id").agg(n_of("blank"), n_of("duplicate"), n_of("truncated"), more)
    days = turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = F.expr("try_cast(cast(max(turn) as decimal(38, 0)) - min(turn) + 1 - count(1) as bigint)").alias("gaps")
    days = days.groupBy("conv_id").agg(gaps)
    audits = edits.where("audit is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("rows"))
    audits = audits.select("conv_id", F.concat_ws("", F.transform("rows", lambda r: r["audit"])).alias("audit"))
    table = _join(_join(_join(counts, whole.drop("end"), ["conv_id"]), days, ["conv_id"], "left"), audits, ["conv_id"])
    table = table.select(
        "conv_id",
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        "blank",
        (F.col("duplicate") + F.col("more")).alias("duplicate"),
        "truncated",
        "illegal",
        "cost",
        "audit",
    )
    made = edits.where("place is not null").select("place", F.arrays_zip("edits", "roles").alias("_made"))
    rows = turns.select("conv_id", "place", "turn", "role", "text").join(made, "place")
    rows = rows.select("conv_id", "place", "turn", "role", "text", F.posexplode("_made").alias("part", "_one"))
    rows = rows.select(
        "conv_id",
        "place",
        "part",
        F.col("_one.edits").alias("edit"),
        "turn",
        F.coalesce("_one.roles", "role").alias("role"),
        F.when(F.col("_one.edits") == "I", "").otherwise(F.col("text")).alias("text"),
    )
    return Repair(table, rows)


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired turns, `role:text` joined by line feeds.

    The digest of a conversation can only be computed in order, so one task reads its sorted rows as a
    stream; it holds one batch of them, however many there are.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple[object, str]] = []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if digest is None or conv != last:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    digest, last = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], batch.column("conv_id").type), pa.array([d for _, d in done])], names=["conv_id", "repaired_sha256"])
            kept_type = batch.column("conv_id").type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kept_type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "role", "text")
    return map_arrow(rows, run, f"conv_id {kind}, repaired_sha256 string")

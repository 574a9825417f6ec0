"""Maximal periodic runs of words, found on a grammar of the texts.

Words are the runs between ASCII white space. The texts of a batch become one sequence of word ids, which
is compressed in rounds: wherever two pairs that occur at least twice overlap, the more frequent one is
replaced by a nonterminal (Re-Pair, all pairs of a round at once). What is left of each text is closed by
a balanced tree. A run of a text lies in a lowest nonterminal and crosses the boundary of its two parts
there; so the runs across that boundary are computed once for each nonterminal, on its first occurrence,
and translated to all its places in all texts of the batch. Pieces of one run that overlap are merged.

A run has a smallest period q and at least LEAST_WORDS words and EXPONENT periods, so two periods lie on
one side of the boundary: hashes of neighbouring words name the periods for which that holds, and each is
then extended by comparing ids. Memory and time of a task grow with PIECE_BYTES or the longest text, by
n log n; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import map_arrow
from sensorloom.llm.wordhash import mix

LEAST_WORDS, EXPONENT = 6, 4
#: Text handled at once; longer texts are handled alone.
PIECE_BYTES = 1 << 21
#: Rounds of pairs go on while they shorten the sequence by this share.
LEAST_GAIN = 0.005

RESULTS = ("n_words", "runs", "collapsed")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Nonterminals of a sequence: parts, length and first place of each, and one root for each text."""

    def __init__(self, ids: np.ndarray, n_ids: int, sizes: np.ndarray) -> None:
        n_texts = len(sizes)
        self.first = n_ids + n_texts  # the first nonterminal; the ids before are words, then text ends
        ends = np.cumsum(sizes) + np.arange(n_texts)
        self.begins = ends - sizes
        text = np.empty(len(ids) + n_texts, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside], text[ends] = ids, n_ids + np.arange(n_texts)
        self.text = text
        self._ends = (n_ids, self.first)
        self.layers: list[tuple[np.ndarray, ...]] = []  # left, right, place, middle, end of each rule
        self.size = self.first
        seq, at = self._pairs(text, np.arange(len(text)))
        self._close(seq, at, n_texts)

    def _add(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        self.layers.append((left, right, place, middle, end))
        self.size += len(left)

    def _pairs(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self._ends
        total = len(self.text)
        while len(seq) > 2:
            end = np.append(at[1:], total)
            mark = (seq >= low) & (seq < high)
            code = seq[:-1] * np.int64(self.size) + seq[1:]
            code[mark[:-1] | mark[1:]] = -1
            distinct, which, count = np.unique(code, return_inverse=True, return_counts=True)
            if distinct[0] == -1:
                count[0] = 0
            # Equal pairs overlap in a row of one symbol: every other one may be taken.
            same = np.zeros(len(code), bool)
            same[1:] = code[1:] == code[:-1]
            runs = np.flatnonzero(~same)
            odd = (np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))) % 2 == 1
            rank = np.where(count >= 2, count * np.int64(len(count)) + np.arange(len(count)), 0)[which]
            rank[odd] = 0
            before, after = np.append(0, rank[:-1]), np.append(rank[1:], 0)
            taken = np.flatnonzero((rank > before) & (rank > after))
            if len(taken) <= LEAST_GAIN * len(seq):
                break
            _, one, new = np.unique(code[taken], return_index=True, return_inverse=True)
            one = taken[one]
            symbols = self.size + new
            self._add(seq[one], seq[one + 1], at[one], at[one + 1], end[one + 1])
            keep = np.ones(len(seq), bool)
            keep[taken + 1] = False
            seq = seq.copy()
            seq[taken] = symbols
            seq, at = seq[keep], at[keep]
        return seq, at

    def _close(self, seq: np.ndarray, at: np.ndarray, n_texts: int) -> None:
        low, high = self._ends
        end = np.append(at[1:], len(self.text))
        mark = (seq >= low) & (seq < high)
        owner = (np.cumsum(mark) - mark)[~mark]
        seq, at, end = seq[~mark], at[~mark], end[~mark]
        while True:
            begins = np.searchsorted(owner, np.arange(n_texts))
            place = np.arange(len(seq)) - begins[owner]
            pair = np.zeros(len(seq), bool)
            pair[:-1] = (place[:-1] % 2 == 0) & (owner[:-1] == owner[1:])
            left = np.flatnonzero(pair)
            if not len(left):
                break
            symbols = self.size + np.arange(len(left))
            self._add(seq[left], seq[left + 1], at[left], at[left + 1], end[left + 1])
            keep = np.ones(len(seq), bool)
            keep[left + 1] = False
            seq, end = seq.copy(), end.copy()
            seq[left], end[left] = symbols, end[left + 1]
            seq, at, end, owner = seq[keep], at[keep], end[keep], owner[keep]
        self.roots, self.places = seq, at


def _extend(text: np.ndarray, low: int, high: int, begin: int, end: int, period: int) -> tuple[int, int]:
    """The longest part of text[low:high] around [begin, end) in which words a period apart are equal."""
    step = 64
    while end < high:
        stop = min(high, end + step)
        differ = np.flatnonzero(text[end:stop] != text[end - period : stop - period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    step = 64
    while begin > low:
        stop = max(low, begin - step)
        differ = np.flatnonzero(text[stop:begin] != text[stop + period : begin + period])
        if len(differ):
            begin = stop + int(differ[-1]) + 1
            break
        begin, step = stop, step * 2
    return begin, end


def _crossing(text: np.ndarray, low: int, mid: int, high: int, periods: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of text[low:high] across mid: begin, end and period, one for each smallest period.

    periods are those of which two lie on the right (or left) of mid, in ascending order. Multiples of a
    period inside its run are no smallest periods and are left out.
    """
    live = np.ones(len(periods), bool)
    i = 0
    while True:
        rest = np.flatnonzero(live[i:])
        if not len(rest):
            return
        i += int(rest[0])
        q = int(periods[i])
        begin, end = _extend(text, low, high, mid if right[i] else mid - q, mid + q if right[i] else mid, q)
        live[i] = False
        inside = np.where(right, (mid + 2 * periods <= end) & (begin <= mid), (mid - 2 * periods >= begin) & (end >= mid))
        live &= ~(inside & (periods % q == 0))
        if begin < mid < end and end - begin >= max(LEAST_WORDS, EXPONENT * q):
            yield begin, end, q


def _rule_runs(grammar: Grammar, layer: tuple[np.ndarray, ...], sums: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a layer of rules: the rule and (offset, length, period) of each run across its boundary."""
    text = grammar.text
    _, _, low, mid, high = layer
    most = np.where(high - low >= LEAST_WORDS, (high - low) // EXPONENT, 0)
    rule = np.repeat(np.arange(len(low)), most)
    first = np.cumsum(most) - most
    q = np.arange(len(rule)) - first[rule] + 1
    found = []
    for right in (True, False):
        at = mid[rule] if right else mid[rule] - 2 * q
        fits = (at + 2 * q <= high[rule]) if right else (at >= low[rule])
        # The words next to the boundary are compared first, since few periods pass that.
        edge = mid[rule] if right else mid[rule] - 1
        other = np.clip(edge + q if right else edge - q, 0, len(text) - 1)
        some = np.flatnonzero(fits & (text[edge] == text[other]))
        a, p = at[some], q[some]
        one, two = sums[a + p] - sums[a], sums[a + 2 * p] - sums[a + p]
        some = some[one * power[p] == two]
        found.append((rule[some], q[some], np.full(len(some), right)))
    rules, periods, sides = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((periods, rules))
    rules, periods, sides = rules[order], periods[order], sides[order]
    owners, runs = [], []
    cuts = np.flatnonzero(np.diff(rules)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(rules)), strict=True):
        if a == b:
            continue
        x = int(rules[a])
        for begin, end, p in _crossing(text, int(low[x]), int(mid[x]), int(high[x]), periods[a:b], sides[a:b]):
            owners.append(x)
            runs.append((begin - int(low[x]), end - begin, p))
    return np.array(owners, np.int64), np.array(runs, np.int64).reshape(-1, 3)


def _spread(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, counts[row] indexes from begins[row] on: the rows and the indexes."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[rows]


def find_runs(ids: np.ndarray, n_ids: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin, length and period of all maximal runs, sorted by text, begin and period.

    ids are the word ids (below n_ids) of all texts one after another, sizes the words of each text.
    """
    grammar = Grammar(ids, n_ids, sizes)
    text = grammar.text
    power = np.full(len(text) // 2 + 2, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(text) + 1, np.uint64)
    up = np.full(len(text), _BASE, np.uint64)
    up[:1] = 1
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up), out=sums[1:])

    useful = np.zeros(grammar.size, bool)  # nonterminals with runs, in themselves or in their parts
    owner, own = [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
    left, right, middle = (np.zeros(grammar.size, np.int64) for _ in range(3))
    base = grammar.first
    for layer in grammar.layers:
        rules, runs = _rule_runs(grammar, layer, sums, power)
        part = slice(base, base + len(layer[0]))
        left[part], right[part], middle[part] = layer[0], layer[1], layer[3] - layer[2]
        useful[part] = useful[layer[0]] | useful[layer[1]]
        useful[base + rules] = True
        owner.append(base + rules)
        own.append(runs)
        base = part.stop
    owner, own = np.concatenate(owner), np.concatenate(own)
    first, last = np.searchsorted(owner, np.arange(grammar.size)), np.searchsorted(owner, np.arange(grammar.size), "right")

    begins, lengths, periods = [], [], []
    symbol, place = grammar.roots, grammar.places
    while len(symbol):
        some = useful[symbol]
        symbol, place = symbol[some], place[some]
        rows, which = _spread(last[symbol] - first[symbol], first[symbol])
        begins.append(place[rows] + own[which, 0])
        lengths.append(own[which, 1])
        periods.append(own[which, 2])
        inner = symbol >= grammar.first
        symbol, place = symbol[inner], place[inner]
        symbol, place = np.concatenate([left[symbol], right[symbol]]), np.concatenate([place, place + middle[symbol]])
    if not begins:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    begin, length, period = map(np.concatenate, (begins, lengths, periods))

    # Pieces of the same run overlap by a period or more; two runs of one period overlap by less.
    order = np.lexsort((begin, period))
    begin, end, period = begin[order], (begin + length)[order], period[order]
    rank = np.cumsum(np.append(0, np.diff(period) > 0)) * np.int64(len(text) + 1)
    reach = np.maximum.accumulate(rank + end)
    new = np.ones(len(begin), bool)
    new[1:] = rank[1:] + begin[1:] > reach[:-1] - period[1:]
    heads = np.flatnonzero(new)
    begin, period = begin[heads], period[heads]
    end = (reach - rank)[np.append(heads[1:], len(new)) - 1] if len(heads) else end
    which = np.searchsorted(grammar.begins, begin, "right") - 1
    begin, length = begin - grammar.begins[which], end - begin
    order = np.lexsort((period, begin, which))
    return which[order], begin[order], length[order], period[order]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and how many each has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    full = np.asarray(pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), bool)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    sums = np.append(0, np.cumsum(full))
    return words.filter(pa.array(full)), np.diff(sums[offsets])


def _join(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The words of each text, joined by one blank; an empty text where there are none."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int64())
    lists = pa.LargeListArray.from_arrays(offsets, words)
    return pc.fill_null(pc.binary_join(lists, " "), "").cast(pa.string())


def _piece(batch: pa.RecordBatch, text: int, others: list[int]) -> pa.RecordBatch:
    words, sizes = _split(batch.column(text))
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    which, begin, length, period = find_runs(ids, len(coded.dictionary), sizes)
    starts = np.cumsum(sizes) - sizes
    # +1 where the repeated words of a run begin and -1 behind them.
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, starts[which] + begin + period, 1)
    np.add.at(depth, starts[which] + begin + length, -1)
    kept = np.cumsum(depth)[:-1] == 0
    left = np.diff(np.append(0, np.cumsum(kept))[np.append(starts, len(ids))])
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begin, length, period)], ["start", "length", "period"])
    counts = np.bincount(which, minlength=len(sizes))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), runs)
    collapsed = _join(words.filter(pa.array(kept)), left)
    columns = [batch.column(i) for i in others]
    names = [batch.schema.field(i).name for i in others]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), lists, collapsed], names=[*names, *RESULTS])


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        done = np.append(0, np.cumsum(sizes))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(done, done[at] + PIECE_BYTES, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of df with n_words, runs and collapsed; columns of df so named are replaced.

    runs is an array of (start, length, period) in words, sorted by start and period. collapsed joins by
    one blank the words that no run holds behind its first period. A null text counts as empty: no words,
    no runs, an empty collapsed text. Each row stands for itself, so repeated rows and ids do no harm.
    """
    own = [c for c in df.columns if c not in RESULTS and c != text]
    df = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType(
        [
            *df.schema.fields[:-1],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    at = len(own)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, at):
            yield _piece(piece, at, list(range(at)))

    return map_arrow(df, task, schema)

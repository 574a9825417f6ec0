"""Passages of benchmark items in documents, by q-gram counts in diagonal bands and banded alignment.

Both texts become lower-case words of letters and digits with one blank between. An item is cut into
overlapping windows of two lengths: wide ones, and narrow ones so close together that every passage of
LEAST_PASSAGE characters holds one of them whole. A region of a document within e edits of a window of length n shares at least
n - q + 1 - q * e of its q-grams, all of them on diagonals at most e apart. So shared q-grams are
counted in overlapping bands of diagonals, regions that reach the bound are kept, and an alignment in
a band around the diagonal gives the edits. Nothing within the budget is missed. Items of fewer than
LEAST_CHARS characters are looked up whole, by a hash of all their characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.chars import BLANK, plain
from sensorloom.llm.common import map_arrow, text_rows

#: Length of a q-gram, of a window and between windows, in characters of the plain text.
Q, WINDOW, STRIDE = 10, 100, 50
#: Characters of an item that are always found where they stand unchanged, and of a narrow window.
LEAST_PASSAGE, NARROW = 60, 50
#: Edits allowed for each character of a window.
EDITS = 0.07
#: Items with fewer plain characters are found as a whole only, unchanged and between word borders.
LEAST_CHARS = 40
#: Plain characters of items that are searched for in one pass over the documents.
BLOCK_CHARS = 4_000_000
#: Characters of a document that are looked up at a time.
CHUNK = 1 << 18
#: Matches of q-grams that are held at a time; beyond, the places are halved, then the items.
MATCHES = 1 << 20
#: Characters of a region in which a window is aligned once.
REGION = 1 << 13


@dataclass(frozen=True)
class Index:
    """The q-grams of a block of items: sorted hashes with their item and place, and a filter of them."""

    items: list[tuple[int, np.ndarray]]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    #: For each item the windows: first character, length, edits, q-grams that a region shares at least.
    windows: list[np.ndarray]
    #: For each length, the sorted hashes of the items below LEAST_CHARS with their item_id and characters.
    short: dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray]]]]


def build_index(every_item: list[tuple[int, np.ndarray]]) -> Index:
    items = [x for x in every_item if len(x[1]) >= LEAST_CHARS]
    hashes = [_grams(points) for _, points in items]
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if items else np.empty(0, np.int64)
    every = np.concatenate(hashes) if items else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    known = np.zeros(1 << max(20, int(16 * len(every)).bit_length()), bool)
    known[_slot(every, known)] = True
    windows = [np.array([(s, n, budget(n), max(1, n - Q + 1 - Q * budget(n))) for s, n in windows_of(len(points))]) for _, points in items]
    return Index(items, every[order], item[order].astype(np.int64), place[order].astype(np.int64), known, windows, _short(every_item))


def _short(items: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    out = {}
    for n in sorted({len(points) for _, points in items if len(points) < LEAST_CHARS}):
        same = [x for x in items if len(x[1]) == n]
        hashes = np.array([_run_hashes(points, np.zeros(1, np.int64), _sums(points), n)[0] for _, points in same], np.uint64)
        order = np.argsort(hashes, kind="stable")
        out[n] = hashes[order], [same[i] for i in order]
    return out


#: An odd factor and its inverse modulo 2 ** 64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@lru_cache(maxsize=2)
def _table(factor: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(factor: int, n: int) -> np.ndarray:
    return _table(factor, max(CHUNK + 2 * WINDOW, n).bit_length())[:n]


def _grams(points: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place, by one difference of running sums."""
    n = len(points) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = _sums(points)
    out = sums[Q:] - sums[:-Q]
    out *= _powers(_FACTOR, n)
    return out


def _sums(points: np.ndarray) -> np.ndarray:
    """Running sums from which _run_hashes takes the hash of any run of characters."""
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * _powers(_INVERSE, len(points)), out=out[1:])
    return out


def _run_hashes(points: np.ndarray, begin: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each begin on, the same wherever they stand."""
    return (sums[begin + n] - sums[begin]) * _powers(_FACTOR, len(points))[begin]


#: Code points of scripts that put no blanks between words: Thai to Burmese, Khmer, kana, Han.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _borders(points: np.ndarray) -> np.ndarray:
    """For each place between characters, the ends too, whether a word may begin or end there."""
    free = points == BLANK
    for a, b in _UNSPACED:
        free |= (points >= a) & (points <= b)
    out = np.ones(len(points) + 1, bool)
    out[1:-1] = free[1:] | free[:-1]
    return out


def _slot(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - len(known).bit_length())).astype(np.int64)


def windows_of(n: int) -> list[tuple[int, int]]:
    """First character and length of the windows of an item of n characters; the last ends with it."""
    wide = [(0, n)] if n <= WINDOW else [(s, WINDOW) for s in [*range(0, n - WINDOW, STRIDE), n - WINDOW]]
    if n <= LEAST_PASSAGE:
        return wide
    stride = LEAST_PASSAGE - NARROW + 1
    return wide + [(s, NARROW) for s in [*range(0, n - NARROW, stride), n - NARROW]]


def budget(n: int) -> int:
    return int(EDITS * n)


def align(window: np.ndarray, region: np.ndarray, e: int) -> tuple[int, int, int] | None:
    """(fewest edits, first begin, last end) of the parts of region within e edits of window, or None.

    Parts are those that end where no neighbouring end is nearer to the window. Where it occurs
    unchanged, only what lies before the first and behind the last occurrence is filled.
    """
    n, text = len(window), region.tobytes()
    first = _find(text, window.tobytes(), 1)
    if first < 0:
        return _fill(window, region, e)
    last = _find(text, window.tobytes(), -1)
    begin, end = first, last + n
    if first >= n - e and (before := _fill(window, region[: first + n - 1], e)):
        begin = min(begin, before[1])
    if len(region) - end >= n - e and (after := _fill(window, region[last + 1 :], e)):
        end = max(end, last + 1 + after[2])
    return 0, begin, end


def _find(text: bytes, part: bytes, step: int) -> int:
    """The first (step 1) or last (step -1) place of part in text, in whole code points."""
    at = text.find(part) if step > 0 else text.rfind(part)
    while at >= 0 and at % 4:
        at = text.find(part, at + 1) if step > 0 else text.rfind(part, 0, at + len(part) - 1)
    return at // 4 if at >= 0 else -1


def _fill(window: np.ndarray, region: np.ndarray, e: int) -> tuple[int, int, int] | None:
    """As align, by filling a table of len(window) rows and len(region) columns."""
    n, m = len(window), len(region)
    far = np.int64(1 << 30)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    columns = np.arange(m + 1)
    for i in range(1, n + 1):
        new, origin = np.full(m + 1, far), begin.copy()
        take = cost[:-1] + (region != window[i - 1])
        skip = cost + 1
        new[1:], origin[1:] = take, begin[:-1]
        less = skip < new
        new[less], origin[less] = skip[less], begin[less]
        # Insertions along the row: the running minimum of cost less the column.
        run = np.minimum.accumulate(new - columns)
        source = np.maximum.accumulate(np.where(new - columns == run, columns, 0))
        cost, begin = run + columns, origin[source]
        if cost.min() > e:
            return None
    near = cost <= e
    near[1:] &= cost[1:] <= cost[:-1]
    near[:-1] &= cost[:-1] < cost[1:]
    ends = np.flatnonzero(near & (begin < columns))
    return (int(cost[ends].min()), int(begin[ends].min()), int(ends.max())) if len(ends) else None


def find_passages(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item_id, fewest edits of a window, begin, end in the text) of each item with a window in the text."""
    points, at = plain(text, digits=True)
    found = _short_items(points, at, index) if index.short else {}
    if len(index.hashes):
        _long_items(points, at, index, found)
    return [(k, *v) for k, v in found.items()]


def _add(found: dict[int, list[int]], item_id: int, edits: int, begin: int, end: int) -> None:
    old = found.get(item_id)
    found[item_id] = [min(edits, old[0]), min(begin, old[1]), max(end, old[2])] if old else [edits, begin, end]


def _short_items(points: np.ndarray, at: np.ndarray, index: Index) -> dict[int, list[int]]:
    """The items of fewer than LEAST_CHARS characters that stand whole and unchanged in the text."""
    found: dict[int, list[int]] = {}
    for c in range(0, len(points), CHUNK):
        part = points[c : c + CHUNK + LEAST_CHARS]
        border = _borders(points[max(0, c - 1) : c + CHUNK + LEAST_CHARS + 1])[min(c, 1) :][: len(part) + 1]
        sums = _sums(part)
        starts = np.flatnonzero(border[: min(CHUNK, len(part))] & (part[:CHUNK] != BLANK))
        for n, (hashes, items) in index.short.items():
            begin = starts[: np.searchsorted(starts, len(part) - n, side="right")]
            begin = begin[border[begin + n]]
            own = _run_hashes(part, begin, sums, n)
            low = np.searchsorted(hashes, own, side="left")
            begin, low, own = (x[low < len(hashes)] for x in (begin, low, own))
            begin, low = (x[hashes[low] == own] for x in (begin, low))
            for k in np.unique(low):
                places = begin[low == k]
                for item_id, whole in items[k : np.searchsorted(hashes, hashes[k], side="right")]:
                    same = (p for p in places if np.array_equal(part[p : p + n], whole))
                    first = next(same, None)
                    if first is not None:
                        last = next(p for p in places[::-1] if np.array_equal(part[p : p + n], whole))
                        _add(found, item_id, 0, int(at[c + first]), int(at[c + last + n - 1]) + 1)
    return found


def _long_items(points: np.ndarray, at: np.ndarray, index: Index, found: dict[int, list[int]]) -> None:
    """Add the items of which the text holds a window."""
    places, low, high = [], [], []
    for c in range(0, len(points) - Q + 1, CHUNK):
        hashes = _grams(points[c : c + CHUNK + Q - 1])
        maybe = np.flatnonzero(index.filter[_slot(hashes, index.filter)])
        if len(maybe):
            places.append(maybe + c)
            low.append(np.searchsorted(index.hashes, hashes[maybe], side="left"))
            high.append(np.searchsorted(index.hashes, hashes[maybe], side="right"))
    if places:
        _matches(points, at, index, found, *(np.concatenate(x) for x in (places, low, high)), None)


#: A region of a window reaches over fewer places than this.
_REACH = WINDOW + 6 * (budget(WINDOW) + 1)


def _matches(points, at, index: Index, found: dict, places: np.ndarray, low: np.ndarray, high: np.ndarray, only: np.ndarray | None) -> None:
    """Look at the q-grams of the text that items share: place, first and last entry of the index.

    Too many matches are halved: by place, each part with the places that a region may reach over, first
    and last parts before those between; then by item (only: which entries of the index count). An item
    that is found unchanged and reaches over a part already is left out there.
    """
    if not len(places):
        return
    if found:
        begin, end = int(at[places[0]]), int(at[min(places[-1] + _REACH, len(at) - 1)]) + 1
        done = [i for i, (item_id, _) in enumerate(index.items) if item_id in found and found[item_id][0] == 0 and found[item_id][1] <= begin and found[item_id][2] >= min(end, int(at[-1]) + 1)]
        if done:
            fresh = ~np.isin(index.item, done)
            only = fresh if only is None else only & fresh
    if only is not None:
        sums = np.append(0, np.cumsum(only))
        times = sums[high] - sums[low]
    else:
        times = high - low
    some = times > 0
    if not some.all():
        places, low, high, times = places[some], low[some], high[some], times[some]
        if not len(places):
            return
    total = int(times.sum())
    if total > MATCHES and places[-1] - places[0] > 4 * _REACH:
        cut = places[0] + (places[-1] - places[0]) // 2
        if only is None and places[-1] - places[0] > 64 * _REACH:
            # The ends first: what they hold often settles what lies between.
            a, b = places[0] + 4 * _REACH, places[-1] - 4 * _REACH
            parts = [places <= a, places >= b, (places > a - _REACH) & (places < b + _REACH)]
        else:
            parts = [places <= cut + _REACH // 2, places > cut - _REACH // 2]
        for part in parts:
            if part.sum() < len(places):
                _matches(points, at, index, found, places[part], low[part], high[part], only)
        return
    which = np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange((high - low).sum()) if only is None else None
    if only is not None:
        kept = np.flatnonzero(only)
        first = np.searchsorted(kept, low)
        which = kept[np.repeat(first - np.cumsum(times) + times, times) + np.arange(total)]
        items = np.unique(index.item[kept])
    else:
        items = None
    if total > MATCHES:
        items = np.unique(index.item[which]) if items is None else items
        if len(items) > 1:
            half = items[len(items) // 2]
            base = np.ones(len(index.item), bool) if only is None else only
            for side in (index.item < half, index.item >= half):
                _matches(points, at, index, found, places, low, high, base & side)
            return
    _verify(points, at, index, found, np.repeat(places, times), which)


def _verify(points, at, index: Index, found: dict, where: np.ndarray, which: np.ndarray) -> None:
    """Align the windows of items that share enough q-grams in a band of diagonals."""
    item, place = index.item[which], index.place[which]
    diagonal = where - place
    order = np.lexsort((diagonal, item))
    item, place, diagonal, where = item[order], place[order], diagonal[order], where[order]
    edges = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        item_id, whole = index.items[item[x]]
        windows = index.windows[item[x]]
        if y - x < windows[:, 3].min():
            continue
        near, far = int(where[x:y].min()), int(where[x:y].max())
        reach = at[max(0, near - _REACH)], at[min(len(at) - 1, far + _REACH)]
        places = np.sort(place[x:y])
        shared = np.searchsorted(places, windows[:, 0] + windows[:, 1] - Q, side="right") - np.searchsorted(places, windows[:, 0])
        for begin, n, e, least in windows[shared >= windows[:, 3]].tolist():
            known = found.get(item_id)
            if known and known[0] == 0 and known[1] <= reach[0] and known[2] > reach[1]:
                break  # nothing here can change it
            inside = (place[x:y] >= begin) & (place[x:y] <= begin + n - Q)
            starts = _bands(diagonal[x:y][inside], where[x:y][inside], e, least)
            # A band spans diagonals start to start + 2 * (e + 1) - 1.
            first = np.maximum(0, starts + begin - e)
            last = np.minimum(len(points), starts + begin + n + 3 * (e + 1))
            for a, b in _regions(first, last, at, known):
                hit = align(whole[begin : begin + n], points[a:b], e)
                if hit is not None and hit[2] > hit[1]:
                    _add(found, item_id, hit[0], int(at[a + hit[1]]), int(at[a + hit[2] - 1]) + 1)


def _regions(first: np.ndarray, last: np.ndarray, at: np.ndarray, known: list[int] | None) -> Iterator[tuple[int, int]]:
    """Overlapping regions made one, up to about REGION characters; those that can't change known are left out."""
    some = last > first
    first, last = first[some], last[some]
    if known and known[0] == 0 and len(first):
        open_ = (at[first] < known[1]) | (at[last - 1] >= known[2])
        first, last = first[open_], last[open_]
    i = 0
    while i < len(first):
        j = i + 1
        while j < len(first) and first[j] <= last[j - 1] and last[j] - first[i] <= REGION:
            j += 1
        yield int(first[i]), int(last[j - 1])
        i = j


def _bands(diagonal: np.ndarray, where: np.ndarray, e: int, least: int) -> np.ndarray:
    """First diagonals of the bands of 2 * (e + 1) diagonals, e + 1 apart, that hold enough distinct places."""
    if len(diagonal) < least:
        return np.empty(0, np.int64)
    w = e + 1
    band, low = diagonal // w, int(where.min())
    lowest, span = int(band.min()) - 1, int(where.max()) - low + 1
    pairs = np.unique((np.r_[band, band - 1] - lowest) * span + np.r_[where, where] - low)
    bands, n = np.unique(pairs // span, return_counts=True)
    return (bands[n >= least] + lowest) * w


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items in turn, each of BLOCK_CHARS plain characters at most or of one item."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    for row in items.distinct().orderBy("item_id", "text").toLocalIterator():
        points, _ = plain(row["text"], digits=True)
        if not len(points):
            continue
        if held and size + max(len(points), LEAST_CHARS) > BLOCK_CHARS:
            yield build_index(held)
            held, size = [], 0
        held.append((row["item_id"], points))
        size += max(len(points), LEAST_CHARS)
    if held:
        yield build_index(held)


FOUND = "doc_id long, item_id long, n_edits long, begin long, end long"


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_edits, begin, end) for each row of docs and item of which it holds a passage.

    A passage is a window of WINDOW or of NARROW plain characters of the item, or the whole of a shorter
    one, within EDITS edits a character; so any LEAST_PASSAGE plain characters of an item that stand in
    the text are found. An item of fewer than LEAST_CHARS is found where it stands whole, unchanged and
    between word borders (next to a character of a script without blanks is one). begin and end are the characters of the text that the found windows of
    the item reach over, n_edits the fewest edits of one. Null and empty texts hold nothing; items with
    a null id or text, or without a letter or digit, take no part. Repeated
    rows of docs give repeated rows; repeated items count once, and items of one id but other texts
    each on their own. Empty tables give an empty result. Items come to the driver in blocks of bounded size,
    and the documents are read once for each block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for index in _blocks(benchmark):
        out = out.unionByName(_search(rows, index))
    return out


def _search(rows: DataFrame, index: Index) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_CHARS
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_edits", "begin", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            found = [(ids[i].as_py(), *x) for i, text in text_rows(batch) for x in find_passages(text, held.value)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    return map_arrow(rows, run, FOUND)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no passage of an item; see contaminations."""
    for index in _blocks(benchmark):
        docs = _clean(docs, index)
    return docs


def _clean(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not find_passages(text, held.value) for _, text in text_rows(batch)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, run, T.StructType(docs.schema.fields))

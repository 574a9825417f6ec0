"""Documents whose word-shingle sets reach a Jaccard similarity, joined exactly.

Sets that differ in at most H shingles, dealt by hash into H + 1 + E parts, have E + 1 parts in common;
one of them holds a shingle unless both sets leave more than E parts empty, and those share one of their
first shingles in the order of the hashes. So empty parts, which all sets have in common, are left out. Two
sets that link have sizes in one band or in neighbouring ones, and the sizes of a band bound H, so the
hashes of parts find the pairs that can link (all of them for 0.88 and more; for less see part_hashes).
Pairs that share a part make up candidate clusters;
the members of a cluster are compared in tiles of bounded bytes. A tile holds sets of one size band
and of the same or the next one. In a tile, the bits in which two hashed bitmaps differ bound the
overlap from above; pairs that stay below the bound are intersected exactly, as sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import map_arrow, small_side, sorted_groups, text_rows
from sensorloom.llm.components import components
from sensorloom.llm.wordhash import mix, shingle_set, word_hashes
from sensorloom.sources.scratch import written

#: Sets up to SMALL shingles are found by first shingles where parts are small; see part_hashes.
SMALL = 64
#: Part hashes that a task gathers before it passes them on, and the number in a shuffled bucket.
FLUSH = 1_000_000
BUCKET = 100_000
#: Bytes of sorted shingle hashes in a tile, and sets.
TILE_BYTES, TILE_SETS = 8_000_000, 512


def band_of(n: int, percent: int) -> int:
    """Number of the band of size n: bands begin at the powers of 100 / percent."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def most_different(tile: int, percent: int) -> int:
    """Most shingles in which two linked sets of bands tile and tile + 1 can differ."""
    largest = (100 / percent) ** (tile + 2)
    return int(2 * largest * (100 - percent) / (100 + percent) + 1e-6)


def part_hashes(shingles: np.ndarray, percent: int) -> np.ndarray:
    """One hash for each part of the set, in the tile of its own band and the one below it.

    A set that leaves more parts empty than are spare gives its first shingles as well, so many that it
    shares one with any set it links with. Below a similarity of about 0.88 a part holds few shingles, and one with none or one would join
    sets that have little in common. There, parts with fewer than two are left out, which loses a pair
    only if all parts it has in common are so small: with more than SMALL shingles, less than one
    pair in 10,000 of those just at the threshold. Smaller sets are found by their first shingles in
    the order of the hashes, so many that linked sets share one of them for certain.
    """
    n = len(shingles)
    sparse = (100 + percent) < 8 * 2 * (100 - percent)
    first_ones = mix(shingles[: n + (-percent * n // 100) + 1] ^ np.uint64(0x5A5A))
    out = []
    if sparse and n * percent <= SMALL * 100:
        out.append(first_ones)
    if sparse and n <= SMALL:
        return out[0]
    band = band_of(n, percent)
    for tile in (band - 1, band):
        parts = most_different(tile, percent) + 1
        spare = 0 if sparse else 1 + parts // 200
        parts += spare
        salt = np.uint64(tile + 2)
        part = (mix(shingles + salt) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.zeros(parts, np.uint64)
        sums[part[first]] = np.add.reduceat(mix(shingles[order] ^ np.uint64(0xA5A5)), first)
        sums += mix(np.arange(parts, dtype=np.uint64) + (salt << np.uint64(40)))
        held = np.bincount(part, minlength=parts)
        out.append(mix(sums)[held >= (2 if sparse else 1)])
        if not sparse and parts - np.count_nonzero(held) > spare:
            out.append(first_ones)
    return np.unique(np.concatenate(out))


def _profiles(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, text in text_rows(batch):
                shingles = shingle_set(word_hashes(text), k)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], schema=schema)

    return run, "doc_id long, n_shingles long, set_key binary"


def _part_rows(k: int, percent: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("data", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def flush(hashes: list, owners: list) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.r_[True, h[1:] != h[:-1]]
        a, b = _stars(new, doc)
        # Sets of one task that share a part are linked here; only the first goes on.
        h, doc = h[new], doc[new]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        rows = np.stack([h[order].view(np.int64), doc[order]], axis=1)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        data = [rows[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        none = pa.nulls(len(data), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array(data, pa.binary()), none, none], schema=schema)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(b % buckets), pa.nulls(len(a), pa.binary()), pa.array(a), pa.array(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, held = [], [], 0
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0)
            for i, text in text_rows(batch):
                if not ids[i].is_valid:
                    continue
                shingles = shingle_set(word_hashes(text), k)
                if not len(shingles):
                    continue
                key = xxhash.xxh3_128_digest(shingles.tobytes())
                if key in seen:  # a copy within the task: its class is known from the profile
                    continue
                seen.add(key)
                if len(seen) > 1_000_000:
                    seen.clear()
                parts = part_hashes(shingles, percent)
                hashes.append(parts)
                owners.append(np.full(len(parts), ids[i].as_py(), np.int64))
                held += len(parts)
                if held >= FLUSH:
                    yield from flush(hashes, owners)
                    hashes, owners, held = [], [], 0
        if held:
            yield from flush(hashes, owners)

    return run, "bucket long, data binary, a long, b long"


def _stars(new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the first document of each run and another of the same run."""
    head = doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(doc) else doc
    apart = head != doc
    pairs = np.unique(np.stack([head[apart], doc[apart]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for _, table in sorted_groups(batches, "bucket"):
        known = table.filter(table["a"].is_valid()).select(["a", "b"])
        yield from known.cast(schema).to_batches()
        data = [x for x in table["data"].to_pylist() if x is not None]
        if not data:
            continue
        rows = np.frombuffer(b"".join(data), np.int64).reshape(-1, 2)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        a, b = _stars(np.r_[True, rows[1:, 0] != rows[:-1, 0]], rows[:, 1])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)


def _sets(k: int, percent: int):
    schema = pa.schema([("node", pa.int64()), ("cluster", pa.int64()), ("copies", pa.int64()), ("band", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, bands, sizes, data = [], [], [], []
            for i, text in text_rows(batch):
                shingles = shingle_set(word_hashes(text), k)
                if len(shingles):
                    keep.append(i)
                    bands.append(band_of(len(shingles), percent))
                    sizes.append(len(shingles))
                    data.append(shingles.tobytes())
            rows = batch.select(["node", "cluster", "copies"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(bands, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return run, "node long, cluster long, copies long, band long, n long, hashes binary"


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions in left and right whose sets link; a position in both is paired once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = max(256, 1 << int(4 * sizes.max() - 1).bit_length())
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        at = np.unique((s & np.uint64(bits - 1)).astype(np.int64))
        np.bitwise_or.at(maps[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    maps = maps.view(np.uint64)
    both = set(left.tolist()) & set(right.tolist())
    step = max(1, 64_000_000 // (maps.shape[1] * 8 * max(1, len(right))))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        differ = np.bitwise_count(maps[rows][:, None, :] ^ maps[right][None, :, :]).sum(axis=2, dtype=np.int64)
        total = sizes[rows][:, None] + sizes[right][None, :]
        possible = (100 + percent) * ((total - differ) // 2) >= percent * total
        for i, j in zip(*np.nonzero(possible), strict=True):
            x, y = int(rows[i]), int(right[j])
            if x == y or (x > y and x in both and y in both):
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                yield x, y


def _compare(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in sorted_groups(batches, "tile"):
            node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "side"))
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(left) or not len(right) or len(node) < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table["hashes"].chunks for x in chunk]
            links = np.zeros(len(node), np.int64)
            root = list(range(len(node)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in linked_pairs(sets, left, right, percent):
                links[x] += copies[y]
                links[y] += copies[x]
                root[find(x)] = find(y)
            hit = np.flatnonzero(links)
            if len(hit):
                # Of the links, a tree of each connected part goes on, with the number at each document.
                tops = np.array([node[find(int(x))] for x in hit], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tops), pa.array(node[hit].astype(np.int64)), pa.array(links[hit])], schema=schema)

    return run, "a long, b long, links long"


def _tiles(sets: DataFrame) -> DataFrame:
    """The sets, once for each tile they are compared in; side 0, 1, or 2 for both."""
    totals = written(sets.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.sum("n") * 8 / TILE_BYTES, F.count(F.lit(1)) / TILE_SETS)).alias("parts")))
    near = {d: totals.select("cluster", (F.col("band") - d).alias("band"), F.col("parts").alias(name)) for d, name in ((1, "above"), (-1, "below"))}
    parts = written(totals.join(near[1], ["cluster", "band"], "left").join(near[-1], ["cluster", "band"], "left"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    own = sets.join(small_side(parts), ["cluster", "band"]).withColumn("part", part)

    def numbers(n: str) -> F.Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).otherwise(F.array().cast("array<long>"))

    def tile(band: F.Column, low: F.Column, up: int, high: F.Column, side: F.Column) -> F.Column:
        return F.struct(F.concat_ws("/", F.col("cluster"), band, low, F.lit(up), high).alias("tile"), side.alias("side"))

    band, p = F.col("band"), F.col("part")
    same = F.transform(numbers("parts"), lambda q: tile(band, F.least(p, q), 0, F.greatest(p, q), F.when(q == p, 2).when(q > p, 0).otherwise(1)))
    above = F.transform(numbers("above"), lambda q: tile(band, p, 1, q, F.lit(0)))
    below = F.transform(numbers("below"), lambda q: tile(band - 1, q, 1, p, F.lit(1)))
    return own.withColumn("at", F.explode(F.concat(same, above, below))).select("at.tile", "at.side", "node", "copies", "hashes")


def ngram_join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs (doc_id, text, and any others).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word
    shingles. component_id is the smallest doc_id reachable by links, n_links the number of other
    documents linked to this one. A null or blank text has an empty set, no links and itself as
    component. Fewer than k words are one shingle. Rows with equal texts link; rows that share a
    doc_id count as one document for links. A row without doc_id has no place in candidates: it is
    only linked to the exact copies of its set, and has a null component if all of those lack an id.
    An empty table gives an empty result. Columns other than doc_id and text are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = written(map_arrow(rows, *_profiles(k)))
    classes = written(profile.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    of = written(profile.join(classes, "set_key", "left").select("doc_id", "n_shingles", "node", "copies"))
    size = profile.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(64, int(size * 4 * (100 - percent) / (100 + percent) / BUCKET))
    shuffled = map_arrow(rows, *_part_rows(k, percent, buckets)).repartition("bucket").sortWithinPartitions("bucket")
    found = written(map_arrow(shuffled, _bucket_pairs, "a long, b long").distinct())
    ids = of.where("doc_id is not null and node is not null").select("doc_id", "node").distinct()
    ends = found.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    clusters = components(ends)
    members = written(clusters.join(of.where("doc_id = node").select("node", "copies").distinct(), "node").select("node", F.col("component").alias("cluster"), "copies"))
    texts = rows.join(small_side(members), rows["doc_id"] == members["node"]).select("node", "cluster", "copies", "text")
    sets = written(map_arrow(texts, *_sets(k, percent)))
    tiles = _tiles(sets).repartition("tile").sortWithinPartitions("tile")
    links = written(map_arrow(tiles, *_compare(percent)))
    counts = links.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    labels = written(components(links).join(counts, "node", "left"))
    out = of.join(labels, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), n_links.cast("long").alias("n_links"))

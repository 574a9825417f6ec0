"""Exact largest inner products through a pivot-distance index.

With one more coordinate, the root of what a vector's squared length lacks to the largest, the largest
inner products with a query are the nearest neighbours of the query with a zero there. Pivots are
vectors that lie far apart. Each vector is keyed by its nearest pivot and its ring of distances to that
pivot, and each ring knows between which distances from the other pivots its vectors lie. A query first
visits the rings that can be nearest, until they hold enough vectors; the score it then has bounds its
distance, and the triangle inequality, applied to every pivot, leaves only the rings that can hold
anything as near. A ring is cut into blocks of
bounded rows, so that a vector that is repeated often spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import map_arrow
from sensorloom.sources.scratch import written

#: Vectors for which one ring is planned, and the least and most rings.
RING_ROWS, LEAST_RINGS, MOST_RINGS = 2_000, 16, 65_536
#: Vectors for each of which there is one pivot, the most pivots, and the vectors they are chosen from.
PIVOT_ROWS, MOST_PIVOTS, PIVOT_SAMPLE = 8, 256, 4_096
#: Numbers that the distances of all rings from pivots take at most, in either direction.
INTERVALS = 8_000_000
BLOCK_ROWS = 4_096
#: Times k vectors that the first rings visited by a query hold together.
FIRST = 4


@dataclass(frozen=True)
class Rings:
    """The index without its vectors: pivots, and the rings that hold any (MOST_RINGS at most)."""

    pivots: np.ndarray  # with the added coordinate
    most: float  # largest squared length
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    nearest: np.ndarray  # of each ring, the least distance to each of the first pivots
    farthest: np.ndarray

    def lower_bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least distance of each query (a row) to anything in each ring (a column)."""
        every = distances(np.pad(queries, ((0, 0), (0, 1))), self.pivots)
        d = every[:, self.pivot]
        least = np.maximum(0, np.maximum(d - self.high, self.low - d))
        for j in range(self.nearest.shape[1]):
            d = every[:, j, None]
            np.maximum(least, d - self.farthest[:, j], out=least)
            np.maximum(least, self.nearest[:, j] - d, out=least)
        return least

    def blocks(self) -> np.ndarray:
        return -(-self.rows // BLOCK_ROWS)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def raised(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the same length."""
    rest = np.sqrt(np.maximum(most - (vectors * vectors).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, each the one farthest from those before it."""
    chosen, least = [0], distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def _intervals(pivots: np.ndarray, most: float):
    """Of each ring, the least and the largest distance of its vectors to each pivot, rounded outwards."""
    schema = pa.schema([("ring", pa.int64()), ("near", pa.binary()), ("far", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        far: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ring = batch.column(0).to_numpy()
            order = np.argsort(ring, kind="stable")
            d = distances(raised(matrix(batch.column(1)).astype(np.float64), most), pivots)[order]
            at = np.flatnonzero(np.r_[True, np.diff(ring[order]) > 0])
            for r, low, high in zip(ring[order][at].tolist(), np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), strict=True):
                near[r] = np.minimum(near[r], low) if r in near else low
                far[r] = np.maximum(far[r], high) if r in far else high
        if near:
            low = [np.nextafter(near[r].astype("<f4"), np.float32(-np.inf)).tobytes() for r in near]
            high = [np.nextafter(far[r].astype("<f4"), np.float32(np.inf)).tobytes() for r in near]
            yield pa.RecordBatch.from_arrays([pa.array(list(near), pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], schema=schema)

    return run, "ring long, near binary, far binary"


def _merged(found: DataFrame, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of the rings in the order of keys; each task has one row a ring."""
    near, far = np.full((len(keys), n), np.inf, np.float32), np.full((len(keys), n), -np.inf, np.float32)
    for r in found.toLocalIterator():
        i = int(np.searchsorted(keys, r["ring"]))
        np.minimum(near[i], np.frombuffer(r["near"], "<f4"), out=near[i])
        np.maximum(far[i], np.frombuffer(r["far"], "<f4"), out=far[i])
    return near, far


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a binary column as rows of whole numbers."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<i8").reshape(len(data), -1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; in floating point only where that is exact."""
    size = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if size < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _whole(scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("square", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keep, dims, data, squares = batch.column(0), [], [], [], []
            for i, value in enumerate(batch.column(1)):
                if not value.is_valid or not ids[i].is_valid or not len(value) or value.values.null_count:
                    continue
                x = np.floor(value.values.to_numpy().astype(np.float64) * scale)
                if np.isfinite(x).all() and np.abs(x).max() < 2**62:
                    keep.append(i)
                    dims.append(len(x))
                    data.append(x.astype("<i8").tobytes())
                    squares.append(float((x * x).sum()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(squares, pa.float64())], schema=schema)

    return run, "vec_id long, dim int, vector binary, square double"


def _keyed(pivots: np.ndarray, most: float):
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("pivot", pa.int32()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(raised(matrix(batch.column(1)).astype(np.float64), most), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], schema=schema)

    return run, "vec_id long, vector binary, pivot int, distance double"


def _placed(bounds: dict[int, np.ndarray], rings: int):
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("ring", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ring = np.array([p * rings + np.searchsorted(bounds[p], x, side="right") for p, x in zip(pivot.tolist(), d, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ring), batch.column(3)], schema=schema)

    return run, "vec_id long, vector binary, ring long, distance double"


def _visits(index: Rings, keys: np.ndarray, k: int, later: bool):
    """The blocks that each query visits: the first rings, or later those that its bound leaves."""
    schema = pa.schema([("ring", pa.int64()), ("block", pa.int64()), ("vec_id", pa.int64()), ("vector", pa.binary())])
    blocks = index.blocks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q = matrix(batch.column(1)).astype(np.float64)
                low = index.lower_bounds(q)
                order = np.argsort(low, axis=1, kind="stable")
                held = np.cumsum(index.rows[order], axis=1)
                first = np.zeros(low.shape, bool)
                np.put_along_axis(first, order, held - index.rows[order] < FIRST * k, axis=1)
                take = first
                if later:
                    score = batch.column(2).fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.float64)
                    reach = np.maximum((q * q).sum(1) + index.most - 2 * score, 0)
                    slack = 1e-9 * ((q * q).sum(1) + index.most) + 1e-6
                    take = ~first & (low * low <= (reach + slack)[:, None])
                rows, rings = np.nonzero(take)
                times = blocks[rings]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows, rings = np.repeat(rows, times), np.repeat(rings, times)
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys[rings]), pa.array(block), picked.column(0), picked.column(1)], schema=schema)

    return run, "ring long, block long, vec_id long, vector binary"


def _scores(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(ids: np.ndarray, vectors: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            query = part.column(3).to_numpy()
            s = products(matrix(part.column(4)), vectors)
            out = [[], [], []]
            for i, q in enumerate(query):
                others = np.flatnonzero(ids != q)
                if len(others) > k:  # all that reach the k-th score, then ties by vec_id
                    least = np.partition(s[i, others], len(others) - k)[len(others) - k]
                    others = others[s[i, others] >= least]
                others = others[np.lexsort((ids[others], -s[i, others]))[:k]]
                out[0].append(np.full(len(others), q))
                out[1].append(ids[others])
                out[2].append(s[i, others])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by ring and block, its vectors (kind 0) before the queries (kind 1).
        key, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1), True])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                part, now = batch.slice(x, y - x), tuple(marks[x, :2])
                if now != key:
                    key, held, ready = now, [], None
                if marks[x, 2] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held) if held else None
                    ready = (table["vec_id"].to_numpy(), matrix(table["vector"])) if held else ()
                if ready:
                    yield from best(*ready, part)

    return run, "query_id long, vec_id long, score long"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visited_share(index: Rings, queries: np.ndarray, kth: np.ndarray) -> float:
    """Share of all vectors that lie in rings which the bounds leave to queries with these k-th scores."""
    squares = (queries * queries).sum(1)
    reach = np.sqrt(np.maximum(squares + index.most - 2 * kth, 0))
    left = index.lower_bounds(queries) <= reach[:, None]
    return float((left * index.rows).sum() / (len(queries) * index.rows.sum()))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query, exact.

    vectors has vec_id and embedding (and any other columns). A component x counts as floor(scale * x).
    Rows for which the condition queries holds are searched for among all rows but their own. Ties go
    to the smaller vec_id; a query with fewer than k others gets them all. Rows with a null id,
    with a null or empty vector, or with null or non-finite components take no part, nor do vectors
    whose number of components is not the most frequent one (of equally frequent ones, the smallest).
    Of rows that share a vec_id, one takes part. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    numbers = map_arrow(rows, *_whole(scale)).groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "square")).alias("x")).select("vec_id", "x.*")
    whole = written(numbers)
    sizes = whole.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("most")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = whole.where(F.col("dim") == sizes["dim"])
    cells = min(MOST_RINGS, max(LEAST_RINGS, sizes["n"] // RING_ROWS))
    n_pivots = int(min(MOST_PIVOTS, max(np.ceil(np.sqrt(cells)), sizes["n"] // PIVOT_ROWS)))
    rings = -(-cells // n_pivots)
    # Pivots are among vectors spread by a hash; sorted by it, so that the same rows give the same pivots.
    chosen = whole.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(PIVOT_SAMPLE).collect()
    most = float(sizes["most"])
    pivots = far_apart(raised(np.stack([np.frombuffer(r["vector"], "<i8") for r in chosen]).astype(np.float64), most), n_pivots)
    keyed = written(map_arrow(whole.select("vec_id", "vector"), *_keyed(pivots, most)))
    shares = [i / rings for i in range(1, rings)] or [0.5]
    bounds = {r["pivot"]: np.unique(r["cuts"]) for r in keyed.groupBy("pivot").agg(F.percentile_approx("distance", shares, 1000).alias("cuts")).collect()}
    placed = written(map_arrow(keyed, *_placed(bounds, rings + 1)))
    found = placed.groupBy("ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("ring").toPandas()
    keys = found["ring"].to_numpy()
    own = (found["low"].to_numpy(), found["high"].to_numpy(), found["n"].to_numpy())
    n_bounds = max(1, min(len(pivots), INTERVALS // len(keys)))
    gathered = map_arrow(placed.select("ring", "vector").repartition("ring"), *_intervals(pivots[:n_bounds], most))
    index = Rings(pivots, most, keys // (rings + 1), *own, *_merged(gathered, keys, n_bounds))
    table = spark.createDataFrame([(int(a), int(b)) for a, b in zip(keys, index.blocks(), strict=True)], "ring long, blocks long")
    blocked = placed.join(F.broadcast(table), "ring").select("ring", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "vector")
    asked = whole.where(queries).select("vec_id", "vector")

    def visit(visits: DataFrame) -> DataFrame:
        both = blocked.unionByName(visits.select("ring", "block", F.lit(1).alias("kind"), "vec_id", "vector"))
        dealt = both.repartition("ring", "block").sortWithinPartitions("ring", "block", "kind", "vec_id")
        return map_arrow(dealt, *_scores(k))

    first = written(_top(visit(map_arrow(asked, *_visits(index, keys, k, later=False))), k))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    bounded = asked.join(kth, "vec_id", "left").select("vec_id", "vector", "kth")
    second = visit(map_arrow(bounded, *_visits(index, keys, k, later=True)))
    return _top(first.drop("rank").unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

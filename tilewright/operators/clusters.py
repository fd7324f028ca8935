"""K-means of many groups at once, over weighted distinct points packed into blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage, ship_package

BLOCK = 16_384  # distinct points of a block; a group of one block is clustered in its task


def _shuffled(h: np.ndarray, seed: int, start: int) -> np.ndarray:
    """Another order of 64-bit hashes for each start."""
    x = h.view(np.uint64) ^ np.uint64((seed * 1_000_003 + start) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (start, point, centre); centres that a start does not have (NaN) are infinitely far."""
    out = np.zeros((len(centers), len(points), centers.shape[1]))
    for f in range(points.shape[1]):
        step = points[None, :, None, f] - centers[:, None, :, f]
        out += step * step
    return np.where(np.isnan(out), np.inf, out)


def sums_of(points: np.ndarray, weights: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(start, centre, features + 2): weighted sums, weight and cost of the points nearest to each centre."""
    away = distances(points, centers)
    own = away.argmin(2)
    cost = np.take_along_axis(away, own[:, :, None], 2)[:, :, 0] * weights
    out = np.zeros((*centers.shape[:2], points.shape[1] + 2))
    for j in range(centers.shape[1]):
        mine = np.where(own == j, weights, 0.0)
        out[:, j, :-2] = mine @ points
        out[:, j, -2] = mine.sum(1)
        out[:, j, -1] = np.where(own == j, cost, 0.0).sum(1)
    return out


def moved(centers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of the sums; a centre without points stays."""
    n = sums[:, :, -2:-1]
    return np.where(n > 0, sums[:, :, :-2] / np.where(n > 0, n, 1), centers)


def farthest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start the greatest distance to its centres, and the point (the last in order on ties)."""
    away = distances(points, centers).min(2)
    top = away.max(1)
    at = away.shape[1] - 1 - (away[:, ::-1] == top[:, None]).argmax(1)
    return top, points[at]


def cluster(points: np.ndarray, weights: np.ndarray, hashes: np.ndarray, k: int, seed: int, iterations: int, starts: int, tolerance: float) -> np.ndarray:
    """Centres of the best start of a group that is here as a whole; `points` are in order."""
    centers = np.full((starts, k, points.shape[1]), np.nan)
    for s in range(starts):
        centers[s, 0] = points[_shuffled(hashes, seed, s).argmin()]
    for j in range(1, k):
        far, at = farthest(points, centers)
        centers[far > 0, j] = at[far > 0]
    for _ in range(iterations):
        new = moved(centers, sums_of(points, weights, centers))
        step = np.nansum((new - centers) ** 2, 2).max()
        centers = new
        if step <= tolerance:
            break
    total = sums_of(points, weights, centers)[:, :, -1].sum(1)
    return centers[np.round(total, 9).argmin()]


def _flat(array: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return array.flatten().to_numpy(zero_copy_only=False), np.asarray(array.offsets) - array.offsets[0].as_py()


def _lists(values: np.ndarray, rows: int) -> pa.ListArray:
    """One list for each of `rows` equal parts of `values`; NaN is null."""
    flat = values.reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (len(flat) // max(1, rows)), pa.int32()), pa.array(flat, mask=np.isnan(flat)))


def packed(rows: DataFrame, features: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(image_id, blocks, points, weights, hashes): the distinct points of each group, in rows of about `block` points."""
    point = [F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]
    names = [f"_{i}" for i in range(len(features))]
    distinct = rows.select("image_id", *point).groupBy("image_id", *names).agg(F.count("*").cast("double").alias("_n"))
    distinct = distinct.withColumn("_h", F.xxhash64(*names))
    sizes = distinct.groupBy("image_id").agg(F.ceil(F.count("*") / block).cast("bigint").alias("blocks"))
    dealt = distinct.join(sizes, "image_id").withColumn("_b", F.pmod(F.col("_h"), F.col("blocks")))
    item = F.struct(F.array(*names).alias("p"), F.col("_n").alias("n"), F.col("_h").alias("h"))
    lists = dealt.groupBy("image_id", "blocks", "_b").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    return lists.select("image_id", "blocks", F.flatten("_l.p").alias("points"), F.col("_l.n").alias("weights"), F.col("_l.h").alias("hashes"))


def _blocks(batch: pa.RecordBatch, size: int):
    """(points, weights, hashes) of each row of a batch of packed blocks."""
    points, at = _flat(batch.column(2))
    weights, hashes = _flat(batch.column(3))[0], _flat(batch.column(4))[0]
    for lo, hi in zip(at[:-1], at[1:]):
        a, b = lo // size, hi // size
        yield points[lo:hi].reshape(-1, size), weights[a:b], hashes[a:b]


def best_centers(rows: DataFrame, features: Sequence[str], k: int, seed: int, iterations: int, starts: int, tolerance: float, block: int = BLOCK) -> DataFrame:
    """(image_id, _centers): the centres of the start of least cost for each group.

    A group of one block is clustered in one task, all its starts side by side. A larger one
    takes the same steps over its blocks: each block adds up all starts at once, and only
    sums by (group, start, centre) are shuffled, one round a step, whatever its size.
    """
    ship_package(rows.sparkSession)
    size = len(features)
    blocks = cut_lineage(packed(rows, features, block))
    key = blocks.schema["image_id"].dataType.simpleString()

    def alone(batches):
        for batch in batches:
            found = [cluster(*b, k, seed, iterations, starts, tolerance) for b in _blocks(batch, size)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.stack(found), len(found))], ["image_id", "_flat"])

    small = blocks.filter("blocks = 1").mapInArrow(alone, f"image_id {key}, _flat array<double>")
    large = blocks.filter("blocks > 1")
    flat = small
    if not large.isEmpty():
        flat = small.unionByName(_in_rounds(large, key, size, k, seed, iterations, starts, tolerance))
    centre = lambda j: F.slice("_flat", j * size + 1, size)
    return flat.select("image_id", F.filter(F.array(*[centre(j) for j in range(k)]), lambda c: F.get(c, F.lit(0)).isNotNull()).alias("_centers"))


def _in_rounds(blocks: DataFrame, key: str, size: int, k: int, seed: int, iterations: int, starts: int, tolerance: float) -> DataFrame:
    """(image_id, _flat) of groups of many blocks; the centres of all starts of a group are one row."""

    def picks(batches):
        for batch in batches:
            for at, (points, _, hashes) in enumerate(_blocks(batch, size)):
                order = [_shuffled(hashes, seed, s) for s in range(starts)]
                first = [o.argmin() for o in order]
                ranks = pa.array([int(o[i] >> np.uint64(1)) for o, i in zip(order, first)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * starts)), pa.array(range(starts), pa.int32()), ranks, _lists(points[first], starts)], ["image_id", "s", "rank", "p"])

    def far(batches):
        for batch in batches:
            centers, _ = _flat(batch.column(5))
            centers = centers.reshape(batch.num_rows, starts, k, size)
            for at, (points, _, _) in enumerate(_blocks(batch, size)):
                top, where = farthest(points, centers[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * starts)), pa.array(range(starts), pa.int32()), pa.array(top), _lists(where, starts)], ["image_id", "s", "rank", "p"])

    def add_up(batches):
        for batch in batches:
            centers, _ = _flat(batch.column(5))
            centers = centers.reshape(batch.num_rows, starts, k, size)
            for at, (points, weights, _) in enumerate(_blocks(batch, size)):
                sums = sums_of(points, weights, centers[at]).reshape(starts * k, size + 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * len(sums))), pa.array(range(len(sums)), pa.int32()), *[pa.array(c) for c in sums.T.copy()]], ["image_id", "s", *sums_names])

    sums_names = [f"v{i}" for i in range(size + 2)]
    missing = F.array(*[F.lit(None).cast("double")] * size)
    by_start = lambda df: df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("s", "p"))).alias("_l"))
    with_centers = lambda centers: blocks.join(centers, "image_id").select("image_id", "blocks", "points", "weights", "hashes", "_flat")
    candidate = f"image_id {key}, s int, rank {{}}, p array<double>"
    first = blocks.mapInArrow(picks, candidate.format("bigint")).groupBy("image_id", "s").agg(F.min(F.struct("rank", "p"))["p"].alias("p"))
    lines = F.transform("_l.p", lambda p: F.concat(p, *[missing] * (k - 1)))
    centers = cut_lineage(by_start(first).select("image_id", F.flatten(lines).alias("_flat")))
    for j in range(1, k):
        found = with_centers(centers).mapInArrow(far, candidate.format("double")).groupBy("image_id", "s").agg(F.max(F.struct("rank", "p")).alias("m"))
        found = by_start(found.select("image_id", "s", F.when(F.col("m.rank") > 0, F.col("m.p")).otherwise(missing).alias("p")))
        row = lambda s, j=j: F.concat(F.slice("_flat", s * k * size + 1, j * size), F.get("_l", s)["p"], *[missing] * (k - 1 - j))
        centers = cut_lineage(centers.join(found, "image_id").select("image_id", F.flatten(F.array(*[row(F.lit(s)) for s in range(starts)])).alias("_flat")))
    schema = f"image_id {key}, s int, " + ", ".join(f"{n} double" for n in sums_names)
    total = lambda c: with_centers(c).mapInArrow(add_up, schema).groupBy("image_id", "s").agg(*[F.sum(n).alias(n) for n in sums_names])
    for _ in range(iterations):
        means = total(centers).select("image_id", "s", F.when(F.col(sums_names[-2]) > 0, F.array(*[F.col(n) / F.col(sums_names[-2]) for n in sums_names[:-2]])).alias("p"))
        fresh = by_start(means)
        row = lambda i: F.coalesce(F.get("_l", F.lit(i))["p"], F.slice("_flat", i * size + 1, size))
        kept = cut_lineage(centers.join(fresh, "image_id").select("image_id", F.col("_flat").alias("_old"), F.flatten(F.array(*[row(i) for i in range(starts * k)])).alias("_flat")))
        centers = kept.select("image_id", "_flat")
        square = F.zip_with("_flat", "_old", lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0)))
        steps = [F.aggregate(F.slice(square, i * size + 1, size), F.lit(0.0), lambda s, x: s + x) for i in range(starts * k)]
        if kept.filter(F.greatest(*steps, F.lit(0.0)) > tolerance).isEmpty():
            break
    cost = total(centers).groupBy("image_id", F.floor(F.col("s") / k).alias("start")).agg(F.round(F.sum(sums_names[-1]), 9).alias("cost"))
    best = cost.groupBy("image_id").agg(F.min(F.struct("cost", "start"))["start"].alias("start"))
    return cut_lineage(centers.join(best, "image_id").select("image_id", F.slice("_flat", (F.col("start") * k * size + 1).cast("int"), F.lit(k * size)).alias("_flat")))

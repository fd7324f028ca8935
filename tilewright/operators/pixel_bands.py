"""Window sums and correlations over pixel rows of pictures of any size.

Pictures are cut into bands along their longer side. A band holds the windows that begin in
it, and the pixels of those windows: its own, and the first few lines of the next band, so a
pixel is copied once at most, whatever the size of the window. A task streams bands, turns
each into arrays and answers every window with four lookups in a summed-area table; a large
picture is as many bands as its longer side needs, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import ship_package

BAND = 256  # lines of a band at least; more where the window is larger
CELLS = 1 << 21  # products of a correlation that are held at once


@dataclass
class Band:
    """Place of a band: its first line, and how many lines and columns the picture has from there; `turned` if lines run down."""

    first: int
    lines: int
    columns: int
    turned: bool


def banded(rows: DataFrame, images: DataFrame, fw: int, fh: int, whole_windows: bool) -> DataFrame:
    """`rows` (image_id, y, x, ...) with `_band`, line `_u`, column `_v` and the picture's size.

    Pixels (`whole_windows` false) go to each band that needs them, two at most; window corners
    go to the one band they lie in.
    """
    size = max(BAND, fw, fh)
    sized = rows.join(images.select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h")), "image_id")
    tall = F.col("_h") >= F.col("_w")
    u = F.when(tall, F.col("y")).otherwise(F.col("x"))
    v = F.when(tall, F.col("x")).otherwise(F.col("y"))
    own = F.floor(u / size).cast("bigint")
    if whole_windows:
        bands: Column = own
    else:
        reach = F.when(tall, F.lit(fh)).otherwise(F.lit(fw)) - 1
        bands = F.explode(F.when((u - own * size < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own)))
    placed = sized.filter(F.col("x").between(0, F.col("_w") - 1) & F.col("y").between(0, F.col("_h") - 1))
    return placed.withColumn("_u", u.cast("bigint")).withColumn("_v", v.cast("bigint")).withColumn("_band", bands)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by its first `keys` columns, with the bounds between groups."""
    held: list[pa.RecordBatch] = []
    last = None

    def together(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in range(keys):
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return table, np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and any(c[0] != x for c, x in zip(columns, last))
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            done = [*held, batch.slice(0, cuts[-1])] if cuts[-1] else held
            yield together(done)
            held = []
            batch = batch.slice(cuts[-1])
        held.append(batch)
        last = [c[-1] for c in columns]
    if held:
        yield together(held)


def per_band(rows: DataFrame, size: int, work: Callable[[Band, dict[str, np.ndarray]], list[np.ndarray]], outputs: str, columns: Sequence[str]) -> DataFrame:
    """Apply `work` to the arrays of each band; it gives columns (line, column, ...) of windows, which come out as (image_id, y0, x0, `outputs`)."""
    key = rows.schema["image_id"].dataType.simpleString()
    schema = f"image_id {key}, y0 bigint, x0 bigint, {outputs}"
    names = [f.split()[0] for f in schema.split(", ")]
    ship_package(rows.sparkSession)

    def run(batches):
        for table, bounds in whole_groups(batches, 2):
            arrays = {c: table.column(c).to_numpy() for c in ["_band", "_u", "_v", "_w", "_h", *columns]}
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                w, h = int(arrays["_w"][lo]), int(arrays["_h"][lo])
                turned = h < w
                first = int(arrays["_band"][lo]) * size
                band = Band(first, (w if turned else h) - first, h if turned else w, turned)
                u, v, *values = work(band, {c: a[lo:hi] for c, a in arrays.items()})
                if len(u):
                    y, x = (v, u + first) if turned else (u + first, v)
                    image = table.column(0).combine_chunks().take(pa.array(np.full(len(u), lo)))
                    yield pa.RecordBatch.from_arrays([image, pa.array(y.astype(np.int64)), pa.array(x.astype(np.int64)), *[pa.array(c) for c in values]], names)

    dealt = rows.select("image_id", "_band", "_u", "_v", "_w", "_h", *columns).repartition("image_id", "_band").sortWithinPartitions("image_id", "_band")
    return dealt.mapInArrow(run, schema)


def summed_area(values: np.ndarray) -> np.ndarray:
    """Sums over all cells above and to the left, with a line and a column of zeros before them."""
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    np.cumsum(np.cumsum(values, axis=0), axis=1, out=out[1:, 1:])
    return out


def window_sums(table: np.ndarray, u: np.ndarray, v: np.ndarray, du: int, dv: int) -> np.ndarray:
    """Sums of du x dv windows at all (u, v), by four lookups each."""
    at = lambda a, b: table[np.ix_(a, b)]
    return at(u + du, v + dv) - at(u, v + dv) - at(u + du, v) + at(u, v)


def correlate(values: np.ndarray, fragment: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sum of products of a fragment with the window at each (u, v), line by line of the fragment."""
    out = np.zeros((len(u), len(v)))
    step = max(1, CELLS // max(1, len(v) * fragment.shape[1]))
    for lo in range(0, len(u), step):
        for line, weights in enumerate(fragment):
            part = np.lib.stride_tricks.sliding_window_view(values[u[lo : lo + step] + line], fragment.shape[1], axis=1)
            out[lo : lo + step] += part[:, v] @ weights
    return out


def _grid(band: Band, size: int, du: int, dv: int, su: int, sv: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines (from the band's first) and columns where windows of the band begin."""
    last = min(size - 1, band.lines - du)
    begin = -band.first % su
    return np.arange(begin, last + 1, su), np.arange(0, band.columns - dv + 1, sv)


def _cells(band: Band, arrays: dict[str, np.ndarray], height: int) -> tuple[np.ndarray, tuple[int, int]]:
    return (arrays["_u"] - band.first) * band.columns + arrays["_v"], (height, band.columns)


def _plane(at: np.ndarray, shape: tuple[int, int], weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, shape[0] * shape[1]).reshape(shape).astype(float)


def window_means(pixels: DataFrame, images: DataFrame, value: str, fw: int, fh: int, stride_x: int, stride_y: int) -> DataFrame:
    """(image_id, y0, x0, mean) of every fw x fh window at multiples of the strides that has a pixel with a value."""
    size = max(BAND, fw, fh)
    known = pixels.select("image_id", "y", "x", F.col(value).cast("double").alias("_a")).filter("_a is not null")

    def work(band, arrays):
        du, dv, su, sv = (fw, fh, stride_x, stride_y) if band.turned else (fh, fw, stride_y, stride_x)
        u, v = _grid(band, size, du, dv, su, sv)
        if not len(u) or not len(v):
            return [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        at, shape = _cells(band, arrays, min(band.lines, size + du - 1))
        n = window_sums(summed_area(_plane(at, shape)), u, v, du, dv)
        total = window_sums(summed_area(_plane(at, shape, arrays["_a"])), u, v, du, dv)
        i, j = np.nonzero(n > 0.5)
        return [u[i], v[j], total[i, j] / np.rint(n[i, j])]

    return per_band(banded(known, images, fw, fh, False), size, work, "mean double", ["_a"])


def window_correlations(pixels: DataFrame, images: DataFrame, value: str, fragment: DataFrame, fw: int, fh: int, stride_x: int, stride_y: int) -> DataFrame:
    """(image_id, y0, x0, score): normalised correlation of each window with a fragment (dy, dx, f).

    Sums run over the places that both the window and the fragment have; where nothing is
    missing, the window's sums come from summed-area tables and only the products are
    correlated. At most fw * fh sums of the fragment pass the driver. A window that shares no
    place with the fragment is left out; one without variation scores 0.
    """
    size = max(BAND, fw, fh)
    inside = fragment.filter(F.col("dy").between(0, fh - 1) & F.col("dx").between(0, fw - 1) & F.col("f").isNotNull())
    f = F.col("f").cast("double")
    sums = inside.groupBy("dy", "dx").agg(F.count("*").alias("n"), F.sum(f).alias("b"), F.sum(f * f).alias("bb")).collect()
    weights = np.zeros((3, fh, fw))
    for r in sums:
        weights[:, int(r["dy"]), int(r["dx"])] = r["n"], r["b"], r["bb"]
    known = pixels.select("image_id", "y", "x", F.col(value).cast("double").alias("_a")).filter("_a is not null")

    def work(band, arrays):
        du, dv, su, sv = (fw, fh, stride_x, stride_y) if band.turned else (fh, fw, stride_y, stride_x)
        u, v = _grid(band, size, du, dv, su, sv)
        if not len(u) or not len(v):
            return [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        one, own, square = weights.transpose(0, 2, 1) if band.turned else weights
        at, shape = _cells(band, arrays, min(band.lines, size + du - 1))
        here, a, aa = _plane(at, shape), _plane(at, shape, arrays["_a"]), _plane(at, shape, arrays["_a"] ** 2)
        ab = correlate(a, own, u, v)
        if (here == 1).all() and (one == 1).all():
            n, b, bb = np.full(ab.shape, float(du * dv)), np.full(ab.shape, own.sum()), np.full(ab.shape, square.sum())
            a, aa = (window_sums(summed_area(p), u, v, du, dv) for p in (a, aa))
        else:
            n, b, bb = correlate(here, one, u, v), correlate(here, own, u, v), correlate(here, square, u, v)
            a, aa = correlate(a, one, u, v), correlate(aa, one, u, v)
        i, j = np.nonzero(n > 0.5)
        n, a, b, ab, aa, bb = (p[i, j] for p in (n, a, b, ab, aa, bb))
        spread = (aa - a * a / n) * (bb - b * b / n)
        score = np.where(spread > 0, (ab - a * b / n) / np.sqrt(np.where(spread > 0, spread, 1)), 0.0)
        return [u[i], v[j], score]

    return per_band(banded(known, images, fw, fh, False), size, work, "score double", ["_a"])


def full_windows(points: DataFrame, pixels: DataFrame, images: DataFrame, w: int, h: int) -> DataFrame:
    """Rows of `points` (image_id, y, x, ...) whose w x h window has every pixel set (`mask`).

    Set pixels and points meet in bands; a point is answered by four lookups.
    """
    size = max(BAND, w, h)
    kept = F.struct(*[F.col(c) for c in points.columns])
    marks = banded(pixels.filter("mask").select("image_id", "y", "x"), images, w, h, False)
    asked = banded(points.withColumn("_p", kept).select("image_id", "y", "x", "_p"), images, w, h, True)
    place = ["image_id", "_band", "_u", "_v", "_w", "_h"]
    rows = marks.select(*place, F.lit(None).cast(asked.schema["_p"].dataType).alias("_p")).unionByName(asked.select(*place, "_p"))
    ship_package(rows.sparkSession)

    def run(batches):
        for table, bounds in whole_groups(batches, 2):
            band_of, u, v, width, height = (table.column(c).to_numpy() for c in place[1:])
            point = table.column("_p").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            found = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                ask = lo + np.flatnonzero(point[lo:hi])
                if len(ask) == hi - lo or not len(ask):
                    continue
                turned = height[lo] < width[lo]
                du, dv = (w, h) if turned else (h, w)
                lines, columns = (width[lo], height[lo]) if turned else (height[lo], width[lo])
                first = band_of[lo] * size
                shape = (int(min(lines - first, size + du - 1)), int(columns))
                ask = ask[(u[ask] - first + du <= shape[0]) & (v[ask] + dv <= shape[1])]
                set_ = lo + np.flatnonzero(~point[lo:hi])
                plane = np.zeros(shape)
                plane[u[set_] - first, v[set_]] = 1
                sums = summed_area(plane)
                a, b = u[ask] - first, v[ask]
                full = sums[a + du, b + dv] - sums[a, b + dv] - sums[a + du, b] + sums[a, b] > du * dv - 0.5
                found.append(ask[full])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(at):
                yield pa.RecordBatch.from_arrays([table.column("_p").combine_chunks().take(pa.array(at))], ["_p"])

    dealt = rows.repartition("image_id", "_band").sortWithinPartitions("image_id", "_band")
    schema = f"_p {asked.schema['_p'].dataType.simpleString()}"
    return dealt.mapInArrow(run, schema).select("_p.*")

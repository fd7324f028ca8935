"""Window sums, correlations and fits over bands, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import masks as om
from tilewright.operators import pixel_bands as pb
from tilewright.operators import pixels as px


@pytest.fixture(scope="module")
def pictures():
    """Tall, wide, square and tiny pictures, with and without missing pixels; one smaller than the window."""
    draw = random.Random(5)
    out = {}
    for image, (w, h, kept) in {1: (7, 40, 1.0), 2: (45, 6, 1.0), 3: (12, 12, 0.7), 4: (3, 2, 1.0), 5: (30, 31, 1.0), 6: (25, 9, 0.9)}.items():
        out[image] = (w, h, {(y, x): draw.randrange(5) for y in range(h) for x in range(w) if draw.random() < kept})
    return out


def frames(spark, pictures):
    rows = [(i, y, x, v) for i, (_, _, cells) in pictures.items() for (y, x), v in cells.items()] + [(3, 0, 0, None), (99, 0, 0, 1), (1, -1, 0, 9), (1, 0, 99, 9)]
    pixels = spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint, v bigint").filter("not (image_id = 3 and y = 0 and x = 0 and v is not null)")
    pictures[3][2].pop((0, 0), None)
    return pixels.repartition(7), spark.createDataFrame([(i, w, h) for i, (w, h, _) in pictures.items()], "image_id bigint, w bigint, h bigint")


def windows(pictures, fw, fh, sx, sy):
    for i, (w, h, cells) in pictures.items():
        for y0 in range(0, h - fh + 1, sy):
            for x0 in range(0, w - fw + 1, sx):
                yield i, y0, x0, {(y - y0, x - x0): v for (y, x), v in cells.items() if y0 <= y < y0 + fh and x0 <= x < x0 + fw}


@pytest.mark.parametrize("fw,fh,sx,sy", [(4, 3, 1, 1), (2, 6, 3, 2), (1, 1, 1, 5)])
def test_window_means(spark, pictures, monkeypatch, fw, fh, sx, sy):
    monkeypatch.setattr(pb, "BAND", 8)
    pixels, images = frames(spark, pictures)
    got = {(r["image_id"], r["y0"], r["x0"]): r["mean"] for r in pb.window_means(pixels, images, "v", fw, fh, sx, sy).collect()}
    want = {(i, y, x): sum(c.values()) / len(c) for i, y, x, c in windows(pictures, fw, fh, sx, sy) if c}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("holes", [False, True])
def test_window_correlations(spark, pictures, monkeypatch, holes):
    monkeypatch.setattr(pb, "BAND", 8)
    monkeypatch.setattr(pb, "CELLS", 50)
    fw, fh = 5, 4
    draw = random.Random(2)
    part = {(dy, dx): draw.randrange(9) for dy in range(fh) for dx in range(fw) if not holes or (dy + dx) % 3}
    fragment = spark.createDataFrame([(*k, v) for k, v in part.items()] + [(fh, 0, 7), (0, -1, 7), (0, 0, None)], "dy bigint, dx bigint, f bigint")
    pixels, images = frames(spark, pictures)
    got = {(r["image_id"], r["y0"], r["x0"]): r["score"] for r in pb.window_correlations(pixels, images, "v", fragment, fw, fh, 2, 1).collect()}
    want = {}
    for i, y, x, cells in windows(pictures, fw, fh, 2, 1):
        both = [(cells[k], part[k]) for k in cells if k in part]
        if both:
            a, b = np.array(both, float).T
            below = ((a * a).sum() - a.sum() ** 2 / len(a)) * ((b * b).sum() - b.sum() ** 2 / len(b))
            want[i, y, x] = ((a * b).sum() - a.sum() * b.sum() / len(a)) / below**0.5 if below > 0 else 0.0
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    best = px.top_similar(pixels, images, fragment, fw, fh, k=2, stride=1)
    assert best.groupBy("image_id").count().filter("count = 2").count() == 5  # picture 4 is too small


def test_full_windows(spark, pictures, monkeypatch):
    monkeypatch.setattr(pb, "BAND", 8)
    pixels, images = frames(spark, pictures)
    marked = pixels.withColumn("mask", F.col("v") > 0)
    points = pixels.filter("v is not null").select("image_id", "y", "x", F.lit("kept").alias("_u"))
    twice = points.unionByName(points.filter("image_id = 5"))
    w, h = 3, 2
    got = sorted(tuple(r) for r in om.box_fits(twice, marked, images, w, h).collect())
    want = []
    for i, (width, height, cells) in pictures.items():
        for y, x in cells:
            if x + w < width and y + h < height and all(cells.get((y + dy, x + dx), 0) for dy in range(h) for dx in range(w)):
                want += [(i, y, x, "kept")] * (2 if i == 5 else 1)
    assert want and got == sorted(want)


def test_a_pixel_is_in_two_bands_at_most(spark, monkeypatch):
    monkeypatch.setattr(pb, "BAND", 8)
    pixels = spark.range(100 * 60).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 60).alias("y"), (F.col("id") % 60).alias("x"))
    images = spark.createDataFrame([(1, 60, 100)], "image_id int, w bigint, h bigint")
    for fw, fh in ((1, 1), (5, 8), (40, 30)):
        copies = pb.banded(pixels, images, fw, fh, False).groupBy("y", "x").agg(F.count("*").alias("n"), F.count_distinct("_band").alias("d"))
        assert copies.filter("n > 2 or n <> d").count() == 0 and copies.count() == 6000
    assert pb.banded(pixels, images, 5, 8, False).select("_band").distinct().count() == 13


def test_empty_tables(spark):
    pixels = spark.createDataFrame([], "image_id bigint, y bigint, x bigint, v bigint, mask boolean")
    images = spark.createDataFrame([], "image_id bigint, w bigint, h bigint")
    assert pb.window_means(pixels, images, "v", 2, 2, 1, 1).collect() == [] and pb.full_windows(pixels.select("image_id", "y", "x"), pixels, images, 2, 2).collect() == []

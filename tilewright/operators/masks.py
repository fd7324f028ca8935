"""Masks as pixel rows or as runs: extents, runs, fits, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import islands
from tilewright.operators.pixel_bands import full_windows

RUN_BUCKET = 4096


def mask_bbox(pixels: DataFrame, images: DataFrame, pad: int = 0) -> DataFrame:
    """Extent of the foreground: inclusive corners with clamped padding, and percent box to 2 decimals."""
    box = pixels.filter("mask").groupBy("image_id").agg(
        F.min("y").alias("_y1"), F.min("x").alias("_x1"), F.max("y").alias("_y2"), F.max("x").alias("_x2")
    )
    w, h = F.col("w"), F.col("h")
    pct = lambda e, size: F.round(e / size * 100, 2)
    return box.join(images.select("image_id", "w", "h"), "image_id").select(
        "image_id",
        F.greatest(F.lit(0), F.col("_y1") - pad).alias("y1"),
        F.greatest(F.lit(0), F.col("_x1") - pad).alias("x1"),
        F.least(h - 1, F.col("_y2") + pad).alias("y2"),
        F.least(w - 1, F.col("_x2") + pad).alias("x2"),
        pct(F.col("_x1"), w).alias("x_pct"),
        pct(F.col("_y1"), h).alias("y_pct"),
        pct(F.col("_x2") - F.col("_x1") + 1, w).alias("w_pct"),
        pct(F.col("_y2") - F.col("_y1") + 1, h).alias("h_pct"),
    )


def mask_runs(pixels: DataFrame) -> DataFrame:
    """Maximal horizontal runs of set pixels: (image_id, y, x0, x1), both ends included."""
    rows = pixels.select("image_id", "y", "x", "mask")
    runs = islands(rows, ["image_id", "y"], ["x"], ["mask"], "run", chunk=F.floor(F.col("x") / 65_536))
    return runs.filter("mask").groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def box_fits(points: DataFrame, pixels: DataFrame, images: DataFrame, w: int, h: int) -> DataFrame:
    """Points where a w x h placement lies inside the image with every mask pixel set.

    A point is answered by four lookups in the summed mask of its part of the picture; equal
    points stay as many rows as they are.
    """
    inside = points.join(images.select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h")), "image_id")
    inside = inside.filter((F.col("x") + w < F.col("_w")) & (F.col("y") + h < F.col("_h"))).select(*points.columns)
    return full_windows(inside, pixels, images, w, h)


def mask_run_stats(runs: DataFrame) -> DataFrame:
    """Area and extent of masks given as (mask_id, start, len, width) runs over row-major positions."""
    last = F.col("start") + F.col("len") - 1
    y0, y1 = F.floor(F.col("start") / F.col("width")), F.floor(last / F.col("width"))
    one = y0 == y1
    return runs.groupBy("mask_id").agg(
        F.sum("len").alias("area"),
        F.min(F.when(one, F.col("start") % F.col("width")).otherwise(0)).alias("x0"),
        F.min(y0).alias("y0"),
        F.max(F.when(one, last % F.col("width")).otherwise(F.col("width") - 1)).alias("x1"),
        F.max(y1).alias("y1"),
    )


def mask_overlap(a: DataFrame, b: DataFrame, on: str = "image_id") -> DataFrame:
    """Common area of two masks per image, by a bucketed range join of their runs."""

    def bucketed(df: DataFrame, alias: str) -> DataFrame:
        last = F.col("start") + F.col("len") - 1
        buckets = F.sequence(F.floor(F.col("start") / RUN_BUCKET), F.floor(last / RUN_BUCKET))
        return df.select(on, "mask_id", "start", (F.col("start") + F.col("len")).alias("stop"), F.explode(buckets).alias("_b")).alias(alias)

    lo, hi = F.greatest("l.start", "r.start"), F.least("l.stop", "r.stop")
    cond = (
        (F.col(f"l.{on}") == F.col(f"r.{on}")) & (F.col("l._b") == F.col("r._b")) & (lo < hi) & (F.floor(lo / RUN_BUCKET) == F.col("l._b"))
    )
    pairs = bucketed(a, "l").join(bucketed(b, "r"), cond)
    return pairs.groupBy(F.col(f"l.{on}").alias(on), F.col("l.mask_id").alias("a"), F.col("r.mask_id").alias("b")).agg(F.sum(hi - lo).alias("overlap"))

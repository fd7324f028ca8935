"""Aggregates and joins of pixel rows (image_id, y, x, channels...)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.pixels import WARMTH_GAP, placement_color, sky_color
from tilewright.operators.ordered import top_per_group
from tilewright.operators.pixel_bands import window_correlations, window_means


def color_placement_mask(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Placement mask from hue, sat, val, gray columns: ground colours without sky."""
    sized = pixels.join(images.select("image_id", F.col("h").alias("_h")), "image_id")
    good = placement_color("hue", "sat", "val") & ~sky_color("hue", "sat", "val", "gray", "y", "_h")
    return sized.withColumn("mask", good).drop("_h")


def combine_masks(mask_pixels: DataFrame) -> DataFrame:
    """OR of the masks of an image as 0/1 and 0/255."""
    on = mask_pixels.groupBy("image_id", "y", "x").agg(F.max((F.col("value") > 0).cast("int")).alias("mask"))
    return on.withColumn("out", F.col("mask") * 255)


def binarize_mask(mask_pixels: DataFrame, background: int = 0, value: str = "value") -> DataFrame:
    return mask_pixels.withColumn("mask", (F.col(value) != background).cast("int"))


def horizon_row(pixels: DataFrame, images: DataFrame, road: int = 0) -> DataFrame:
    """Highest row with class road, else 30 % of the height."""
    top = pixels.filter(F.col("cls") == road).groupBy("image_id").agg(F.min("y").alias("_top"))
    default = F.floor(F.col("h") * 3 / 10)
    return images.join(top, "image_id", "left").select("image_id", F.coalesce("_top", default).cast("bigint").alias("horizon"))


def luminance_stats(pixels: DataFrame, lum: str = "v", mask: str | None = None) -> DataFrame:
    """Mean and population deviation per image; an image whose mask is empty is an error."""
    value = F.col(lum) if mask is None else F.when(F.col(mask), F.col(lum))
    out = pixels.groupBy("image_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("_n"))
    ok = F.when(F.col("_n") == 0, F.raise_error(F.concat(F.lit("empty mask for image "), F.col("image_id").cast("string")))).otherwise(F.lit(True))
    return out.filter(ok).drop("_n")


def luminance_percentiles(pixels: DataFrame, lo: float = 50, hi: float = 95, lum: str = "v", mask: str | None = None) -> DataFrame:
    """Interpolated percentiles per image, from counts per level so that pixels combine before the shuffle."""
    rows = pixels if mask is None else pixels.filter(mask)
    levels = rows.groupBy("image_id", lum).agg(F.count("*").alias("_n"))
    at = lambda p: F.percentile(lum, p / 100, F.col("_n"))
    return levels.groupBy("image_id").agg(at(lo).alias("low"), at(hi).alias("high"))


def color_profile(pixels: DataFrame, mask: str | None = None) -> DataFrame:
    """Mean b, g, r of a region, brightness of the whole picture, colour temperature; 128 for an empty region."""
    b, g, r = [F.col(c) if mask is None else F.when(F.col(mask), F.col(c)) for c in "bgr"]
    gray = F.avg(F.round(F.col("b") * 0.114 + F.col("g") * 0.587 + F.col("r") * 0.299, 0))
    out = pixels.groupBy("image_id").agg(*[F.avg(c).alias(f"_{n}") for c, n in zip((b, g, r), "bgr")], gray.alias("_gray"))
    empty = F.col("_b").isNull()
    kind = F.when(F.col("_b") > F.col("_r") + WARMTH_GAP, "cool").when(F.col("_r") > F.col("_b") + WARMTH_GAP, "warm").otherwise("neutral")
    return out.select(
        "image_id", *[F.coalesce(F.col(f"_{n}"), F.lit(128.0)).alias(f"mean_{n}") for n in "bgr"],
        F.when(empty, F.lit(128.0)).otherwise(F.col("_gray")).alias("brightness"), kind.alias("temperature"),
    )


def channel_histogram(pixels: DataFrame, channels: Sequence[str], bins: int = 50, lo: float = 0, hi: float = 255) -> DataFrame:
    """Counts per image, channel and equal-width bin, the last bin closed."""
    long = pixels.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in channels])).alias("s"))
    bucket = F.least(F.lit(bins), F.width_bucket(F.col("s.value").cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))) - 1
    inside = long.filter(F.col("s.value").between(lo, hi))
    return inside.groupBy("image_id", F.col("s.channel").alias("channel"), bucket.alias("bin")).agg(F.count("*").alias("n"))


def class_centroids(pixels: DataFrame) -> DataFrame:
    mean = lambda c: F.floor(F.avg(c)).cast("bigint")
    return pixels.groupBy("image_id", "cls").agg(F.count("*").alias("pixels"), mean("y").alias("cy"), mean("x").alias("cx"))


def mean_cov(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = (), ridge: float = 1e-6) -> DataFrame:
    """Mean vector and sample covariance (plus a small ridge) as columns mean_<f> and cov_<f>_<g>."""
    aggs = [F.avg(f).alias(f"mean_{f}") for f in features]
    for i, f in enumerate(features):
        for j in range(i, len(features)):
            g = features[j]
            aggs.append((F.covar_samp(f, g) + (ridge if i == j else 0.0)).alias(f"cov_{f}_{g}"))
    return rows.groupBy(*keys).agg(*aggs)


def mean_cov_vectors(rows: DataFrame, vector: str, size: int, ridge: float = 1e-6) -> DataFrame:
    """Mean and sample covariance of a vector column as rows (i, j, mean_i, cov) with i <= j, from 0.

    For many dimensions: a row meets its dimensions once, and each task adds up `size`
    covariances for each of them, so the shuffle carries size * size sums a task at most.
    """
    at = lambda j: F.get(vector, F.lit(j)).cast("double")
    spread = rows.select(vector, F.posexplode(vector).alias("i", "_v"))
    sums = spread.groupBy("i").agg(F.avg(F.col("_v").cast("double")).alias("mean_i"), F.array(*[F.covar_samp(F.col("_v").cast("double"), at(j)) for j in range(size)]).alias("_c"))
    out = sums.select("i", "mean_i", F.posexplode("_c").alias("j", "cov")).filter("j >= i")
    return out.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "mean_i", F.when(F.col("i") == F.col("j"), F.col("cov") + ridge).otherwise(F.col("cov")).alias("cov"))


def mahalanobis(features: Sequence[str], mean: Sequence[float], cov: np.ndarray) -> Column:
    """Distance of a row to a distribution of a few dimensions."""
    inverse = np.linalg.inv(np.asarray(cov, dtype=float))
    diff = [F.col(f) - float(m) for f, m in zip(features, mean)]
    total = F.lit(0.0)
    for i, a in enumerate(diff):
        for j, b in enumerate(diff):
            total = total + a * b * float(inverse[i, j])
    return F.sqrt(total)


def top_matches(
    pixels: DataFrame, images: DataFrame, background: DataFrame, features: Sequence[str], fw: int, fh: int, k: int = 5, stride_ratio: float = 0.25, per_image: bool = True
) -> DataFrame:
    """k windows of least mean Mahalanobis distance to the background's colours.

    Only the mean and the small covariance matrix of the background pass the driver.
    """
    stats = mean_cov(background, features).first()
    if stats is None or stats[f"mean_{features[0]}"] is None:
        raise ValueError("the background mask is empty")
    n = len(features)
    cov = np.empty((n, n))
    for i in range(n):
        for j in range(i, n):
            cov[i, j] = cov[j, i] = stats[f"cov_{features[i]}_{features[j]}"]
    scored = pixels.withColumn("_d", mahalanobis(features, [stats[f"mean_{f}"] for f in features], cov)).select("image_id", "y", "x", "_d")
    windows = window_means(scored, images, "_d", fw, fh, max(1, int(fw * stride_ratio)), max(1, int(fh * stride_ratio)))
    means = windows.select("image_id", "y0", "x0", F.round("mean", 6).alias("score"))
    return top_per_group(means, ["image_id"] if per_image else [], ["score", "image_id", "y0", "x0"], k)


def top_similar(pixels: DataFrame, images: DataFrame, fragment: DataFrame, fw: int, fh: int, k: int = 5, stride: int = 10, value: str = "v") -> DataFrame:
    """k best windows per image by normalised correlation with a fragment (dy, dx, f)."""
    windows = window_correlations(pixels, images, value, fragment, fw, fh, stride, stride)
    scored = windows.select("image_id", "y0", "x0", F.round("score", 6).alias("score"))
    return top_per_group(scored, ["image_id"], [F.desc("score"), "y0", "x0"], k)


def alpha_blend(background: DataFrame, fragment: DataFrame, y0: int, x0: int, alpha: float, value: str = "v") -> DataFrame:
    """Fragment pixels (dy, dx, f) over each background, moved to (y0, x0); zero fragment pixels are transparent.

    Fragment pixels beyond the border find no partner and are cut.
    """
    moved = fragment.filter("f <> 0").select((F.col("dy") + y0).alias("y"), (F.col("dx") + x0).alias("x"), F.col("f").cast("double").alias("_f"))
    joined = background.join(moved, ["y", "x"], "left")
    mixed = F.col("_f") * alpha + F.col(value) * (1 - alpha)
    return joined.withColumn(value, F.coalesce(mixed, F.col(value).cast("double"))).drop("_f").select(*background.columns)


def stitch_tiles(tile_pixels: DataFrame, images: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Tile-level mask pixels (tile corner y0, x0, offset dy, dx, value) to image pixels, cut at the border."""
    placed = tile_pixels.withColumn("y", F.col("y0") + F.col("dy")).withColumn("x", F.col("x0") + F.col("dx"))
    placed = placed.join(images.select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h")), "image_id")
    whole = placed.filter((F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).select("image_id", "y", "x", F.col("value"))
    if mask is None:
        return whole
    gate = mask.select("image_id", "y", "x", F.col("mask").alias("_m"))
    return whole.join(gate, ["image_id", "y", "x"], "left").withColumn("value", F.when(F.col("_m"), F.col("value")).otherwise(0)).drop("_m")

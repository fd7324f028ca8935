"""Luminosity and colour arithmetic on pixel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.hashing import as_col

# fixed values: HSV ranges (low, high), both ends included
ROAD = ((0, 0, 50), (180, 50, 150))
GROUND = [((10, 30, 80), (30, 150, 200)), ((20, 50, 100), (35, 200, 255))]
GRASS = ((40, 30, 50), (80, 150, 180))
SKY = ((100, 50, 100), (130, 255, 255))
BRIGHT = 200
EPS = 1e-6
WARMTH_GAP = 10


def clip255(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))


def masked(mask, changed: Column, kept) -> Column:
    kept = as_col(kept).cast("double")
    return changed if mask is None else F.when(as_col(mask), changed).otherwise(kept)


def std_match(lum, src_mean, src_std, tgt_mean, tgt_std, mask=None, target_scale: float = 1.0) -> Column:
    """Move mean and spread of L to the target's, inside the mask."""
    moved = (as_col(lum) - as_col(src_mean)) * (as_col(tgt_std) / (as_col(src_std) + EPS)) + as_col(tgt_mean) * target_scale
    return masked(mask, clip255(moved), lum)


def percentile_match(lum, src_low, src_high, tgt_low, tgt_high, mask=None) -> Column:
    """Scale and shift L so that two percentiles land on the target's, inside the mask."""
    scale = (as_col(tgt_high) - as_col(tgt_low)) / (as_col(src_high) - as_col(src_low) + EPS)
    return masked(mask, clip255(scale * as_col(lum) + as_col(tgt_low) - scale * as_col(src_low)), lum)


def gamma_l(lum, gamma, mask=None) -> Column:
    """Gamma curve of L inside the mask; other pixels keep their value."""
    return masked(mask, clip255(F.pow(as_col(lum) / 255.0, as_col(gamma)) * 255.0), lum)


def scale_l(lum, factor, dimming: bool = False) -> Column:
    """L times a factor, cut to 0..255; the dimming form wants 0 < factor <= 1."""
    f = as_col(factor)
    scaled = clip255(as_col(lum) * f)
    if not dimming:
        return scaled
    return F.when((f > 0) & (f <= 1), scaled).otherwise(F.raise_error(F.lit("factor must be in (0, 1]")))


def in_range(h, s, v, bounds) -> Column:
    low, high = bounds
    parts = [as_col(c).between(a, b) for c, a, b in zip((h, s, v), low, high)]
    return parts[0] & parts[1] & parts[2]


def placement_color(h, s, v) -> Column:
    """Road, ground or grass colour."""
    out = in_range(h, s, v, ROAD) | in_range(h, s, v, GRASS)
    for bounds in GROUND:
        out = out | in_range(h, s, v, bounds)
    return out


def sky_color(h, s, v, gray, y, height) -> Column:
    """Sky blue anywhere, or bright in the top third."""
    return in_range(h, s, v, SKY) | ((as_col(y) < F.floor(as_col(height) / 3)) & (as_col(gray) > BRIGHT))

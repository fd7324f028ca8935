"""Box, crop and scale arithmetic as column expressions. Pixel boxes are x, y, w, h."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.hashing import as_col, hashrand

# fixed values of the crop rules
MIN_RATIO = 0.001
SCALE_LIMITS = (0.1, 3.0)
FAR_PAD = 4000
MIN_CUT_PAD = 100
CUT_MODES = ["TL", "TR", "BL", "BR"]


def overlaps(a: str, b: str) -> Column:
    """Strictly positive intersection of two aliased pixel boxes; touching edges do not count."""
    c = lambda s, n: F.col(f"{s}.{n}")
    return (
        (c(a, "x") < c(b, "x") + c(b, "w"))
        & (c(b, "x") < c(a, "x") + c(a, "w"))
        & (c(a, "y") < c(b, "y") + c(b, "h"))
        & (c(b, "y") < c(a, "y") + c(a, "h"))
    )


def box_convert(box: Sequence, frm: str, to: str, width=None, height=None) -> list[Column]:
    """Convert four box columns between forms.

    Forms: xywh, xyxy, slice (row0, row1, col0, col1), yolo (centre, 0..1),
    percent (corner, 0..100). Pixel results of fractional forms are cut toward zero.
    """
    p, q, r, s = [as_col(c) for c in box]
    W = as_col(width) if width is not None else None
    H = as_col(height) if height is not None else None
    if frm == "xywh":
        x, y, w, h = p, q, r, s
    elif frm == "xyxy":
        x, y, w, h = p, q, r - p, s - q
    elif frm == "slice":
        x, y, w, h = r, p, s - r, q - p
    elif frm == "yolo":
        x, y, w, h = [e.cast("bigint") for e in ((p - r / 2) * W, (q - s / 2) * H, r * W, s * H)]
    elif frm == "percent":
        x, y, w, h = [e.cast("bigint") for e in (p / 100 * W, q / 100 * H, r / 100 * W, s / 100 * H)]
    else:
        raise ValueError(f"unknown box form {frm}")
    if to == "xywh":
        return [x, y, w, h]
    if to == "xyxy":
        return [x, y, x + w, y + h]
    if to == "slice":
        return [y, y + h, x, x + w]
    if to == "yolo":
        return [(x + w / 2) / W, (y + h / 2) / H, w / W, h / H]
    if to == "percent":
        return [x / W * 100, y / H * 100, w / W * 100, h / H * 100]
    raise ValueError(f"unknown box form {to}")


def clamp_box(x, y, w, h, pads: Sequence, width, height) -> list[Column]:
    """x1, y1, x2, y2 of a box grown by (left, top, right, bottom) pads and cut to the image."""
    x, y, w, h = [as_col(c) for c in (x, y, w, h)]
    left, top, right, bottom = [as_col(p) for p in pads]
    return [
        F.greatest(F.lit(0), x - left).cast("bigint"),
        F.greatest(F.lit(0), y - top).cast("bigint"),
        F.least(as_col(width), x + w + right).cast("bigint"),
        F.least(as_col(height), y + h + bottom).cast("bigint"),
    ]


def crop_box(x, y, w, h, corners: Sequence[Column]) -> list[Column]:
    """Box of the object inside a crop with the given corners."""
    x1, y1, _, _ = corners
    return [as_col(x) - x1, as_col(y) - y1, as_col(w), as_col(h)]


def skewed_pads(max_pad, skew) -> tuple[Column, Column]:
    """Largest padding before and after; `skew` is an integer in hundredths, its sign names the smaller side."""
    m, k = as_col(max_pad), as_col(skew)
    less = F.floor(m * 100 / F.abs(k))
    return F.when(k < 0, m).otherwise(less).cast("bigint"), F.when(k < 0, less).otherwise(m).cast("bigint")


def engulf_crop(box: Sequence, skew_h, skew_v, max_h, max_v, min_pads: Sequence, width, height, seed, *key) -> list[Column]:
    """Crop around a box: each side draws a pad between its minimum and its skewed maximum."""
    x, y, w, h = box
    left, right = skewed_pads(max_h, skew_h)
    top, bottom = skewed_pads(max_v, skew_v)
    drawn = [
        hashrand(f"{seed}{side}", *key, lo=F.least(as_col(low), high), hi=high)
        for side, low, high in zip("ltrb", min_pads, (left, top, right, bottom))
    ]
    return clamp_box(x, y, w, h, drawn, width, height)


def cut_crop(box: Sequence, mode, max_pad_scale: int, width, height, seed, *key) -> list[Column]:
    """Crop from a point inside the box (40 to 60 %) to beyond the opposite corner."""
    x, y, w, h = [as_col(c) for c in box]
    mode, W, H = as_col(mode), as_col(width), as_col(height)
    inner = lambda side, at, size: at + hashrand(
        f"{seed}{side}", *key, lo=F.floor(size * 4 / 10), hi=F.floor(size * 6 / 10)
    )
    cx, cy = inner("x", x, w), inner("y", y, h)
    pad_h = F.greatest(F.lit(MIN_CUT_PAD), hashrand(f"{seed}h", *key, lo=F.lit(0), hi=w * max_pad_scale))
    pad_v = F.greatest(F.lit(MIN_CUT_PAD), hashrand(f"{seed}v", *key, lo=F.lit(0), hi=h * max_pad_scale))
    from_left, from_top = mode.isin("TL", "BL"), mode.isin("TL", "TR")
    return [
        F.greatest(F.lit(0), F.when(from_left, cx).otherwise(x - pad_h)).cast("bigint"),
        F.greatest(F.lit(0), F.when(from_top, cy).otherwise(y - pad_v)).cast("bigint"),
        F.least(W, F.when(from_left, x + w + pad_h).otherwise(cx)).cast("bigint"),
        F.least(H, F.when(from_top, y + h + pad_v).otherwise(cy)).cast("bigint"),
    ]


def resize_pad_meta(w, h, size: int) -> Column:
    """Scaled size and centred pads when the longer side becomes `size`."""
    w, h = as_col(w), as_col(h)
    scale = F.lit(float(size)) / F.greatest(w, h)
    new_w, new_h = F.bround(w * scale, 0).cast("bigint"), F.bround(h * scale, 0).cast("bigint")
    left, top = F.floor((size - new_w) / 2), F.floor((size - new_h) / 2)
    return F.struct(
        scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"),
        left.alias("pad_left"), (size - new_w - left).alias("pad_right"), top.alias("pad_top"), (size - new_h - top).alias("pad_bottom"),
    )


def unpad_range(meta: Column, size: int) -> Column:
    """Rows and columns of the padded picture that hold content."""
    return F.struct(
        meta["pad_top"].alias("row0"), (size - meta["pad_bottom"]).alias("row1"), meta["pad_left"].alias("col0"), (size - meta["pad_right"]).alias("col1")
    )


def perspective_scale(y, y2, horizon, horizon2, height, height2) -> Column:
    """Ratio of the distances to the horizon, each relative to its picture height."""
    old = F.greatest(F.abs(as_col(y) - as_col(horizon)) / as_col(height), F.lit(MIN_RATIO))
    new = F.greatest(F.abs(as_col(y2) - as_col(horizon2)) / as_col(height2), F.lit(MIN_RATIO))
    return F.least(F.lit(SCALE_LIMITS[1]), F.greatest(F.lit(SCALE_LIMITS[0]), new / old))


def horizon_scale(from_y, from_horizon, to_y, to_horizon, w, h, on_error: str = "raise") -> Column:
    """struct(w, h, scale); a base on or above its horizon is an error, or null with on_error='null'."""
    fy, fh, ty, th = [as_col(c) for c in (from_y, from_horizon, to_y, to_horizon)]
    good = (fy > fh) & (ty > th)
    scale = (ty - th) / (fy - fh)
    value = F.struct((as_col(w) * scale).cast("bigint").alias("w"), (as_col(h) * scale).cast("bigint").alias("h"), scale.alias("scale"))
    if on_error == "null":
        return F.when(good, value)
    return F.when(good, value).otherwise(F.raise_error(F.lit("base must lie below its horizon")))


def ground_scale(y, h) -> Column:
    at = as_col(y) / as_col(h)
    return F.when(at > 0.7, 1.0 + (at - 0.7) * 1.67).otherwise(0.3 + at / 0.7 * 0.7)


def keypoint_prompts(x, y, w, h, frame) -> Column:
    """Five points of a percent box as fractions: centre, left, right, top, bottom quarter; frame from 0."""
    x, y, w, h = [as_col(c) / 100 for c in (x, y, w, h)]
    points = [(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)]
    return F.array(
        *[F.struct((as_col(frame) - 1).alias("frame_idx"), (x + w * i / 4).alias("px"), (y + h * j / 4).alias("py")) for i, j in points]
    )


def points_to_percent(points, width, height) -> Column:
    """Pixel polygon to percent; points outside the picture are dropped."""
    moved = F.transform(as_col(points), lambda p: F.struct((p["x"] / as_col(width) * 100).alias("x"), (p["y"] / as_col(height) * 100).alias("y")))
    return F.filter(moved, lambda p: (p["x"] >= 0) & (p["x"] <= 100) & (p["y"] >= 0) & (p["y"] <= 100))

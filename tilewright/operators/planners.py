"""Plans of crops and synthetic scenes as rows; every random choice is a seeded hash."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import boxes as fb
from tilewright.functions.draws import KINDS, Ids
from tilewright.functions.hashing import digest, hash_unit, hashrand
from tilewright.operators import boxes as ob
from tilewright.operators.datasets import pair_by_position, total_rows
from tilewright.operators.masks import box_fits
from tilewright.operators.ordered import has_hot_group, hash_chunk, number_rows, top_per_group
from tilewright.session import cut_lineage, parallelism, ship_package

JITTER = 20  # fixed value: paddings vary by up to this many pixels
CORNERS = ["x1", "y1", "x2", "y2"]
HELD = 50_000  # rows of boxes and sizes that are planned side by side
PAIRS = 1 << 20  # points, and pairs of points and boxes, side by side
PACKED = 1 << 23  # fragments whose sizes are broadcast; more of them meet the draws by a shuffle


def _sizes(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.col("w").alias("iw"), F.col("h").alias("ih"))


def _named(cols: Sequence[Column], names: Sequence[str]) -> list[Column]:
    return [c.cast("bigint").alias(n) for c, n in zip(cols, names)]


def image_tiles(images: DataFrame, t: int) -> DataFrame:
    """Row-major grid of t x t tiles; tiles at the right and lower edge are smaller."""
    across = F.ceil(F.col("w") / t)
    grid = images.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1, F.lit(t).cast("bigint"))))
    grid = grid.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1, F.lit(t).cast("bigint"))))
    return grid.select(
        "image_id",
        (F.col("y") / t * across + F.col("x") / t).cast("bigint").alias("tile"),
        "y", "x",
        F.least(F.lit(t), F.col("w") - F.col("x")).cast("bigint").alias("tile_w"),
        F.least(F.lit(t), F.col("h") - F.col("y")).cast("bigint").alias("tile_h"),
    )


def gate_tiles(tiles: DataFrame, mask: DataFrame) -> DataFrame:
    """Whether the class mask holds at a tile's upper left pixel; a missing pixel closes the gate."""
    gate = mask.select("image_id", "y", "x", F.col("mask").alias("_m"))
    return tiles.join(gate, ["image_id", "y", "x"], "left").withColumn("scored", F.coalesce("_m", F.lit(False))).drop("_m")


def plan_positive_crops(boxes: DataFrame, images: DataFrame, seed: int, max_pad: int = 1000, min_pad: int = 20, merge: str | None = "greedy") -> DataFrame:
    """One crop per merged box with a random pad on each side, and the box inside the crop."""
    merged = boxes if merge is None else ob.merge_boxes(boxes, merge)
    if "ann_id" not in merged.columns:
        merged = merged.withColumn("ann_id", F.xxhash64("x", "y", "w", "h"))
    rows = merged.join(_sizes(images), "image_id")
    pads = [hashrand(f"{seed}{s}", "image_id", "ann_id", lo=F.lit(min_pad), hi=F.lit(max_pad)) for s in "ltrb"]
    corners = fb.clamp_box("x", "y", "w", "h", pads, "iw", "ih")
    inner = fb.crop_box("x", "y", "w", "h", corners)
    return rows.select("image_id", "ann_id", *_named(corners, CORNERS), *_named(inner, ["bx", "by", "bw", "bh"]))


def plan_negative_crops(boxes: DataFrame, images: DataFrame, seed: int, ratio: int = 1, max_size: int = 1000, attempts: int = 100) -> DataFrame:
    """`ratio` squares per box, free of all boxes, each the largest possible at its random point.

    The largest square at a point needs no search: a box that reaches right of and below
    the point limits it to the larger of the two distances. `attempts` points are tried per
    wanted square, in rounds of 2, 4, 8, ... points; only images that are still short of
    squares take part in the next round. Images of up to CELL boxes are planned in the task
    that their boxes are dealt to, larger ones by joins.
    """
    whole = all(df.schema[c].dataType.simpleString() in KINDS[:-1] for df, cols in ((boxes, "xywh"), (images, "wh")) for c in cols)
    plain = whole and all(df.schema["image_id"].dataType.simpleString() in KINDS for df in (boxes, images))
    odd = F.coalesce(F.col("w") <= 0, F.lit(True)) | F.coalesce(F.col("h") <= 0, F.lit(True))
    if not plain or not images.filter(F.col("image_id").isNotNull() & odd).isEmpty():
        return _squares_by_joins(boxes, images, seed, ratio, max_size, attempts)
    if not has_hot_group(boxes, ["image_id"], ob.CELL):
        return _squares_in_tasks(boxes, images, seed, ratio, max_size, attempts)
    large = boxes.groupBy("image_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > ob.CELL).select("image_id")
    small = _squares_in_tasks(boxes.join(large, "image_id", "left_anti"), images, seed, ratio, max_size, attempts)
    return small.unionByName(_squares_by_joins(boxes.join(large, "image_id", "left_semi"), images, seed, ratio, max_size, attempts))


def _squares_in_tasks(boxes: DataFrame, images: DataFrame, seed: int, ratio: int, max_size: int, attempts: int) -> DataFrame:
    """Squares of images that a task holds as a whole; boxes and sizes travel in one shuffle."""
    number = lambda c: F.col(c).cast("bigint").alias(c)
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    # a box without a place is wanted a square for, but limits none
    placed = [F.when(known, F.col(c)).otherwise(v).cast("bigint").alias(c) for c, v in (("x", -1), ("y", -1), ("w", 0), ("h", 0))]
    zero = F.lit(0).cast("bigint")
    sizes = images.select("image_id", F.lit(False).alias("_box"), zero.alias("x"), zero.alias("y"), number("w"), number("h"))
    rows = sizes.unionByName(boxes.select("image_id", F.lit(True).alias("_box"), *placed)).filter("image_id is not null")
    names, kind = ["image_id", "n", "x", "y", "size"], rows.schema["image_id"].dataType.simpleString()

    def plan(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        at, n, x, y, size = _largest_squares(batch.column(0).take(pa.array(starts)), starts, *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], seed, ratio, max_size, attempts)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts[at])), *map(pa.array, (n, x, y, size))], names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD:
                continue
            batch, starts = _keys(held)
            held = [batch.slice(starts[-1])]
            rows = 0  # a key that goes on is looked at again after as many rows
            if len(starts) > 1:
                yield plan(batch.slice(0, starts[-1]), starts[:-1])
        if sum(b.num_rows for b in held):
            yield plan(*_keys(held))

    ship_package(boxes.sparkSession)
    return rows.repartition("image_id").sortWithinPartitions("image_id", "_box").mapInArrow(run, f"image_id {kind}, n bigint, x bigint, y bigint, size bigint")


def _keys(batches: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    """Batches as one, and where the keys of its first column begin."""
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    key = whole.column(0)
    return whole, np.r_[0, 1 + np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))]


def _largest_squares(
    ids: pa.Array, starts: np.ndarray, is_box: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, seed: int, ratio: int, max_size: int, attempts: int
) -> tuple[np.ndarray, ...]:
    """(image, n, x, y, size) of the squares of images whose rows begin at `starts`: first the size, as often as the image comes, then boxes."""
    texts, count = Ids(ids), np.add.reduceat(is_box.astype(np.int64), starts)
    copies = np.diff(np.r_[starts, len(x)]) - count
    wanted, first = count * ratio, starts + copies  # the image's first box
    iw, ih, right, low = w[starts], h[starts], x + w, y + h
    need = -(-wanted // np.maximum(copies, 1))  # of different points; each comes as often as its image
    have, found = np.zeros(len(starts), np.int64), []
    begin, step = 0, 2
    short = np.flatnonzero((count > 0) & (copies > 0) & (need > 0))
    while begin < attempts and len(short):
        end = min(attempts, begin + step)
        for image in _slices(short, wanted[short] * (end - begin)):
            at = np.repeat(image, wanted[image] * (end - begin))
            draw = 1 + begin * wanted[at] + _count(wanted[image] * (end - begin))
            px, py = texts.number(f"{seed}x", at, draw) % iw[at], texts.number(f"{seed}y", at, draw) % ih[at]
            size = np.minimum(max_size, np.minimum(iw[at] - px, ih[at] - py))
            for point in _slices(np.arange(len(at)), count[at]):
                boxes = count[at[point]]
                pair, box = np.repeat(point, boxes), np.repeat(first[at[point]], boxes) + _count(boxes)
                limit = np.maximum(x[box] - px[pair], y[box] - py[pair])
                limit[(px[pair] >= right[box]) | (py[pair] >= low[box])] = max_size
                size[point] = np.minimum(size[point], np.minimum.reduceat(limit, np.cumsum(boxes) - boxes))
            good = np.flatnonzero(size > 0)
            per = np.bincount(at[good], minlength=len(starts))
            n = have[at[good]] + 1 + _count(per[image])
            good = good[n <= need[at[good]]]
            have += per
            found.append((at[good], px[good], py[good], size[good]))
        short = short[have[short] < need[short]]
        begin, step = end, 2 * step
    if not found:
        return (np.zeros(0, np.int64),) * 5
    at, *columns = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(at, kind="stable")
    order = np.repeat(order, copies[at[order]])
    at = at[order]
    n = 1 + _count(np.bincount(at, minlength=len(starts)))
    kept = n <= wanted[at]
    return at[kept], n[kept], *[c[order][kept] for c in columns]


def _slices(rows: np.ndarray, work: np.ndarray) -> list[np.ndarray]:
    """`rows` in slices of about PAIRS units of work, of one row at least."""
    return np.split(rows, 1 + np.flatnonzero(np.diff(np.cumsum(work) // PAIRS)))


def _squares_by_joins(boxes: DataFrame, images: DataFrame, seed: int, ratio: int, max_size: int, attempts: int) -> DataFrame:
    """Only boxes overlapping the largest allowed square can matter, so points and boxes meet in the cells of the boxes."""
    missing = cut_lineage(boxes.groupBy("image_id").agg((F.count("*") * ratio).alias("wanted")).join(_sizes(images), "image_id").withColumn("have", F.lit(0).cast("bigint")))
    distinct = boxes.select("image_id", "x", "y", "w", "h").distinct()
    cells = ob.fit_cells(distinct)
    found, begin, size = None, 0, 2
    while begin < attempts:
        end = min(attempts, begin + size)
        good = cut_lineage(_free_squares(missing, distinct, cells, seed, max_size, begin, end))
        found = good if found is None else found.unionByName(good)
        counted = good.groupBy("image_id").agg(F.max("n").alias("_have"))
        missing = cut_lineage(missing.join(counted, "image_id", "left").withColumn("have", F.coalesce("_have", "have")).drop("_have").filter("have < wanted"))
        if missing.isEmpty():
            break
        begin, size = end, 2 * size
    return found


def _free_squares(missing: DataFrame, boxes: DataFrame, cells: ob.Cells | None, seed: int, max_size: int, begin: int, end: int) -> DataFrame:
    """Squares at the draws begin * wanted + 1 .. end * wanted of each image, numbered on from those it has."""
    draws = F.sequence(F.col("wanted") * begin + 1, F.col("wanted") * end)
    points = missing.withColumn("draw", F.explode(draws)).select(
        "image_id", "draw", "wanted", "have",
        hashrand(f"{seed}x", "image_id", "draw", lo=F.lit(0), hi=F.col("iw") - 1).alias("x"),
        hashrand(f"{seed}y", "image_id", "draw", lo=F.lit(0), hi=F.col("ih") - 1).alias("y"),
        "iw", "ih",
    )
    room = F.least(F.lit(max_size), F.col("iw") - F.col("x"), F.col("ih") - F.col("y")).cast("bigint")
    squares = points.select("image_id", "draw", "wanted", "have", "x", "y", room.alias("w"), room.alias("h"))
    pairs = ob.overlap_join(squares, boxes, cells=cells, fitted=True)
    limit = F.greatest(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    limits = pairs.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.draw").alias("draw")).agg(F.min(limit).alias("_limit"))
    sized = squares.join(limits, ["image_id", "draw"], "left").withColumn("size", F.least("w", F.col("_limit"))).filter("size > 0")
    good = number_rows(sized.select("image_id", "draw", "wanted", "have", "x", "y", "size"), ["image_id"], ["draw"], "n", F.floor(F.col("draw") / 65_536))
    return good.withColumn("n", F.col("n") + F.col("have")).filter(F.col("n") <= F.col("wanted")).select("image_id", "n", "x", "y", "size")


def _pick_annotation(draws: DataFrame, anns: DataFrame, counts: DataFrame, seed: str) -> DataFrame:
    """A random annotation of the image for each (image_id, draw)."""
    at = hashrand(seed, "image_id", "draw", lo=F.lit(1), hi=F.col("_n"))
    picked = draws.join(counts, "image_id").withColumn("_rank", at).drop("_n")
    return picked.join(anns, ["image_id", "_rank"])


def _ranked(anns: DataFrame, chunk=None) -> tuple[DataFrame, DataFrame]:
    rows = number_rows(anns.select("image_id", "ann_id", "x", "y", "w", "h"), ["image_id"], ["ann_id"], "_rank", chunk)
    return rows, anns.groupBy("image_id").agg(F.count("*").alias("_n"))


def _jitter(seed: str, base: int) -> Column:
    return F.lit(base) + hashrand(seed, "image_id", "draw", lo=F.lit(-JITTER), hi=F.lit(JITTER))


def plan_crops(anns: DataFrame, images: DataFrame, n: int, seed: int, mode: str | None = None, max_skew: int = 300, compat: bool = False, chunk=None) -> DataFrame:
    """Crop corners: one close and one far crop per annotation, then n random ones per image.

    A random crop engulfs a random annotation (2 of 3) or cuts through it. With `compat`
    the first draw fixes the kind for the whole image. `max_skew` is in hundredths.
    """
    if n < 0:
        raise ValueError("the number of crops must not be negative")
    ranked, counts = _ranked(anns, chunk)
    box, size = ["x", "y", "w", "h"], ("iw", "ih")
    per_ann = ranked.join(_sizes(images), "image_id").withColumn("draw", F.col("ann_id"))
    even = F.lit(100)

    def fixed(kind: str, reach: int, least: int | None) -> DataFrame:
        reach_col = lambda axis: F.least(_jitter(f"{seed}{kind}{axis}", reach), _jitter(f"{seed}{kind}m", reach))
        drawn = {"_h": reach_col("h"), "_v": reach_col("v")} | ({} if least is None else {f"_{s}": _jitter(f"{seed}{kind}n{s}", least) for s in "ltrb"})
        mins = [F.lit(0) if least is None else F.col(f"_{s}") for s in "ltrb"]
        corners = fb.engulf_crop(box, even, even, "_h", "_v", mins, *size, f"{seed}{kind}", "image_id", "draw")
        # drawn numbers are columns of their own: inside the corners each hash would be worked out many times
        return per_ann.withColumns(drawn).select("image_id", F.lit(kind).alias("kind"), "draw", "ann_id", *_named(corners, CORNERS))

    draws = counts.select("image_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("draw")) if n else None
    out = fixed("close", 100, None).unionByName(fixed("far", fb.FAR_PAD, 2000))
    if draws is None:
        return out
    rows = _pick_annotation(draws, ranked, counts, f"{seed}a").join(_sizes(images), "image_id")
    if mode is None:
        third = hashrand(f"{seed}k", "image_id", F.lit(1) if compat else F.col("draw"), lo=F.lit(0), hi=F.lit(2))
        kind = F.when(third == 0, "cut").otherwise("engulf")
    else:
        kind = F.lit(mode)

    def skew(axis: str) -> Column:
        sign = 2 * hashrand(f"{seed}s{axis}", "image_id", "draw", lo=F.lit(0), hi=F.lit(1)) - 1
        return sign * hashrand(f"{seed}w{axis}", "image_id", "draw", lo=F.lit(100), hi=F.lit(max_skew))

    drawn = {"_sh": skew("h"), "_sv": skew("v"), "_h": _jitter(f"{seed}rh", fb.FAR_PAD), "_v": _jitter(f"{seed}rv", fb.FAR_PAD), "kind": kind}
    around = fb.engulf_crop(box, "_sh", "_sv", "_h", "_v", [F.lit(0)] * 4, *size, f"{seed}r", "image_id", "draw")
    corner = F.element_at(F.array(*[F.lit(m) for m in fb.CUT_MODES]), hashrand(f"{seed}c", "image_id", "draw", lo=F.lit(1), hi=F.lit(4)).cast("int"))
    through = fb.cut_crop(box, "_corner", 2, *size, f"{seed}t", "image_id", "draw")
    rows = rows.withColumns({**drawn, "_corner": corner})
    both = [F.when(F.col("kind") == "cut", c).otherwise(e) for c, e in zip(through, around)]
    return out.unionByName(rows.select("image_id", "kind", "draw", "ann_id", *_named(both, CORNERS)))


def random_crops(anns: DataFrame, images: DataFrame, n: int, max_pad: int, seed: int, min_w: int = 0, min_h: int = 0, chunk=None) -> DataFrame:
    """n crops per image around random annotations; crop box x, y, w, h out."""
    ranked, counts = _ranked(anns, chunk)
    draws = counts.select("image_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("draw"))
    rows = _pick_annotation(draws, ranked, counts, f"{seed}a").join(_sizes(images), "image_id")
    pads = [hashrand(f"{seed}{s}", "image_id", "draw", lo=F.lit(0), hi=F.lit(max_pad)) for s in "ltrb"]
    x1, y1, x2, y2 = fb.clamp_box("x", "y", "w", "h", pads, "iw", "ih")
    x2 = F.when(x2 - x1 < min_w, F.least(F.col("iw"), x1 + min_w)).otherwise(x2)
    y2 = F.when(y2 - y1 < min_h, F.least(F.col("ih"), y1 + min_h)).otherwise(y2)
    return rows.select("image_id", "draw", "ann_id", *_named([x1, y1, x2 - x1, y2 - y1], ["crop_x", "crop_y", "crop_w", "crop_h"]))


def placement_points(mask: DataFrame, n: int, seed: int, images: DataFrame | None = None, lower_half: bool = False) -> DataFrame:
    """n random set pixels per image, optionally from the lower half only; `pos` is the draw order."""
    pixels = mask.filter("mask").select("image_id", "y", "x")
    if lower_half:
        pixels = pixels.join(images.select("image_id", "h"), "image_id").filter(F.col("y") >= F.floor(F.col("h") / 2)).drop("h")
    drawn = pixels.withColumn("_d", digest(seed, "image_id", "y", "x"))
    best = top_per_group(drawn, ["image_id"], ["_d", "y", "x"], n)
    return number_rows(best, ["image_id"], ["_d", "y", "x"], "pos", hash_chunk(best, seed, "image_id", "y", "x")).select("image_id", "pos", "y", "x")


def spaced_points(mask: DataFrame, images: DataFrame, frag_w: int, frag_h: int, n: int, seed: int, tries: int = 1000) -> DataFrame:
    """Points whose fragment fits the mask, at least max(frag_w, frag_h) apart.

    `tries` random mask pixels are looked at per image, which is the rule of the operator
    and bounds the rows of an image that are accepted one after the other.
    """
    tried = placement_points(mask, tries, seed)
    fitting = box_fits(tried, mask, images, frag_w, frag_h)
    gap = max(frag_w, frag_h)

    def accept(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        xy, kept, pos = rows[["x", "y"]].to_numpy(), [], []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            mine: list[int] = []
            for i in range(start, stop):
                if len(mine) == n:
                    break
                if not mine or (((xy[mine] - xy[i]) ** 2).sum(axis=1) >= gap * gap).all():
                    mine.append(i)
            kept += mine
            pos += range(1, len(mine) + 1)
        out = rows.iloc[kept][["image_id", "y", "x"]].copy()
        out.insert(1, "pos", pos)
        return out

    kind = fitting.schema["image_id"].dataType.simpleString()
    return ob.per_key(fitting, ["image_id"], ["pos"], accept, f"image_id {kind}, pos bigint, y bigint, x bigint")


def sample_multiset(frags: DataFrame, images: DataFrame, max_total: int, seed: int, frag_id: str = "frag_id", keep: Sequence[str] = ()) -> DataFrame:
    """0 .. max_total draws with replacement per image, as (image_id, draw, columns of the image to keep, fragment columns)."""
    ranked = number_rows(frags, [], [frag_id], "_rank")
    draws = images.select("image_id", *keep, hashrand(f"{seed}m", "image_id", lo=F.lit(0), hi=F.lit(max_total)).alias("_m")).filter("_m > 0")
    draws = draws.select("image_id", *keep, F.explode(F.sequence(F.lit(1).cast("bigint"), "_m")).alias("draw")).withColumn("_n", total_rows(frags))
    pick = hashrand(f"{seed}f", "image_id", "draw", lo=F.lit(1), hi=F.col("_n"))
    # merged: the planner takes the draws for as small as the images that they are exploded from, and would broadcast them
    return draws.withColumn("_rank", pick).drop("_n").hint("merge").join(ranked, "_rank").drop("_rank")


def synth_boxes(images: DataFrame, frags: DataFrame, seed: int, max_total: int = 30, max_clusters: int = 3, max_per_cluster: int = 20, merge: bool = True) -> DataFrame:
    """Boxes of pasted fragments: some clusters in random windows, then all fragments anywhere.

    `frags` has frag_id, fw, fh. Boxes are cut at the window and picture border.
    """
    if merge:
        return _merged_synthetic(images, frags, seed, max_total, max_clusters, max_per_cluster).drop("iw", "ih")
    # the sizes travel with the draws, which spares two joins with the images
    drawn = sample_multiset(frags, _sizes(images), max_total, seed, keep=["iw", "ih"])
    biggest = drawn.groupBy("image_id").agg(F.max("fw").alias("_mw"), F.max("fh").alias("_mh"), F.count("*").alias("_n"), F.max("iw").alias("iw"), F.max("ih").alias("ih"))
    r = lambda tag, *key, lo, hi: hashrand(f"{seed}{tag}", "image_id", *key, lo=lo, hi=hi)
    clusters = biggest.withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("bigint"), r("c", lo=F.lit(0), hi=F.lit(max_clusters))))
    )  # window 0 is the whole picture
    inner = F.col("_k") > 0
    windows = clusters.select(
        "image_id", "_k",
        F.when(inner, r("wx", "_k", lo=F.lit(0), hi=F.col("iw"))).otherwise(F.lit(0)).alias("wx"),
        F.when(inner, r("wy", "_k", lo=F.lit(0), hi=F.col("ih"))).otherwise(F.lit(0)).alias("wy"),
        F.when(inner, F.col("_mw") + r("ww", "_k", lo=F.lit(5), hi=F.lit(100))).otherwise(F.col("iw")).alias("ww"),
        F.when(inner, F.col("_mh") + r("wh", "_k", lo=F.lit(5), hi=F.lit(100))).otherwise(F.col("ih")).alias("wh"),
        F.when(inner, r("s", "_k", lo=F.lit(0), hi=F.lit(max_per_cluster))).otherwise(F.col("_n")).alias("_take"),
    )
    placed = drawn.join(windows.hint("merge"), "image_id").withColumn("_d", digest(f"{seed}o", "image_id", "_k", "draw"))
    # at most max_total draws and max_clusters + 1 windows per image: a small group by the operator's own limits
    within = Window.partitionBy("image_id", "_k").orderBy("_d")
    ranked = placed.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= F.col("_take"))
    right, low = F.least(F.col("wx") + F.col("ww"), F.col("iw")), F.least(F.col("wy") + F.col("wh"), F.col("ih"))
    spots = ranked.withColumn("_right", right).withColumn("_low", low).filter((F.col("_right") > F.col("wx")) & (F.col("_low") > F.col("wy")))
    x = F.col("wx") + r("px", "_k", "draw", lo=F.lit(0), hi=F.col("_right") - F.col("wx") - 1)
    y = F.col("wy") + r("py", "_k", "draw", lo=F.lit(0), hi=F.col("_low") - F.col("wy") - 1)
    return spots.withColumn("x", x).withColumn("y", y).select(
        "image_id", (F.col("_k") * (max_total + 1) + F.col("draw")).alias("ann_id"), "x", "y",
        F.least(F.col("fw"), F.col("_right") - F.col("x")).cast("bigint").alias("w"),
        F.least(F.col("fh"), F.col("_low") - F.col("y")).cast("bigint").alias("h"),
    )


def _merged_synthetic(images: DataFrame, frags: DataFrame, seed: int, max_total: int, max_clusters: int, max_per_cluster: int) -> DataFrame:
    """Merged boxes of `synth_boxes` with their picture's size (iw, ih).

    A picture's boxes follow from its id, its size and the fragments' sizes. So where these fit into
    a broadcast of bounded size, a task draws, places and merges the boxes of its pictures in numpy,
    and only the pictures are shuffled. More fragments meet the draws by joins.
    """
    plain = images.schema["image_id"].dataType.simpleString() in KINDS and max_total * (max_clusters + 1) <= ob.GROUP_ROWS
    packed = _packed_sizes(frags) if plain else None
    if packed is None:
        boxes = synth_boxes(images, frags, seed, max_total, max_clusters, max_per_cluster, merge=False)
        return ob.merge_greedy(boxes).join(_sizes(images).hint("merge"), "image_id")
    spark = images.sparkSession
    whole = _sizes(images).filter("image_id is not null and iw > 0 and ih > 0").select("image_id", F.col("iw").cast("bigint"), F.col("ih").cast("bigint"))
    # pictures are few bytes and much work, so their tasks are not coalesced by size
    single = whole.repartition(2 * parallelism(spark), "image_id").groupBy("image_id").agg(F.max("iw").alias("iw"), F.max("ih").alias("ih"), F.count("*").alias("_c"))
    sizes = spark.sparkContext.broadcast(packed)

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(sizes.value[0]):
                at, columns, c = _paste(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), sizes.value, seed, max_total, max_clusters, max_per_cluster)
                at, columns = np.repeat(at, c), [np.repeat(v, c) for v in columns]
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), *map(pa.array, columns), batch.column(1).take(place), batch.column(2).take(place)], ["image_id", "ann_id", "x", "y", "w", "h", "iw", "ih"])

    ship_package(spark)
    kind = images.schema["image_id"].dataType.simpleString()
    return single.mapInArrow(run, f"image_id {kind}, ann_id bigint, x bigint, y bigint, w bigint, h bigint, iw bigint, ih bigint")


def _packed_sizes(frags: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Width and height of the fragments in order of their ids, as narrow numbers; None if there are more than PACKED or if one has no whole number.

    Tasks hand on what they hold as bytes, so the driver sees at most 12 bytes a fragment.
    """
    if any(frags.schema[c].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint") for c in ("fw", "fh")):
        return None
    odd = F.count(F.when(F.col("fw").isNull() | F.col("fh").isNull() | (F.abs("fw") >= 1 << 31) | (F.abs("fh") >= 1 << 31), 1))
    n, unfit = frags.agg(F.count("*"), odd).first()
    if n > PACKED or unfit:
        return None

    def pack(batches):
        for batch in batches:
            parts = [batch.column(i).to_numpy() for i in range(3)]
            kinds = [np.min_scalar_type(v.min(initial=0)) if v.min(initial=0) < 0 else np.min_scalar_type(v.max(initial=0)) for v in parts[1:]]
            kinds = [np.dtype(np.int32) if k.kind == "i" else k for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array([parts[0].astype(np.int32).tobytes()], pa.binary()), *[pa.array([v.astype(k).tobytes()], pa.binary()) for v, k in zip(parts[1:], kinds)], *[pa.array([k.str]) for k in kinds]], ["at", "fw", "fh", "kw", "kh"]
            )

    ranked = number_rows(frags.select("frag_id", F.col("fw").cast("bigint").alias("fw"), F.col("fh").cast("bigint").alias("fh")), [], ["frag_id"], "_rank")
    rows = ranked.select((F.col("_rank") - 1).alias("at"), "fw", "fh").mapInArrow(pack, "at binary, fw binary, fh binary, kw string, kh string").collect()
    out = []
    for side, kind in (("fw", "kw"), ("fh", "kh")):
        whole = np.zeros(n, np.result_type(np.uint8, *{r[kind] for r in rows}))
        for r in rows:
            whole[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r[side], r[kind])
        out.append(whole)
    return out[0], out[1]


def _paste(ids: pa.Array, iw: np.ndarray, ih: np.ndarray, copies: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], seed: int, max_total: int, max_clusters: int, max_per_cluster: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """`synth_boxes` of some pictures: the picture of each merged box, its columns ann_id, x, y, w, h, and how often it comes.

    A picture that comes several times (`copies`) meets itself when draws and sizes are joined, so
    that a window takes fewer different boxes of it, as in SQL.
    """
    texts, every = Ids(ids), np.arange(len(ids))
    many = texts.number(f"{seed}m", every) % (max_total + 1)
    own = np.repeat(every, many)
    draw = _count(many) + 1
    pick = texts.number(f"{seed}f", own, draw) % len(sizes[0])
    fw, fh = sizes[0][pick].astype(np.int64), sizes[1][pick].astype(np.int64)
    has, start = np.flatnonzero(many), np.cumsum(many) - many
    biggest = [np.zeros(len(ids), np.int64) for _ in range(2)]
    for b, v in zip(biggest, (fw, fh)):
        if len(has):
            b[has] = np.maximum.reduceat(v, start[has])
    # windows: 0 is the whole picture
    clusters = 1 + texts.number(f"{seed}c", has) % (max_clusters + 1)
    of, k = np.repeat(has, clusters), _count(clusters)
    wx, wy, ww, wh, take = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), iw[of], ih[of], many[of]
    inner = np.flatnonzero(k)
    at, number = of[inner], k[inner]
    wx[inner] = texts.number(f"{seed}wx", at, number) % (iw[at] + 1)
    wy[inner] = texts.number(f"{seed}wy", at, number) % (ih[at] + 1)
    ww[inner] = biggest[0][at] + 5 + texts.number(f"{seed}ww", at, number) % 96
    wh[inner] = biggest[1][at] + 5 + texts.number(f"{seed}wh", at, number) % 96
    take[inner] = -(-(texts.number(f"{seed}s", at, number) % (max_per_cluster + 1)) // copies[at] ** 2)
    right, low = np.minimum(wx + ww, iw[of]), np.minimum(wy + wh, ih[of])
    used = np.flatnonzero((right > wx) & (low > wy) & (take > 0))
    of, k, wx, wy, take, right, low = (v[used] for v in (of, k, wx, wy, take, right, low))
    # the draws of each window; a window that does not take all takes those of the least digests
    window = np.repeat(np.arange(len(of)), many[of])
    placed = start[of][window] + _count(many[of])
    some = np.flatnonzero((take < many[of])[window])
    if len(some):
        words = texts.digest(f"{seed}o", of[window[some]], k[window[some]], draw[placed[some]]).astype(np.uint64)
        high, rest = words[0] << np.uint64(32) | words[1], words[2] << np.uint64(32) | words[3]
        order = np.lexsort((high, window[some]))
        if ((high[order][1:] == high[order][:-1]) & (window[some][order][1:] == window[some][order][:-1])).any():
            order = np.lexsort((rest, high, window[some]))
        rank = np.empty(len(some), np.int64)
        rank[order] = _count(np.bincount(window[some], minlength=len(of)))
        keep = np.ones(len(window), bool)
        keep[some[rank >= take[window[some]]]] = False
        window, placed = window[keep], placed[keep]
    at, number, drawn = of[window], k[window], draw[placed]
    x = wx[window] + texts.number(f"{seed}px", at, number, drawn) % (right - wx)[window]
    y = wy[window] + texts.number(f"{seed}py", at, number, drawn) % (low - wy)[window]
    corners = np.stack([x, y, x + np.minimum(fw[placed], right[window] - x), y + np.minimum(fh[placed], low[window] - y)], 1)
    if not len(at):
        return at, [np.zeros(0, np.int64)] * 5, at
    bounds = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
    merged, first = ob.merge_many(corners, bounds)
    at = at[first]
    columns = [number[first] * (max_total + 1) + drawn[first], merged[:, 0], merged[:, 1], merged[:, 2] - merged[:, 0], merged[:, 3] - merged[:, 1]]
    return at, columns, copies[at]


def _count(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of some groups that lie one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def synth_labels(images: DataFrame, frags: DataFrame, seed: int, cls: int = 0, max_total: int = 30, max_clusters: int = 3, max_per_cluster: int = 20, merge: bool = True) -> DataFrame:
    """Merged synthetic boxes as normalised label rows."""
    if merge:
        boxes = _merged_synthetic(images, frags, seed, max_total, max_clusters, max_per_cluster)
    else:
        boxes = synth_boxes(images, frags, seed, max_total, max_clusters, max_per_cluster, merge=False).join(_sizes(images).hint("merge"), "image_id")
    yolo = fb.box_convert(["x", "y", "w", "h"], "xywh", "yolo", "iw", "ih")
    return boxes.select("image_id", F.lit(cls).alias("cls"), *[F.round(c, 9).alias(n) for c, n in zip(yolo, ["xc", "yc", "bw", "bh"])], "x", "y", "w", "h")


def scene_plan(images: DataFrame, frags: DataFrame, mask: DataFrame, seed: int, max_objects: int = 50) -> DataFrame:
    """Fragments paired with valid points, each with scale, blur kernel and luminosity factor.

    `images` has image_id, w, h, horizon; `frags` has frag_id, frag_y, frag_horizon, frag_height.
    """
    drawn = sample_multiset(frags, images, max_objects, seed)
    points = placement_points(mask, 2 * max_objects, f"{seed}p")
    paired = drawn.withColumn("pos", F.col("draw")).join(points, ["image_id", "pos"]).join(
        images.select("image_id", F.col("h").alias("ih"), "horizon"), "image_id"
    )
    r = lambda tag, lo, hi: hashrand(f"{seed}{tag}", "image_id", "pos", lo=F.lit(lo), hi=F.lit(hi))
    scale = fb.perspective_scale("frag_y", "y", "frag_horizon", "horizon", "frag_height", "ih")
    return paired.select(
        "image_id", "pos", "frag_id", "y", "x",
        F.round(F.when(r("s", 0, 3) == 0, F.lit(1.0)).otherwise(scale), 9).alias("scale"),
        r("b", 0, 2).alias("blur"),
        F.round(F.when(r("u", 0, 1) == 1, 1 + hash_unit(f"{seed}l", "image_id", "pos") * 0.5).otherwise(F.lit(-1.0)), 9).alias("luminosity"),
    )


__all__ = [
    "gate_tiles", "image_tiles", "pair_by_position", "placement_points", "plan_crops", "plan_negative_crops",
    "plan_positive_crops", "random_crops", "sample_multiset", "scene_plan", "spaced_points", "synth_boxes", "synth_labels",
]

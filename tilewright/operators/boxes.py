"""Spatial joins between boxes and merging of overlapping boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.boxes import overlaps
from tilewright.operators.graphs import least_reachable
from tilewright.session import cut_lineage, ship_package

CELL = 256  # boxes that meet in one cell before it is cut
DEPTH = 20  # cuts of an image's square at most
GROUP_ROWS = 10_000  # larger images are merged by joins instead of in one task
BATCH_MERGE = 64  # rows of one image in one batch from which a local merge pays


def _fractional(df: DataFrame) -> bool:
    return any(df.schema[c].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint") for c in ("x", "y", "w", "h"))


@dataclass
class Cells:
    """Quadtrees of the images that hold too many boxes for one cell.

    `large` has the square (x0, y0, extent) of each such image, `splits` the squares (depth,
    column, row) that are cut in four. Any such cells give the same pairs.
    """

    on: list[str]
    large: DataFrame
    splits: DataFrame
    depth: int

    def place(self, df: DataFrame) -> DataFrame:
        """`df` with `_d`, `_cx`, `_cy` (and its image's square), one row for each leaf that a box meets; other images are one cell."""
        one = [F.lit(0).alias("_d"), F.lit(0).cast("bigint").alias("_cx"), F.lit(0).cast("bigint").alias("_cy")]
        nothing = [F.lit(None).cast("double").alias(c) for c in SQUARE]
        whole = df.join(self.large, self.on, "left_anti").select("*", *nothing, *one)
        rows = df.join(self.large, self.on).select(*df.columns, *SQUARE, *one)
        cut = self.splits.withColumn("_cut", F.lit(True))
        for _ in range(self.depth + 1):
            kids = F.flatten(F.transform(self._halves("x", "w", "_cx"), lambda x: F.transform(self._halves("y", "h", "_cy"), lambda y: F.struct((F.col("_d") + 1).alias("_d"), x.alias("_cx"), y.alias("_cy")))))
            same = F.array(F.struct("_d", "_cx", "_cy"))
            rows = rows.join(cut, [*self.on, "_d", "_cx", "_cy"], "left").withColumn("_k", F.explode(F.when(F.col("_cut"), kids).otherwise(same)))
            rows = rows.select(*df.columns, *SQUARE, "_k.*")
        return whole.unionByName(rows)

    def _halves(self, start: str, size: str, cell: str) -> Column:
        low, high = (_unit(F.col(start) + e, start, F.col("_d") + 1) for e in (F.lit(0), F.col(size)))
        return F.sequence(F.greatest(F.col(cell) * 2, low), F.least(F.col(cell) * 2 + 1, high))


SQUARE = ["_x0", "_y0", "_extent"]


def _unit(value: Column, axis: str, depth: Column, prefix: str = "") -> Column:
    """Column or row of a coordinate among the 2^depth of its image's square; what lies outside counts to the border."""
    cells = F.pow(F.lit(2.0), depth)
    at = F.floor((value - F.col(f"{prefix}_{axis}0")) / F.col(f"{prefix}_extent") * cells)
    return F.greatest(F.lit(0), F.least(cells - 1, at)).cast("bigint")


def fit_cells(boxes: DataFrame, on: Sequence[str] = ("image_id",), limit: int = CELL) -> Cells | None:
    """Cells for the images with more than `limit` boxes; None if there is no such image.

    A square is cut while more than `limit` corners of boxes of at most half its side lie in
    it. Boxes that crowd at their own size overlap each other anyway, and cutting would only
    copy them. So a small box is in four leaves at most, and a huge one in as many as the
    crowd below it needs, whatever its area.
    """
    on = list(on)
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    size = boxes.groupBy(*on).agg(F.count("*").alias("_n"), F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max(right).alias("_x1"), F.max(bottom).alias("_y1")).filter(F.col("_n") > limit)
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")).cast("double")
    large = cut_lineage(size.select(*on, F.col("_x0").cast("double").alias("_x0"), F.col("_y0").cast("double").alias("_y0"), F.when(extent > 0, extent).otherwise(1.0).alias("_extent")))
    if large.isEmpty():
        return None
    inside = boxes.join(large, on)
    side = F.greatest("w", "h").cast("double")
    own = F.when(side <= 0, F.lit(DEPTH)).otherwise(F.floor(F.log2(F.col("_extent") / (2 * side))))
    deep = inside.withColumn("_d", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(DEPTH), own)).cast("int"))))
    counted = deep.groupBy(*on, "_d", _unit(F.col("x"), "x", F.col("_d")).alias("_cx"), _unit(F.col("y"), "y", F.col("_d")).alias("_cy")).agg(F.count("*").alias("_n"))
    splits = cut_lineage(counted.filter((F.col("_n") > limit) & (F.col("_d") < DEPTH)).drop("_n"))
    return Cells(on, large, splits, splits.agg(F.coalesce(F.max("_d"), F.lit(0)).alias("d")).first()["d"])


def _both(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    keep = [*on, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]]
    return left.select(*keep) if left is right else left.select(*keep).unionByName(right.select(*keep))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("image_id",), cell: int = CELL, extra=None, cells: Cells | None = None, fitted: bool = False) -> DataFrame:
    """Pairs of overlapping boxes with equal `on`, as columns of aliases `a` and `b`.

    Images of up to `cell` boxes are joined as a whole; larger ones meet in the leaves of a
    quadtree that is fitted to them (`cells`, where it is `fitted` before). A pair comes out
    once, in the leaf of the upper left corner of its intersection.
    """
    if not fitted:
        cells = fit_cells(_both(left, right, on), on, cell)
    a, b = (df if cells is None else cells.place(df) for df in (left, right))
    a, b = a.alias("a"), b.alias("b")
    cond = overlaps("a", "b")
    for key in on:
        cond = cond & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    if cells is not None:
        for key in ("_d", "_cx", "_cy"):
            cond = cond & (F.col(f"a.{key}") == F.col(f"b.{key}"))
        home = [_unit(F.greatest(f"a.{c}", f"b.{c}"), c, F.col("a._d"), "a.") == F.col(f"a._c{c}") for c in "xy"]
        cond = cond & (F.col("a._extent").isNull() | (home[0] & home[1]))
    return a.join(b, cond if extra is None else cond & extra)


def overlapping_boxes(boxes: DataFrame, order: str = "ann_id", cell: int = CELL) -> DataFrame:
    """Pairs of boxes of one image with strictly positive intersection."""
    pairs = overlap_join(boxes, boxes, cell=cell, extra=F.col(f"a.{order}") < F.col(f"b.{order}"))
    return pairs.select(F.col("a.image_id").alias("image_id"), F.col(f"a.{order}").alias("a"), F.col(f"b.{order}").alias("b"))


def boxes_clear_of(cands: DataFrame, boxes: DataFrame, id_cols: Sequence[str], cell: int = CELL) -> DataFrame:
    """Candidates that hit no box of their image."""
    distinct = boxes.select("image_id", "x", "y", "w", "h").distinct()
    cells = fit_cells(_both(cands, distinct, ["image_id"]), limit=cell)
    if cells is None:
        near = F.col("a.image_id") == F.col("b.image_id")
        return cands.alias("a").join(distinct.alias("b"), near & overlaps("a", "b"), "left_anti")
    a, b = cells.place(cands).alias("a"), cells.place(distinct).alias("b")
    same = overlaps("a", "b")
    for key in ("image_id", "_d", "_cx", "_cy"):
        same = same & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    hit = a.join(b, same, "left_semi").select(*id_cols).distinct()
    return cands.join(hit, list(id_cols), "left_anti")


# ---- streaming over sorted keys -----------------------------------------


def per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply `fn` to the ordered rows of many keys at a time.

    Partitions are sorted by key and streamed. `fn` gets a frame of whole keys and the row
    bounds between them, so it may work on all of them at once. Memory holds one batch and
    one key, so the caller must know that keys are small.
    """
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if frame.empty:
                continue
            starts = np.flatnonzero(frame[keys].ne(frame[keys].shift()).any(axis=1).to_numpy())
            held = frame.iloc[starts[-1]:].reset_index(drop=True)
            if len(starts) > 1:
                yield fn(frame.iloc[: starts[-1]], starts)
        if held is not None and len(held):
            yield fn(held, np.array([0, len(held)]))

    ship_package(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


# ---- merging -------------------------------------------------------------


def _grow(boxes: np.ndarray, free: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Enlarge `current` until no free box overlaps it; takes the boxes out of `free`."""
    while True:
        hit = (
            free & (boxes[:, 0] < current[2]) & (current[0] < boxes[:, 2]) & (boxes[:, 1] < current[3]) & (current[1] < boxes[:, 3])
        )
        if not hit.any():
            return current
        free &= ~hit
        taken = boxes[hit]
        current = np.array(
            [min(current[0], taken[:, 0].min()), min(current[1], taken[:, 1].min()), max(current[2], taken[:, 2].max()), max(current[3], taken[:, 3].max())]
        )


def greedy_merge(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corner boxes in order -> merged boxes and the index of the box each one started from."""
    free, out, first = np.ones(len(boxes), dtype=bool), [], []
    for i in range(len(boxes)):
        if free[i]:
            free[i] = False
            first.append(i)
            out.append(_grow(boxes, free, boxes[i]))
    return np.array(out), np.array(first)


def closure_merge(boxes: np.ndarray) -> np.ndarray:
    """Merge until no two results overlap."""
    while True:
        merged, _ = greedy_merge(boxes)
        if len(merged) == len(boxes):
            return merged
        boxes = merged


CORNERS = ["x1", "y1", "x2", "y2"]


def _corners(boxes: DataFrame, *extra: str) -> DataFrame:
    kind = "double" if _fractional(boxes) else "bigint"
    return boxes.select(
        "image_id", *extra, F.col("x").cast(kind).alias("x1"), F.col("y").cast(kind).alias("y1"),
        (F.col("x") + F.col("w")).cast(kind).alias("x2"), (F.col("y") + F.col("h")).cast(kind).alias("y2"),
    )


def _as_boxes(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "image_id", *extra, F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")
    )


def _premerge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge crowded images inside one batch: an exact first step that shrinks hot images before any shuffle."""
    for frame in frames:
        crowded = frame["image_id"].map(frame["image_id"].value_counts()) >= BATCH_MERGE
        outs = [frame[~crowded]]
        for image, rows in frame[crowded].groupby("image_id"):
            merged = pd.DataFrame(closure_merge(rows[CORNERS].to_numpy()), columns=CORNERS)
            merged.insert(0, "image_id", image)
            outs.append(merged)
        yield pd.concat(outs, ignore_index=True)


def merge_closure(boxes: DataFrame, cell: int = CELL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Bounding boxes of merged groups, repeated until no two results of an image overlap.

    Images of up to `group_rows` boxes are merged in one task, many side by side. For the
    others each round replaces every box by the bounding box of all boxes it overlaps and drops
    duplicates. Images without a change are final and leave the loop. A box of zero width or
    height overlaps no copy of itself; it stays as it is unless it lies inside another box.
    """
    cornered = _corners(boxes)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cornered.schema.fields)
    ship_package(boxes.sparkSession)
    large = cornered.groupBy("image_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows).select("image_id")
    if not large.take(1):
        return _as_boxes(per_key(cornered, ["image_id"], CORNERS, _closure_rows, schema))
    small = _as_boxes(per_key(cornered.join(large, "image_id", "left_anti"), ["image_id"], CORNERS, _closure_rows, schema))
    return small.unionByName(_closure_by_joins(cornered.join(large, "image_id", "left_semi"), schema, cell))


def _closure_by_joins(cornered: DataFrame, schema: str, cell: int) -> DataFrame:
    active = cut_lineage(cornered.distinct().mapInPandas(_premerge, schema).distinct())
    cells, done = fit_cells(_as_boxes(active), limit=cell), None
    while True:
        rows = _as_boxes(active)
        key = ["image_id", "x", "y", "w", "h"]
        ends = lambda n, s: (F.col(f"b.{n}") + F.col(f"b.{s}"))
        met = overlap_join(rows, rows, cells=cells, fitted=True).select(
            *[F.col(f"a.{c}").alias(c) for c in key], F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), ends("x", "w").alias("x2"), ends("y", "h").alias("y2")
        )
        alone = rows.select(*key, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
        grown = met.unionByName(alone).groupBy(*key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
        same = (F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1")) & (F.col("x") + F.col("w") == F.col("x2")) & (F.col("y") + F.col("h") == F.col("y2"))
        moved = grown.groupBy("image_id", *CORNERS).agg(F.bool_or(~same).alias("_m"))
        moved = cut_lineage(moved)
        busy = moved.filter("_m").select("image_id").distinct()
        still = moved.select("image_id", *CORNERS).join(busy, "image_id", "left_anti")
        done = still if done is None else done.unionByName(still)
        if not moved.filter("_m").take(1):
            return _as_boxes(done)
        active = moved.select("image_id", *CORNERS).join(busy, "image_id", "left_semi")


def merge_many(corners: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`greedy_merge` of many images side by side: merged boxes and the rows they started from, by image and order.

    A step grows the current box of every unfinished image at once, so steps follow the
    longest image of the batch and rows that are used up leave.
    """
    images = len(bounds) - 1
    of = np.repeat(np.arange(images), np.diff(bounds))
    start, left = bounds[:-1].copy(), np.delete(np.arange(len(corners)), bounds[:-1])
    of, current, active = of[left], corners[bounds[:-1]].copy(), np.arange(images)
    merged, first = [], []
    heads = lambda of: np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    while len(active):
        own, box = current[of], corners[left]
        hit = (box[:, 0] < own[:, 2]) & (own[:, 0] < box[:, 2]) & (box[:, 1] < own[:, 3]) & (own[:, 1] < box[:, 3])
        grew = np.zeros(images, bool)
        if hit.any():
            taken, mine = box[hit], of[hit]
            begins = heads(mine)
            who = mine[begins]
            current[who, :2] = np.minimum(current[who, :2], np.minimum.reduceat(taken[:, :2], begins))
            current[who, 2:] = np.maximum(current[who, 2:], np.maximum.reduceat(taken[:, 2:], begins))
            grew[who] = True
            left, of = left[~hit], of[~hit]
        done = active[~grew[active]]
        first.append(start[done])
        merged.append(current[done])
        begins = heads(of)
        begins = begins[~grew[of[begins]]]
        who, rows = of[begins], left[begins]
        start[who], current[who] = rows, corners[rows]
        left, of = np.delete(left, begins), np.delete(of, begins)
        active = np.concatenate([active[grew[active]], who])
    first, merged = np.concatenate(first), np.concatenate(merged)
    order = np.argsort(first)
    return merged[order], first[order]


def _greedy_rows(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    merged, first = merge_many(rows[CORNERS].to_numpy(), bounds)
    out = rows.iloc[first].copy()
    out[CORNERS] = merged
    return out


def _closure_rows(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    corners, of = rows[CORNERS].to_numpy(), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.arange(len(rows))
    while True:
        merged, kept = merge_many(corners, np.searchsorted(of, np.arange(len(bounds))))
        first, of = first[kept], of[kept]
        if len(merged) == len(corners):
            break
        corners = merged
    out = rows.iloc[first].copy()
    out[CORNERS] = merged
    return out.drop_duplicates()


def merge_greedy(boxes: DataFrame, order: str = "ann_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Take boxes in order and grow each until no unused box overlaps it.

    Results may overlap each other, as a later one is never tested against an earlier one.
    `order` of a result is that of the box it started from. Images with more than
    `group_rows` boxes are cut into their closure components, which cannot influence each
    other; a component that is still too large is grown by joins.
    """
    rows = _corners(boxes, order)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {t}" for n, t in types.items())
    counts = rows.groupBy("image_id").agg(F.count("*").alias("_n"))
    large = counts.filter(F.col("_n") > group_rows).select("image_id")
    if not large.take(1):
        return _as_boxes(per_key(rows, ["image_id"], [order], _greedy_rows, schema), order)
    small = per_key(rows.join(large, "image_id", "left_anti"), ["image_id"], [order], _greedy_rows, schema)
    return _as_boxes(small.unionByName(_merge_large(rows.join(large, "image_id", "left_semi"), order, group_rows, schema)), order)


def _merge_large(rows: DataFrame, order: str, group_rows: int, schema: str) -> DataFrame:
    # equal boxes always end in one group: keep the first of each
    rows = rows.groupBy("image_id", *CORNERS).agg(F.min(order).alias(order)).select("image_id", order, *CORNERS)
    whole = merge_closure(_as_boxes(rows, order))
    placed = overlap_join(_as_boxes(rows, order), whole)
    c = F.col
    placed = placed.select(
        c("a.image_id").alias("image_id"), c(f"a.{order}").alias(order), c("a.x").alias("x1"), c("a.y").alias("y1"),
        (c("a.x") + c("a.w")).alias("x2"), (c("a.y") + c("a.h")).alias("y2"), c("b.x").alias("_gx"), c("b.y").alias("_gy"),
    )
    # a box of zero width or height that meets no merged box is one itself
    alone = rows.filter("x1 = x2 or y1 = y2").join(placed, ["image_id", order], "left_anti")
    placed = placed.unionByName(alone.select("image_id", order, *CORNERS, c("x1").alias("_gx"), c("y1").alias("_gy")))
    placed = cut_lineage(placed)
    group = ["image_id", "_gx", "_gy"]
    big = placed.groupBy(*group).agg(F.count("*").alias("_n")).filter(c("_n") > group_rows).select(*group)
    fits = placed.join(big, group, "left_anti")
    out = per_key(fits, group, [order], _greedy_rows, f"{schema}, _gx {placed.schema['_gx'].dataType.simpleString()}, _gy {placed.schema['_gy'].dataType.simpleString()}").select("image_id", order, *CORNERS)
    rest = placed.join(big, group, "left_semi")
    return out.unionByName(_grow_by_joins(rest, group, order)) if big.take(1) else out


def _clusters_of_cell(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """For each box of a cell the least box number that it is connected to by overlaps inside the cell."""
    corners, out = rows[CORNERS].to_numpy(), rows["_box"].to_numpy().copy()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        free = np.arange(lo, hi)
        while len(free):
            todo, mine = [free[0]], [free[0]]
            free = free[1:]
            while todo and len(free):
                c, own = corners[free], corners[todo.pop()]
                hit = (c[:, 0] < own[2]) & (own[0] < c[:, 2]) & (c[:, 1] < own[3]) & (own[1] < c[:, 3])
                todo.extend(free[hit])
                mine.extend(free[hit])
                free = free[~hit]
            out[mine] = out[mine].min()
    return pd.DataFrame({"_box": rows["_box"].to_numpy(), "_least": out})


def _with_clusters(boxes: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """`boxes` with the extent (_cx1 .. _cy2) of all boxes of their group that chains of overlaps connect them to.

    Cells of the fitted quadtree are connected inside tasks; boxes that lie in several cells
    stitch these together, in a number of rounds that grows with the logarithm of a chain.
    """
    numbered = cut_lineage(boxes.withColumn("_box", F.xxhash64(*group, order, *CORNERS)))
    squares = numbered.select(*group, "_box", *CORNERS, F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    cells = fit_cells(squares, group)
    placed = squares.withColumns({"_d": F.lit(0), "_cx": F.lit(0), "_cy": F.lit(0)}) if cells is None else cells.place(squares)
    keys = [*group, "_d", "_cx", "_cy"]
    inside = per_key(placed.select(*keys, "_box", *CORNERS), keys, ["_box"], _clusters_of_cell, "_box bigint, _least bigint")
    roots = least_reachable(inside.select(F.col("_box").alias("a"), F.col("_least").alias("b")))
    rooted = cut_lineage(numbered.join(roots, F.col("_box") == F.col("node")).drop("node", "_box"))
    extent = rooted.groupBy("root").agg(F.min("x1").alias("_cx1"), F.min("y1").alias("_cy1"), F.max("x2").alias("_cx2"), F.max("y2").alias("_cy2"))
    return rooted.join(extent, "root").drop("root")


def _grow_by_joins(free: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Greedy growth of all given groups side by side, one aggregate per growth step.

    Whoever takes a box takes all that chains of overlaps connect it to, so a step grows to
    the extent of these at once.
    """
    group = list(group)
    free = cut_lineage(_with_clusters(free, group, order))
    done = None
    at = F.struct(order, *CORNERS)
    reach = [F.min("_cx1").alias("x1"), F.min("_cy1").alias("y1"), F.max("_cx2").alias("x2"), F.max("_cy2").alias("y2")]
    current = free.groupBy(*group).agg(F.min(at).alias("s")).select(*group, *[F.col(f"s.{n}").alias(f"_{n}") for n in (order, *CORNERS)])
    current = cut_lineage(current)
    hit = (F.col("x1") < F.col("_x2")) & (F.col("_x1") < F.col("x2")) & (F.col("y1") < F.col("_y2")) & (F.col("_y1") < F.col("y2"))
    while current.take(1):
        joined = free.join(current, group)
        own = F.col(order) == F.col(f"_{order}")  # the box it started from, also where that has no area
        grown = joined.filter(hit | own).groupBy(*group, f"_{order}", *[f"_{n}" for n in CORNERS]).agg(*reach)
        pick = [F.least(F.col(n), F.col(f"_{n}")) if n in ("x1", "y1") else F.greatest(F.col(n), F.col(f"_{n}")) for n in CORNERS]
        grown = grown.select(*group, f"_{order}", *[e.alias(f"_{n}") for n, e in zip(CORNERS, pick)],
                             (~F.array(*pick).eqNullSafe(F.array(*[F.col(f"_{n}") for n in CORNERS]))).alias("_m"))
        grown = cut_lineage(grown)
        closed = grown.filter("not _m").drop("_m")
        ready = closed.select("image_id", F.col(f"_{order}").alias(order), *[F.col(f"_{n}").alias(n) for n in CORNERS])
        done = ready if done is None else done.unionByName(ready)
        open_groups = grown.filter("_m").drop("_m")
        gone = hit | (F.col(order) == F.col(f"_{order}"))
        used = free.join(closed, group, "left").filter(~F.coalesce(gone, F.lit(False))).select(*free.columns)
        free = cut_lineage(used)
        fresh = free.join(open_groups.select(*group), group, "left_anti").groupBy(*group).agg(F.min(at).alias("s"))
        fresh = fresh.select(*group, *[F.col(f"s.{n}").alias(f"_{n}") for n in (order, *CORNERS)])
        current = cut_lineage(open_groups.unionByName(fresh))
    return done


def merge_boxes(boxes: DataFrame, mode: str = "greedy", order: str = "ann_id") -> DataFrame:
    if mode == "greedy":
        return merge_greedy(boxes, order)
    if mode == "closure":
        return merge_closure(boxes)
    raise ValueError(f"unknown merge mode {mode}")

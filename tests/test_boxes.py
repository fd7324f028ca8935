"""Box merging and planners against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import boxes as ob
from tilewright.operators import masks as om
from tilewright.operators import planners as pl


def overlap(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def brute_greedy(boxes):
    left, out = list(boxes), []
    while left:
        current = left.pop(0)
        while True:
            hits = [b for b in left if overlap(current, b)]
            if not hits:
                break
            for b in hits:
                current = union(current, b)
                left.remove(b)
        out.append(current)
    return sorted(out)


def brute_closure(boxes):
    boxes = set(boxes)
    while True:
        pair = next(((a, b) for a in boxes for b in boxes if a != b and overlap(a, b)), None)
        if pair is None:
            return sorted(boxes)
        boxes -= set(pair)
        boxes.add(union(*pair))


def make(spark, images):
    data = [(i, k, x1, y1, x2 - x1, y2 - y1) for i, boxes in images.items() for k, (x1, y1, x2, y2) in enumerate(boxes)]
    return spark.createDataFrame(data, "image_id bigint, ann_id bigint, x bigint, y bigint, w bigint, h bigint")


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], []).append((r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def images():
    rng = random.Random(3)

    def box():
        x, y = rng.randrange(0, 900), rng.randrange(0, 900)
        return (x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 90))

    # image 0 is crowded, image 1 has copies, the others are small
    made = {0: [box() for _ in range(300)], 1: [box() for _ in range(20)] * 4}
    made.update({i: [box() for _ in range(rng.randrange(1, 9))] for i in range(2, 30)})
    return made


def test_example_where_modes_differ(spark):
    df = make(spark, {1: [(0, 0, 10, 10), (12, 3, 20, 14), (5, 12, 14, 20)]})
    assert result(ob.merge_boxes(df, "greedy")) == {1: [(0, 0, 10, 10), (5, 3, 20, 20)]}
    assert result(ob.merge_boxes(df, "closure")) == {1: [(0, 0, 20, 20)]}


def test_touching_edges_do_not_overlap(spark):
    df = make(spark, {1: [(0, 0, 10, 10), (10, 0, 20, 10), (0, 10, 10, 20)]})
    assert ob.overlapping_boxes(df).count() == 0
    assert len(result(ob.merge_boxes(df, "closure"))[1]) == 3


def test_greedy(spark, images):
    df = make(spark, images)
    want = {i: brute_greedy(b) for i, b in images.items()}
    assert result(ob.merge_greedy(df)) == want


@pytest.mark.parametrize("limit", [20, 4])
def test_greedy_of_large_images(spark, limit):
    """A low limit sends images through components, and components through joins."""
    rng = random.Random(8)

    def box(span, size):
        x, y = rng.randrange(0, span), rng.randrange(0, span)
        return (x, y, x + rng.randrange(1, size), y + rng.randrange(1, size))

    # one picture is a dense heap with copies, one is loose, one is small
    heap = [box(120, 50) for _ in range(40)]
    made = {0: heap + heap[:10], 1: [box(400, 40) for _ in range(22)], 2: [box(50, 20) for _ in range(3)]}
    assert result(ob.merge_greedy(make(spark, made), group_rows=limit)) == {i: brute_greedy(b) for i, b in made.items()}


def test_closure(spark, images):
    assert result(ob.merge_closure(make(spark, images))) == {i: brute_closure(b) for i, b in images.items()}


def test_overlap_pairs(spark, images):
    got = {(r["image_id"], r["a"], r["b"]) for r in ob.overlapping_boxes(make(spark, images), cell=37).collect()}
    want = {(i, a, b) for i, boxes in images.items() for a in range(len(boxes)) for b in range(a + 1, len(boxes)) if overlap(boxes[a], boxes[b])}
    assert got == want


def sizes(spark, images, w=1000, h=1000):
    return spark.createDataFrame([(i, w, h) for i in images], "image_id bigint, w bigint, h bigint")


def test_negative_crops_are_free_and_maximal(spark, images):
    df, pics = make(spark, images), sizes(spark, images)
    crops = pl.plan_negative_crops(df, pics, seed=4, max_size=120, attempts=3).collect()
    assert crops
    for c in crops:
        square = lambda s: (c["x"], c["y"], c["x"] + s, c["y"] + s)
        assert c["x"] + c["size"] <= 1000 and c["y"] + c["size"] <= 1000
        assert not any(overlap(square(c["size"]), b) for b in images[c["image_id"]])
        grown = c["size"] + 1
        assert grown > 120 or c["x"] + grown > 1000 or c["y"] + grown > 1000 or any(overlap(square(grown), b) for b in images[c["image_id"]])
    per = {}
    for c in crops:
        per[c["image_id"]] = per.get(c["image_id"], 0) + 1
    assert all(n <= len(images[i]) for i, n in per.items())


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_negative_crops_in_tasks_equal_joins(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    rows = [(int(i), *map(int, rng.integers(0, 150, 2)), *map(int, rng.integers(0, 60, 2))) for i in rng.integers(0, 40, 300) ** 2 // 40]
    rows += [(50, 0, 0, 300, 300), (51, 10, 10, 0, 0), (52, None, 4, 5, 6), (None, 1, 1, 1, 1), (99, 1, 1, 1, 1)] + rows[:9]  # no room, no area, no place, no image
    df = spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint, w bigint, h bigint").withColumn("image_id", F.col("image_id").cast(kind))
    pics = spark.createDataFrame([(i, 200 - i, 150 + i) for i in [*range(41), 50, 51, 52, 3, 60]] + [(None, 100, 100)], "image_id bigint, w bigint, h bigint").withColumn("image_id", F.col("image_id").cast(kind))
    monkeypatch.setattr(pl, "HELD", 40)
    monkeypatch.setattr(pl, "PAIRS", 64)
    crops = pl.plan_negative_crops(df, pics, seed=4, ratio=3, max_size=90, attempts=20)
    plan = crops._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    joined = pl._squares_by_joins(df, pics, 4, 3, 90, 20)
    got = sorted(map(tuple, crops.collect()))
    assert got == sorted(map(tuple, joined.collect())) and len(got) > 500
    for limit in (12, 0):  # some images, and all of them, go by joins
        monkeypatch.setattr(ob, "CELL", limit)
        assert sorted(map(tuple, pl.plan_negative_crops(df, pics, seed=4, ratio=3, max_size=90, attempts=20).collect())) == got


def test_positive_crops_hold_their_box(spark, images):
    crops = pl.plan_positive_crops(make(spark, images), sizes(spark, images), seed=4, max_pad=50).collect()
    for c in crops:
        assert 0 <= c["x1"] <= c["x2"] <= 1000 and 0 <= c["y1"] <= c["y2"] <= 1000
        assert c["bx"] >= 0 and c["by"] >= 0 and c["x1"] + c["bx"] + c["bw"] <= max(c["x2"], 1000)


def test_crop_plan(spark, images):
    df, pics = make(spark, images), sizes(spark, images)
    plan = pl.plan_crops(df, pics, 4, seed=9)
    kinds = {r["kind"]: r["count"] for r in plan.groupBy("kind").count().collect()}
    total = sum(map(len, images.values()))
    assert kinds["close"] == kinds["far"] == total and kinds["cut"] + kinds["engulf"] == 4 * len(images)
    assert plan.filter("x1 < 0 or y1 < 0 or x2 > 1000 or y2 > 1000 or x1 > x2 or y1 > y2").count() == 0
    one = pl.plan_crops(df, pics, 4, seed=9, compat=True).filter("kind in ('cut', 'engulf')").groupBy("image_id").agg(F.countDistinct("kind").alias("n"))
    assert one.filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        pl.plan_crops(df, pics, -1, seed=9)


def test_synthetic_boxes_stay_inside(spark):
    pics = spark.range(40).select(F.col("id").alias("image_id"), F.lit(300).cast("bigint").alias("w"), F.lit(200).cast("bigint").alias("h"))
    frags = spark.range(9).select(F.col("id").alias("frag_id"), (F.col("id") + 5).alias("fw"), (F.col("id") * 2 + 3).alias("fh"))
    raw = pl.synth_boxes(pics, frags, 3, merge=False)
    assert raw.filter("x < 0 or y < 0 or x + w > 300 or y + h > 200 or w < 1 or h < 1").count() == 0
    assert raw.groupBy("image_id").count().agg(F.max("count")).first()[0] <= 30 + 3 * 20
    assert raw.count() == raw.select("image_id", "ann_id").distinct().count()
    labels = pl.synth_labels(pics, frags, 3)
    assert labels.filter("xc < 0 or xc > 1 or bw <= 0 or bw > 1").count() == 0


def test_many_images_merge_as_each_alone():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 70, 3, 1, 9, 400, 5, 2]
    at = rng.integers(0, 300, (sum(sizes), 2))
    corners = np.concatenate([at, at + rng.integers(0, 40, at.shape)], 1)
    bounds = np.r_[0, np.cumsum(sizes)]
    alone = [ob.greedy_merge(corners[a:b]) for a, b in zip(bounds, bounds[1:])]
    merged, first = ob.merge_many(corners, bounds)
    assert (merged == np.concatenate([m for m, _ in alone])).all()
    assert (first == np.concatenate([f + a for (_, f), a in zip(alone, bounds)])).all()


def test_closure_in_tasks_equals_joins(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 7), *map(int, rng.integers(0, 200, 2)), *map(int, rng.integers(0, 30, 2))) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "image_id bigint, x bigint, y bigint, w bigint, h bigint")
    key = ["image_id", "x", "y", "w", "h"]
    assert sorted(map(tuple, ob.merge_closure(df).select(key).collect())) == sorted(map(tuple, ob.merge_closure(df, group_rows=5).select(key).collect()))


def test_synthetic_draws_are_not_broadcast(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("image_id"), F.lit(300).cast("bigint").alias("w"), F.lit(200).cast("bigint").alias("h")).write.parquet(f"{tmp_path}/images")
    spark.range(50).select(F.col("id").alias("frag_id"), (F.col("id") % 9 + 5).alias("fw"), (F.col("id") % 9 * 2 + 3).alias("fh")).write.parquet(f"{tmp_path}/frags")
    pics, frags = spark.read.parquet(f"{tmp_path}/images"), spark.read.parquet(f"{tmp_path}/frags")
    plan = pl.synth_boxes(pics, frags, 3, merge=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_rank" in plan and "BroadcastHashJoin [_rank" not in plan


def test_numbers_in_tasks_equal_those_of_columns(spark):
    import pyarrow as pa

    from tilewright.functions.draws import Ids
    from tilewright.functions.hashing import hash_int

    ids = ["7", "-12", "", "é", "x" * 60, "1234567", "b" * 50, "a" * 45]
    keys = [(i, t, k, d) for i, t in enumerate(ids) for k in (0, 3, 11) for d in (1, 30, 999, 5_000_000_000)]
    df = spark.createDataFrame(keys, "i int, id string, k bigint, d bigint").select("i", "k", "d", hash_int("12px", "id", "k", "d").alias("two"), hash_int("8x", "id", "d").alias("one"), hash_int(3, "id").alias("none"))
    want = df.toPandas()
    at, k, d = (want[c].to_numpy().astype(np.int64) for c in ("i", "k", "d"))
    texts = Ids(pa.array(["before", *ids]).slice(1))
    for got, name in ((texts.number("12px", at, k, d), "two"), (texts.number("8x", at, d), "one"), (texts.number("3", at), "none")):
        assert got.tolist() == want[name].tolist()
    assert len(texts.digest("12px", at[:0], k[:0], d[:0])[0]) == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_synthetic_labels_follow_from_the_picture(spark, monkeypatch, kind):
    pics = spark.range(300).selectExpr(f"cast(case when id = 9 then null else id * 37 end as {kind}) as image_id", "cast(case when id = 5 then 0 when id = 6 then null else 100 + id end as bigint) as w", "200 as h")
    frags = spark.range(70).selectExpr("id * 3 as frag_id", "cast(id + 5 as int) as fw", "300 - id * 2 as fh")
    labels = pl.synth_labels(pics, frags, 3)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the pictures
    got = sorted(map(tuple, labels.collect()))
    monkeypatch.setattr(pl, "PACKED", 69)
    joined = pl.synth_labels(pics, frags, 3)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(map(tuple, joined.collect())) and len(got) > 500
    monkeypatch.undo()
    assert pl.synth_labels(pics, frags.limit(0), 3).count() == 0
    odd = frags.unionByName(spark.sql("select 1000L as frag_id, cast(null as int) as fw, 4L as fh"))
    assert "Join" in pl.synth_labels(pics, odd, 3)._jdf.queryExecution().executedPlan().toString()


def grid_mask(spark, h, w, on):
    return spark.createDataFrame([(1, y, x, on(y, x)) for y in range(h) for x in range(w)], "image_id bigint, y bigint, x bigint, mask boolean")


def test_spaced_points(spark):
    mask = grid_mask(spark, 40, 40, lambda y, x: not (10 <= y < 14 and x > 5))
    pics = spark.createDataFrame([(1, 40, 40)], "image_id bigint, w bigint, h bigint")
    points = [(r["x"], r["y"]) for r in pl.spaced_points(mask, pics, 6, 5, 6, seed=2).collect()]
    assert 1 <= len(points) <= 6
    for i, (x, y) in enumerate(points):
        assert x + 6 < 40 and y + 5 < 40
        assert not any(10 <= yy < 14 and xx > 5 for yy in range(y, y + 5) for xx in range(x, x + 6))
        assert all((x - a) ** 2 + (y - b) ** 2 >= 36 for a, b in points[:i])


def test_mask_runs(spark):
    mask = grid_mask(spark, 5, 9, lambda y, x: (x * 7 + y * 3) % 4 != 0)
    cells = {(r["y"], x) for r in om.mask_runs(mask).collect() for x in range(r["x0"], r["x1"] + 1)}
    assert cells == {(r["y"], r["x"]) for r in mask.filter("mask").collect()}


def test_boxes_without_area_are_kept_on_every_path(spark):
    made = {
        1: [(5, 5, 5, 9), (0, 0, 3, 3), (2, 2, 6, 4)],  # a line beside two boxes
        2: [(4, 1, 4, 4), (0, 0, 8, 8), (20, 20, 20, 20)],  # a line inside a box, a point far away
        3: [(7, 7, 7, 7), (7, 7, 7, 7)],  # equal points never overlap
    }
    small = result(ob.merge_greedy(make(spark, made)))
    assert small[1] == [(0, 0, 6, 4), (5, 5, 5, 9)] and small[2] == [(0, 0, 8, 8), (20, 20, 20, 20)]
    for limit in (2, 1):
        large = result(ob.merge_greedy(make(spark, made), group_rows=limit))
        assert {i: sorted(set(b)) for i, b in large.items()} == {i: sorted(set(b)) for i, b in small.items()}
    assert result(ob.merge_closure(make(spark, made))) == {i: sorted(set(b)) for i, b in small.items()}


def test_fractional_boxes_keep_their_size(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0.2, 0.3, 0.3), (1, 1, 127.5, 0.0, 1.0, 1.0), (1, 2, 128.2, 0.0, 1.0, 1.0)], "image_id bigint, ann_id bigint, x double, y double, w double, h double")
    want = [(0.2, 0.2, 0.3, 0.3), (127.5, 0.0, 1.7, 1.0)]
    for merged in (ob.merge_greedy(df), ob.merge_greedy(df, group_rows=1), ob.merge_closure(df)):
        got = sorted((r["x"], r["y"], round(r["w"], 9), round(r["h"], 9)) for r in merged.collect())
        assert got == want


def test_crowded_image_and_huge_boxes_are_cut_evenly(spark):
    """20,000 small boxes with a dense spot, and boxes over the whole picture: no leaf holds a large part of them."""
    rng = random.Random(9)
    small = [(rng.randrange(0, 30_000), rng.randrange(0, 30_000)) for _ in range(12_000)] + [(500 + rng.randrange(0, 700), 900 + rng.randrange(0, 700)) for _ in range(8_000)]
    boxes = [(x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for x, y in small] + [(0, 0, 30_000, 30_000), (-5, 20, 31_000, 29_000)]
    df = make(spark, {0: boxes, 1: boxes[:3]})
    cells = ob.fit_cells(df)
    placed = cells.place(df)
    leaves = placed.filter("image_id = 0").groupBy("_d", "_cx", "_cy").count()
    assert leaves.agg(F.max("count")).first()[0] <= ob.CELL + 60 and placed.count() < 1.5 * len(boxes)
    assert placed.filter("image_id = 1").count() == 3
    pairs = ob.overlapping_boxes(df)
    got = {(r["a"], r["b"]) for r in pairs.filter("image_id = 0").collect()}
    want, grid = set(), {}
    for k, (x1, y1, x2, y2) in enumerate(boxes[:-2]):
        for cx in range(x1 // 16, x2 // 16 + 1):
            for cy in range(y1 // 16, y2 // 16 + 1):
                grid.setdefault((cx, cy), []).append(k)
    for members in grid.values():
        want |= {(a, b) for i, a in enumerate(members) for b in members[i + 1 :] if overlap(boxes[a], boxes[b])}
    want |= {(k, n) for n in (len(boxes) - 2, len(boxes) - 1) for k in range(n) if overlap(boxes[k], boxes[n])}
    assert pairs.filter("image_id = 0").count() == len(got) and got == want


@pytest.mark.parametrize("scale", [1, 1e-4])
def test_clear_of_boxes_at_any_cell_size(spark, images, scale):
    cands = make(spark, {i: [(x, y, x + 25, y + 25) for x in range(0, 900, 90) for y in range(0, 900, 110)] for i in images})
    scaled = lambda df: df if scale == 1 else df.select("image_id", "ann_id", *[(F.col(c) * scale).alias(c) for c in "xywh"])
    want = {(i, x, y) for i, own in images.items() for x in range(0, 900, 90) for y in range(0, 900, 110) if not any(overlap((x, y, x + 25, y + 25), b) for b in own)}
    for cell in (1, 30, 10_000):
        free = ob.boxes_clear_of(scaled(cands), scaled(make(spark, images)), ["image_id", "ann_id"], cell=cell)
        assert {(r["image_id"], round(r["x"] / scale), round(r["y"] / scale)) for r in free.collect()} == want


def test_a_long_staircase_takes_few_rounds(spark, monkeypatch):
    """300 boxes in a chain across cells, far above the limit of a task: one growth, not one round a step."""
    monkeypatch.setattr(ob, "CELL", 16)
    stairs = [(10 * k, 7 * k, 10 * k + 12, 7 * k + 9) for k in range(300)]
    loose = [(3500 + 20 * k, 0, 3505 + 20 * k, 9) for k in range(5)]
    draw = random.Random(1)
    boxes = stairs + loose + [(5, 5, 5, 5)]
    draw.shuffle(boxes)
    calls = []
    monkeypatch.setattr(ob, "cut_lineage", lambda df, cut=ob.cut_lineage: calls.append(1) or cut(df))
    assert result(ob.merge_greedy(make(spark, {0: boxes}), group_rows=50)) == {0: brute_greedy(boxes)}
    assert len(calls) < 40


def test_least_reachable(spark):
    from tilewright.operators.graphs import least_reachable

    draw = random.Random(6)
    chain = list(range(1000, 1200))
    draw.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, 5), (7, 8), (8, 9), (9, 7)] + [(50, k) for k in range(51, 80)]
    got = {r["node"]: r["root"] for r in least_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1000 for k in chain}, 5: 5, **dict.fromkeys((7, 8, 9), 7), **{k: 50 for k in range(50, 80)}}
    assert least_reachable(spark.createDataFrame([], "a bigint, b bigint")).collect() == []

"""Published cases and contracts of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import boxes as fb
from tilewright.functions import geo, text
from tilewright.operators import datasets as ds
from tilewright.operators import regions as rg
from tilewright.operators import runs as rn
from tilewright.operators import scoring as sc
from tilewright.operators import sequences as sq
from tilewright.operators import state as st
from tilewright.operators import texts as tx
from tilewright.operators import tiles as tl


def rows(df):
    return sorted(map(tuple, df.collect()))


# ---- sequences -----------------------------------------------------------

PROBS = [[0.7, 0.1], [0.55, 0.3], [0.2, 0.9], [0.3, 0.6], [0.4, 0.75], [0.95, 0.2], [0.1, 0.2], [0.6, 0.65]]


def test_scores_to_frame_ranges(spark):
    long = [(1, i + 1, k, ["Idle", "Moving"][k], p) for i, r in enumerate(PROBS) for k, p in enumerate(r)]
    probs = spark.createDataFrame(long, "video_id int, frame bigint, label_idx int, label string, prob double")
    got = {r["id"]: (r["label"], r["score"]) for r in sq.threshold_segments(probs, 0.5).collect()}
    want = {"0_1_2": ("Idle", 0.625), "1_3_5": ("Moving", 0.75), "2_6_6": ("Idle", 0.95), "3_8_8": ("Idle", 0.6), "4_8_8": ("Moving", 0.65)}
    assert got.keys() == want.keys()
    for key, (label, score) in want.items():
        assert got[key][0] == label and got[key][1] == pytest.approx(score)


def test_frame_ranges_to_matrix(spark):
    regions = spark.createDataFrame(
        [(1, [(2, 5)], ["Open"]), (1, [(7, 9)], ["Shut"]), (1, [(9, 11), (20, 21)], ["Open", "Shut"])],
        "video_id int, ranges array<struct<start:bigint,end:bigint>>, labels array<string>",
    )
    got = sq.label_frames(sq.first_of_region(regions), ["Shut", "Open"])
    on = {(r["frame"], r["label"]) for r in got.filter("value = 1").collect()}
    assert got.count() == 22
    assert on == {(f, "Open") for f in (2, 3, 4, 5, 9, 10, 11)} | {(f, "Shut") for f in (7, 8, 9)}


def test_range_labels_counts(spark):
    series = spark.range(100).select(F.lit(1).alias("seq_id"), F.col("id").alias("t"))
    ranges = spark.createDataFrame([(1, 1, 0, 40, "Run", True), (1, 2, 60, 85, "Late", False)], "seq_id int, ord bigint, lo bigint, hi bigint, label string, ground_truth boolean")
    counts = lambda r: {x["range_label"]: x["count"] for x in sq.label_rows(series, r).groupBy("range_label").count().collect()}
    assert counts(ranges) == {"Run": 41, "background": 59}
    both = ranges.withColumn("ground_truth", F.lit(False)).replace("Late", "Walk", "label")
    assert counts(both) == {"Run": 41, "Walk": 26, "background": 33}
    over = both.unionByName(spark.createDataFrame([(1, 3, 40, 41, "Last", False)], both.schema))
    assert counts(over) == {"Run": 40, "Last": 2, "Walk": 26, "background": 32}


def test_windows_cover_and_average(spark):
    series = spark.range(25).select(F.lit(1).alias("seq_id"), (F.col("id") + 1).alias("t"), F.col("id").cast("double").alias("score"))
    windows = sq.sliding_windows(series, 10, 0.5)
    assert {r["start"] for r in windows.select("start").distinct().collect()} == {0, 5, 10, 15}
    preds = windows.select("seq_id", "start", "pos", F.lit(0).alias("label_idx"), F.col("score").alias("prob"))
    out = sq.overlap_average(preds, sq.sequence_lengths(series), 10).orderBy("t").collect()
    assert [r["prob"] for r in out] == [float(i) for i in range(25)]
    tail = sq.sliding_windows(series.filter("t <= 23"), 10, 0.5)
    assert {r["start"] for r in tail.select("start").distinct().collect()} == {0, 5, 10, 13}


def padded_at(values, size, mode, p):
    """What the padding rule puts at position p of the padded series."""
    n = len(values)
    if mode == "edge":
        return values[min(max(p - size // 2, 0), n - 1)]
    front = (size - n) // 2 if mode == "zero" else (size - n + 1) // 2
    if front <= p < front + n:
        return values[p - front]
    if mode == "zero":
        return 0.0
    steps = p if p < front else p - front - n  # both sides begin with the last value and go backwards, again and again
    return values[n - 1 - steps % n]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 9])
@pytest.mark.parametrize("mode", ["reflect", "edge", "zero"])
def test_padding(spark, n, mode):
    values = [float(10 + i) for i in range(n)]
    series = spark.createDataFrame([(1, i + 1, v, 3) for i, v in enumerate(values)], "seq_id int, t bigint, score double, lab int")
    got = sq.pad_sequences(series, 10, mode, ["score"], "lab").orderBy("pos").collect()
    assert [r["score"] for r in got] == [padded_at(values, 10, "zero" if n == 1 and mode == "reflect" else mode, p) for p in range(10)]
    if mode == "reflect" and n > 1:
        front = (10 - n + 1) // 2
        assert [r["lab"] for r in got] == [3 if front <= p < front + n else -1 for p in range(10)]
    if n == 1 and mode == "reflect":
        assert [r["lab"] for r in got] == [3] * 10


def test_char_spans(spark):
    tokens = tx.tokenize(spark.createDataFrame([(1, "ab cde f")], "doc_id int, text string"))
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 6), (1, 2, 7, 8), (1, 3, 8, 9)], "doc_id int, span_id bigint, start bigint, end bigint")
    assert rows(tx.char_to_token_spans(tokens, spans)) == [(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 2, 3), (1, 3, None, 3)]
    assert rows(tx.char_to_token_spans(tokens, spans, compat=True))[0] == (1, 0, 1, 1)


def test_keyword_hits(spark):
    texts = spark.createDataFrame([(1, "aXa xx XAX"), (2, "none"), (3, "a.b aab")], "doc_id int, text string")
    assert rows(tx.keyword_spans(texts, "x").drop("score")) == [(1, 1, 2, "X"), (1, 4, 5, "x"), (1, 5, 6, "x"), (1, 7, 8, "X"), (1, 9, 10, "X")]
    assert rows(tx.keyword_spans(texts, "a.b").drop("score")) == [(3, 0, 3, "a.b")]
    assert rows(tx.keyword_spans(texts, "a.b", as_regex=True).drop("score")) == [(3, 0, 3, "a.b"), (3, 4, 7, "aab")]


# ---- regions -------------------------------------------------------------

LABEL_CASES = [
    ([("Fastener", "bolt,nut"), ("Tool", "wrench")], ["bolt", "nut", "wrench"], {"bolt": "Fastener", "nut": "Fastener", "wrench": "Tool"}),
    ([], ["bolt"], {}),
    ([("Leaf", None)], ["LEAF"], {"leaf": "Leaf"}),
    ([("Garden hose", None), ("Rake", "rake")], ["Garden hose", "rake"], {"Garden hose": "Garden hose", "rake": "Rake"}),
    ([("Tool", "wrench,saw"), ("Plant", "fern")], ["wrench", "saw"], {"wrench": "Tool", "saw": "Tool"}),
    ([("First", "x"), ("Second", " x , ")], ["x"], {"x": "Second"}),
]


@pytest.mark.parametrize("ui, models, want", LABEL_CASES)
def test_label_map(spark, ui, models, want):
    labels = spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(ui)], "label string, ord bigint, predicted_values string")
    names = spark.createDataFrame([(m,) for m in models], "name string")
    assert {r["model_label"]: r["ui_label"] for r in rg.label_map(labels, names).collect()} == want


# ---- state and tiles -----------------------------------------------------


def test_state_life_cycle(spark):
    tiles = spark.createDataFrame([(14, 100 + i, 200, "pending", 0) for i in range(3)], "z int, x bigint, y bigint, status string, image_count bigint")
    again = st.insert_ignore(tiles, tiles.withColumn("status", F.lit("failed")), ["z", "x", "y"])
    assert rows(again) == rows(tiles)
    change = lambda x, s, n: spark.createDataFrame([(14, x, 200, s, n)], "z int, x bigint, y bigint, status string, image_count bigint")
    started = st.update_status(tiles, change(100, "in_progress", None), ["z", "x", "y"], st.TILE_CHANGES)
    done = st.update_status(started, change(100, "completed", 5), ["z", "x", "y"], st.TILE_CHANGES)
    assert rows(done)[0] == (14, 100, 200, "completed", 5)
    skipped = st.update_status(done, change(101, "completed", 5), ["z", "x", "y"], st.TILE_CHANGES)
    assert rows(skipped) == rows(done)
    requests = spark.createDataFrame([("1", "downloading")], "image_id string, status string")
    t, r = st.reset_in_progress(started, requests)
    assert t.filter("status <> 'pending'").count() == 0 and r.first()["status"] == "pending"
    assert rows(st.tile_stats(done)) == [("completed", 1, 5), ("pending", 2, 0)]


def test_sampling_adds_new_images(spark):
    images = spark.range(100).select(F.col("id").cast("string").alias("image_id"))
    requests = spark.createDataFrame([], "image_id string, status string")
    for seed in (1, 2):
        requests = st.request_images(requests, st.sample_unrequested(images, requests, 10, seed))
    assert requests.select("image_id").distinct().count() == 20
    assert st.selection_hook(images, requests).count() == 100


def test_tiles(spark):
    box = lambda *b: spark.createDataFrame([(1, *b)], "id int, min_lon double, min_lat double, max_lon double, max_lat double")
    small = box(-122.15, 37.42, -122.10, 37.45)
    counts = [tl.tiles_for_bbox(small, z).count() for z in (12, 14, 16)]
    assert counts == sorted(counts) and counts[0] >= 1
    assert [tl.tile_count(small, z).first()["tiles"] for z in (12, 14, 16)] == counts
    tile = spark.createDataFrame([(14, 2621, 6332)], "z int, x bigint, y bigint")
    b = tile.select(geo.tile_bounds("z", "x", "y").alias("b")).first()["b"]
    assert b["west"] < b["east"] and b["south"] < b["north"]
    inside = spark.createDataFrame([((b["west"] + b["east"]) / 2, (b["south"] + b["north"]) / 2)], "lon double, lat double")
    assert tuple(inside.select(*geo.lonlat_to_tile("lon", "lat", 14)).first()) == (2621, 6332)
    # a box just inside the tile's own bounds (given to 9 decimals) touches only that tile
    inner = box(b["west"] + 1e-9, b["south"] + 1e-9, b["east"] - 1e-9, b["north"] - 1e-9)
    assert rows(tl.tiles_for_bbox(inner, 14).select("x", "y")) == [(2621, 6332)]
    parts = tl.sub_boxes(tile).collect()
    assert all(p["max_lon"] - p["min_lon"] <= 0.01 and p["max_lat"] - p["min_lat"] <= 0.01 for p in parts)
    assert max(p["max_lon"] for p in parts) == b["east"] and max(p["max_lat"] for p in parts) == b["north"]
    across = tl.tiles_for_bbox(box(179.99, 0.0, -179.99, 0.01), 10)
    assert {r["x"] for r in across.collect()} == {0, 1023}


# ---- contracts -----------------------------------------------------------


def test_errors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "image_id int, v string")
    assert ds.lookup_one(df, "image_id", 2).first()["v"] == "c"
    for bad in (1, 9):
        with pytest.raises(Exception, match="image_id"):
            ds.lookup_one(df, "image_id", bad).collect()
    with pytest.raises(ValueError):
        ds.even_chunks(df, 0, ["v"])
    with pytest.raises(ValueError):
        ds.split_dataset(df, 0.5, 0.1, 0.1)
    with pytest.raises(Exception, match="twice"):
        ds.assign_names(df, ["image_id"]).collect()
    with pytest.raises(Exception, match="bad run name"):
        spark.createDataFrame([("a=1-b",)], "n string").select(text.parse_run_name("n")).collect()
    stem = df.select(F.col("v").alias("stem"), F.col("v").alias("path"))
    with pytest.raises(Exception, match="no mask"):
        ds.collate_datasets([(stem, stem.filter("stem <> 'c'"))]).collect()


def test_even_chunks_sizes(spark):
    got = ds.even_chunks(spark.range(14).withColumnRenamed("id", "i"), 4, ["i"]).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [4, 4, 3, 3]
    assert ds.even_chunks(spark.range(2).withColumnRenamed("id", "i"), 5, ["i"]).select("chunk").distinct().count() == 2


def test_split_sizes_are_exact(spark):
    got = ds.split_dataset(spark.range(1003).withColumnRenamed("id", "image_id"), 0.7, 0.2, 0.1)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 702, "val": 200, "test": 101}


def test_box_forms_round_trip(spark):
    df = spark.createDataFrame([(10, 20, 64, 32, 640, 480)], "x bigint, y bigint, w bigint, h bigint, iw bigint, ih bigint")
    box = ["x", "y", "w", "h"]
    for form in ("xyxy", "slice", "yolo", "percent"):
        mid = df.select("iw", "ih", *[c.alias(f"c{i}") for i, c in enumerate(fb.box_convert(box, "xywh", form, "iw", "ih"))])
        back = mid.select(*fb.box_convert([f"c{i}" for i in range(4)], form, "xywh", "iw", "ih")).first()
        assert [abs(a - b) <= 1 for a, b in zip(back, (10, 20, 64, 32))] == [True] * 4


def test_horizon_scale_errors(spark):
    df = spark.createDataFrame([(50, 60)], "a int, b int")
    with pytest.raises(Exception, match="horizon"):
        df.select(fb.horizon_scale("a", "b", F.lit(5), F.lit(1), F.lit(10), F.lit(10))).collect()


def test_grid_and_cache_match(spark):
    grid = rn.param_grid(spark, {"model": ["s", "l"], "n": ["1", "2", "3"]})
    assert [tuple(r) for r in grid.orderBy("idx").collect()] == [(i, m, n) for i, (m, n) in enumerate((m, n) for m in "sl" for n in "123")]
    stored = spark.createDataFrame([(5, "s", "2"), (9, "s", "2"), (7, "l", None)], "run_id int, model string, n string")
    flagged = rn.new_experiments(grid, stored, ["model", "n", "absent"])
    assert [r["run_id"] for r in flagged.filter("cached").collect()] == [9]
    assert flagged.filter("not cached").count() == 5


def test_pipe_and_compose():
    add, double = (lambda x: x + 1), (lambda x: x * 2)
    assert sc.pipe(add, double)(3) == 8 and sc.compose(add, double)(3) == 7


def test_version_bump(spark):
    df = spark.createDataFrame([("1.2.3",), ("Net-v0.9.1",)], "v string")
    assert [r[0] for r in df.select(text.bump_version("v")).collect()] == ["1.3.0", "Net-v0.10.0"]


def lloyd(points, centers, steps):
    for _ in range(steps):
        near = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([points[near == i].mean(axis=0) if (near == i).any() else centers[i] for i in range(len(centers))])
    return ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_kmeans_per_image(spark):
    rng = np.random.default_rng(5)
    data = [(img, i // 8, i % 8, *map(float, rng.integers(0, 30, 3) + 90 * int(rng.integers(0, 3)))) for img in (1, 2) for i in range(64)]
    df = spark.createDataFrame(data, "image_id int, y int, x int, b double, g double, r double")
    out = sc.kmeans_rows(df, ["b", "g", "r"], 3, iterations=10, starts=3)
    assert out.count() == 128
    for img in (1, 2):
        points = np.array([d[3:] for d in data if d[0] == img])
        got = out.filter(F.col("image_id") == img).agg(F.sum("cost")).first()[0]
        best = min(lloyd(points, points[rng.choice(64, 3, replace=False)], 20) for _ in range(20))
        assert got <= 3 * best + 1e-6 and got < points.var(axis=0).sum() * 64


def test_text_classifier_learns(spark):
    data = [(f"the red apple number {i}", "fruit") for i in range(20)] + [(f"a fast car model {i}", "vehicle") for i in range(20)]
    train = spark.createDataFrame(data, "text string, label string")
    test = spark.createDataFrame([("one red apple", "fruit"), ("my fast car", "vehicle")], "text string, want string")
    out = sc.text_classifier(train, test, features=1 << 12)[0].collect()
    assert [(r["prediction"], r["score"] > 0.5) for r in out] == [(r["want"], True) for r in out]


def test_clock_in_milliseconds_to_windows_and_segments(spark):
    """A clock in ms becomes dense places for windows; segments take the clock as it is."""
    clock = [1_700_000_000_000 + 250 * i + (i % 3) for i in range(20)]
    series = spark.createDataFrame([(7, t, "on" if 5 <= i < 9 else "off", float(i)) for i, t in enumerate(clock)], "seq_id int, t bigint, label string, score double")
    placed = sq.dense_positions(series.withColumnRenamed("t", "at"), "at")
    assert [r["t"] for r in placed.orderBy("at").collect()] == list(range(1, 21))
    same = sq.dense_positions(series, "t")
    assert [r["t"] for r in same.orderBy("score").collect()] == list(range(1, 21))
    windows = sq.sliding_windows(placed, 8, 0.0)
    assert {r["score"] for r in windows.select("score").collect()} == {float(i) for i in range(20)}
    got = [(r["start"], r["end"], r["score"]) for r in sq.segments(series, "off").collect()]
    assert got == [(clock[5], clock[8], 6.5)]

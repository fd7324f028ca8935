"""File sources, cached outputs, and streaming jobs over several micro-batches."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tilewright.operators import sequences as sq
from tilewright.sources import annotations as ann
from tilewright.sources import files, runs, state_tables, timeseries
from tilewright.streaming import jobs
from tilewright.streaming.tables import BucketedTable


def rows(df):
    return sorted(map(tuple, df.collect()))


def png(width, height, pixels):
    """Minimal 8-bit RGB picture."""
    raw = b"".join(b"\0" + bytes(v for p in pixels[y * width:(y + 1) * width] for v in p) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_pixels(spark, tmp_path):
    pixels = [(i * 10, i * 10 + 1, i * 10 + 2) for i in range(6)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p1.png").write_bytes(png(3, 2, pixels))
    images = files.read_images(spark, str(tmp_path))
    assert [(r["stem"], r["w"], r["h"], r["channels"]) for r in images.collect()] == [("p1", 3, 2, 3)]
    got = files.explode_pixels(images).orderBy("y", "x").collect()
    assert [(r["r"], r["g"], r["b"]) for r in got] == pixels and [(r["y"], r["x"]) for r in got] == [(i // 3, i % 3) for i in range(6)]


def test_small_images_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / str(i % 3)).mkdir(exist_ok=True)
        (tmp_path / str(i % 3) / f"p{i // 3}.png").write_bytes(png(1, 1, [(i, i, i)]))  # each stem in three folders
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        images = files.read_images(spark, str(tmp_path))
        assert images.rdd.getNumPartitions() == 8 * 4
        pixels = files.explode_pixels(images, keep=["w", "path"])
        assert pixels._jdf.queryExecution().executedPlan().toString().count("FileScan image") == 1
        got = sorted((int(r["path"].split("/")[-2]), r["image_id"], r["w"], r["b"]) for r in pixels.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((i % 3, f"p{i // 3}", 1, i) for i in range(60))


def test_read_images_reads_once(spark):
    found = queries()["read_images"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan image") == 1


def test_pixels_of_odd_images(spark):
    wide = bytes(range(256)) * 3 * 300
    odd = [("a", 3, 2, 3, bytes(range(18))), ("none", 2, 1, 3, None), ("b", 2, 2, 3, bytes(range(200, 207))), ("gray", 2, 2, 1, b"\x01\x02\x03\xff"), ("alpha", 1, 2, 4, bytes(range(8)))]
    odd += [("empty", 0, 5, 3, b""), ("void", None, 5, 3, b"1"), ("minus", -2, -2, 3, b"1"), ("wide", 256, 300, 3, wide), ("long", 1, 1, 3, b"12345"), (None, 1, 1, 1, b"7")]
    images = spark.createDataFrame(odd, "stem string, w int, h int, channels int, data binary").coalesce(1)
    got = {(r["image_id"], r["y"], r["x"]): (r["w"], r["b"], r["g"], r["r"]) for r in files.explode_pixels(images, keep=["w"]).collect()}
    want = {}
    for stem, w, h, channels, data in odd:
        for p in range(max(0, w or 0) * max(0, h)):
            bytes_of = [(data or b"")[p * channels + i : p * channels + i + 1] if i < channels else b"" for i in range(3)]
            want[stem, p // w, p % w] = (w, *[b[0] if b else None for b in bytes_of])
    assert got == want


def test_inventory(spark, tmp_path):
    for name in ("x/a.jpg", "y/a.JPG", "y/b.txt", "y/c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = {r["stem"]: (r["parent"], r["suffix"]) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a": ("y", ".JPG"), "c": ("y", ".png")}


def test_label_files(spark, tmp_path):
    (tmp_path / "im1.txt").write_text("0 0.5 0.5 0.25 0.125\n2 0.1 0.2 0.3 0.4\n")
    (tmp_path / "im2.txt").write_text("\n")
    assert rows(ann.read_yolo_labels(spark, str(tmp_path))) == [("im1", 0, 0.5, 0.5, 0.25, 0.125), ("im1", 2, 0.1, 0.2, 0.3, 0.4)]


def test_coco_file(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "batch_1/a.jpg", "width": 10, "height": 20}],
        "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [1.5, 2, 3, 4], "segmentation": [[1, 2, 3, 4, 5, 6]]}],
        "categories": [{"id": 3, "name": "can", "supercategory": "metal"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    images, annotations, categories = ann.read_coco(spark, str(tmp_path / "c.json"))
    assert images.first()["file_name"] == "batch_1/a.jpg" and categories.first()["name"] == "can"
    assert tuple(annotations.select("x", "y", "w", "h").first()) == (1.5, 2.0, 3.0, 4.0)


def test_export_file(spark, tmp_path):
    tasks = [
        {"id": 1, "data": {"image": "/d/?d=a.jpg"}, "annotations": [{"completed_by": 4, "result": [{"id": "r", "from_name": "tag", "type": "brushlabels", "value": {"format": "rle", "rle": [1, 2]}, "original_width": 8}]}]},
        {"id": 2, "data": {"image": "b"}, "annotations": []},
    ]
    (tmp_path / "e.json").write_text(json.dumps(tasks))
    got = ann.rle_value(ann.read_label_export(spark, str(tmp_path / "e.json"))).orderBy("task_id").collect()
    assert got[0]["rle"] == [1, 2] and got[0]["original_width"] == 8 and got[1]["region_index"] is None


def test_segmentation_csv(spark, tmp_path):
    (tmp_path / "segmentations.csv").write_text("MaskPath,ImageID,LabelName\nm1.png,i1,/m/1\nm2.png,i1,/m/2\n")
    (tmp_path / "classes.csv").write_text("/m/1,Tin can\n")
    got = ann.read_segmentation_csv(spark, str(tmp_path))
    assert rows(got.select("mask_name", "class_name")) == [("m1.png", "Tin can"), ("m2.png", "/m/2")]


def test_series_without_time_column(spark, tmp_path):
    for name, n in (("s1", 250), ("s2", 3)):
        (tmp_path / f"{name}.csv").write_text("value,value2\n" + "".join(f"{i * 0.5},{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = timeseries.read_timeseries(spark, str(tmp_path), ["value", "value2"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 253 and all(r["t"] == r["value2"] + 1 for r in got)


LOG = """
=== FILE_SIZE=35-retries=0 | attempt 1 | start: 2026-01-25 12:24:16.925714 ===
loading
[0, 0.8, 1.25, '00:07']
[0, 0.6, 0.5, '00:08']

=== FAILED | attempt_time: 0:00:02.500000 ===

=== FILE_SIZE=35-retries=0 | attempt 2 | start: 2026-01-25 12:25:16.925714 ===
[0, 0.7, nan, '01:00:07']
=== SUCCESS | attempt_time: 1 day, 0:02:27.000000 ===
"""


def test_run_log(spark, tmp_path):
    (tmp_path / "run.log").write_text(LOG)
    got = runs.parse_run_log(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["attempt"], r["kind"]) for r in got] == [(1, "start"), (1, "epoch"), (1, "epoch"), (1, "outcome"), (2, "start"), (2, "epoch"), (2, "outcome")]
    assert [r["seconds"] for r in got] == [None, 7.0, 8.0, 2.5, None, 3607.0, 86547.0]
    assert got[0]["started_at"].second == 16 and got[6]["outcome"] == "SUCCESS"


def test_materialize(spark, tmp_path):
    calls = []

    def build(n, note):
        calls.append(n)
        if n < 0:
            raise RuntimeError("broken")
        return spark.range(n).withColumn("suffix", F.when(F.col("id") < 2, ".png").otherwise(".txt"))

    make = lambda n, note, **kw: runs.materialize(spark, str(tmp_path), "set", {"n": n, "note": note}, ["n"], build, **kw)
    assert make(5, "a").count() == 5 and make(5, "b", wanted=[".png"]).count() == 2 and calls == [5]
    with pytest.raises(RuntimeError):
        make(-1, "a")
    assert not (tmp_path / runs.cache_key("set", {"n": -1}, ["n"])).exists()
    with pytest.raises(TypeError):
        runs.materialize(spark, str(tmp_path), "set", [1], ["n"], build)


def test_state_folder(spark, tmp_path):
    tables = state_tables.empty_state(spark)
    tables["tiles"] = spark.createDataFrame([(14, 1, 2, None, None, None, None, None)], tables["tiles"].schema)
    state_tables.write_state({k: v for k, v in tables.items() if k != "tiles"}, str(tmp_path / "s"))
    tables["tiles"].write.parquet(str(tmp_path / "s" / "tiles"))
    got = state_tables.read_state(spark, str(tmp_path / "s"))
    assert got["tiles"].select("status", "image_count").first() == ("pending", 0) and got["images"].count() == 0


# ---- streams -------------------------------------------------------------


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """An event log of three files in order, read one file per micro-batch."""
    path = tmp_path_factory.mktemp("log")
    import os
    import time

    for i in range(3):
        part = spark.range(i * 200, (i + 1) * 200).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), ((F.col("id") * 7919) / 11 % 4).cast("int").alias("e"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"),
        )
        part.coalesce(1).write.parquet(str(path / f"p{i}"))
        source = next((path / f"p{i}").glob("*.parquet"))
        target = path / f"f{i}.parquet"
        source.rename(target)
        os.utime(target, (time.time() - 100 + i * 10,) * 2)
    return str(path)


def stream_of(spark, log):
    schema = spark.read.parquet(f"{log}/f0.parquet").schema
    batch = spark.read.schema(schema).parquet(*[f"{log}/f{i}.parquet" for i in range(3)])
    return jobs.file_stream(spark, log, "f*.parquet", schema, max_files=1), batch


def test_stream_segments_equal_batch(spark, log, tmp_path):
    stream, batch = stream_of(spark, log)
    pick = lambda df: df.select(F.col("k").alias("seq_id"), F.col("id").alias("t"), F.col("e").cast("string").alias("label"), (F.col("id") % 10).cast("double").alias("score"))
    got = jobs.stream_segments(pick(stream), *[str(tmp_path / n) for n in ("o", "s", "c")])
    want = sq.segments(pick(batch), None)
    cols = ["seq_id", "label", "start", "end", F.round("score", 6)]
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    kept = BucketedTable(spark, str(tmp_path / "s"), ["seq_id"])._places()
    assert kept and all(len(versions) <= 2 for versions in kept.values())  # older ones are removed


def test_stream_trigger(spark, log, tmp_path):
    stream, batch = stream_of(spark, log)
    names = F.element_at(F.array(*[F.lit(x) for x in (jobs.CREATED, jobs.UPDATED, jobs.DELETED[1], jobs.START)]), F.col("e") + 1)
    events = stream.select(F.col("k").alias("project"), names.alias("action"), F.col("id").alias("at"), "id")
    got = rows(jobs.stream_train_trigger(events, 5, *[str(tmp_path / n) for n in ("o", "s", "c")]).select("id", "tasks"))
    counts, want = {}, []
    for r in batch.orderBy("id").collect():
        counts[r["k"]] = counts.get(r["k"], 0) + {0: 1, 2: -1}.get(r["e"], 0)
        if r["e"] == 3 or (r["e"] in (0, 1) and counts[r["k"]] % 5 == 0):
            want.append((r["id"], counts[r["k"]]))
    assert got == want


def test_stream_retry(spark, log, tmp_path):
    stream, batch = stream_of(spark, log)
    names = F.element_at(F.array(F.lit("error"), F.lit("error"), F.lit("rate_limit"), F.when(F.col("id") % 5 == 0, "ok").otherwise("error")), F.col("e") + 1)
    pick = lambda df: df.select(F.col("k").alias("item"), names.alias("outcome"), F.col("id").alias("at"), "id")
    got = rows(jobs.stream_retry(pick(stream), *[str(tmp_path / n) for n in ("o", "s", "c")]).select("id", "action", "attempt", "delay"))
    errors, want = {}, []
    for r in pick(batch).orderBy("id").collect():
        if r["outcome"] == "ok":
            errors[r["item"]] = 0
        elif r["outcome"] == "rate_limit":
            want.append((r["id"], "retry", None, 60))
        else:
            n = errors.get(r["item"], 0) % 5 + 1
            errors[r["item"]] = n
            want.append((r["id"], "failed", 5, None) if n == 5 else (r["id"], "retry", n, 10))
    assert got == want


def test_stream_status_and_annotations(spark, log, tmp_path):
    stream, batch = stream_of(spark, log)
    base = spark.range(9).select(F.col("id").alias("k"), F.lit("new").alias("status"))
    changes = stream.select(F.col("k").cast("bigint").alias("k"), F.col("e").cast("string").alias("status"), F.col("id").alias("at"), "id")
    got = rows(jobs.stream_status(changes, base, ["k"], str(tmp_path / "t"), str(tmp_path / "c")))
    last = {r["k"]: str(r["e"]) for r in batch.orderBy("id").collect()}
    assert got == [(k, last.get(k, "new")) for k in range(9)]
    names = F.element_at(F.array(*[F.lit(x) for x in (jobs.CREATED, jobs.UPDATED, jobs.DELETED[0], "OTHER")]), F.col("e") + 1)
    events = stream.select((F.col("id") % 50).alias("ID"), names.alias("action"), F.col("ts").alias("at"), F.col("id").alias("seq"), F.col("id").alias("value"))
    table = rows(jobs.stream_annotations(events, str(tmp_path / "a"), str(tmp_path / "c2")))
    live = {}
    for r in batch.filter("e < 3").orderBy("id").collect():
        live.pop(r["id"] % 50, None)
        if r["e"] < 2:
            live[r["id"] % 50] = r["id"]
    assert table == sorted(live.items())


def stream_in_batches(spark, folder, batches, schema):
    """One file for each batch, in this order."""
    for k, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_events_lose_in_later_batches(spark, tmp_path):
    c, u, d = jobs.CREATED, jobs.UPDATED, jobs.DELETED[0]
    batches = [[(1, c, 10, 1, "new"), (2, d, 10, 2, None), (3, c, 1, 3, "a")], [(1, u, 5, 4, "old"), (2, u, 5, 5, "old")], [(3, u, 2, 6, "b"), (4, c, 1, 7, "c")], [(3, d, 1, 8, None), (4, d, 3, 9, None)]]
    events = stream_in_batches(spark, str(tmp_path / "in"), batches, "ID bigint, action string, at bigint, seq bigint, value string")
    table = jobs.stream_annotations(events, str(tmp_path / "t"), str(tmp_path / "c"))
    assert rows(table.select("ID", "value")) == [(1, "new"), (3, "b")]
    base = spark.range(4).select(F.col("id").alias("k"), F.lit("start").alias("status"))
    batches = [[(1, "done", 9, 1), (2, "busy", 3, 2)], [(1, "busy", 4, 3), (2, "done", 5, 4)], [(9, "done", 1, 5)], [(2, "failed", 5, 3)]]
    changes = stream_in_batches(spark, str(tmp_path / "in2"), batches, "k bigint, status string, at bigint, id bigint")
    got = jobs.stream_status(changes, base, ["k"], str(tmp_path / "t2"), str(tmp_path / "c2"))
    assert got.columns == ["k", "status"] and rows(got) == [(0, "start"), (1, "done"), (2, "done"), (3, "start")]


def test_stream_discover_once(spark, log, tmp_path):
    stream, _ = stream_of(spark, log)
    twice = stream.select((F.col("id") - F.col("id") % 2).alias("image_id"), "ts")
    assert jobs.run_to_files(jobs.stream_discover(twice), str(tmp_path / "o"), str(tmp_path / "c")).count() == 300


def test_stream_discover_forgets_nothing_and_loses_nothing(spark, tmp_path):
    """Ids of files that arrive hours late and out of order come out once each."""
    source = str(tmp_path / "in")
    for k, (ids, hour) in enumerate([((1, 2), 12), ((1, 3), 20), ((4, 2), 1), ((1,), 23), ((5,), 0)]):
        rows = [(i, f"2024-01-01 {hour:02d}:00:00") for i in ids]
        spark.createDataFrame(rows, "image_id bigint, ts string").select("image_id", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
    stream = spark.readStream.schema("image_id bigint, ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.run_to_files(jobs.stream_discover(stream.select("image_id", "ts")), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["image_id"] for r in out.collect()) == ["1", "2", "3", "4", "5"]


def test_clock_and_long_numbers(spark):
    from tilewright.operators import datasets, documents, runs as runs_ops

    clocks = spark.createDataFrame([("1:02:03",), ("02:03",), ("x",), (None,)], "c string").select(runs_ops.clock_seconds(F.col("c")).alias("s"))
    assert [r["s"] for r in clocks.collect()] == [3723, 123, None, None]
    folders = spark.createDataFrame([("007",), ("1" * 25,)], "run_dir string")
    assert datasets.next_run_id(folders).first()[0] == "008"
    tasks = spark.createDataFrame([(1, 1, 1)], "task_id bigint, completed_by bigint, updated_by bigint")
    regions = spark.createDataFrame([(1, 1, "size", "9" * 30), (1, 2, "n", "12")], "task_id bigint, ord bigint, from_name string, value string")
    users = spark.createDataFrame([(1, "a@b")], "user_id bigint, email string")
    row = documents.flatten_annotations(tasks, regions, users).first()
    assert row["size"] == "9" * 30 and row["n"] == 12


def test_label_files_round_trip(spark, tmp_path):
    from tilewright.sources import annotations

    boxes = spark.createDataFrame([(i, a, a % 3, 10 * a, 5, 20, 10) for i in (1, 2, 30) for a in range(1, 8)], "image_id bigint, ann_id bigint, category_id bigint, x bigint, y bigint, w bigint, h bigint")
    images = spark.createDataFrame([(i, 200, 100) for i in (1, 2, 30)], "image_id bigint, w bigint, h bigint")
    texts = annotations.write_yolo_labels(boxes, images, part_size=3)
    annotations.save_yolo_labels(texts, str(tmp_path / "labels"))
    written = list((tmp_path / "labels").glob("stem=*/*.txt"))
    assert len(written) == 3
    lines = (next((tmp_path / "labels" / "stem=30").glob("*.txt"))).read_text().split("\n")
    assert [x.split()[0] for x in lines if x] == [str(a % 3) for a in range(1, 8)]  # parts in order
    back = annotations.read_yolo_labels(spark, str(tmp_path / "labels"))
    assert back.count() == 21 and {r["stem"] for r in back.select("stem").collect()} == {"1", "2", "30"}


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tilewright import session

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(remote, "x")


def test_stream_timeouts(spark, log, tmp_path):
    stream, batch = stream_of(spark, log)
    changes = stream.select(F.col("id").alias("item"), F.when(F.col("e") == 0, "in_progress").otherwise("completed").alias("status"), "ts", "id")
    got = jobs.run_to_files(jobs.stream_timeouts(changes, 600_000, "1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    # items started at least 10 minutes before the last watermark
    want = batch.filter("e = 0").filter((F.col("id") + 10) <= 599 - 1)
    assert sorted(r["item"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_flattening_reads_the_regions_once(spark):
    from tilewright.operators import documents

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, k, f"c{k % 3}", str(i + k)) for i in range(50) for k in range(6)]
    regions = spark.createDataFrame(rows, "task_id bigint, ord bigint, from_name string, value string").mapInArrow(count, "task_id bigint, ord bigint, from_name string, value string")
    tasks = spark.range(60).selectExpr("id as task_id", "1L as completed_by", "2L as updated_by")
    got = documents.flatten_annotations(tasks, regions, spark.sql("select 1L as user_id, 'a' as email")).filter("ID in (7, 55)").orderBy("ID").collect()
    assert [tuple(r) for r in got] == [(7, 10, 11, 12, "a", ""), (55, None, None, None, "a", "")]
    assert seen.value == len(rows)


def test_labels_are_the_same_however_large_groups_are_told(spark):
    from tilewright.sources import annotations

    boxes = spark.range(40).selectExpr("id % 3 as image_id", "id as ann_id", "id % 5 as category_id", "id as x", "id as y", "3 as w", "4 as h")
    images = spark.range(3).selectExpr("id as image_id", "100 as w", "200 as h")
    texts = [sorted(map(tuple, annotations.write_yolo_labels(boxes, images, part_size=6, hot=hot).collect())) for hot in (True, False, None)]
    assert texts[0] == texts[1] == texts[2] and len(texts[0]) == 9


def test_mask_lists_are_the_same_however_large_groups_are_told(spark):
    from tilewright.operators import datasets as ds

    masks = spark.range(40).selectExpr("id % 3 as image_id", "id as ann_id", "concat('m', id) as mask_name")
    lists = [sorted(map(tuple, ds.masks_per_image(masks, part_size=6, hot=hot).collect())) for hot in (True, False, None)]
    assert lists[0] == lists[1] == lists[2] and len(lists[0]) == 9
    assert lists[0][0] == (0, 0, ["m0", "m3", "m6", "m9", "m12", "m15"])


def test_a_micro_batch_of_several_files(spark, monkeypatch):
    import __spark_entry__ as entry
    import check_oracle
    from tilewright.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    found = entry.queries()["stream_segments"](spark, "/root/testdata/sf0.001")
    cur = check_oracle.connect("/root/testdata/sf0.001").execute(entry.oracle_sql()["stream_segments"])
    assert check_oracle.compare(found.columns, found.collect(), [d[0] for d in cur.description], cur.fetchall()) is None

"""Queries that write files of given names and read them back through the listing, picture, log and metadata readers."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilewright.plans.pixels import BGR
from tilewright.plans.registry import query
from tilewright.session import cut_lineage, shared_dir
from tilewright.sources import annotations as ann
from tilewright.sources import files
from tilewright.sources.named_files import remove_folders, write_named_files, write_one_file

TREE = 4_000_000  # files that lie there at once to be listed: each takes an inode and a block of the file system
SHARDS = 64  # folders below which they are dealt, since tasks that fill one folder wait for each other


def below(directory: str, path: str = "path"):
    """The part of a listed path behind a directory."""
    return F.regexp_extract(path, rf"/{directory.rstrip('/').rpartition('/')[2]}/(.*)$", 1)


@query(
    "list_files",
    """select cast(p_partkey as varchar) as stem, max(p) as path, arg_max(sf, p) as suffix, arg_max(d, p) as parent from (select p_partkey, d, sf, concat('set/', d, '/', p_partkey, sf) as p from part,
    (values ('a','.jpg'),('b','.PNG'),('c','.txt')) k(d, sf) where not (p_partkey%3=0 and d='b')) q where lower(sf)<>'.txt' group by p_partkey""",
)
def list_files(v):
    """Trees of at most about TREE files, one after the other, each in SHARDS folders; those listed are removed before the next is written."""
    i, h = F.col("p_partkey"), F.xxhash64("path")
    paths = F.array(F.concat(F.lit("set/a/"), i, F.lit(".jpg")), F.when(i % 3 != 0, F.concat(F.lit("set/b/"), i, F.lit(".PNG"))), F.concat(F.lit("set/c/"), i, F.lit(".txt")))
    named = v.table("part").select(F.explode(paths).alias("path"), F.col("p_name").alias("content")).filter("path is not null")
    trees, found = max(1, math.ceil(named.count() / TREE)), None
    for tree in range(trees):
        folder, shard = shared_dir(v.spark, "listing"), F.pmod(h, F.lit(SHARDS))
        rows = named.filter(F.pmod(F.shiftright(h, 32), F.lit(trees)) == tree)
        write_named_files(rows.withColumn("path", F.concat_ws("/", shard.cast("string"), "path")), folder)
        listed = files.list_paths(v.spark, folder).select(F.regexp_extract(below(folder), "^[0-9]+/(.*)$", 1).alias("path"))
        if tree < trees - 1:
            listed = cut_lineage(listed)
            remove_folders(v.spark, [f"{folder}/{k}" for k in range(SHARDS)])
        found = listed if found is None else found.unionByName(listed)
    return files.filter_suffixes(found, ["jpg", "png"])


def png(batches):
    """(path, content) of a lossless picture from (path, w, h, rgb)."""
    for batch in batches:
        out = []
        for w, h, rgb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            lines = np.zeros((h, 1 + 3 * w), np.uint8)  # each line has a filter byte, 0, before it
            lines[:, 1:] = rgb.values.cast(pa.uint8()).to_numpy().reshape(h, 3 * w)
            parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
            out.append(b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])


@query("read_images", f"select image_id, 8 as w, 8 as h, 3 as channels, cast(image_id%5 as varchar) as parent, y, x, b, g, r from {BGR} p")
def read_images(v):
    folder = shared_dir(v.spark, "pictures")
    level = lambda e: F.floor((e.cast("double") + 1) * 127.5)
    # the pixels of `bgr`, made where the row lies
    rgb = lambda c, i: F.array((c * 3 + (i % 8) * 11) % 256, (c * 7) % 256, c)
    flat = F.flatten(F.transform(F.transform("embedding", level), rgb))
    name = F.concat_ws("/", (F.col("vec_id") % 5).cast("string"), F.concat(F.col("vec_id"), F.lit(".png")))
    images = v.table("embeddings").filter(F.size("embedding") > 0)
    rows = images.select(name.alias("path"), F.lit(8).alias("w"), F.lit(8).alias("h"), flat.alias("rgb"))
    write_named_files(rows.mapInArrow(png, "path string, content binary"), folder)
    parent = F.regexp_extract(below(folder), "^([^/]*)/", 1).alias("parent")
    found = files.read_images(v.spark, folder).withColumn("parent", parent)
    pixels = files.explode_pixels(found, keep=["w", "h", "channels", "parent"])
    return pixels.select(F.col("image_id").cast("bigint").alias("image_id"), "w", "h", "channels", "parent", "y", "x", *[F.col(c).cast("bigint").alias(c) for c in "bgr"])


@query("metadata_files", "select image_id, event_id, epoch_us(captured_at) as captured_us, round(lon,6) as lon, round(lat,6) as lat, image_id as stem from v_points")
def metadata_files(v):
    folder = shared_dir(v.spark, "metadata")
    files.write_metadata_files(v.points, folder)
    schema = v.points.schema
    raw = v.spark.read.schema(schema).json(folder, recursiveFileLookup=True).select("*", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem"))
    return raw.select("image_id", "event_id", F.unix_micros(F.col("captured_at").cast("timestamp")).alias("captured_us"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "stem")


def items(rows, item):
    """Text of array elements, each with a comma behind it; a null, which readers pass over, closes the array."""
    return rows.select(F.concat(F.to_json(item), F.lit(",\n")).alias("content"))


@query("coco_file", "select b.image_id, ann_id, category_id, b.x*1e0 as x, b.y*1e0 as y, b.w*1e0 as w, b.h*1e0 as h, i.w as width, i.h as height from v_boxes b join v_images i on b.image_id=i.image_id")
def coco_file(v):
    """The whole set as one document, read by many tasks."""
    folder, box = shared_dir(v.spark, "coco-file"), F.array(*[F.col(c).cast("double") for c in "xywh"])
    image = F.struct(F.col("image_id").alias("id"), F.col("w").alias("width"), F.col("h").alias("height"))
    annotation = F.struct(F.col("ann_id").alias("id"), "image_id", "category_id", box.alias("bbox"))
    write_one_file(f"{folder}/set.json", ['{"images": [', items(v.images, image), 'null], "annotations": [', items(v.boxes, annotation), 'null], "categories": []}'])
    images, annotations, _ = ann.read_coco(v.spark, f"{folder}/set.json")
    sizes = images.select(F.col("id").alias("image_id"), "width", "height")
    return annotations.withColumnRenamed("id", "ann_id").select("image_id", "ann_id", "category_id", "x", "y", "w", "h").join(sizes, "image_id")


@query("export_file", "select task_id, ord, from_name, value, completed_by from v_regions")
def export_file(v):
    """All tasks as one array in one file, read by many tasks."""
    folder = shared_dir(v.spark, "export-file")
    region = F.struct("from_name", "value", F.col("ord").cast("string").alias("id"))
    parts = ann.collect_parts(v.regions, ["task_id", "completed_by"], ["ord"], region, chunk=F.floor(F.col("ord") / 10_000), hot=v.hot_boxes)
    task = F.struct(F.col("task_id").alias("id"), F.array(F.struct("completed_by", F.col("items").alias("result"))).alias("annotations"))
    write_one_file(f"{folder}/tasks.json", ["[", items(parts, task), "null]"])
    found = ann.read_label_export(v.spark, f"{folder}/tasks.json")
    return found.select("task_id", F.col("region_id").cast("bigint").alias("ord"), "from_name", "value", "completed_by")

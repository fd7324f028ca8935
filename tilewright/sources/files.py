"""File listings, image decoding, split folders."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tilewright.session import cut_lineage, parallelism, ship_package
from tilewright.sources.named_files import write_named_files

# fixed values: picture suffixes accepted by listings
IMAGE_SUFFIXES = ["jpg", "jpeg", "png"]
PIXELS = 1 << 16  # pixel rows that leave a task at once
LISTED = 10_000  # paths that leave a task at once
READERS = 8  # tasks for a shuffle partition, at most, that read a folder of pictures


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add stem, suffix and parent folder name of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        df.withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))
        .withColumn("suffix", F.regexp_extract(name, r"(\.[^.]*)$", 1))
        .withColumn("parent", F.try_element_at(F.split(path, "/"), F.lit(-2)))
    )


def filter_suffixes(files: DataFrame, exts: Sequence[str]) -> DataFrame:
    """Suffix whitelist in either case; the greatest path wins among equal stems."""
    wanted = [f".{e.lower().lstrip('.')}" for e in exts]
    kept = path_parts(files).filter(F.lower("suffix").isin(wanted))
    return kept.groupBy("stem").agg(
        F.max("path").alias("path"), F.max_by("suffix", "path").alias("suffix"), F.max_by("parent", "path").alias("parent")
    )


def _children(folder: str):
    """(path, whether it is a folder) of what lies in a folder, without the hidden names that Spark's readers pass over; a file is itself."""
    local = folder[5:] if folder.startswith("file:") else folder
    if not os.path.isdir(local):
        os.stat(local)
        yield folder, False
        return
    with os.scandir(local) as entries:
        for e in entries:
            if not (e.name.startswith(".") or (e.name.startswith("_") and "=" not in e.name) or e.name.endswith("._COPYING_")):
                yield f"{folder.rstrip('/')}/{e.name}", e.is_dir()


def list_paths(spark: SparkSession, directory: str) -> DataFrame:
    """`path` of every file below a directory.

    A level of folders is listed by tasks at a time, a folder as a stream in its task, so the
    driver holds no path. Stores that are no mounted file system are listed by Spark.
    """
    plain = re.sub("^file:/+", "/", directory)
    if not plain.startswith("/"):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path")

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                children = _children(folder)
                while part := list(itertools.islice(children, LISTED)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([d for _, d in part], pa.bool_())], ["path", "folder"])

    ship_package(spark)
    folders, files = spark.createDataFrame([(f"file:{plain}",)], "path string"), None
    while True:
        found = cut_lineage(folders.mapInArrow(run, "path string, folder boolean"))
        level = found.filter("not folder").select("path")
        files = level if files is None else files.unionByName(level)
        folders = found.filter("folder").select("path")
        if folders.isEmpty():
            return files
        folders = folders.repartition("path")


def file_inventory(spark: SparkSession, directory: str, exts: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Recursive listing; contents are never read."""
    return filter_suffixes(list_paths(spark, directory), exts)


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    """Path, stem, size, channel count and BGR bytes of each picture.

    Spark counts each file as `spark.sql.files.openCostInBytes` (4 MB), so a task would read a
    few small pictures only; a task reads many of these shares here, one after the other.
    """
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(directory)
    flat = raw.coalesce(READERS * parallelism(spark)).select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("w"), F.col("image.height").alias("h"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    return path_parts(flat).drop("suffix", "parent")


def explode_pixels(images: DataFrame, id_col: str = "stem", names: Sequence[str] = ("b", "g", "r"), keep: Sequence[str] = ()) -> DataFrame:
    """One row per pixel with its channel values (w, h, channels, data as `read_images` gives them) and the picture's columns `keep`.

    The pixels of a batch of pictures are numbered through and leave the task in slices of
    PIXELS rows; a channel that the picture does not have, and bytes that are missing at its
    end, are null.
    """
    kept = [images.schema[k] for k in keep]
    kind = images.schema[id_col].dataType
    schema = StructType([StructField("image_id", kind), StructField("y", LongType()), StructField("x", LongType()), *[StructField(n, IntegerType()) for n in names], *kept])

    def run(batches):
        for batch in batches:
            w, h, channels = (batch.column(c).fill_null(0).to_numpy() for c in range(1, 4))
            data = batch.column(4).cast(pa.large_binary())  # the bytes lie one behind the other in one buffer
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
            flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)
            size = np.where(data.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            pixels = np.maximum(w, 0) * np.maximum(h, 0)
            last = np.cumsum(pixels)
            for lo in range(0, int(pixels.sum()), PIXELS):
                number = np.arange(lo, min(int(last[-1]), lo + PIXELS))
                at = np.searchsorted(last, number, "right")
                pos = number - (last - pixels)[at]
                values = []
                for i in range(len(names)):
                    place = pos * channels[at] + i
                    known = (place < size[at]) & (i < channels[at])
                    value = np.zeros(len(at), np.int32)
                    value[known] = flat[(ends[at] + place)[known]]
                    values.append(pa.array(value, mask=~known))
                picture = pa.array(at)
                columns = [batch.column(0).take(picture), pa.array(pos // w[at]), pa.array(pos % w[at]), *values, *[batch.column(5 + k).take(picture) for k in range(len(keep))]]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "y", "x", *names, *keep])

    sizes = [F.col(c).cast("bigint").alias(f"_{c}") for c in ("w", "h", "channels")]
    return images.select(F.col(id_col), *sizes, F.col("data").alias("_data"), *keep).mapInArrow(run, schema)


def write_split_dataset(rows: DataFrame, directory: str, dry_run: bool = False) -> DataFrame:
    """Write kind=images|labels / split=... folders; the returned plan says what goes where."""
    plan = rows.select("kind", "split", "stem", "path").withColumn(
        "target", F.concat_ws("/", "kind", "split", F.element_at(F.split("path", "/"), -1))
    )
    if not dry_run:
        rows.write.mode("errorifexists").partitionBy("kind", "split").parquet(directory)
    return plan


def write_metadata_json(images: DataFrame) -> DataFrame:
    """One JSON text per image, all columns but the key inside."""
    return images.select("image_id", F.to_json(F.struct(*images.columns)).alias("json"))


def write_metadata_files(images: DataFrame, directory: str) -> None:
    """One file `image_id`.json per image with all its columns; times keep their microseconds."""
    text = F.to_json(F.struct(*images.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    write_named_files(images.select(F.concat(F.col("image_id").cast("string"), F.lit(".json")).alias("path"), text.alias("content")), directory)

"""Sinks that put out files of given names: one row (or one key's rows, in order) is one file, or all rows are one large file."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "named_files"
_REGISTERED: set[str] = set()


def _source():
    """The data source; defined here so that it is shipped with its code and needs no package on the workers."""
    import uuid

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    class Writer(DataSourceArrowWriter):
        def __init__(self, directory):
            self.directory = directory

        def write(self, iterator):
            from pyarrow import fs

            at = self.directory[5:] if self.directory.startswith("file:/") and not self.directory.startswith("file://") else self.directory
            store, root = fs.FileSystem.from_uri(at)
            path = stream = hidden = made = None

            def put():
                stream.close()
                store.move(hidden, f"{root}/{path}")

            try:
                for batch in iterator:
                    names, parts = batch.column(0), batch.column(1)
                    for name, part in zip(names.to_pylist(), parts):
                        if name != path:
                            if stream is not None:
                                put()
                                stream = None
                            folder, _, last = f"{root}/{name}".rpartition("/")
                            if folder != made:
                                store.create_dir(folder, recursive=True)
                                made = folder
                            path, hidden = name, f"{folder}/.{last}.{uuid.uuid4().hex}"
                            stream = store.open_output_stream(hidden)
                        if part.is_valid:
                            stream.write(part.as_buffer())
                if stream is not None:
                    put()
                    stream = None
            finally:
                if stream is not None:
                    stream.close()
                    store.delete_file(hidden)
            return WriterCommitMessage()

    class NamedFiles(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def schema(self):
            return "path string, content binary"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    return NamedFiles


def write_named_files(files: DataFrame, directory: str, part: str | None = None) -> None:
    """Write `content` (text or bytes) of each row to `directory`/`path`.

    Rows of one path are one file, in order of `part`; they stream through one task, a batch
    at a time. A file is written under a hidden name and moved into place when it is whole,
    so a task that is run again leaves the same files. A folder takes one new name at a time, so
    each task goes through the folders in an order of its own. Null content is empty. Names must
    be relative and stay below the directory.
    """
    spark: SparkSession = files.sparkSession
    if spark.sparkContext.applicationId not in _REGISTERED:
        spark.dataSource.register(_source())
        _REGISTERED.add(spark.sparkContext.applicationId)
    bad = F.col("path").isNull() | F.col("path").rlike(r"^/|^$|/$|(^|/)\.\.?(/|$)")
    named = files.withColumn("path", F.when(bad, F.raise_error(F.concat(F.lit("not a name of a file below the folder: "), F.coalesce("path", F.lit("null"))))).otherwise(F.col("path")))
    order = ["_turn", "path"] if part is None else ["_turn", "path", part]
    turn = F.xxhash64(F.regexp_extract("path", "^(.*)/", 1), F.spark_partition_id())
    dealt = named.repartition("path").withColumn("_turn", turn).sortWithinPartitions(*order).select("path", F.col("content").cast("binary").alias("content"))
    dealt.write.format(FORMAT).mode("append").save(directory)


def remove_folders(spark: SparkSession, folders: Sequence[str]) -> None:
    """Remove folders with all that lies in them, each by a task; a folder that is gone is passed over."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_dir(path)
            yield batch

    spark.createDataFrame([(f,) for f in folders], "path string").repartition(len(folders)).mapInArrow(run, "path string").count()


def write_one_file(file: str, pieces: Sequence[str | DataFrame]) -> None:
    """Write texts and frames (`content`), one after the other, as one file of any size; a frame's rows in its own order.

    Tasks put out what they hold as parts; only a part's name and size reach the driver, and
    tasks copy each part to its place in the file, which is moved into place when it is whole.
    So no task sees more than its own rows. A store that is no mounted file system takes a
    file from one writer only: there the rows stream through one task.
    """
    frames = [p for p in pieces if isinstance(p, DataFrame)]
    spark, local = frames[0].sparkSession, re.sub("^file:/+", "/", file)
    if not local.startswith("/"):
        rows = [spark.createDataFrame([(p,)], "content string") if isinstance(p, str) else p.select(F.col("content").cast("string").alias("content")) for p in pieces]
        placed = [r.select(F.struct(F.lit(i).alias("piece"), F.monotonically_increasing_id().alias("row")).alias("part"), "content") for i, r in enumerate(rows)]
        whole = placed[0]
        for r in placed[1:]:
            whole = whole.unionByName(r)
        folder, _, name = file.rpartition("/")
        write_named_files(whole.withColumn("path", F.lit(name)), folder, "part")
        return
    folder, _, name = local.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"

    def put(batches):
        from pyspark import TaskContext

        os.makedirs(hidden, exist_ok=True)
        part, size = f"{hidden}/{uuid.uuid4().hex}", 0
        with open(part, "wb") as out:
            for batch in batches:
                text = batch.column(0).cast(pa.large_binary())  # the rows lie one behind the other in one buffer
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                if len(text) and ends[-1] > ends[0]:
                    size += out.write(text.buffers()[2][int(ends[0]) : int(ends[-1])])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([part]), pa.array([size], pa.int64())], ["task", "part", "size"])

    def copy(batches):
        for batch in batches:
            for part, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(part, "rb") as source, os.fdopen(os.open(f"{hidden}/whole", os.O_WRONLY | os.O_CREAT, 0o666), "wb") as out:
                    out.seek(place)
                    shutil.copyfileobj(source, out, 1 << 22)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["part"])

    os.makedirs(hidden)
    try:
        parts, place = [], 0
        for i, piece in enumerate(pieces):
            if isinstance(piece, str):
                found = [(f"{hidden}/text-{i}", len(piece.encode()))]
                with open(found[0][0], "wb") as out:
                    out.write(piece.encode())
            else:
                content = F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")
                rows = piece.select(content).mapInArrow(put, "task bigint, part string, size bigint").collect()
                found = [(r["part"], r["size"]) for r in sorted(rows, key=lambda r: r["task"])]
            for part, size in found:
                parts.append((part, place))
                place += size
        open(f"{hidden}/whole", "wb").close()
        if parts:
            spark.createDataFrame(parts, "part string, place bigint").repartition(len(parts)).mapInArrow(copy, "part string").count()
        os.replace(f"{hidden}/whole", local)
    finally:
        shutil.rmtree(hidden)

"""Sensor tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.ordered import number_rows


def read_timeseries(spark: SparkSession, path: str, channels: Sequence[str], time_col: str | None = None, extra: str = "") -> DataFrame:
    """(seq_id, t, channels...) with one sequence per CSV file.

    Without a time column, t is the row's place in its file, from 1, as the sequence operators count. Rows of a file are
    numbered block by block, so one large file is not read by one task.
    """
    sample = spark.read.csv(path, header=True, recursiveFileLookup=True)
    raw = sample.select("*", "_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start")
    seq = F.regexp_replace("file_name", r"\.[^.]*$", "").alias("seq_id")
    values = [F.col(c).cast("double").alias(c) for c in channels]
    if time_col is not None:
        return raw.select(seq, F.col(time_col).cast("bigint").alias("t"), *values)
    placed = raw.select(seq, "file_path", F.col("file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), *values)
    numbered = number_rows(placed, ["file_path"], ["_block", "_at"], "_rn", chunk=F.col("_block"))
    return numbered.select("seq_id", F.col("_rn").alias("t"), *channels)

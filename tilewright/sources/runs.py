"""Run folders: histories, logs, cached outputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.runs import clock_seconds, parse_log_lines


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch rows of every run folder below `path`; `run_dir` is the folder of the file."""
    schema = "epoch bigint, train_loss double, valid_loss double, time string"
    raw = spark.read.csv(path, header=True, schema=schema, recursiveFileLookup=True, pathGlobFilter="*.csv")
    folder = F.try_element_at(F.split("_metadata.file_path", "/"), F.lit(-2))
    return raw.select(folder.alias("run_dir"), "epoch", "train_loss", "valid_loss", clock_seconds(F.trim("time")).alias("seconds"))


def parse_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Start, epoch and outcome rows of all log files; lines keep their file order."""
    text = spark.read.text(path, recursiveFileLookup=True)
    lines = text.select(
        F.col("_metadata.file_name").alias("run"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")
    )
    return parse_log_lines(lines, order=["block", "pos"], chunk=F.col("block"))


def cache_key(name: str, args: dict, key_args: Sequence[str]) -> str:
    """First 16 hex digits of the sha256 of the chosen arguments as sorted JSON."""
    chosen = {k: str(args[k]) for k in key_args if k in args}
    return f"{name}_{hashlib.sha256(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:16]}"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _filesystem(spark, path)
    return bool(fs.exists(hadoop))


def materialize(
    spark: SparkSession, root: str, name: str, args: dict, key_args: Sequence[str], build: Callable[..., DataFrame], wanted: Sequence[str] | None = None
) -> DataFrame:
    """Build once per key and read from then on.

    `_SUCCESS` is the commit mark: an output without it is a broken build and is made
    again. A failing build leaves nothing. Arguments outside `key_args` do not change the
    key; all arguments go to `build` by name. `wanted` keeps rows with these suffixes.
    """
    if not isinstance(args, dict):
        raise TypeError("arguments must be given by name")
    path = f"{root.rstrip('/')}/{cache_key(name, args, key_args)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        fs, hadoop = _filesystem(spark, path)
        if fs.exists(hadoop):
            fs.delete(hadoop, True)
        try:
            build(**args).write.mode("errorifexists").parquet(path)
        except Exception:
            if fs.exists(hadoop):
                fs.delete(hadoop, True)
            raise
    out = spark.read.parquet(path)
    return out if wanted is None else out.filter(F.col("suffix").isin(list(wanted)))

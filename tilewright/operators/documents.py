"""Outputs that are single documents: manifests, reports, wide upload rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geo import tile_bounds
from tilewright.functions.text import coerce_text
from tilewright.operators.datasets import annotator_emails
from tilewright.operators.ordered import collect_parts
from tilewright.session import shared_dir


def dataset_manifest(classes: DataFrame, directory: str, part_size: int = 10_000) -> DataFrame:
    """Manifest JSON: path, split folders, class count, names in order.

    One row unless there are more than `part_size` classes; then the names go on in further parts.
    """
    named = classes.select("ord", "name")
    parts = collect_parts(named, [], ["ord", "name"], F.col("name"), part_size)
    body = F.struct(
        F.lit(directory).alias("path"),
        F.lit("images/train").alias("train"),
        F.lit("images/val").alias("val"),
        F.lit("images/test").alias("test"),
        named.agg(F.count("*").alias("n")).scalar().alias("nc"),
        F.col("items").alias("names"),
    )
    return parts.select("part", F.to_json(body).alias("manifest"))


def tiles_report(tiles: DataFrame, city: str, bbox: Sequence[float], zoom: int, part_size: int = 10_000) -> DataFrame:
    """JSON report of a city's tiles with bounds, in parts of bounded length."""
    b = tile_bounds("z", "x", "y")
    entry = F.struct(F.col("z"), F.col("x"), F.col("y"), b.alias("bounds"))
    parts = collect_parts(tiles, [], ["x", "y", "z"], entry, part_size)
    body = F.struct(
        F.lit(city).alias("city"), F.array(*[F.lit(float(v)) for v in bbox]).alias("bbox"), F.lit(zoom).alias("zoom"), F.col("items").alias("tiles")
    )
    return parts.select("part", F.size("items").alias("tiles"), F.to_json(body).alias("report"))


def flatten_annotations(
    tasks: DataFrame, regions: DataFrame, users: DataFrame, names: Sequence[str] | None = None, infer_types: bool = True
) -> DataFrame:
    """One wide row per task: ID, emails and one column per control, columns sorted after ID.

    The last value of a control wins. Text loses outer quotes; a column whose values are
    all whole numbers within bigint is bigint, any other varchar.
    """
    # the regions are read once: names, kinds and columns come from one row a task with its few controls
    last = regions.filter("from_name is not null").groupBy("task_id", "from_name").agg(F.max_by("value", "ord").alias("value"))
    table = shared_dir(tasks.sparkSession, "controls")
    last.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("from_name", "value"))).alias("_controls")).write.parquet(table)
    controls = tasks.sparkSession.read.schema("task_id " + regions.schema["task_id"].dataType.simpleString() + ", _controls map<string,string>").parquet(table)
    if names is None:  # the set of controls is the label configuration, a handful of names
        names = [r[0] for r in controls.select(F.explode(F.map_keys("_controls")).alias("n")).distinct().orderBy("n").collect()]
    values = controls.select("task_id", *[F.col("_controls")[n].alias(n) for n in names])
    who = annotator_emails(tasks.select("task_id", "completed_by", "updated_by"), users)
    wide = who.join(values, "task_id", "left").withColumnRenamed("task_id", "ID")
    wide = wide.select(*[coerce_text(c).alias(c) if c in names else F.col(c) for c in wide.columns])
    if infer_types:
        known = tasks.select("task_id").join(values, "task_id").select(*[coerce_text(n).alias(n) for n in names])
        whole = known.agg(*[F.bool_and(F.col(n).isNull() | (F.col(n).rlike("^[0-9]+$") & F.col(n).try_cast("bigint").isNotNull())).alias(n) for n in names]).first()
        for n in names:
            if whole is not None and whole[n]:
                wide = wide.withColumn(n, F.col(n).cast("bigint"))
    return wide.select("ID", *sorted(c for c in wide.columns if c != "ID"))

"""State tables on parquet: fixed schemas, defaults, versioned rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "tiles": "z int, x bigint, y bigint, status string, started_at timestamp, completed_at timestamp, image_count bigint, error_message string",
    "images": "image_id string, tile_z int, tile_x bigint, tile_y bigint, captured_at bigint, lat double, lon double",
    "download_requests": "image_id string, status string, thumb_url string, downloaded_at timestamp, local_path string, error_message string",
    "metadata": "key string, value string",
}
DEFAULTS = {"tiles": {"status": "pending", "image_count": 0}, "download_requests": {"status": "pending"}}


def with_state_defaults(df: DataFrame, table: str) -> DataFrame:
    for column, default in DEFAULTS.get(table, {}).items():
        if column in df.columns:
            df = df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))
    if table == "images" and "captured_at" in df.columns:
        df = df.withColumn("captured_at", F.timestamp_millis("captured_at"))
    return df


def read_state(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The four tables of a state folder."""
    return {
        name: with_state_defaults(spark.read.schema(schema).parquet(f"{directory}/{name}"), name)
        for name, schema in SCHEMAS.items()
    }


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], T.StructType.fromDDL(schema)) for name, schema in SCHEMAS.items()}


def write_state(tables: dict[str, DataFrame], directory: str) -> None:
    """Write each table, state tables by status so that status filters prune partitions."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if "status" in df.columns:
            writer = writer.partitionBy("status")
        writer.parquet(f"{directory}/{name}")

"""Keyed tables kept by streaming jobs, in parquet buckets with versions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BUCKETS = 64


class BucketedTable:
    """A keyed table whose micro-batches rewrite only the buckets that their keys fall into.

    Rows are dealt by a hash of the key. Version n + 1 is made from version n by batch n and
    holds the touched buckets; a bucket's content is in the newest version that holds it. A
    batch that runs again reads the same versions and overwrites the same output, so a
    restart cannot apply it twice. A version counts once its _SUCCESS mark is there; bucket
    folders that two newer versions have replaced are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.schema = None

    def _names(self, path: str, pattern: str) -> list[int]:
        folder = self.hadoop.Path(path)
        if not self.fs.exists(folder):
            return []
        found = (re.fullmatch(pattern, s.getPath().getName()) for s in self.fs.listStatus(folder))
        return sorted(int(m.group(1)) for m in found if m)

    def _places(self, upto: int | None = None) -> dict[int, list[int]]:
        """Versions that hold each bucket, in order."""
        out: dict[int, list[int]] = {}
        for n in self._names(self.path, r"v=(\d+)"):
            if (upto is None or n <= upto) and self.fs.exists(self.hadoop.Path(f"{self.path}/v={n}/_SUCCESS")):
                for b in self._names(f"{self.path}/v={n}", r"bucket=(\d+)"):
                    out.setdefault(b, []).append(n)
        return out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def read(self, upto: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        places = self._places(upto)
        paths = [f"{self.path}/v={v[-1]}/bucket={b}" for b, v in places.items() if only is None or b in only]
        if not places:
            return None
        if self.schema is None:
            self.schema = self.spark.read.parquet(*[f"{self.path}/v={v[0]}/bucket={b}" for b, v in places.items()][:1]).schema
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, touched: Sequence[int] | None = None) -> None:
        """`df` is the whole new content of the touched buckets (of all, if not told)."""
        self.schema = df.schema
        target = f"{self.path}/v={version}"
        df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        for b in range(self.buckets) if touched is None else touched:  # also those that are empty now
            self.fs.mkdirs(self.hadoop.Path(f"{target}/bucket={b}"))
        for b, versions in self._places().items():
            for old in [v for v in versions if v < version][:-1]:
                self.fs.delete(self.hadoop.Path(f"{self.path}/v={old}/bucket={b}"), True)


class BatchOutput:
    """Append-only output of a foreachBatch job, one folder per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch")

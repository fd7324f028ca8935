"""Tile, image and download-request state tables: keyed inserts, updates, counts, samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.hashing import digest
from tilewright.operators.ordered import number_rows, shuffle_rank, top_per_group

# fixed values: allowed status changes of the two state tables
TILE_CHANGES = {"pending": ["in_progress"], "in_progress": ["completed", "failed", "pending"]}
REQUEST_CHANGES = {"pending": ["downloading"], "downloading": ["downloaded", "failed", "pending"]}
SMALL_LIMIT = 10_000


def pending_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.filter(F.col("status").isin("pending", "in_progress"))


def pending_downloads(requests: DataFrame, n: int) -> DataFrame:
    return first_n(requests.filter(F.col("status") == "pending"), ["image_id"], n)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Ordered limit; a large n is cut by distributed row number instead of one task."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    return number_rows(df, [], list(order), "_rn").filter(F.col("_rn") <= n).drop("_rn")


def dedupe_first(df: DataFrame, key: str, order: Sequence) -> DataFrame:
    """First row per id, ids compared as text."""
    keyed = df.withColumn(key, F.col(key).cast("string"))
    return top_per_group(keyed, [key], order, 1)


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write per key; `order` sorts newest first."""
    return top_per_group(log, keys, order, 1)


def union_discovered(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence | None = None) -> DataFrame:
    """Add rows with unknown keys; known rows stay as they are."""
    fresh = top_per_group(new, keys, order or [F.col(k) for k in keys], 1)
    return base.unionByName(fresh.join(base.select(*keys), list(keys), "left_anti"))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence | None = None) -> DataFrame:
    """Replace by key: the new row wins over the stored one."""
    fresh = top_per_group(new, keys, order or [F.col(k) for k in keys], 1)
    return base.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def update_status(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], allowed: dict[str, list[str]] | None = None
) -> DataFrame:
    """Set status and any stamp columns of `changes` (one row per key) on matching rows.

    With `allowed`, a change the state machine does not know leaves the row as it is.
    """
    stamps = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in stamps])
    ok = F.coalesce(F.col("_hit"), F.lit(False))
    if allowed is not None:
        steps = F.lit(False)
        for old, targets in allowed.items():
            steps = steps | ((F.col("status") == old) & F.col("_n_status").isin(*targets))
        ok = ok & steps
    joined = base.join(new, list(keys), "left").withColumn("_ok", ok)
    out = [
        F.when(F.col("_ok"), F.coalesce(F.col(f"_n_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in stamps else F.col(c)
        for c in base.columns
    ]
    return joined.select(*out)


def reset_in_progress(tiles: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crash recovery: work in flight goes back to pending."""

    def back(df: DataFrame, flying: str) -> DataFrame:
        return df.withColumn("status", F.when(F.col("status") == flying, "pending").otherwise(F.col("status")))

    return back(tiles, "in_progress"), back(requests, "downloading")


def unrequested_images(images: DataFrame, requests: DataFrame) -> DataFrame:
    return images.join(requests.select("image_id"), "image_id", "left_anti")


def orphan_requests(requests: DataFrame, images: DataFrame) -> DataFrame:
    return requests.join(images.select("image_id"), "image_id", "left_anti")


def take_subset(df: DataFrame, n: int | None, seed: int, id_col: str = "image_id") -> DataFrame:
    """First n rows after a seeded shuffle; a negative or missing n keeps everything."""
    if n is None or n < 0:
        return df
    if n <= SMALL_LIMIT:
        return df.withColumn("_d", digest(seed, id_col)).orderBy("_d", id_col).limit(n).drop("_d")
    return shuffle_rank(df, id_col, seed, name="_rn").filter(F.col("_rn") <= n).drop("_rn")


def sample_unrequested(images: DataFrame, requests: DataFrame, n: int, seed: int) -> DataFrame:
    """n random images among those not requested yet; a second call adds different ones."""
    return take_subset(unrequested_images(images, requests), n, seed)


def request_images(requests: DataFrame, chosen: DataFrame) -> DataFrame:
    """Insert-ignore of pending requests for the chosen images."""
    new = chosen.select("image_id", F.lit("pending").alias("status"))
    return insert_ignore(requests.select("image_id", "status"), new, ["image_id"])


def selection_hook(
    images: DataFrame, requests: DataFrame, choose: Callable[[DataFrame, DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Requests after a user's choice of images; the default requests all of them."""
    return request_images(requests, images if choose is None else choose(images, requests))


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("status").agg(
        F.count("*").alias("tiles"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images")
    )


def download_stats(requests: DataFrame) -> DataFrame:
    """Rows per status, with a zero row for `downloaded` when there is none."""
    zero = requests.sparkSession.range(1).select(F.lit("downloaded").alias("status"))
    counted = requests.select("status", F.lit(1).alias("_n")).unionByName(zero.withColumn("_n", F.lit(0)))
    return counted.groupBy("status").agg(F.sum("_n").alias("requests"))


def totals(images: DataFrame, requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Discovered, requested, downloaded, effective total and what is left of it; one row."""
    a = images.select(F.lit(1).alias("d"), F.lit(0).alias("r"), F.lit(0).alias("g"))
    b = requests.select(F.lit(0).alias("d"), F.lit(1).alias("r"), (F.col("status") == "downloaded").cast("int").alias("g"))
    one = a.unionByName(b).agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("discovered"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("requested"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("downloaded"),
    )
    total = F.least(F.lit(limit), F.col("discovered")) if limit else F.col("discovered")
    return one.withColumn("effective_total", total.cast("bigint")).withColumn(
        "remaining", F.greatest(F.lit(0), F.col("effective_total") - F.col("downloaded"))
    )

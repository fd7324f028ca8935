"""Tile generators and point-to-tile assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geo import DEFAULT_ZOOM, EDGE_EPSILON, MAX_SEARCH_BOX, lonlat_to_tile, tile_bounds
from tilewright.operators.ordered import top_per_group


def _tile_range(bboxes: DataFrame, z: int) -> DataFrame:
    """Corner tiles of each box; a box across the date line becomes two."""
    wraps = F.col("min_lon") > F.col("max_lon")
    piece = lambda a, b: F.struct(a.cast("double").alias("w"), b.cast("double").alias("e"))
    pieces = F.when(wraps, F.array(piece(F.lit(-180), F.col("max_lon")), piece(F.col("min_lon"), F.lit(180)))).otherwise(
        F.array(piece(F.col("min_lon"), F.col("max_lon")))
    )
    cut = bboxes.withColumn("_p", F.explode(pieces))
    x1, y1 = lonlat_to_tile(F.col("_p.w"), F.col("max_lat"), z)
    x2, y2 = lonlat_to_tile(F.col("_p.e") - EDGE_EPSILON, F.col("min_lat") + EDGE_EPSILON, z)
    return cut.select(*bboxes.columns, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def tiles_for_bbox(bboxes: DataFrame, z: int = DEFAULT_ZOOM) -> DataFrame:
    """Every tile at zoom z that touches a box."""
    keep = [c for c in bboxes.columns if c not in ("min_lon", "min_lat", "max_lon", "max_lat")]
    return (
        _tile_range(bboxes, z)
        .withColumn("x", F.explode(F.sequence("x1", "x2")))
        .withColumn("y", F.explode(F.sequence("y1", "y2")))
        .select(*keep, F.lit(z).alias("z"), "x", "y")
    )


def tile_count(bboxes: DataFrame, z: int = DEFAULT_ZOOM) -> DataFrame:
    """Number of tiles of each box, without making them."""
    keep = [c for c in bboxes.columns if c not in ("min_lon", "min_lat", "max_lon", "max_lat")]
    n = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    return _tile_range(bboxes, z).groupBy(*keep).agg(F.sum(n).alias("tiles"))


def tiles_extent(tiles: DataFrame) -> DataFrame:
    b = tile_bounds("z", "x", "y")
    return tiles.agg(
        F.min(b["west"]).alias("west"), F.min(b["south"]).alias("south"), F.max(b["east"]).alias("east"), F.max(b["north"]).alias("north")
    )


def sub_boxes(tiles: DataFrame, max_size: float = MAX_SEARCH_BOX) -> DataFrame:
    """Search boxes of a tile in steps of 0.9 * max_size, the last ones cut at the edge."""
    step = max_size * 0.9
    b = tile_bounds("z", "x", "y")
    boxed = tiles.withColumn("_b", b)

    def starts(lo: str, hi: str):
        n = F.ceil((F.col(f"_b.{hi}") - F.col(f"_b.{lo}")) / step)
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    grid = boxed.withColumn("row", starts("south", "north")).withColumn("col", starts("west", "east"))
    lon, lat = F.col("_b.west") + F.col("col") * step, F.col("_b.south") + F.col("row") * step
    return grid.select(
        "z", "x", "y", "row", "col",
        F.round(lon, 9).alias("min_lon"),
        F.round(lat, 9).alias("min_lat"),
        F.round(F.least(lon + step, F.col("_b.east")), 9).alias("max_lon"),
        F.round(F.least(lat + step, F.col("_b.north")), 9).alias("max_lat"),
    )


def points_in_tiles(points: DataFrame, tiles: DataFrame, z: int, cap: int | None = None, id_col: str = "image_id") -> DataFrame:
    """Points joined to their tile by computed tile key; `cap` keeps the first rows per tile, as the search service does."""
    x, y = lonlat_to_tile("lon", "lat", z)
    found = points.withColumn("z", F.lit(z)).withColumn("x", x).withColumn("y", y)
    found = found.join(tiles.select("z", "x", "y"), ["z", "x", "y"], "left_semi")
    return found if cap is None else top_per_group(found, ["z", "x", "y"], [F.col(id_col)], cap)


def tile_image_counts(discovered: DataFrame, first_order) -> DataFrame:
    """Images per tile when the first tile keeps an image seen twice."""
    from tilewright.operators.state import dedupe_first

    kept = dedupe_first(discovered, "image_id", first_order)
    return kept.groupBy("z", "x", "y").agg(F.count("*").alias("image_count"))

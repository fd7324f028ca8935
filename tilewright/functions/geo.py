"""Web-Mercator tiles and geographic boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.hashing import as_col

# fixed values: latitude limit of the projection, inward shift of south and east edges
MAX_LATITUDE = 85.05112877980659
EDGE_EPSILON = 1e-11
DEFAULT_ZOOM = 14
MAX_SEARCH_BOX = 0.01


def lonlat_to_tile(lon, lat, z=DEFAULT_ZOOM) -> tuple[Column, Column]:
    """Tile x, y of a point at zoom z."""
    lon, lat, z = as_col(lon), as_col(lat), as_col(z)
    size = F.pow(F.lit(2.0), z)
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))))
    x = (lon + 180) / 360 * size
    y = (F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * size

    def cell(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size - 1, F.floor(v))).cast("bigint")

    return cell(x), cell(y)


def tile_bounds(z, x, y) -> Column:
    """struct(west, south, east, north) of a tile, to 9 decimals."""
    z, x, y = as_col(z), as_col(x), as_col(y)
    size = F.pow(F.lit(2.0), z)

    def lon(col: Column) -> Column:
        return F.round(col / size * 360 - 180, 9)

    def lat(row: Column) -> Column:
        return F.round(F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * row / size)))), 9)

    return F.struct(lon(x).alias("west"), lat(y + 1).alias("south"), lon(x + 1).alias("east"), lat(y).alias("north"))


def parse_place_bbox(box, lat, lon) -> Column:
    """[south, north, west, east] texts to a box; with fewer than four, the point +- 0.01 degrees."""
    box = as_col(box)
    part = [F.try_element_at(box, F.lit(i)).cast("double") for i in (1, 2, 3, 4)]
    lat, lon = as_col(lat).cast("double"), as_col(lon).cast("double")
    full = F.size(box) >= 4
    return F.struct(
        F.when(full, part[2]).otherwise(lon - 0.01).alias("min_lon"),
        F.when(full, part[0]).otherwise(lat - 0.01).alias("min_lat"),
        F.when(full, part[3]).otherwise(lon + 0.01).alias("max_lon"),
        F.when(full, part[1]).otherwise(lat + 0.01).alias("max_lat"),
    )


def parse_bbox_text(text) -> Column:
    """"a,b,c,d" to a box; null unless there are exactly four numbers."""
    parts = F.split(as_col(text), ",")
    nums = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    good = (F.size(nums) == 4) & F.forall(nums, lambda n: n.isNotNull())
    names = ["min_lon", "min_lat", "max_lon", "max_lat"]
    return F.when(good, F.struct(*[F.try_element_at(nums, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]))


def parse_geometry(coordinates) -> tuple[Column, Column]:
    """First two coordinates as lon, lat; null where the geometry is missing or short."""
    c = as_col(coordinates)
    return F.get(c, F.lit(0)), F.get(c, F.lit(1))

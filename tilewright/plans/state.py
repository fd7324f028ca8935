"""Queries of the tile, image and request state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions.hashing import hash_int
from tilewright.operators import state, tiles
from tilewright.plans.fixtures import sql_hash
from tilewright.plans.registry import query
from tilewright.session import shared_dir
from tilewright.sources.state_tables import empty_state, read_state as read_state_tables, write_state

XY = """cast(greatest(0,least(pow(2,{z})-1,floor(({lon}+180)/360*pow(2,{z})))) as bigint)""", """cast(greatest(0,least(pow(2,{z})-1,floor((0.5e0-ln((1+sin(radians(greatest(-85.05112877980659e0,least(85.05112877980659e0,{lat})))))/(1-sin(radians(greatest(-85.05112877980659e0,least(85.05112877980659e0,{lat}))))))/(4*pi()))*pow(2,{z})))) as bigint)"""


def xy_sql(z, lon="lon", lat="lat"):
    return XY[0].format(z=z, lon=lon), XY[1].format(z=z, lat=lat)


X8, Y8 = xy_sql(8)
X14, Y14 = xy_sql(14)
WEST = "round({x}/pow(2,{z})*360-180,9)"
LAT = "round(degrees(atan(sinh(pi()*(1-2*({y})/pow(2,{z}))))),9)"
BOUNDS_SQL = (
    f"{WEST.format(x='x', z='z')} as west, {LAT.format(y='y+1', z='z')} as south, "
    f"{WEST.format(x='(x+1)', z='z')} as east, {LAT.format(y='y', z='z')} as north"
)


@query(
    "images_per_tile_status",
    f"""with p as (select image_id, event_id, {X8} as x, {Y8} as y from v_points),
    d as (select * from (select *, row_number() over(partition by image_id order by event_id) rn from p) q where rn=1)
    select t.status, count(distinct (t.x, t.y)) as tiles, count(*) as images
    from d join v_tiles t on d.x=t.x and d.y=t.y group by t.status""",
)
def images_per_tile_status(v):
    first = state.dedupe_first(tiles.points_in_tiles(v.points, v.tiles, 8), "image_id", ["event_id"])
    per_tile = first.groupBy("x", "y").agg(F.count("*").alias("n"))
    return v.tiles.join(per_tile, ["x", "y"]).groupBy("status").agg(F.count("*").alias("tiles"), F.sum("n").alias("images"))


@query("read_state", "select z, x, y, coalesce(status,'pending') as status, coalesce(image_count,0) as image_count from (select z,x,y, nullif(status,'failed') as status, image_count from v_tiles) q")
def read_state(v):
    path = shared_dir(v.spark, "state")
    gaps = v.tiles.withColumn("status", F.nullif(F.col("status"), F.lit("failed")))
    write_state({**empty_state(v.spark), "tiles": gaps, "download_requests": v.requests}, path)
    return read_state_tables(v.spark, path)["tiles"].select("z", "x", "y", "status", "image_count")


@query("parse_geometry", "select image_id, case when event_id%5=0 then null else lon end as lon, case when event_id%5<2 then null else lat end as lat from v_points")
def parse_geometry(v):
    e = F.col("event_id") % 5
    coords = F.when(e == 0, F.lit(None)).when(e == 1, F.array("lon")).otherwise(F.array("lon", "lat"))
    lon, lat = geo.parse_geometry("coordinates")
    return v.points.withColumn("coordinates", coords).select("image_id", lon.alias("lon"), lat.alias("lat"))


@query(
    "parse_place_bbox",
    """select c_custkey as place_id,
    round(case when c_custkey%3=0 then lon-0.01e0 else lon-0.5e0 end,9) as min_lon, round(case when c_custkey%3=0 then lat-0.01e0 else lat-0.25e0 end,9) as min_lat,
    round(case when c_custkey%3=0 then lon+0.01e0 else lon+0.5e0 end,9) as max_lon, round(case when c_custkey%3=0 then lat+0.01e0 else lat+0.25e0 end,9) as max_lat
    from (select c_custkey, (c_custkey*37)%300-150 as lon, (c_custkey*11)%120-60 as lat from customer) c""",
)
def parse_place_bbox(v):
    k = F.col("c_custkey")
    c = v.table("customer").select(k, ((k * 37) % 300 - 150).alias("lon"), ((k * 11) % 120 - 60).alias("lat"))
    full = F.array(*[e.cast("string") for e in (F.col("lat") - 0.25, F.col("lat") + 0.25, F.col("lon") - 0.5, F.col("lon") + 0.5)])
    box = F.when(k % 3 == 0, F.slice(full, 1, 2)).otherwise(full)
    b = c.select(k.alias("place_id"), geo.parse_place_bbox(box, F.col("lat").cast("string"), F.col("lon").cast("string")).alias("b"))
    return b.select("place_id", *[F.round(f"b.{n}", 9).alias(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(
    "parse_bbox_text",
    "select o_orderkey as id, o_orderkey%90*1.0e0 as min_lon, 1.5e0 as min_lat, o_orderkey%90+2.0e0 as max_lon, 3.5e0 as max_lat from orders where o_orderkey%4 in (0,1)",
)
def parse_bbox_text(v):
    k = F.col("o_orderkey")
    lon = (k % 90).cast("string")
    text = (
        F.when(k % 4 == 2, F.concat(lon, F.lit(",1.5,2")))
        .when(k % 4 == 3, F.concat(lon, F.lit(",a,b,c")))
        .otherwise(F.concat(lon, F.lit(", 1.5, "), (k % 90 + 2).cast("string"), F.lit(",3.5")))
    )
    b = v.table("orders").select(k.alias("id"), geo.parse_bbox_text(text).alias("b"))
    return b.filter(F.col("b").isNotNull()).select("id", "b.*")


@query("pending_tiles", "select z,x,y,status from v_tiles where status in ('pending','in_progress')")
def pending_tiles(v):
    return state.pending_tiles(v.tiles).select("z", "x", "y", "status")


@query("pending_downloads", "select image_id, status from v_requests where status='pending' order by image_id limit 50")
def pending_downloads(v):
    return state.pending_downloads(v.requests, 50)


@query("unrequested_images", "select image_id from v_points where image_id not in (select image_id from v_requests)")
def unrequested_images(v):
    return state.unrequested_images(v.points, v.requests).select("image_id")


@query("orphan_requests", "select image_id, status from v_requests where image_id not in (select image_id from v_points where event_id%4<>0)")
def orphan_requests(v):
    return state.orphan_requests(v.requests, v.points.filter(F.col("event_id") % 4 != 0))


@query("points_in_tiles", f"select p.z, p.x, p.y, image_id from (select 8 as z, {X8} as x, {Y8} as y, image_id from v_points) p join (select x,y from v_tiles where status='pending') t on p.x=t.x and p.y=t.y")
def points_in_tiles(v):
    wanted = v.tiles.filter(F.col("status") == "pending")
    return tiles.points_in_tiles(v.points, wanted, 8).select("z", "x", "y", "image_id")


@query(
    "points_in_tiles_capped",
    f"""select z, x, y, image_id from (select 8 as z, p.x, p.y, image_id, row_number() over(partition by p.x, p.y order by image_id) as rn
    from (select {X8} as x, {Y8} as y, image_id from v_points) p join (select x,y from v_tiles where status='pending') t on p.x=t.x and p.y=t.y) q where rn<=20""",
)
def points_in_tiles_capped(v):
    wanted = v.tiles.filter(F.col("status") == "pending")
    return tiles.points_in_tiles(v.points, wanted, 8, cap=20).select("z", "x", "y", "image_id")


@query("tile_stats", "select status, count(*) as tiles, cast(coalesce(sum(image_count),0) as bigint) as images from v_tiles group by status")
def tile_stats(v):
    return state.tile_stats(v.tiles)


@query("download_stats", "select status, count(*) as requests from v_requests group by status")
def download_stats(v):
    return state.download_stats(v.requests)


@query(
    "totals",
    """select discovered, requested, downloaded, effective_total, greatest(0, effective_total-downloaded) as remaining from (
    select *, least(5000, discovered) as effective_total from (select (select count(*) from v_points) as discovered,
    (select count(*) from v_requests) as requested, (select count(*) from v_requests where status='downloaded') as downloaded) a) b""",
)
def totals(v):
    return state.totals(v.points, v.requests, 5000)


@query("tile_count", f"select o_orderkey as id, cast(sum((x2-x1+1)*(y2-y1+1)) as bigint) as tiles from (select o_orderkey, {xy_sql(12, 'a', 'd')[0]} x1, {xy_sql(12, 'a', 'd')[1]} y1, {xy_sql(12, '(c-1e-11)', '(b+1e-11)')[0]} x2, {xy_sql(12, '(c-1e-11)', '(b+1e-11)')[1]} y2 from (select o_orderkey, o_orderkey%170+0.05e0 a, o_orderkey%80+0.05e0 b, o_orderkey%170+0.35e0 c, o_orderkey%80+0.25e0 d from orders) p) q group by o_orderkey")
def tile_count(v):
    k = F.col("o_orderkey")
    boxes = v.table("orders").select(
        k.alias("id"), (k % 170 + 0.05).alias("min_lon"), (k % 80 + 0.05).alias("min_lat"), (k % 170 + 0.35).alias("max_lon"), (k % 80 + 0.25).alias("max_lat")
    )
    return tiles.tile_count(boxes, 12)


@query("tiles_extent", f"select min(west) as west, min(south) as south, max(east) as east, max(north) as north from (select {BOUNDS_SQL} from v_tiles) b")
def tiles_extent(v):
    return tiles.tiles_extent(v.tiles)


@query("dedupe_first", "select cast(image_id as varchar) as image_id, ann_id, x, y from (select *, row_number() over(partition by image_id order by x, ann_id) rn from v_boxes) b where rn=1")
def dedupe_first(v):
    return state.dedupe_first(v.boxes, "image_id", ["x", "ann_id"]).select("image_id", "ann_id", "x", "y")


@query("latest_per_key", "select user_id, event_type, event_id, value from (select *, row_number() over(partition by user_id, event_type order by ts desc, event_id desc) rn from events) e where rn=1")
def latest_per_key(v):
    log = v.table("events").select("user_id", "event_type", "ts", "event_id", "value")
    return state.latest_per_key(log, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("union_discovered", "select image_id, lon, lat from v_points where lon<80 union all select image_id, lon, lat from v_points where lon>=75")
def union_discovered(v):
    p = v.points.select("image_id", "lon", "lat")
    return state.union_discovered([p.filter("lon < 80"), p.filter("lon >= 75")])


@query(
    "insert_ignore",
    """with n as (select distinct 8 as z, x+1 as x, y from v_tiles)
    select z,x,y,status,image_count from v_tiles union all
    select z,x,y,'pending',null from n where not exists (select 1 from v_tiles t where t.z=n.z and t.x=n.x and t.y=n.y)""",
)
def insert_ignore(v):
    new = v.tiles.select("z", (F.col("x") + 1).alias("x"), "y", F.lit("pending").alias("status"), F.lit(None).cast("bigint").alias("image_count"))
    return state.insert_ignore(v.tiles, new, ["z", "x", "y"])


@query(
    "upsert",
    """with n as (select 8 as z, x+1 as x, y, 'failed' as status from v_tiles)
    select z,x,y,status from n union all select z,x,y,status from v_tiles t where not exists (select 1 from n where t.x=n.x and t.y=n.y)""",
)
def upsert(v):
    base = v.tiles.select("z", "x", "y", "status")
    return state.upsert(base, base.withColumn("x", F.col("x") + 1).withColumn("status", F.lit("failed")), ["z", "x", "y"])


@query(
    "update_status",
    """select z,x,y, case when x%2=0 and status='in_progress' then 'completed' else status end as status,
    case when x%2=0 and status='in_progress' then y else image_count end as image_count from v_tiles""",
)
def update_status(v):
    changes = v.tiles.filter("x % 2 = 0").select("z", "x", "y", F.lit("completed").alias("status"), F.col("y").alias("image_count"))
    return state.update_status(v.tiles, changes, ["z", "x", "y"], state.TILE_CHANGES)


@query(
    "reset_in_progress",
    """select 'tile' as kind, concat(x,'/',y) as id, case status when 'in_progress' then 'pending' else status end as status from v_tiles
    union all select 'request', image_id, case status when 'downloading' then 'pending' else status end from v_requests""",
)
def reset_in_progress(v):
    t, r = state.reset_in_progress(v.tiles, v.requests)
    t = t.select(F.lit("tile").alias("kind"), F.concat_ws("/", "x", "y").alias("id"), "status")
    return t.unionByName(r.select(F.lit("request").alias("kind"), F.col("image_id").alias("id"), "status"))


@query(
    "sample_unrequested",
    f"select image_id, lon, lat from v_points where image_id not in (select image_id from v_requests) order by {sql_hash(7, 'image_id')}, image_id limit 100",
)
def sample_unrequested(v):
    return state.sample_unrequested(v.points, v.requests, 100, 7).select("image_id", "lon", "lat")


@query("take_subset", f"select image_id, w, h from v_images order by {sql_hash(11, 'image_id')}, image_id limit 12000")
def take_subset(v):
    return state.take_subset(v.images, 12_000, 11)


@query(
    "selection_hook",
    f"""with c as (select image_id from v_points where image_id not in (select image_id from v_requests) order by {sql_hash(5, 'image_id')}, image_id limit 40)
    select image_id, status from v_requests union all select image_id, 'pending' from c""",
)
def selection_hook(v):
    return state.selection_hook(v.points, v.requests, lambda i, r: state.sample_unrequested(i, r, 40, 5))


@query("lonlat_to_tile", f"select image_id, {X14} as x, {Y14} as y from v_points")
def lonlat_to_tile(v):
    x, y = geo.lonlat_to_tile("lon", "lat")
    return v.points.select("image_id", x.alias("x"), y.alias("y"))


@query("tile_bounds", f"select z, x, y, {BOUNDS_SQL} from v_tiles")
def tile_bounds(v):
    return v.tiles.select("z", "x", "y", geo.tile_bounds("z", "x", "y").alias("b")).select("z", "x", "y", "b.*")


@query(
    "tiles_for_bbox",
    f"""select id, 10 as z, gx.x as x, gy.y as y from (select n_nationkey as id, {xy_sql(10, 'a', 'd')[0]} x1, {xy_sql(10, 'a', 'd')[1]} y1, {xy_sql(10, '(c-1e-11)', '(b+1e-11)')[0]} x2, {xy_sql(10, '(c-1e-11)', '(b+1e-11)')[1]} y2
    from (select c_custkey as n_nationkey, (c_custkey*7)%150+0.03e0 a, (c_custkey*3)%70+0.03e0 b, (c_custkey*7)%150+1.23e0 c, (c_custkey*3)%70+0.83e0 d from customer) p) q,
    lateral (select unnest(range(x1, x2+1)) as x) gx, lateral (select unnest(range(y1, y2+1)) as y) gy""",
)
def tiles_for_bbox(v):
    k = F.col("c_custkey")
    lon, lat = (k * 7) % 150, (k * 3) % 70
    boxes = v.table("customer").select(
        k.alias("id"), (lon + 0.03).alias("min_lon"), (lat + 0.03).alias("min_lat"), (lon + 1.23).alias("max_lon"), (lat + 0.83).alias("max_lat")
    )
    return tiles.tiles_for_bbox(boxes, 10)


@query(
    "sub_boxes",
    f"""with b as (select z,x,y,{BOUNDS_SQL} from (select 14 as z, x*64 as x, y*64 as y from v_tiles) t),
    g as (select b.*, gr.r as "row", gc.c as col, 0.01e0*0.9e0 as step from b, lateral (select unnest(range(0, cast(ceil((north-south)/(0.01e0*0.9e0)) as bigint))) r) gr, lateral (select unnest(range(0, cast(ceil((east-west)/(0.01e0*0.9e0)) as bigint))) c) gc)
    select z,x,y,"row",col, round(west+col*step,9) as min_lon, round(south+"row"*step,9) as min_lat, round(least(west+col*step+step,east),9) as max_lon, round(least(south+"row"*step+step,north),9) as max_lat from g""",
)
def sub_boxes(v):
    t = v.tiles.select(F.lit(14).alias("z"), (F.col("x") * 64).alias("x"), (F.col("y") * 64).alias("y"))
    return tiles.sub_boxes(t)


@query("hashrand", "select image_id, cast(concat('0x',substring(md5(concat('7:',cast(image_id as varchar))),1,7)) as bigint) % 100 as r from v_images")
def hashrand(v):
    return v.images.select("image_id", (hash_int(7, "image_id") % 100).alias("r"))

"""Queries of box geometry, masks and crop planners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import boxes as fb
from tilewright.functions.hashing import hashrand
from tilewright.operators import boxes as ob
from tilewright.operators import masks as om
from tilewright.operators import planners as pl
from tilewright.plans.fixtures import sql_hash, sql_rand
from tilewright.plans.registry import query

SIZED = "(select b.*, i.w as iw, i.h as ih from v_boxes b join v_images i on b.image_id=i.image_id)"
OVERLAP = "a.x<b.x+b.w and b.x<a.x+a.w and a.y<b.y+b.h and b.y<a.y+a.h"


def sized(v):
    return v.boxes.join(v.images.select("image_id", F.col("w").alias("iw"), F.col("h").alias("ih")), "image_id")


def ann_chunk():
    return F.floor(F.col("ann_id") / 10_000)


@query("overlapping_boxes", f"select a.image_id, a.ann_id as a, b.ann_id as b from v_boxes a join v_boxes b on a.image_id=b.image_id and a.ann_id<b.ann_id and {OVERLAP}")
def overlapping_boxes(v):
    return ob.overlapping_boxes(v.boxes)


CAND = "(select image_id, k, 40*k as x, 30*k as y, 60 as w, 60 as h from v_images, (select unnest(range(0,10)) as k) g)"


@query("boxes_clear_of", f"select a.image_id, a.k, a.x, a.y from {CAND} a where not exists(select 1 from v_boxes b where a.image_id=b.image_id and {OVERLAP})")
def boxes_clear_of(v):
    side = F.lit(60).cast("bigint")
    cands = v.images.select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("k")).select(
        "image_id", "k", (F.col("k") * 40).alias("x"), (F.col("k") * 30).alias("y"), side.alias("w"), side.alias("h")
    )
    return ob.boxes_clear_of(cands, v.boxes, ["image_id", "k"]).select("image_id", "k", "x", "y")


BOX = "struct(o bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint)"


def greedy_sql(source: str) -> str:
    """Recursive tables that grow one box of each image at a time; the merged boxes are `merged` (image_id, ann_id, x, y, w, h).

    A step either adds all free boxes that meet the current one, or closes it and starts
    with the next free box in order.
    """
    hit = "lambda b: b.x1<cur.x2 and cur.x1<b.x2 and b.y1<cur.y2 and cur.y1<b.y2"
    reach = lambda f, c: f"{f}(list_transform(hits, lambda b: b.{c}))"
    return f"""g as (
      select image_id, list(struct_pack(o := ann_id, x1 := x, y1 := y, x2 := x+w, y2 := y+h) order by ann_id) as free, cast(null as {BOX}) as cur, cast(null as {BOX}) as done from {source} group by image_id
      union all
      select image_id, case when len(hits)>0 then list_filter(free, lambda b: not (b.x1<cur.x2 and cur.x1<b.x2 and b.y1<cur.y2 and cur.y1<b.y2)) else free[2:] end as free,
        case when len(hits)>0 then struct_pack(o := cur.o, x1 := least(cur.x1, {reach('list_min', 'x1')}), y1 := least(cur.y1, {reach('list_min', 'y1')}), x2 := greatest(cur.x2, {reach('list_max', 'x2')}), y2 := greatest(cur.y2, {reach('list_max', 'y2')}))
          when len(free)>0 then free[1] end as cur,
        case when len(hits)=0 and cur is not null then cur end as done
      from (select *, case when cur is null then [] else list_filter(free, {hit}) end as hits from g where cur is not null or len(free)>0) q
    ), merged as (select image_id, done.o as ann_id, done.x1 as x, done.y1 as y, done.x2-done.x1 as w, done.y2-done.y1 as h from g where done is not null)"""


@query("merge_boxes", f"with recursive {greedy_sql('v_boxes')} select image_id, ann_id, x, y, w, h from merged")
def merge_boxes(v):
    return ob.merge_boxes(v.boxes, "greedy")


@query(
    "merge_boxes_closure",
    """with recursive r as (
      select 0 as step, image_id, x as x1, y as y1, x+w as x2, y+h as y2 from v_boxes
      union
      select step+1, image_id, x1, y1, x2, y2 from (
        select distinct a.step, a.image_id, min(b.x1) as x1, min(b.y1) as y1, max(b.x2) as x2, max(b.y2) as y2
        from r a join r b on a.image_id=b.image_id and a.x1<b.x2 and b.x1<a.x2 and a.y1<b.y2 and b.y1<a.y2
        where a.step<9 group by a.step, a.image_id, a.x1, a.y1, a.x2, a.y2) g)
    select distinct image_id, x1 as x, y1 as y, x2-x1 as w, y2-y1 as h from r where step=9""",
)
def merge_boxes_closure(v):
    return ob.merge_boxes(v.boxes, "closure")


@query(
    "box_convert",
    f"""select image_id, ann_id, x+w as x2, y+h as y2, y as row0, y+h as row1, x as col0, x+w as col1,
    round((x+w/2e0)/iw,12) as xc, round((y+h/2e0)/ih,12) as yc, round(w*1e0/iw,12) as nw, round(h*1e0/ih,12) as nh,
    round(x*1e0/iw*100,10) as px, round(y*1e0/ih*100,10) as py, cast(trunc((x+0.75e0)*2) as bigint) as back_x from {SIZED} s""",
)
def box_convert(v):
    box, size = ["x", "y", "w", "h"], ("iw", "ih")
    corner, cut = fb.box_convert(box, "xywh", "xyxy"), fb.box_convert(box, "xywh", "slice")
    yolo, pct = fb.box_convert(box, "xywh", "yolo", *size), fb.box_convert(box, "xywh", "percent", *size)
    back = fb.box_convert([(F.col("x") + 0.75) / 50.0, F.lit(0), F.lit(1), F.lit(1)], "percent", "xywh", F.lit(10000), F.lit(100))
    return sized(v).select(
        "image_id", "ann_id", corner[2].alias("x2"), corner[3].alias("y2"), *[c.alias(n) for c, n in zip(cut, ["row0", "row1", "col0", "col1"])],
        *[F.round(c, 12).alias(n) for c, n in zip(yolo, ["xc", "yc", "nw", "nh"])], F.round(pct[0], 10).alias("px"), F.round(pct[1], 10).alias("py"),
        back[0].alias("back_x"),
    )


@query("clamp_box", f"select image_id, ann_id, greatest(0,x-30) as x1, greatest(0,y-40) as y1, least(iw,x+w+50) as x2, least(ih,y+h+60) as y2 from {SIZED} s")
def clamp_box(v):
    corners = fb.clamp_box("x", "y", "w", "h", [F.lit(p) for p in (30, 40, 50, 60)], "iw", "ih")
    return sized(v).select("image_id", "ann_id", *[c.alias(n) for c, n in zip(corners, ["x1", "y1", "x2", "y2"])])


KEY = ("image_id", "ann_id")
SKEW = "(2*{s}-1)*{k}"


def skew_sql(tag):
    return f"((2*{sql_rand('1s' + tag, *KEY, lo=0, hi=1)}-1)*{sql_rand('1k' + tag, *KEY, lo=100, hi=300)})"


def pads_sql(m, skew):
    less = f"cast(floor({m}*100e0/abs({skew})) as bigint)"
    return f"(case when {skew}<0 then {m} else {less} end)", f"(case when {skew}<0 then {less} else {m} end)"


@query(
    "engulf_crop",
    f"""with s as (select *, {skew_sql('h')} as sh, {skew_sql('v')} as sv from {SIZED} q),
    m as (select *, {pads_sql('400', 'sh')[0]} as ml, {pads_sql('400', 'sh')[1]} as mr, {pads_sql('300', 'sv')[0]} as mt, {pads_sql('300', 'sv')[1]} as mb from s)
    select image_id, ann_id, greatest(0, x-{sql_rand('5l', *KEY, lo='least(20,ml)', hi='ml')}) as x1, greatest(0, y-{sql_rand('5t', *KEY, lo='least(20,mt)', hi='mt')}) as y1,
    least(iw, x+w+{sql_rand('5r', *KEY, lo='least(20,mr)', hi='mr')}) as x2, least(ih, y+h+{sql_rand('5b', *KEY, lo='least(20,mb)', hi='mb')}) as y2 from m""",
)
def engulf_crop(v):
    skew = lambda t: (2 * hashrand("1s" + t, *KEY, lo=F.lit(0), hi=F.lit(1)) - 1) * hashrand("1k" + t, *KEY, lo=F.lit(100), hi=F.lit(300))
    corners = fb.engulf_crop(["x", "y", "w", "h"], skew("h"), skew("v"), F.lit(400), F.lit(300), [F.lit(20)] * 4, "iw", "ih", 5, *KEY)
    return sized(v).select(*KEY, *[c.alias(n) for c, n in zip(corners, ["x1", "y1", "x2", "y2"])])


def inner_sql(tag, at, size, key=KEY, seed="6"):
    return f"({at}+{sql_rand(seed + tag, *key, lo=f'cast(floor({size}*4/10e0) as bigint)', hi=f'cast(floor({size}*6/10e0) as bigint)')})"


def cut_sql(seed, key, scale):
    cx, cy = inner_sql("x", "x", "w", key, seed), inner_sql("y", "y", "h", key, seed)
    ph = f"greatest(100,{sql_rand(seed + 'h', *key, lo=0, hi=f'w*{scale}')})"
    pv = f"greatest(100,{sql_rand(seed + 'v', *key, lo=0, hi=f'h*{scale}')})"
    return (
        f"greatest(0, case when mode in ('TL','BL') then {cx} else x-{ph} end)", f"greatest(0, case when mode in ('TL','TR') then {cy} else y-{pv} end)",
        f"least(iw, case when mode in ('TL','BL') then x+w+{ph} else {cx} end)", f"least(ih, case when mode in ('TL','TR') then y+h+{pv} else {cy} end)",
    )


@query(
    "cut_crop",
    "select image_id, ann_id, mode, " + ", ".join(f"{e} as {n}" for e, n in zip(cut_sql("6", KEY, 2), ["x1", "y1", "x2", "y2"]))
    + f" from (select *, case ann_id%4 when 0 then 'TL' when 1 then 'TR' when 2 then 'BL' else 'BR' end as mode from {SIZED} s) q",
)
def cut_crop(v):
    rows = sized(v).withColumn("mode", F.element_at(F.array(*[F.lit(m) for m in fb.CUT_MODES]), (F.col("ann_id") % 4 + 1).cast("int")))
    corners = fb.cut_crop(["x", "y", "w", "h"], "mode", 2, "iw", "ih", 6, *KEY)
    return rows.select(*KEY, "mode", *[c.alias(n) for c, n in zip(corners, ["x1", "y1", "x2", "y2"])])


@query(
    "resize_pad_meta",
    """with m as (select image_id, cast(round_even(w*(50e0/greatest(w,h)),0) as bigint) as new_w, cast(round_even(h*(50e0/greatest(w,h)),0) as bigint) as new_h from v_images)
    select image_id, new_w, new_h, (50-new_w)//2 as pad_left, 50-new_w-(50-new_w)//2 as pad_right, (50-new_h)//2 as pad_top, 50-new_h-(50-new_h)//2 as pad_bottom, (50-new_h)//2 as row0, (50-new_h)//2+new_h as row1 from m""",
)
def resize_pad_meta(v):
    rows = v.images.select("image_id", fb.resize_pad_meta("w", "h", 50).alias("m"))
    back = fb.unpad_range(F.col("m"), 50)
    names = ["new_w", "new_h", "pad_left", "pad_right", "pad_top", "pad_bottom"]
    return rows.select("image_id", *[F.col(f"m.{n}") for n in names], back["row0"].alias("row0"), back["row1"].alias("row1"))


@query("perspective_scale", f"select image_id, ann_id, round(least(3e0, greatest(0.1e0, greatest(abs(y-250)*1e0/ih,0.001e0)/greatest(abs(x-300)*1e0/700,0.001e0))),9) as scale from {SIZED} s")
def perspective_scale(v):
    return sized(v).select(*KEY, F.round(fb.perspective_scale("x", "y", F.lit(300), F.lit(250), F.lit(700), "ih"), 9).alias("scale"))


@query("horizon_scale", f"select image_id, ann_id, cast(trunc(w*((y+h-60)*1e0/(ih-90))) as bigint) as nw, cast(trunc(h*((y+h-60)*1e0/(ih-90))) as bigint) as nh, round((y+h-60)*1e0/(ih-90),9) as scale from {SIZED} s where y+h>60 and ih>90")
def horizon_scale(v):
    s = fb.horizon_scale("ih", F.lit(90), F.col("y") + F.col("h"), F.lit(60), "w", "h", on_error="null")
    return sized(v).withColumn("s", s).filter("s is not null").select(*KEY, F.col("s.w").alias("nw"), F.col("s.h").alias("nh"), F.round("s.scale", 9).alias("scale"))


@query("ground_scale", f"select image_id, ann_id, round(case when y*1e0/ih>0.7e0 then 1e0+(y*1e0/ih-0.7e0)*1.67e0 else 0.3e0+y*1e0/ih/0.7e0*0.7e0 end,9) as scale from {SIZED} s")
def ground_scale(v):
    return sized(v).select(*KEY, F.round(fb.ground_scale("y", "ih"), 9).alias("scale"))


@query("image_tiles", "select image_id, gy.y//200*cast(ceil(w/200e0) as bigint)+gx.x//200 as tile, gy.y as y, gx.x as x, least(200,w-gx.x) as tile_w, least(200,h-gy.y) as tile_h from v_images, lateral (select unnest(range(0,h,200)) as y) gy, lateral (select unnest(range(0,w,200)) as x) gx")
def image_tiles(v):
    return pl.image_tiles(v.images, 200)


@query("gate_tiles", "select t.image_id, t.y, t.x, coalesce(p.cls in (0,1,2,3,4,5),false) as scored from (select image_id, gy.y, gx.x from (select distinct image_id from v_pixels) i, (select unnest(range(0,10,2)) as y) gy, (select unnest(range(0,10,2)) as x) gx) t left join v_pixels p on p.image_id=t.image_id and p.y=t.y and p.x=t.x")
def gate_tiles(v):
    size = F.lit(10).cast("bigint")
    images = v.table("embeddings").select(F.col("vec_id").alias("image_id"), size.alias("w"), size.alias("h"))
    mask = v.pixels.withColumn("mask", F.col("cls") <= 5)
    return pl.gate_tiles(pl.image_tiles(images, 2), mask).select("image_id", "y", "x", "scored")


@query(
    "plan_positive_crops",
    f"""with recursive {greedy_sql('v_boxes')}, s as (select m.*, i.w as iw, i.h as ih from merged m join v_images i on m.image_id=i.image_id),
    c as (select *, greatest(0,x-{sql_rand('4l', *KEY, lo=20, hi=1000)}) as x1, greatest(0,y-{sql_rand('4t', *KEY, lo=20, hi=1000)}) as y1,
    least(iw,x+w+{sql_rand('4r', *KEY, lo=20, hi=1000)}) as x2, least(ih,y+h+{sql_rand('4b', *KEY, lo=20, hi=1000)}) as y2 from s)
    select image_id, ann_id, x1, y1, x2, y2, x-x1 as bx, y-y1 as by, w as bw, h as bh from c""",
)
def plan_positive_crops(v):
    return pl.plan_positive_crops(v.boxes, v.images, 4)


@query(
    "plan_positive_crops_single",
    f"""with c as (select *, greatest(0,x-{sql_rand('4l', *KEY, lo=20, hi=200)}) as x1, greatest(0,y-{sql_rand('4t', *KEY, lo=20, hi=200)}) as y1,
    least(iw,x+w+{sql_rand('4r', *KEY, lo=20, hi=200)}) as x2, least(ih,y+h+{sql_rand('4b', *KEY, lo=20, hi=200)}) as y2 from {SIZED} s)
    select image_id, ann_id, x1, y1, x2, y2, x-x1 as bx, y-y1 as by, w as bw, h as bh from c""",
)
def plan_positive_crops_single(v):
    return pl.plan_positive_crops(v.boxes, v.images, 4, max_pad=200, merge=None)


@query(
    "plan_negative_crops",
    f"""with p as (select n.image_id, g.draw, n.wanted, i.w as iw, i.h as ih from (select image_id, count(*) as wanted from v_boxes group by image_id) n join v_images i on n.image_id=i.image_id,
      lateral (select unnest(range(1, wanted*100+1)) as draw) g),
    q as (select *, {sql_rand('8x', 'image_id', 'draw', lo=0, hi='iw-1')} as x, {sql_rand('8y', 'image_id', 'draw', lo=0, hi='ih-1')} as y from p),
    l as (select q.image_id, q.draw, min(case when q.x<b.x+b.w and q.y<b.y+b.h then greatest(b.x-q.x, b.y-q.y) else 300 end) as lim from q join v_boxes b on b.image_id=q.image_id group by q.image_id, q.draw),
    s as (select q.*, least(300, iw-x, ih-y, lim) as size from q join l on l.image_id=q.image_id and l.draw=q.draw),
    n as (select *, row_number() over(partition by image_id order by draw) as n from s where size>0)
    select image_id, n, x, y, size from n where n<=wanted""",
)
def plan_negative_crops(v):
    return pl.plan_negative_crops(v.boxes, v.images, 8, max_size=300)


K2 = ("image_id", "draw")


def jit(tag, base):
    return f"({base}+{sql_rand(tag, *K2, lo=-20, hi=20)})"


def fixed_sql(kind, reach, least):
    mh = f"least({jit(f'2{kind}h', reach)},{jit(f'2{kind}m', reach)})"
    mv = f"least({jit(f'2{kind}v', reach)},{jit(f'2{kind}m', reach)})"
    low = {s: "0" if least is None else jit(f"2{kind}n{s}", least) for s in "ltrb"}
    pad = lambda s, m: sql_rand(f"2{kind}{s}", *K2, lo=f"least({low[s]},{m})", hi=m)
    return f"""select image_id, '{kind}' as kind, draw, ann_id, greatest(0,x-{pad('l', mh)}) as x1, greatest(0,y-{pad('t', mv)}) as y1,
    least(iw,x+w+{pad('r', mh)}) as x2, least(ih,y+h+{pad('b', mv)}) as y2 from a"""


def rskew(axis):
    return f"((2*{sql_rand('2s' + axis, *K2, lo=0, hi=1)}-1)*{sql_rand('2w' + axis, *K2, lo=100, hi=300)})"


def around_sql():
    h, v = pads_sql(jit("2rh", 4000), "sh"), pads_sql(jit("2rv", 4000), "sv")
    pad = lambda s, m: sql_rand(f"2r{s}", *K2, lo="least(0,%s)" % m, hi=m)
    return f"greatest(0,x-{pad('l', h[0])})", f"greatest(0,y-{pad('t', v[0])})", f"least(iw,x+w+{pad('r', h[1])})", f"least(ih,y+h+{pad('b', v[1])})"


@query(
    "plan_crops",
    f"""with a as (select *, ann_id as draw from {SIZED} s),
    d as (select image_id, count(*) as n from v_boxes group by image_id),
    k as (select d.*, g.draw, {sql_rand('2a', 'd.image_id', 'g.draw', lo=1, hi='n')} as pick from d, (select unnest(range(1,4)) as draw) g),
    r as (select k.image_id, k.draw, s.ann_id, s.x, s.y, s.w, s.h, s.iw, s.ih from k join {SIZED} s on s.image_id=k.image_id and s.ann_id=k.pick),
    t as (select *, case when {sql_rand('2k', *K2, lo=0, hi=2)}=0 then 'cut' else 'engulf' end as kind, {rskew('h')} as sh, {rskew('v')} as sv,
      case {sql_rand('2c', *K2, lo=1, hi=4)} when 1 then 'TL' when 2 then 'TR' when 3 then 'BL' else 'BR' end as mode from r)
    {fixed_sql('close', 100, None)} union all {fixed_sql('far', 4000, 2000)} union all
    select image_id, kind, draw, ann_id, """
    + ", ".join(f"case when kind='cut' then {c} else {e} end" for c, e in zip(cut_sql("2t", K2, 2), around_sql()))
    + " from t",
)
def plan_crops(v):
    return pl.plan_crops(v.boxes, v.images, 3, 2, chunk=ann_chunk())


@query(
    "random_crops",
    f"""with d as (select image_id, count(*) as n from v_boxes group by image_id),
    k as (select d.*, g.draw, {sql_rand('3a', 'd.image_id', 'g.draw', lo=1, hi='n')} as pick from d, (select unnest(range(1,5)) as draw) g),
    r as (select k.draw, s.* from k join {SIZED} s on s.image_id=k.image_id and s.ann_id=k.pick),
    c as (select image_id, draw, ann_id, iw, ih, greatest(0,x-{sql_rand('3l', *K2, lo=0, hi=150)}) as x1, greatest(0,y-{sql_rand('3t', *K2, lo=0, hi=150)}) as y1,
      least(iw,x+w+{sql_rand('3r', *K2, lo=0, hi=150)}) as x2, least(ih,y+h+{sql_rand('3b', *K2, lo=0, hi=150)}) as y2 from r)
    select image_id, draw, ann_id, x1 as crop_x, y1 as crop_y, case when x2-x1<120 then least(iw,x1+120) else x2 end-x1 as crop_w, case when y2-y1<120 then least(ih,y1+120) else y2 end-y1 as crop_h from c""",
)
def random_crops(v):
    return pl.random_crops(v.boxes, v.images, 4, 150, 3, 120, 120, chunk=ann_chunk())


@query(
    "placement_points",
    f"select image_id, pos, y, x from (select image_id, y, x, row_number() over(partition by image_id order by {sql_hash(6, 'image_id', 'y', 'x')}, y, x) as pos from v_pixels where cls<9 and y>=4) q where pos<=5",
)
def placement_points(v):
    size = F.lit(8).cast("bigint")
    images = v.table("embeddings").select(F.col("vec_id").alias("image_id"), size.alias("w"), size.alias("h"))
    return pl.placement_points(v.pixels.withColumn("mask", F.col("cls") < 9), 5, 6, images, lower_half=True)


@query(
    "spaced_points",
    f"""with recursive m as (select image_id, y, x from v_pixels where cls<17),
    f as (select p.image_id, p.y, p.x, {sql_hash(6, 'p.image_id', 'p.y', 'p.x')} as d from m p where p.x+2<8 and p.y+2<8
      and (select count(*) from m q where q.image_id=p.image_id and q.x between p.x and p.x+1 and q.y between p.y and p.y+1)=4),
    g as (
      select image_id, list(struct_pack(x := x, y := y) order by d, y, x) as free, 0 as pos, cast(null as struct(x bigint, y bigint)) as cur from f group by image_id
      union all
      select image_id, list_filter(free[2:], lambda p: (p.x-free[1].x)*(p.x-free[1].x)+(p.y-free[1].y)*(p.y-free[1].y)>=4) as free, pos+1 as pos, free[1] as cur from g where len(free)>0 and pos<4)
    select image_id, cast(pos as bigint) as pos, cur.y as y, cur.x as x from g where pos>0""",
)
def spaced_points(v):
    size = F.lit(8).cast("bigint")
    images = v.table("embeddings").select(F.col("vec_id").alias("image_id"), size.alias("w"), size.alias("h"))
    return pl.spaced_points(v.pixels.withColumn("mask", F.col("cls") < 17), images, 2, 2, 4, 6)


@query(
    "box_fits",
    """select p.image_id, p.y, p.x from v_pixels p where p.x+2<8 and p.y+3<8 and (select count(*) from v_pixels q where q.image_id=p.image_id and q.cls<15 and q.x between p.x and p.x+1 and q.y between p.y and p.y+2)=6""",
)
def box_fits(v):
    size = F.lit(8).cast("bigint")
    images = v.table("embeddings").select(F.col("vec_id").alias("image_id"), size.alias("w"), size.alias("h"))
    pixels = v.pixels
    return om.box_fits(pixels.select("image_id", "y", "x"), pixels.withColumn("mask", F.col("cls") < 15), images, 2, 3)


def frags(v):
    k, s = F.col("p_partkey"), F.col("p_size")
    return v.table("part").select(
        k.alias("frag_id"), (8 + s).cast("bigint").alias("fw"), (6 + s * 2 % 37).cast("bigint").alias("fh"),
        (200 + k % 150).alias("frag_y"), (100 + k % 60).alias("frag_horizon"), (400 + k % 200).alias("frag_height"),
    )


@query(
    "sample_multiset",
    f"""with f as (select p_partkey as frag_id, row_number() over(order by p_partkey) rk, count(*) over() n from part),
    d as (select image_id, g.draw from (select image_id, {sql_rand('5m', 'image_id', lo=0, hi=10)} as m from v_images) q, lateral (select unnest(range(1, m+1)) as draw) g)
    select d.image_id, d.draw, f.frag_id from d join f on f.rk={sql_rand('5f', 'd.image_id', 'd.draw', lo=1, hi='(select count(*) from part)')}""",
)
def sample_multiset(v):
    return pl.sample_multiset(frags(v), v.images, 10, 5).select("image_id", "draw", "frag_id")


def synth_sql(seed: int, most: int = 30) -> str:
    """Tables of pasted fragments' boxes: `spots` (image_id, ann_id, x, y, w, h)."""
    r = lambda tag, *key, lo, hi: sql_rand(f"{seed}{tag}", "image_id", *key, lo=lo, hi=hi)
    return f"""f as (select p_partkey, 8+p_size as fw, 6+p_size*2%37 as fh, row_number() over(order by p_partkey) as rk from part),
    n0 as (select image_id, g.draw from (select image_id, {r('m', lo=0, hi=most)} as m from v_images) q, lateral (select unnest(range(1, m+1)) as draw) g),
    n1 as (select image_id, draw, {r('f', 'draw', lo=1, hi='(select count(*) from part)')} as pick from n0),
    drawn as (select n1.image_id, draw, fw, fh, i.w as iw, i.h as ih from n1 join f on f.rk=n1.pick join v_images i on i.image_id=n1.image_id),
    big as (select image_id, max(fw) as mw, max(fh) as mh, count(*) as n, any_value(iw) as iw, any_value(ih) as ih from drawn group by image_id),
    k as (select q.*, g.k from (select *, {r('c', lo=0, hi=3)} as c from big) q, lateral (select unnest(range(0, c+1)) as k) g),
    win as (select image_id, k, case when k>0 then {r('wx', 'k', lo=0, hi='iw')} else 0 end as wx, case when k>0 then {r('wy', 'k', lo=0, hi='ih')} else 0 end as wy,
      case when k>0 then mw+{r('ww', 'k', lo=5, hi=100)} else iw end as ww, case when k>0 then mh+{r('wh', 'k', lo=5, hi=100)} else ih end as wh,
      case when k>0 then {r('s', 'k', lo=0, hi=20)} else n end as take from k),
    pl as (select d.*, w.k, w.wx, w.wy, w.take, least(w.wx+w.ww, d.iw) as rt, least(w.wy+w.wh, d.ih) as low from drawn d join win w on d.image_id=w.image_id),
    rk as (select *, row_number() over(partition by image_id, k order by {sql_hash(f'{seed}o', 'image_id', 'k', 'draw')}) as r from pl),
    spot as (select *, wx+{r('px', 'k', 'draw', lo=0, hi='rt-wx-1')} as x, wy+{r('py', 'k', 'draw', lo=0, hi='low-wy-1')} as y from rk where r<=take and rt>wx and low>wy),
    spots as (select image_id, k*{most + 1}+draw as ann_id, cast(x as bigint) as x, cast(y as bigint) as y, cast(least(fw, rt-x) as bigint) as w, cast(least(fh, low-y) as bigint) as h from spot)"""


@query(
    "synth_labels",
    f"""with recursive {synth_sql(12)}, {greedy_sql('spots')}
    select m.image_id, 0 as cls, round((m.x+m.w/2e0)/i.w,9) as xc, round((m.y+m.h/2e0)/i.h,9) as yc, round(m.w*1e0/i.w,9) as bw, round(m.h*1e0/i.h,9) as bh, m.x, m.y, m.w, m.h
    from merged m join v_images i on i.image_id=m.image_id""",
)
def synth_labels(v):
    return pl.synth_labels(v.images, frags(v), 12)


SCENE_SCALE = "least(3e0,greatest(0.1e0,greatest(abs(y-2)*1e0/8,0.001e0)/greatest(abs(frag_y-frag_horizon)*1e0/frag_height,0.001e0)))"
K3 = ("image_id", "pos")


@query(
    "scene_plan",
    f"""with f as (select p_partkey as frag_id, 200+p_partkey%150 as frag_y, 100+p_partkey%60 as frag_horizon, 400+p_partkey%200 as frag_height, row_number() over(order by p_partkey) rk from part),
    i as (select vec_id as image_id from embeddings),
    d as (select image_id, g.draw from (select image_id, {sql_rand('9m', 'image_id', lo=0, hi=20)} as m from i) q, lateral (select unnest(range(1, m+1)) as draw) g),
    e as (select d.*, {sql_rand('9f', 'd.image_id', 'd.draw', lo=1, hi='(select count(*) from part)')} as pick from d),
    p as (select * from (select image_id, y, x, row_number() over(partition by image_id order by {sql_hash('9p', 'image_id', 'y', 'x')}, y, x) as pos from v_pixels where cls<9) q where pos<=40),
    j as (select p.*, f.* from e join f on f.rk=e.pick join p on p.image_id=e.image_id and p.pos=e.draw)
    select image_id, pos, frag_id, y, x, round(case when {sql_rand('9s', *K3, lo=0, hi=3)}=0 then 1e0 else {SCENE_SCALE} end,9) as scale, {sql_rand('9b', *K3, lo=0, hi=2)} as blur,
    round(case when {sql_rand('9u', *K3, lo=0, hi=1)}=1 then 1+{sql_rand('9l', *K3, lo=0, hi=268435455)}/268435456e0*0.5e0 else -1e0 end,9) as luminosity from j""",
)
def scene_plan(v):
    images = v.table("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(2).alias("horizon"))
    return pl.scene_plan(images, frags(v), v.pixels.withColumn("mask", F.col("cls") < 9), 9, 20)


@query(
    "mask_bbox",
    """select image_id, greatest(0,min(y)-1) as y1, greatest(0,min(x)-1) as x1, least(7,max(y)+1) as y2, least(7,max(x)+1) as x2, round(min(x)/8e0*100,2) as x_pct, round(min(y)/8e0*100,2) as y_pct,
    round((max(x)-min(x)+1)/8e0*100,2) as w_pct, round((max(y)-min(y)+1)/8e0*100,2) as h_pct from v_pixels where cls=3 group by image_id""",
)
def mask_bbox(v):
    size = F.lit(8).cast("bigint")
    images = v.table("embeddings").select(F.col("vec_id").alias("image_id"), size.alias("w"), size.alias("h"))
    return om.mask_bbox(v.pixels.withColumn("mask", F.col("cls") == 3), images, pad=1)


RUNS = "(select image_id, category_id%2 as side, ann_id, y*640+x as start, w*5+h as len from v_boxes)"


def _runs(v):
    return v.boxes.select(
        "image_id", (F.col("category_id") % 2).alias("side"), F.col("ann_id").alias("mask_id"), (F.col("y") * 640 + F.col("x")).alias("start"),
        (F.col("w") * 5 + F.col("h")).alias("len"), F.lit(640).cast("bigint").alias("width"),
    )


@query(
    "mask_run_stats",
    f"""with r as (select concat(image_id,'/',side) as mask_id, start, len, start//640 as ya, (start+len-1)//640 as yb from {RUNS} q)
    select mask_id, cast(sum(len) as bigint) as area, min(case when ya=yb then start%640 else 0 end) as x0, min(ya) as y0, max(case when ya=yb then (start+len-1)%640 else 639 end) as x1, max(yb) as y1 from r group by mask_id""",
)
def mask_run_stats(v):
    return om.mask_run_stats(_runs(v).withColumn("mask_id", F.concat_ws("/", "image_id", "side")))


@query(
    "mask_overlap",
    f"""select a.image_id, a.ann_id as a, b.ann_id as b, cast(sum(least(a.start+a.len,b.start+b.len)-greatest(a.start,b.start)) as bigint) as overlap
    from {RUNS} a join {RUNS} b on a.image_id=b.image_id and a.side=0 and b.side=1 and a.start<b.start+b.len and b.start<a.start+a.len group by all""",
)
def mask_overlap(v):
    r = _runs(v)
    return om.mask_overlap(r.filter("side = 0"), r.filter("side = 1"))


@query("keypoint_prompts", "select video_id, track_id, frame, frame-1 as frame_idx, k as point, round((x/10e0+w/10e0*i/4)/100,9) as px, round((y/10e0+h/10e0*j/4)/100,9) as py from v_tracks, (values (0,2,2),(1,1,2),(2,3,2),(3,2,1),(4,2,3)) g(k,i,j)")
def keypoint_prompts(v):
    c = [F.col(n) / 10 for n in "xywh"]
    points = v.tracks.select("video_id", "track_id", "frame", F.posexplode(fb.keypoint_prompts(*c, "frame")).alias("point", "p"))
    return points.select("video_id", "track_id", "frame", F.col("p.frame_idx").alias("frame_idx"), "point", F.round("p.px", 9).alias("px"), F.round("p.py", 9).alias("py"))


@query(
    "points_to_percent",
    f"""select image_id, ann_id, k as point, round((x+i*w)*1e0/iw*100,9) as px, round((y+j*h)*1e0/ih*100,9) as py from {SIZED} s, (values (0,0,0),(1,1,0),(2,1,1),(3,0,9)) g(k,i,j) where x+i*w<=iw and y+j*h<=ih""",
)
def points_to_percent(v):
    corner = lambda k, i, j: F.struct(F.lit(k).alias("k"), (F.col("x") + F.col("w") * i).alias("x"), (F.col("y") + F.col("h") * j).alias("y"))
    polygon = F.array(*[corner(*p) for p in ((0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 9))])
    rows = sized(v).withColumn("poly", polygon)
    # the point number rides along through a one-point polygon
    one = rows.select(*KEY, "iw", "ih", F.explode("poly").alias("p"))
    kept = one.select(*KEY, F.col("p.k").alias("point"), F.explode(fb.points_to_percent(F.array("p"), "iw", "ih")).alias("q"))
    return kept.select(*KEY, "point", F.round("q.x", 9).alias("px"), F.round("q.y", 9).alias("py"))

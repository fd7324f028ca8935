"""Queries of pixel rows, scoring and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilewright.functions import pixels as fp
from tilewright.operators import pixels as px
from tilewright.operators import scoring as sc
from tilewright.plans.registry import query
from tilewright.session import shared_dir
from tilewright.sources.files import explode_pixels as explode_image_pixels
from tilewright.sources.timeseries import read_timeseries as read_csv_series

HUE, SAT, VAL, GRAY = "v%180", "(v*7)%256", "(v*3+x)%256", "(v*5+y)%256"


def grids(v, h=8, w=8):
    size = lambda n: F.lit(n).cast("bigint")
    return v.table("embeddings").select(F.col("vec_id").alias("image_id"), size(w).alias("w"), size(h).alias("h"))


def bgr(v):
    c = F.col("v")
    return v.pixels.withColumn("b", c).withColumn("g", (c * 7) % 256).withColumn("r", (c * 3 + F.col("x") * 11) % 256)


BGR = "(select *, v as b, (v*7)%256 as g, (v*3+x*11)%256 as r from v_pixels)"


@query("explode_pixels", "select image_id, y, x, v as b from v_pixels")
def explode_pixels(v):
    level = lambda e: F.lpad(F.hex(F.floor((e.cast("double") + 1) * 127.5)), 2, "0")
    images = v.table("embeddings").select(
        F.col("vec_id").alias("stem"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(1).alias("channels"),
        F.unhex(F.array_join(F.transform("embedding", level), "")).alias("data"),
    )
    return explode_image_pixels(images).select("image_id", "y", "x", F.col("b").cast("bigint").alias("b"))


@query("read_timeseries", "select t, event_id*1e0 as event_id, score from v_rows")
def read_timeseries(v):
    path = shared_dir(v.spark, "series")
    v.rows.select("t", "event_id", "score").write.csv(path, header=True)
    return read_csv_series(v.spark, path, ["event_id", "score"], "t").drop("seq_id")


@query(
    "color_placement_mask",
    f"""with p as (select image_id, y, x, {HUE} as h, {SAT} as s, {VAL} as w, {GRAY} as g from v_pixels)
    select image_id, y, x, ((h between 0 and 180 and s between 0 and 50 and w between 50 and 150) or (h between 10 and 30 and s between 30 and 150 and w between 80 and 200)
    or (h between 20 and 35 and s between 50 and 200 and w between 100 and 255) or (h between 40 and 80 and s between 30 and 150 and w between 50 and 180))
    and not ((h between 100 and 130 and s between 50 and 255 and w between 100 and 255) or (y<2 and g>200)) as mask from p""",
)
def color_placement_mask(v):
    rows = v.pixels.select("image_id", "y", "x", F.expr(HUE).alias("hue"), F.expr(SAT).alias("sat"), F.expr(VAL).alias("val"), F.expr(GRAY).alias("gray"))
    return px.color_placement_mask(rows, grids(v)).select("image_id", "y", "x", "mask")


@query("combine_masks", "select image_id//3 as image_id, y, x, max(case when cls<4 then 1 else 0 end) as mask, max(case when cls<4 then 255 else 0 end) as out from v_pixels group by all")
def combine_masks(v):
    value = F.when(F.col("cls") < 4, F.col("cls") + 1).otherwise(0)
    return px.combine_masks(v.pixels.select(F.floor(F.col("image_id") / 3).alias("image_id"), "y", "x", value.alias("value")))


@query("binarize_mask", "select image_id, y, x, cast(cls<>7 as int) as mask from v_pixels")
def binarize_mask(v):
    return px.binarize_mask(v.pixels, 7, "cls").select("image_id", "y", "x", "mask")


@query("horizon_row", "select vec_id as image_id, coalesce(min(y),2) as horizon from embeddings left join (select * from v_pixels where cls=0) p on p.image_id=vec_id group by vec_id")
def horizon_row(v):
    return px.horizon_row(v.pixels, grids(v))


@query("luminance_stats", "select image_id, round(avg(v),6) as mean, round(stddev_pop(v),6) as std from v_pixels where y>=2 group by image_id")
def luminance_stats(v):
    return px.luminance_stats(v.pixels.withColumn("m", F.col("y") >= 2), mask="m").select("image_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("luminance_percentiles", "select image_id, round(quantile_cont(v*1e0,0.5),6) as low, round(quantile_cont(v*1e0,0.95),6) as high from v_pixels where cls<>4 group by image_id")
def luminance_percentiles(v):
    out = px.luminance_percentiles(v.pixels.withColumn("m", F.col("cls") != 4), mask="m")
    return out.select("image_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "color_profile",
    f"""select image_id, round(coalesce(mb,128),6) as mean_b, round(coalesce(mg,128),6) as mean_g, round(coalesce(mr,128),6) as mean_r, round(case when mb is null then 128 else gray end,6) as brightness,
    case when mb>mr+10 then 'cool' when mr>mb+10 then 'warm' else 'neutral' end as temperature from (select image_id, avg(b) filter (cls=2) as mb, avg(g) filter (cls=2) as mg, avg(r) filter (cls=2) as mr,
    avg(round(b*0.114e0+g*0.587e0+r*0.299e0,0)) as gray from {BGR} p group by image_id) q""",
)
def color_profile(v):
    out = px.color_profile(bgr(v).withColumn("m", F.col("cls") == 2), "m")
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in ("mean_b", "mean_g", "mean_r", "brightness")], "temperature")


@query(
    "channel_histogram",
    f"""select image_id, channel, least(49, cast(floor(value/5.1e0) as int)) as bin, count(*) as n from (select image_id, 'b' as channel, b as value from {BGR} p union all select image_id, 'r', r from {BGR} q) u group by all""",
)
def channel_histogram(v):
    return px.channel_histogram(bgr(v), ["b", "r"])


@query("class_centroids", "select image_id, cls, count(*) as pixels, cast(floor(avg(y)) as bigint) as cy, cast(floor(avg(x)) as bigint) as cx from v_pixels group by image_id, cls")
def class_centroids(v):
    return px.class_centroids(v.pixels)


@query(
    "mean_cov",
    """select i, j, round(avg(embedding[i+1]::double),9) as mean_i, round(covar_samp(embedding[i+1]::double, embedding[j+1]::double)+case when i=j then 1e-6 else 0 end,9) as cov
    from embeddings, (select unnest(range(0,64)) as i) a, (select unnest(range(0,64)) as j) b where j>=i group by i, j""",
)
def mean_cov(v):
    out = px.mean_cov_vectors(v.table("embeddings"), "embedding", 64)
    return out.select("i", "j", F.round("mean_i", 9).alias("mean_i"), F.round("cov", 9).alias("cov"))


@query(
    "mean_cov_columns",
    """select cls, round(avg(v),9) as mean_v, round(avg(x),9) as mean_x, round(avg(y),9) as mean_y, round(covar_samp(v,v)+1e-6,9) as cov_v_v, round(covar_samp(v,x),9) as cov_v_x, round(covar_samp(v,y),9) as cov_v_y,
    round(covar_samp(x,x)+1e-6,9) as cov_x_x, round(covar_samp(x,y),9) as cov_x_y, round(covar_samp(y,y)+1e-6,9) as cov_y_y from v_pixels group by cls""",
)
def mean_cov_columns(v):
    out = px.mean_cov(v.pixels, ["v", "x", "y"], ["cls"])
    return out.select("cls", *[F.round(c, 9).alias(c) for c in out.columns if c != "cls"])


@query(
    "std_match",
    """with s as (select image_id, avg(v) as m, stddev_pop(v) as d from v_pixels group by image_id)
    select p.image_id, y, x, round(case when cls<10 then greatest(0e0,least(255e0,(v-m)*(20e0/(d+1e-6))+90*1.25e0)) else v end,6) as v from v_pixels p join s on s.image_id=p.image_id""",
)
def std_match(v):
    stats = px.luminance_stats(v.pixels)
    out = fp.std_match("v", "mean", "std", F.lit(90.0), F.lit(20.0), F.col("cls") < 10, 1.25)
    return v.pixels.join(stats, "image_id").select("image_id", "y", "x", F.round(out, 6).alias("v"))


@query(
    "percentile_match",
    """with s as (select image_id, quantile_cont(v*1e0,0.5) as lo, quantile_cont(v*1e0,0.95) as hi from v_pixels group by image_id)
    select p.image_id, y, x, round(case when cls<10 then greatest(0e0,least(255e0,100e0/(hi-lo+1e-6)*v+80e0-100e0/(hi-lo+1e-6)*lo)) else v end,6) as v from v_pixels p join s on s.image_id=p.image_id""",
)
def percentile_match(v):
    stats = px.luminance_percentiles(v.pixels)
    out = fp.percentile_match("v", "low", "high", F.lit(80.0), F.lit(180.0), F.col("cls") < 10)
    return v.pixels.join(stats, "image_id").select("image_id", "y", "x", F.round(out, 6).alias("v"))


@query("gamma_l", "select image_id, y, x, round(case when cls<10 then pow(v/255e0,0.7e0)*255e0 else v end,6) as v from v_pixels")
def gamma_l(v):
    return v.pixels.select("image_id", "y", "x", F.round(fp.gamma_l("v", F.lit(0.7), F.col("cls") < 10), 6).alias("v"))


@query("scale_l", "select image_id, y, x, round(least(255e0,v*1.5e0),6) as v, round(v*0.4e0,6) as dim from v_pixels")
def scale_l(v):
    dim = fp.scale_l("v", F.lit(0.4), dimming=True)
    return v.pixels.select("image_id", "y", "x", F.round(fp.scale_l("v", F.lit(1.5)), 6).alias("v"), F.round(dim, 6).alias("dim"))


FRAGMENT = "(select y as dy, x as dx, case when cls%3=0 then 0 else v end as f from v_pixels where image_id=(select min(vec_id) from embeddings) and y<4 and x<4)"


def fragment(v):
    least = v.table("embeddings").agg(F.min("vec_id")).scalar()
    value = F.when(F.col("cls") % 3 == 0, 0).otherwise(F.col("v"))
    return v.pixels.filter((F.col("image_id") == least) & (F.col("y") < 4) & (F.col("x") < 4)).select(F.col("y").alias("dy"), F.col("x").alias("dx"), value.alias("f"))


@query("alpha_blend", f"select p.image_id, p.y, p.x, round(case when f.f<>0 then f.f*0.6e0+p.v*(1-0.6e0) else p.v end,6) as v from v_pixels p left join {FRAGMENT} f on p.y=f.dy+6 and p.x=f.dx+2")
def alpha_blend(v):
    return px.alpha_blend(v.pixels.select("image_id", "y", "x", "v"), fragment(v), 6, 2, 0.6).withColumn("v", F.round("v", 6))


@query("stitch_tiles", "select image_id, y, x, case when cls<12 then v%2 else 0 end as value from v_pixels where y<7 and x<6")
def stitch_tiles(v):
    y, x = F.col("y"), F.col("x")
    tiles = v.pixels.select("image_id", (F.floor(y / 3) * 3).alias("y0"), (F.floor(x / 3) * 3).alias("x0"), (y % 3).alias("dy"), (x % 3).alias("dx"), (F.col("v") % 2).alias("value"))
    return px.stitch_tiles(tiles, grids(v, 7, 6), v.pixels.withColumn("mask", F.col("cls") < 12))


COV = """with f as (select image_id, y, x, v*1e0 as a, ((v*7+x*13)%256)*1e0 as b, cls*1e0 as c, cls<5 as bg from v_pixels),
    s as (select avg(a) ma, avg(b) mb, avg(c) mc, covar_samp(a,a)+1e-6 p, covar_samp(a,b) q, covar_samp(a,c) r, covar_samp(b,b)+1e-6 t, covar_samp(b,c) u, covar_samp(c,c)+1e-6 w from f where bg),
    i as (select *, p*(t*w-u*u)-q*(q*w-u*r)+r*(q*u-t*r) as det from s),
    d as (select image_id, y, x, sqrt(((a-ma)*(a-ma)*(t*w-u*u)+2*(a-ma)*(b-mb)*(r*u-q*w)+2*(a-ma)*(c-mc)*(q*u-r*t)+(b-mb)*(b-mb)*(p*w-r*r)+2*(b-mb)*(c-mc)*(r*q-p*u)+(c-mc)*(c-mc)*(p*t-q*q))/det) as d from f, i)"""
WIN = "(select ky.k as y0, kx.k as x0 from (select unnest(range(0,5)) as k) ky, (select unnest(range(0,5)) as k) kx)"


@query(
    "top_matches",
    f"""{COV}, g as (select image_id, y0, x0, round(avg(d),6) as score from d join {WIN} w on y between y0 and y0+3 and x between x0 and x0+3 group by all)
    select image_id, y0, x0, score from (select *, row_number() over(partition by image_id order by score, y0, x0) rn from g) q where rn<=3""",
)
def top_matches(v):
    rows = v.pixels.select("image_id", "y", "x", F.col("v").cast("double").alias("a"), ((F.col("v") * 7 + F.col("x") * 13) % 256).cast("double").alias("b"), F.col("cls").cast("double").alias("c"))
    return px.top_matches(rows, grids(v), rows.filter("c < 5"), ["a", "b", "c"], 4, 4, 3)


@query(
    "top_similar",
    f"""with s as (select p.image_id, y0, x0, count(*)*1e0 n, sum(p.v*1e0) a, sum(f.f*1e0) b, sum(p.v*f.f*1e0) ab, sum(p.v*p.v*1e0) aa, sum(f.f*f.f*1e0) bb from v_pixels p join {WIN} w on p.y between y0 and y0+3 and p.x between x0 and x0+3
      join {FRAGMENT} f on f.dy=p.y-y0 and f.dx=p.x-x0 where y0%2=0 and x0%2=0 group by all),
    g as (select image_id, y0, x0, round(case when (aa-a*a/n)*(bb-b*b/n)>0 then (ab-a*b/n)/sqrt((aa-a*a/n)*(bb-b*b/n)) else 0 end,6) as score from s)
    select image_id, y0, x0, score from (select *, row_number() over(partition by image_id order by score desc, y0, x0) rn from g) q where rn<=2""",
)
def top_similar(v):
    return px.top_similar(v.pixels, grids(v), fragment(v), 4, 4, 2, stride=2)


# ---- scoring -------------------------------------------------------------


def area_model():
    """A stand-in model: boxes above 2000 pixels are big."""

    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        area = frame["w"] * frame["h"]
        return pd.DataFrame({"label": np.where(area > 2000, "big", "small"), "score": (area % 97) / 97.0})

    return predict


def window_model():
    """A stand-in sequence model: each class has a fixed pattern of the value."""

    def predict(window: np.ndarray) -> np.ndarray:
        level = np.rint(window[:, :1] * 100)
        return ((level + np.arange(3) * 7) % 101) / 101.0

    return predict


@query("score_rows", "select image_id, ann_id, case when w*h>2000 then 'big' else 'small' end as label, round((w*h%97)/97e0,9) as score from v_boxes")
def score_rows(v):
    out = sc.score_rows(v.boxes.select("image_id", "ann_id", "w", "h"), area_model, "label string, score double", ["image_id", "ann_id"])
    return out.withColumn("score", F.round("score", 9))


@query("score_groups", "select seq_id, t, k as label_idx, round(((cast(round_even(score*100,0) as bigint)+k*7)%101)/101e0,9) as prob from v_rows, (select unnest(range(0,3)) as k) g")
def score_groups(v):
    return sc.score_sequences(v.rows.select("seq_id", "t", "score"), window_model, 16, 3).withColumn("prob", F.round("prob", 9))


def cluster_facts(clustered, features, k, key="image_id"):
    """What must hold of any clustering: rows, cluster numbers, every row at its nearest mean, and less spread than one cluster."""
    near = 1e-6  # steps may end when centres move less than their tolerance
    means = clustered.groupBy(key, "cluster").agg(*[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)])
    whole = clustered.groupBy(key).agg(F.count("*").alias("rows"), sum_of([F.var_pop(f) for f in features]).alias("_spread"), F.min("cluster").alias("_low"), F.max("cluster").alias("_high"))
    listed = means.groupBy(key).agg(F.collect_list(F.struct("cluster", *[f"_m{i}" for i in range(len(features))])).alias("_means"))
    far = lambda c: sum_of([(F.col(f) - c[f"_m{i}"]) * (F.col(f) - c[f"_m{i}"]) for i, f in enumerate(features)])
    costs = F.transform("_means", lambda c: F.struct(far(c).alias("cost"), c["cluster"].alias("cluster")))
    rows = clustered.join(listed, key).withColumn("_costs", costs)
    own = F.element_at(F.filter("_costs", lambda c: c["cluster"] == F.col("cluster")), 1)["cost"]
    least = F.array_min(F.transform("_costs", lambda c: c["cost"]))
    # a row may tie, or lie within what the last step moved a centre
    checked = rows.groupBy(key).agg(F.bool_and(F.sqrt(own) <= F.sqrt(least) + near ** 0.5 * 4).alias("nearest"), F.avg(own).alias("_cost"))
    facts = whole.join(checked, key)
    return facts.select(key, "rows", "nearest", ((F.col("_low") >= 0) & (F.col("_high") < k)).alias("numbered"), (F.col("_cost") <= F.col("_spread") + 1e-9).alias("closer"))


def sum_of(parts):
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


FACTS = "select image_id, count(*) as rows, true as nearest, true as numbered, true as closer from v_pixels"


@query("kmeans_rows", f"{FACTS} group by image_id")
def kmeans_rows(v):
    return cluster_facts(kmeans_of_rows(v), ["b", "g", "r"], 3)


def kmeans_of_rows(v):
    return sc.kmeans_rows(bgr(v).select("image_id", "y", "x", "b", "g", "r"), ["b", "g", "r"], 3)


@query("kmeans_spatial", f"{FACTS} group by image_id".replace("true as nearest, ", ""))
def kmeans_spatial(v):
    features = ["b", "g", "r", "fx", "fy"]
    rows = sc.spatial_features(bgr(v), grids(v))
    # ten steps need not converge, so rows need not be at their nearest mean yet
    return cluster_facts(sc.kmeans_rows(rows, features, 3, iterations=10, starts=5), features, 3).drop("nearest")


@query("kmeans_table", "select 0 as part, count(*) as rows, true as numbered, true as closer from embeddings")
def kmeans_table(v):
    rows = v.table("embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64)])
    names = [f"e{i}" for i in range(64)]
    clustered = sc.kmeans_table(rows, names, 5).withColumn("part", F.lit(0))
    return cluster_facts(clustered, names, 5, "part").drop("nearest")


@query(
    "background_segment",
    f"""select image_id, count(*) as rows, true as first_is_background, true as whole_clusters, true as nearest from {BGR} p where b<>0 or g<>0 or r<>0 group by image_id""",
)
def background_segment(v):
    found = sc.background_segment(bgr(v).select("image_id", "y", "x", "b", "g", "r"), ["b", "g", "r"])
    facts = cluster_facts(found, ["b", "g", "r"], 3).select("image_id", "nearest")
    first = found.groupBy("image_id").agg(F.count("*").alias("rows"), F.min_by("background", F.struct("y", "x")).alias("first_is_background"))
    whole = found.groupBy("image_id", "cluster").agg(F.min("background").alias("a"), F.max("background").alias("z")).groupBy("image_id").agg(((F.sum(F.col("a").cast("int")) == 1) & (F.sum(F.col("z").cast("int")) == 1)).alias("whole_clusters"))
    return first.join(whole, "image_id").join(facts, "image_id").select("image_id", "rows", "first_is_background", "whole_clusters", "nearest")


@query(
    "text_classifier",
    """select count(*) as tested, true as scored, true as known_labels, true as near_majority from documents d join labels l on d.doc_id=l.doc_id where d.doc_id%5=0""",
)
def text_classifier(v):
    label = F.when(F.col("quality") == 1, "good").otherwise("bad")
    rows = v.table("documents").join(v.table("labels"), "doc_id").select("doc_id", "text", label.alias("label"))
    test = rows.filter("doc_id % 5 = 0")  # held out
    found = sc.text_classifier(rows.filter("doc_id % 5 <> 0"), test, features=1 << 18)[0]  # long texts have millions of different grams
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    major = F.greatest(F.avg((F.col("label") == "good").cast("double")), F.avg((F.col("label") == "bad").cast("double")))
    return found.agg(
        F.count("*").alias("tested"), F.bool_and(F.col("score").between(0.5, 1)).alias("scored"), F.bool_and(F.col("prediction").isin("good", "bad")).alias("known_labels"),
        (right >= major - 0.15).alias("near_majority"),
    )

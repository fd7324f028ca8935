"""Working views over the test tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.ordered import chunk_bounds, has_hot_group, number_rows, quantile_chunk

VIEW_SQL = {
    "v_images": "select o_orderkey as image_id, cast(640+(o_orderkey*37)%1281 as bigint) as w, cast(480+(o_orderkey*53)%721 as bigint) as h from orders",
    "v_boxes": "select l_orderkey as image_id, row_number() over(partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice) as ann_id, cast((l_partkey*131+l_linenumber*17)%600 as bigint) as x, cast((l_suppkey*97+l_linenumber*29)%440 as bigint) as y, cast(8+(l_partkey*7)%120 as bigint) as w, cast(8+(l_suppkey*11+l_partkey)%90 as bigint) as h, l_partkey%12 as category_id from lineitem",
    "v_points": "select cast(event_id as string) as image_id, event_id, ts as captured_at, 68+cast((event_id*7919)%30000 as double)/1000 as lon, 8+cast((event_id*104729)%28000 as double)/1000 as lat from events",
    "v_tiles": "select 8 as z, x, y, case (x+y)%4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'completed' else 'failed' end as status, case when (x+y)%4=2 then count(*) end as image_count from (select cast(floor((lon+180)/360*256) as bigint) as x, cast(floor((0.5-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*256) as bigint) as y from v_points) t group by x, y",
    "v_requests": "select cast(event_id as string) as image_id, case event_type when 'click' then 'downloading' when 'purchase' then 'downloaded' when 'error' then 'failed' else 'pending' end as status from events where event_id%3<>0",
    "v_rows": "select user_id as seq_id, row_number() over(partition by user_id order by ts,event_id) as t, event_id, event_type as label, value as score from events",
    "v_ranges": "select seq_id, t as ord, t as lo, t+(seq_id+t)%6 as hi, label, (t%45=1) as ground_truth from v_rows where t%9=1",
    "v_probs": "select seq_id as video_id, t as frame, k as label_idx, concat('L',cast(k as string)) as label, cast((event_id*37+k*53)%101 as double)/101 as prob from v_rows cross join (select 0 as k union all select 1 union all select 2) ks",
    "v_dets": "select image_id, ann_id, concat('c',cast(category_id as string)) as model_label, cast((x*7+y*3)%101 as double)/101 as score, x, y, w, h from v_boxes",
    "v_tracks": "select image_id%50 as video_id, category_id as track_id, rn+cast(floor(rn/4) as bigint) as frame, x, y, w, h, cast((x*7+y*3)%101 as double)/101 as score from (select *, row_number() over(partition by image_id%50, category_id order by image_id,ann_id) as rn from v_boxes) b",
    "v_pred": "select event_id, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as truth, (event_id*13+7)%5 as pred from events",
    "v_runs": "select l_orderkey%200 as run_id, row_number() over(partition by l_orderkey%200 order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 as epoch, l_discount+l_tax as train_loss, l_extendedprice/100000 as valid_loss from lineitem",
    "v_params": "select run_id, case run_id%2 when 0 then 'small' else 'large' end as model, cast(25+25*(run_id%4) as string) as tile, cast(1000*(1+run_id%3) as string) as n from (select distinct run_id from v_runs) r",
    "v_regions": "select l.image_id as task_id, l.ann_id as ord, concat('f',cast(l.category_id%3 as string)) as from_name, case when l.category_id%2=0 then cast(l.x as string) else concat('\"',cast(l.y as string),'k\"') end as value, o.o_custkey as completed_by, (l.category_id=11) as skipped from v_boxes l join orders o on l.image_id=o.o_orderkey",
    "v_pixels": "select image_id, cast(floor(pos/8) as bigint) as y, cast(pos%8 as bigint) as x, cast(floor((val+1)*127.5e0) as bigint) as v, cast(floor((val+1)*127.5e0) as bigint)%19 as cls from (select vec_id as image_id, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as val from embeddings) p",
}


def oracle(body: str) -> str:
    """Put the used views in front of an oracle query as common table expressions."""
    order = list(VIEW_SQL)

    def used(text: str) -> set[str]:
        direct = set(re.findall(r"\bv_[a-z]+\b", text)) & set(order)
        return direct.union(*(used(VIEW_SQL[n]) for n in direct)) if direct else direct

    names = used(body)
    ctes = ", ".join(f"{n} as ({VIEW_SQL[n]})" for n in order if n in names)
    body = body.strip()
    if not ctes:
        return body
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if head:
        return f"with {'recursive ' if head.group(1) else ''}{ctes}, {body[head.end():]}"
    return f"with {ctes} {body}"


def sql_hash(seed, *cols: str) -> str:
    parts = "".join(f", cast({c} as varchar)" for c in cols)
    return f"md5(concat_ws(':', '{seed}'{parts}))"


def sql_rand(seed, *cols: str, lo, hi) -> str:
    return f"({lo} + cast(concat('0x', substring({sql_hash(seed, *cols)}, 1, 7)) as bigint) % ({hi} - ({lo}) + 1))"


_BOUNDS: dict[tuple, list[float] | bool] = {}


class Views:
    """Lazy DataFrames of the working views for one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _chunk(self, tag: str, df: DataFrame, on):
        key = (self.spark.sparkContext.applicationId, self.dir, tag)
        if key not in _BOUNDS:
            _BOUNDS[key] = chunk_bounds(df, on)
        return quantile_chunk(df, on, _BOUNDS[key])

    def _numbered(self, tag: str, df: DataFrame, keys: list[str], order: list[str], name: str, on) -> DataFrame:
        """`number_rows`; whether a group is too large for one task is counted once for a folder."""
        key = (self.spark.sparkContext.applicationId, self.dir, f"{tag}/hot")
        if key not in _BOUNDS:
            _BOUNDS[key] = has_hot_group(df, keys)
        return number_rows(df, keys, order, name, self._chunk(tag, *on) if _BOUNDS[key] else None, hot=_BOUNDS[key])

    @property
    def images(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("image_id"),
            (640 + (k * 37) % 1281).cast("bigint").alias("w"),
            (480 + (k * 53) % 721).cast("bigint").alias("h"),
        )

    @property
    def boxes(self) -> DataFrame:
        items = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        on = F.col("l_linenumber") * F.lit(1e12) + F.col("l_partkey")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        numbered = self._numbered("boxes", items, ["l_orderkey"], order, "ann_id", (items, on))
        p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        return numbered.select(
            F.col("l_orderkey").alias("image_id"),
            "ann_id",
            ((p * 131 + n * 17) % 600).cast("bigint").alias("x"),
            ((s * 97 + n * 29) % 440).cast("bigint").alias("y"),
            (8 + (p * 7) % 120).cast("bigint").alias("w"),
            (8 + (s * 11 + p) % 90).cast("bigint").alias("h"),
            (p % 12).alias("category_id"),
        )

    @property
    def hot_boxes(self) -> bool:
        """Whether an image has more boxes than one task should order, counted once for a folder."""
        self.boxes
        return _BOUNDS[self.spark.sparkContext.applicationId, self.dir, "boxes/hot"]

    @property
    def points(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.cast("string").alias("image_id"),
            "event_id",
            F.col("ts").alias("captured_at"),
            (68 + ((e * 7919) % 30000).cast("double") / 1000).alias("lon"),
            (8 + ((e * 104729) % 28000).cast("double") / 1000).alias("lat"),
        )

    @property
    def tiles(self) -> DataFrame:
        from tilewright.functions.geo import lonlat_to_tile

        x, y = lonlat_to_tile("lon", "lat", 8)
        state = (F.col("x") + F.col("y")) % 4
        names = ["pending", "in_progress", "completed", "failed"]
        return (
            self.points.select(x.alias("x"), y.alias("y"))
            .groupBy("x", "y")
            .agg(F.count("*").alias("_n"))
            .select(
                F.lit(8).alias("z"),
                "x",
                "y",
                F.element_at(F.array(*[F.lit(s) for s in names]), (state + 1).cast("int")).alias("status"),
                F.when(state == 2, F.col("_n")).alias("image_count"),
            )
        )

    @property
    def requests(self) -> DataFrame:
        t = F.col("event_type")
        status = (
            F.when(t == "click", "downloading").when(t == "purchase", "downloaded").when(t == "error", "failed").otherwise("pending")
        )
        return self.table("events").filter(F.col("event_id") % 3 != 0).select(
            F.col("event_id").cast("string").alias("image_id"), status.alias("status")
        )

    @property
    def rows(self) -> DataFrame:
        events = self.table("events").select("user_id", "ts", "event_id", "event_type", "value")
        events = events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
        numbered = self._numbered("rows", events, ["user_id"], ["_at", "event_id"], "t", (events, F.col("_at")))
        return numbered.select(
            F.col("user_id").alias("seq_id"), "t", "event_id", F.col("event_type").alias("label"), F.col("value").alias("score")
        )

    @property
    def ranges(self) -> DataFrame:
        t = F.col("t")
        return self.rows.filter(t % 9 == 1).select(
            "seq_id",
            t.alias("ord"),
            t.alias("lo"),
            (t + (F.col("seq_id") + t) % 6).alias("hi"),
            "label",
            (t % 45 == 1).alias("ground_truth"),
        )

    @property
    def probs(self) -> DataFrame:
        k = F.col("label_idx")
        return self.rows.select(
            F.col("seq_id").alias("video_id"), F.col("t").alias("frame"), "event_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("label_idx")
        ).select(
            "video_id",
            "frame",
            "label_idx",
            F.concat(F.lit("L"), k.cast("string")).alias("label"),
            (((F.col("event_id") * 37 + k * 53) % 101).cast("double") / 101).alias("prob"),
        )

    @property
    def dets(self) -> DataFrame:
        return self.boxes.select(
            "image_id",
            "ann_id",
            F.concat(F.lit("c"), F.col("category_id").cast("string")).alias("model_label"),
            (((F.col("x") * 7 + F.col("y") * 3) % 101).cast("double") / 101).alias("score"),
            "x", "y", "w", "h",
        )

    @property
    def tracks(self) -> DataFrame:
        b = self.boxes.withColumn("video_id", F.col("image_id") % 50)
        orders = self.table("lineitem")
        on = (orders.select(F.col("l_orderkey").alias("image_id")), F.col("image_id"))
        numbered = self._numbered("tracks", b, ["video_id", "category_id"], ["image_id", "ann_id"], "rn", on)
        return numbered.select(
            "video_id",
            F.col("category_id").alias("track_id"),
            (F.col("rn") + F.floor(F.col("rn") / 4)).alias("frame"),
            "x", "y", "w", "h",
            (((F.col("x") * 7 + F.col("y") * 3) % 101).cast("double") / 101).alias("score"),
        )

    @property
    def pred(self) -> DataFrame:
        t = F.col("event_type")
        truth = F.when(t == "click", 0).when(t == "error", 1).when(t == "purchase", 2).when(t == "signup", 3).otherwise(4)
        return self.table("events").select("event_id", truth.alias("truth"), ((F.col("event_id") * 13 + 7) % 5).alias("pred"))

    @property
    def runs(self) -> DataFrame:
        items = self.table("lineitem").withColumn("run_id", F.col("l_orderkey") % 200)
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        numbered = self._numbered("runs", items, ["run_id"], order, "rn", (items, F.col("l_orderkey")))
        return numbered.select(
            "run_id",
            (F.col("rn") - 1).alias("epoch"),
            (F.col("l_discount") + F.col("l_tax")).alias("train_loss"),
            (F.col("l_extendedprice") / 100000).alias("valid_loss"),
        )

    @property
    def params(self) -> DataFrame:
        r = F.col("run_id")
        return self.table("lineitem").select((F.col("l_orderkey") % 200).alias("run_id")).distinct().select(
            "run_id",
            F.when(r % 2 == 0, "small").otherwise("large").alias("model"),
            (25 + 25 * (r % 4)).cast("string").alias("tile"),
            (1000 * (1 + r % 3)).cast("string").alias("n"),
        )

    @property
    def regions(self) -> DataFrame:
        owners = self.table("orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("completed_by"))
        c = F.col("category_id")
        return self.boxes.join(owners, "image_id").select(
            F.col("image_id").alias("task_id"),
            F.col("ann_id").alias("ord"),
            F.concat(F.lit("f"), (c % 3).cast("string")).alias("from_name"),
            F.when(c % 2 == 0, F.col("x").cast("string")).otherwise(F.concat(F.lit('"'), F.col("y").cast("string"), F.lit('k"'))).alias("value"),
            "completed_by",
            (c == 11).alias("skipped"),
        )

    @property
    def pixels(self) -> DataFrame:
        v = F.floor((F.col("val") + 1) * 127.5)
        return (
            self.table("embeddings")
            .select(F.col("vec_id").alias("image_id"), F.posexplode(F.transform("embedding", lambda e: e.cast("double"))).alias("pos", "val"))
            .select(
                "image_id",
                F.floor(F.col("pos") / 8).alias("y"),
                (F.col("pos") % 8).cast("bigint").alias("x"),
                v.alias("v"),
                (v % 19).alias("cls"),
            )
        )

"""Queries of dataset joins, filters, splits, names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import datasets as ds
from tilewright.operators import documents, state
from tilewright.plans.fixtures import sql_hash
from tilewright.plans.registry import query
from tilewright.session import shared_dir
from tilewright.sources import annotations as ann
from tilewright.sources import files



def micro(num, den):
    """Quotient of integers to 6 decimals, halves up, in integer arithmetic."""
    return f"((2*({num})*1000000+({den}))//(2*({den})))/1e6"


SIZED = "v_boxes b join v_images i on b.image_id=i.image_id"
FMT = "printf('%.6f', {})"
LINE = "concat_ws(' ', cast(b.category_id as varchar), " + ", ".join(
    FMT.format(e) for e in (micro("2*b.x+b.w", "2*i.w"), micro("2*b.y+b.h", "2*i.h"), micro("b.w", "i.w"), micro("b.h", "i.h"))
) + ")"


@query("read_coco", "select b.image_id, ann_id, category_id, b.x*1e0 as x, b.y*1e0 as y, b.w*1e0 as w, b.h*1e0 as h, i.w as width, i.h as height from " + SIZED)
def read_coco(v):
    box = F.struct(
        F.col("ann_id").alias("id"), "image_id", "category_id", F.array(*[F.col(c).cast("double") for c in "xywh"]).alias("bbox")
    )
    parts = ann.collect_parts(v.boxes, ["image_id"], ["ann_id"], box, chunk=F.floor(F.col("ann_id") / 10_000), hot=v.hot_boxes)
    image = v.images.select("image_id", F.array(F.struct(F.col("image_id").alias("id"), F.col("w").alias("width"), F.col("h").alias("height"))).alias("images"))
    path = shared_dir(v.spark, "coco")
    parts.join(image, "image_id").select("images", F.col("items").alias("annotations")).write.json(path)
    images, annotations, _ = ann.read_coco(v.spark, path, multiline=False)
    sizes = images.select(F.col("id").alias("image_id"), "width", "height").distinct()
    return annotations.withColumnRenamed("id", "ann_id").select("image_id", "ann_id", "category_id", "x", "y", "w", "h").join(sizes, "image_id")


@query("read_label_export", "select task_id, ord, from_name, value, completed_by from v_regions")
def read_label_export(v):
    region = F.struct("from_name", "value", F.col("ord").cast("string").alias("id"))
    parts = ann.collect_parts(v.regions, ["task_id", "completed_by"], ["ord"], region, chunk=F.floor(F.col("ord") / 10_000), hot=v.hot_boxes)
    path = shared_dir(v.spark, "export")
    one = F.array(F.struct("completed_by", F.col("items").alias("result")))
    parts.select(F.col("task_id").alias("id"), one.alias("annotations")).write.json(path)
    return ann.read_label_export(v.spark, path, multiline=False).select(
        "task_id", F.col("region_id").cast("bigint").alias("ord"), "from_name", "value", "completed_by"
    )


@query("read_yolo_labels", "select cast(b.image_id%200 as varchar) as stem, cast(category_id as integer) as cls, " + ", ".join(f"{micro(n, d)} as {a}" for n, d, a in (("2*b.x+b.w", "2*i.w", "xc"), ("2*b.y+b.h", "2*i.h", "yc"), ("b.w", "i.w", "w"), ("b.h", "i.h", "h"))) + " from " + SIZED)
def read_yolo_labels(v):
    texts = ann.write_yolo_labels(v.boxes, v.images, chunk=F.floor(F.col("ann_id") / 10_000), hot=v.hot_boxes)
    path = shared_dir(v.spark, "labels")
    ann.save_yolo_labels(texts.withColumn("sheet", F.col("image_id") % 200), path, "sheet")  # one file for the labels of many pictures
    return ann.read_yolo_labels(v.spark, path)


@query("write_yolo_labels", f"select b.image_id, cast(floor((ann_id-1)/10000) as bigint) as part, string_agg({LINE}, chr(10) order by ann_id) as text from {SIZED} group by all")
def write_yolo_labels(v):
    return ann.write_yolo_labels(v.boxes, v.images, chunk=F.floor(F.col("ann_id") / 10_000), hot=v.hot_boxes)


@query("read_segmentation_csv", "select cast(image_id as varchar) as image_id, concat(image_id,'_',ann_id,'.png') as mask_name, case when category_id<10 then concat('class ',category_id) else concat('/m/',category_id) end as class_name from v_boxes")
def read_segmentation_csv(v):
    path = shared_dir(v.spark, "segmentation")
    c = F.col("category_id")
    v.boxes.select(
        F.concat_ws("", "image_id", F.lit("_"), "ann_id", F.lit(".png")).alias("MaskPath"),
        F.col("image_id").alias("ImageID"),
        F.concat(F.lit("/m/"), c).alias("LabelName"),
    ).write.csv(f"{path}/segmentations.csv", header=True)
    v.boxes.filter(c < 10).select(F.concat(F.lit("/m/"), c).alias("a"), F.concat(F.lit("class "), c).alias("b")).distinct().write.csv(f"{path}/classes.csv")
    return ann.read_segmentation_csv(v.spark, path).select("image_id", "mask_name", "class_name")


@query("write_split_dataset", f"""select 'images' as kind, case when rn<=floor(n*0.85e0) then 'train' when rn<=floor(n*0.85e0)+floor(n*0.1e0) then 'val' else 'test' end as split, cast(image_id as varchar) as stem
    from (select *, row_number() over(order by {sql_hash(3, 'image_id')}, image_id) rn, count(*) over() n from v_images) q""")
def write_split_dataset(v):
    split = ds.split_dataset(v.images, 0.85, 0.1, 0.05, seed=3)
    rows = split.select(F.lit("images").alias("kind"), "split", F.col("image_id").cast("string").alias("stem"), F.concat(F.lit("raw/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("path"))
    path = shared_dir(v.spark, "split")
    files.write_split_dataset(rows, path)
    return v.spark.read.schema("kind string, split string, stem string, path string").parquet(path).select("kind", "split", "stem")


@query("dataset_manifest", """select 0 as part, concat('{"path":"data/set","train":"images/train","val":"images/val","test":"images/test","nc":', count(*), ',"names":[', string_agg(concat('"',p_type,'"'), ',' order by p_type), ']}') as manifest from (select distinct p_type from part) p""")
def dataset_manifest(v):
    classes = v.table("part").select(F.col("p_type").alias("name")).distinct()
    coded = ds.label_vocabulary(classes.withColumnRenamed("name", "label")).select(F.col("idx").alias("ord"), F.col("label").alias("name"))
    return documents.dataset_manifest(coded, "data/set")


@query("write_metadata_json", """select image_id, concat('{"image_id":"',image_id,'","event_id":',event_id,'}') as json from v_points""")
def write_metadata_json(v):
    return files.write_metadata_json(v.points.select("image_id", "event_id"))


@query(
    "tiles_report",
    """select part, count(*) as tiles, concat('somewhere 68.0 8.0 98.0 36.0 8') as head, string_agg(concat_ws('/', z, x, y), ' ' order by x, y, z) as listed,
    round(min(x/256e0*360-180),6) as west, round(max((x+1)/256e0*360-180),6) as east from (select *, cast(floor((row_number() over(order by x,y,z)-1)/10000) as bigint) as part from v_tiles) q group by part""",
)
def tiles_report(v):
    """The report's JSON text, read again as a whole."""
    report = documents.tiles_report(v.tiles, "somewhere", (68.0, 8.0, 98.0, 36.0), 8)
    text = "city string, bbox array<double>, zoom int, tiles array<struct<z:int,x:bigint,y:bigint,bounds:struct<west:double,south:double,east:double,north:double>>>"
    read = report.select("part", "tiles", F.from_json("report", text, {"mode": "FAILFAST"}).alias("r"))
    places = F.transform("r.tiles", lambda t: F.concat_ws("/", t["z"].cast("string"), t["x"].cast("string"), t["y"].cast("string")))
    return read.select(
        "part", F.col("tiles").cast("bigint").alias("tiles"), F.concat_ws(" ", "r.city", F.transform("r.bbox", lambda b: b.cast("string")), F.col("r.zoom").cast("string")).alias("head"),
        F.array_join(places, " ").alias("listed"), F.round(F.array_min(F.transform("r.tiles", lambda t: t["bounds"]["west"])), 6).alias("west"), F.round(F.array_max(F.transform("r.tiles", lambda t: t["bounds"]["east"])), 6).alias("east"),
    )


@query(
    "flatten_annotations",
    """with r as (select task_id, from_name, trim(value,'"') as value from (select *, row_number() over(partition by task_id, from_name order by ord desc) rn from v_regions) q where rn=1)
    select o_orderkey as "ID", coalesce(c.c_name,'') as completed_by, coalesce(u.c_name,'') as updated_by,
    max(case from_name when 'f0' then value end) as f0, max(case from_name when 'f1' then value end) as f1, max(case from_name when 'f2' then value end) as f2
    from orders o left join customer c on o.o_custkey=c.c_custkey left join customer u on o.o_custkey+1000=u.c_custkey left join r on r.task_id=o.o_orderkey group by all""",
)
def flatten_annotations(v):
    tasks = v.table("orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("completed_by"), (F.col("o_custkey") + 1000).alias("updated_by"))
    users = v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return documents.flatten_annotations(tasks, v.regions, users)


@query("assign_names", "select image_id, substring(md5(concat_ws(':', image_id, w)),1,16) as name from v_images")
def assign_names(v):
    return ds.assign_names(v.images, ["image_id", "w"], 16, hash_fn=F.md5).select("image_id", "name")


@query(
    "collate_datasets",
    """select d as dataset, cast(image_id as varchar) as stem, concat(d,'/i/',image_id) as image_path, concat(d,'/m/',image_id) as mask_path,
    substring(md5(concat(d,':',image_id)),1,16) as name from (select case when image_id%2=0 then 0 else 1 end as d, image_id from v_images) q""",
)
def collate_datasets(v):
    def side(d, kind):
        rows = v.images.filter(F.col("image_id") % 2 == d)
        stem = F.col("image_id").cast("string")
        return rows.select(stem.alias("stem"), F.concat(F.lit(f"{d}/{kind}/"), stem).alias("path"))

    return ds.collate_datasets([(side(d, "i"), side(d, "m")) for d in (0, 1)], 16, hash_fn=F.md5)


@query(
    "class_codes",
    """select category_id, dense_rank() over(order by category_id) as code, concat('class ',category_id) as name from (select distinct category_id from v_boxes where category_id<>5) c
    union all select null, 0, 'background'""",
)
def class_codes(v):
    cats = v.table("part").select((F.col("p_partkey") % 12).alias("category_id")).distinct().withColumn("name", F.concat(F.lit("class "), "category_id"))
    return ds.class_codes(v.boxes.filter("category_id <> 5"), cats)


@query("annotated_tasks", "select o_orderkey as task_id from orders where exists(select 1 from v_regions r where r.task_id=o_orderkey)")
def annotated_tasks(v):
    return ds.annotated_tasks(v.table("orders").select(F.col("o_orderkey").alias("task_id")), v.regions)


@query("drop_skipped", "select task_id, ord from v_regions r where not exists(select 1 from v_regions q where q.task_id=r.task_id group by q.task_id having count(*)=1 and bool_or(q.skipped))")
def drop_skipped(v):
    return ds.drop_skipped(v.regions).select("task_id", "ord")


@query("drop_skipped_annotations", "select task_id, ord from v_regions where not skipped")
def drop_skipped_annotations(v):
    return ds.drop_skipped(v.regions, "annotation").select("task_id", "ord")


@query("exclude_ids", "select * from v_images where image_id not in (1,7,12,40,41) and image_id not in (select image_id from v_boxes where category_id=3)")
def exclude_ids(v):
    return ds.exclude_ids(ds.exclude_ids(v.images, [1, 7, 12, 40, 41]), v.boxes.filter("category_id = 3"))


@query("filter_classes", "select image_id, ann_id, category_id from v_boxes where category_id in (2,4,9)")
def filter_classes(v):
    return ds.filter_classes(v.boxes, [2, 4, 9]).select("image_id", "ann_id", "category_id")


@query("class_mask", "select image_id, y, x, cls in (0,1,8) as mask, cls not in (10) as rest from v_pixels")
def class_mask(v):
    p = ds.class_mask(ds.class_mask(v.pixels, [0, 1, 8]), [10], inside=False, name="rest")
    return p.select("image_id", "y", "x", "mask", "rest")


@query("complete_crops", "select cast(image_id as varchar) as dir, image_id%3<>0 as has_raw, image_id%2=0 as has_proc from v_images where image_id%3<>0 and image_id%2=0")
def complete_crops(v):
    i = F.col("image_id")
    kinds = F.filter(F.array(F.when(i % 3 != 0, "raw"), F.when(i % 2 == 0, "proc"), F.lit("meta")), lambda k: k.isNotNull())
    listed = v.images.select(i.cast("string").alias("dir"), F.explode(kinds).alias("kind"))
    return ds.complete_crops(listed, need_proc=True)


@query("lookup_one", "select image_id, w, h from v_images where image_id=(select min(image_id) from v_images)")
def lookup_one(v):
    least = v.images.agg(F.min("image_id")).first()[0]
    return ds.lookup_one(v.images, "image_id", least)


@query(
    "annotation_text_pairs",
    """select d.doc_id as task_id, md5(text) as text_md5, case when quality=1 then 'good' else 'bad' end as choice, case when quality=1 then 1 else 0 end as label_idx
    from documents d join labels l on d.doc_id=l.doc_id where toxic=0""",
)
def annotation_text_pairs(v):
    choice = F.when(F.col("quality") == 1, "good").otherwise("bad")
    anns = F.array(F.struct((F.col("toxic") == 1).alias("skipped"), F.array(F.struct(F.array(choice).alias("choices"))).alias("result")))
    tasks = v.table("documents").join(v.table("labels"), "doc_id").select(F.col("doc_id").alias("task_id"), "text", anns.alias("annotations"))
    return ds.annotation_text_pairs(tasks, ["bad", "good"]).select("task_id", F.md5("text").alias("text_md5"), "choice", "label_idx")


@query(
    "labels_to_images",
    """select 'matched' as outcome, b.image_id, ann_id, w from (select image_id, ann_id from v_boxes) b join (select image_id, w from v_images where image_id%5<>0) i on b.image_id=i.image_id
    union all select 'missing', image_id, ann_id, null from v_boxes where image_id%5=0""",
)
def labels_to_images(v):
    labels = v.boxes.select(F.col("image_id").cast("string").alias("stem"), "image_id", "ann_id")
    images = v.images.filter("image_id % 5 <> 0").select(F.col("image_id").cast("string").alias("stem"), "w")
    matched, missing = ds.labels_to_images(labels, images)
    cols = ["outcome", "image_id", "ann_id", "w"]
    return matched.withColumn("outcome", F.lit("matched")).select(*cols).unionByName(
        missing.withColumn("outcome", F.lit("missing")).withColumn("w", F.lit(None).cast("bigint")).select(*cols)
    )


@query("images_with_masks", "select i.image_id, case when i.image_id%4=0 then null else concat(i.image_id,'.json') end as seg from v_images i")
def images_with_masks(v):
    stem = F.col("image_id").cast("string")
    masks = v.images.filter("image_id % 4 <> 0").select(stem.alias("stem"), F.concat(stem, F.lit(".json")).alias("seg"))
    return ds.images_with_masks(v.images.select(stem.alias("stem"), "image_id"), masks).select("image_id", "seg")


@query("name_classes", "select b.image_id, ann_id, coalesce(p.p_type, cast(b.class_id as varchar)) as class_name from (select image_id, ann_id, category_id*300 as class_id from v_boxes) b left join part p on p.p_partkey=b.class_id")
def name_classes(v):
    masks = v.boxes.select("image_id", "ann_id", (F.col("category_id") * 300).alias("class_id"))
    classes = v.table("part").select(F.col("p_partkey").alias("class_id"), F.col("p_type").alias("class_name"))
    return ds.name_classes(masks, classes).select("image_id", "ann_id", "class_name")


@query("resolve_masks", "select image_id, concat(image_id,'_',ann_id) as mask_name, concat('m/',image_id,'_',ann_id,'.png') as mask_path from v_boxes where ann_id%3<>0 and image_id in (select image_id from v_images where w>900)")
def resolve_masks(v):
    masks = v.boxes.select("image_id", "ann_id", F.concat_ws("_", "image_id", "ann_id").alias("mask_name"))
    listed = masks.filter("ann_id % 3 <> 0").select("mask_name", F.concat(F.lit("m/"), "mask_name", F.lit(".png")).alias("mask_path"))
    return ds.resolve_masks(masks, listed, v.images.filter("w > 900")).select("image_id", "mask_name", "mask_path")


@query("annotations_by_path", "select image_id, concat('/data/set/batch_',image_id%15,'/',image_id,'.jpg') as path from v_images where image_id%6<>0")
def annotations_by_path(v):
    i = F.col("image_id")
    name = F.concat(F.lit("batch_"), i % 15, F.lit("/"), i, F.lit(".jpg"))
    images = v.images.select("image_id", name.alias("file_name"))
    listed = v.images.filter("image_id % 6 <> 0").select(F.concat(F.lit("/data/set/"), name).alias("path"))
    return ds.annotations_by_path(images, listed).select("image_id", "path")


@query("annotations_by_image", "select b.image_id, ann_id, x, y, w, h from v_boxes b where image_id in (select image_id from v_images where h<700)")
def annotations_by_image(v):
    boxes = v.boxes.select("image_id", "ann_id", *[(F.col(c) + 0.75).alias(c) for c in "xywh"])
    return ds.annotations_by_image(v.images.filter("h < 700"), boxes)


@query("annotator_emails", "select o_orderkey as id, coalesce(a.c_name,'') as completed_by, coalesce(b.c_name,'') as updated_by from orders o left join customer a on o.o_custkey=a.c_custkey left join customer b on o.o_custkey*2=b.c_custkey")
def annotator_emails(v):
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("completed_by"), (F.col("o_custkey") * 2).alias("updated_by"))
    return ds.annotator_emails(rows, v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email")))


@query("apply_label_mapping", "select seq_id, t, case label when 'click' then 'CLK' when 'error' then 'ERR' else label end as label from v_rows")
def apply_label_mapping(v):
    names = v.table("events").select(F.col("event_type").alias("label")).distinct().filter(F.col("label").isin("click", "error"))
    mapping = names.withColumn("custom_label", F.when(F.col("label") == "click", "CLK").otherwise("ERR"))
    return ds.apply_label_mapping(v.rows.select("seq_id", "t", "label"), mapping)


@query(
    "pair_by_position",
    "select a.rn as pos, image_id, event_id from (select image_id, row_number() over(order by image_id) rn from v_images) a join (select event_id, row_number() over(order by event_id desc) rn from events) b on a.rn=b.rn",
)
def pair_by_position(v):
    events = v.table("events").select("event_id", (-F.col("event_id")).alias("k"))
    return ds.pair_by_position(v.images, events, ["image_id"], ["k"]).select("pos", "image_id", "event_id")


@query("masks_per_image", "select image_id, cast(floor((ann_id-1)/10000) as bigint) as part, string_agg(concat('m',ann_id,'_',category_id), ',' order by ann_id) as masks from v_boxes group by all")
def masks_per_image(v):
    masks = v.boxes.withColumn("mask_name", F.concat(F.lit("m"), "ann_id", F.lit("_"), "category_id"))
    return ds.masks_per_image(masks, chunk=F.floor(F.col("ann_id") / 10_000), hot=v.hot_boxes).withColumn("masks", F.array_join("masks", ","))


@query("batch_stats", "select round(avg(n),9) as mean_objects, min(n) as min_objects, max(n) as max_objects from (select count(*) as n from v_boxes group by image_id) q")
def batch_stats(v):
    return ds.batch_stats(v.boxes)


@query("next_run_id", "select printf('%03d', coalesce(max(run_id),1)+1) as run_id from v_params")
def next_run_id(v):
    dirs = v.params.select(F.lpad(F.col("run_id").cast("string"), 3, "0").alias("run_dir"))
    return ds.next_run_id(dirs.unionByName(dirs.withColumn("run_dir", F.concat(F.lit("tmp"), "run_dir"))))


@query("label_vocabulary", "select label, dense_rank() over(order by label)-1 as idx from (select distinct event_type as label from events) e")
def label_vocabulary(v):
    return ds.label_vocabulary(v.table("events").select(F.col("event_type").alias("label")))


@query(
    "label_vocabulary_bio",
    """with s as (select event_type, row_number() over(order by min(event_id)) rn from events group by event_type)
    select 'O' as label, 0 as idx union all select concat('B-',event_type), 2*rn-1 from s union all select concat('I-',event_type), 2*rn from s""",
)
def label_vocabulary_bio(v):
    return ds.label_vocabulary(v.table("events").select(F.col("event_type").alias("label"), "event_id"), "bio", "event_id")


@query(
    "label_vocabulary_background",
    "select 'background' as label, 0 as idx union all select event_type, row_number() over(order by min(event_id)) from events group by event_type",
)
def label_vocabulary_background(v):
    return ds.label_vocabulary(v.table("events").select(F.col("event_type").alias("label"), "event_id"), "background", "event_id")


@query("ordered_labels", "select distinct p_type as label from part")
def ordered_labels(v):
    return ds.ordered_labels(v.table("part").select(F.col("p_type").alias("label")))


@query("unknown_labels", "select distinct concat(p_type,'-',p_size) as label from part where p_size<=45")
def unknown_labels(v):
    used = v.table("part").select(F.concat_ws("-", "p_type", "p_size").alias("label"), "p_size")
    return ds.unknown_labels(used, used.filter("p_size > 45"))


@query(
    "matched_class_names",
    """with w as (select distinct lower(p_type) as name from part where p_size<40 union all select distinct concat('no such ', p_type) from part where p_size<3)
    select 'known' as outcome, w.name, k.p_type as known_name from w join (select distinct p_type from part) k on w.name=lower(k.p_type)
    union all select 'unknown', name, null from w where name not in (select lower(p_type) from part)""",
)
def matched_class_names(v):
    part = v.table("part")
    wanted = part.filter("p_size < 40").select(F.lower("p_type").alias("name")).distinct().unionByName(
        part.filter("p_size < 3").select(F.concat(F.lit("no such "), "p_type").alias("name")).distinct()
    )
    hit, miss = ds.matched_class_names(wanted, part.select(F.col("p_type").alias("name")))
    return hit.select(F.lit("known").alias("outcome"), "name", "known_name").unionByName(
        miss.select(F.lit("unknown").alias("outcome"), "name", F.lit(None).cast("string").alias("known_name"))
    )


@query(
    "added_lines",
    """with l as (select conv_id, turn, unnest(string_split(text, chr(10))) as line from conversations)
    select conv_id, md5(line) as line_md5 from (select conv_id, line from l where turn=1 except all select conv_id, line from l where turn=0) q""",
)
def added_lines(v):
    c = v.table("conversations")
    new = ds.added_lines(c.filter("turn = 0"), c.filter("turn = 1"), ["conv_id"])
    return new.select("conv_id", F.md5("line").alias("line_md5"))


@query("paths_present_both", "select cast(image_id as varchar) as stem from v_images where image_id in (select image_id from v_boxes)")
def paths_present_both(v):
    stem = F.col("image_id").cast("string").alias("stem")
    return ds.paths_present_both(v.images.select(stem), v.boxes.select(stem))


@query("even_chunks", "select image_id, ntile(7) over(order by image_id)-1 as chunk from v_images")
def even_chunks(v):
    return ds.even_chunks(v.images.select("image_id"), 7, ["image_id"])


@query("batches", "select image_id, cast(floor((row_number() over(order by image_id)-1)/50) as bigint) as batch from v_images")
def batches(v):
    return ds.batches(v.images.select("image_id"), 50, ["image_id"])


@query(
    "split_dataset",
    f"""select image_id, case when rn<=floor(n*0.7e0) then 'train' when rn<=floor(n*0.7e0)+floor(n*0.2e0) then 'val' else 'test' end as split
    from (select image_id, row_number() over(order by {sql_hash(42, 'image_id')}, image_id) rn, count(*) over() n from v_images) q""",
)
def split_dataset(v):
    return ds.split_dataset(v.images.select("image_id"))


@query(
    "holdout_split",
    f"""select path, label, rn<=floor(n*0.2e0) as is_valid from (select *, row_number() over(order by {sql_hash(42, 'path')}, path) rn, count(*) over() n
    from (select concat('crops/c',image_id%4,'/',image_id,'.png') as path, concat('c',image_id%4) as label from v_images) i) q""",
)
def holdout_split(v):
    i = F.col("image_id")
    return ds.holdout_split(v.images.select(F.concat(F.lit("crops/c"), i % 4, F.lit("/"), i, F.lit(".png")).alias("path")))


@query(
    "cycle_to_n",
    f"""with r as (select image_id, row_number() over(order by {sql_hash(9, 'image_id')}, image_id) rn, count(*) over() n from v_images),
    c as (select r.*, unnest(range(0, 3)) as cycle from r)
    select image_id, cycle, cycle*n+rn as pos from c where cycle*n+rn<=n*5//2""",
)
def cycle_to_n(v):
    images = v.images.select("image_id")
    return ds.cycle_to_n(images, F.floor(ds.total_rows(images) * F.lit(2.5)), 9)


@query(
    "file_inventory",
    """select cast(image_id as varchar) as stem, max(p) as path, arg_max(sf, p) as suffix, arg_max(d, p) as parent from (select image_id, d, sf, concat('set/', d, '/', image_id, sf) as p from v_images,
    (values ('a','.jpg'),('b','.PNG'),('c','.txt')) k(d, sf) where not (image_id%3=0 and d='b')) q where lower(sf)<>'.txt' group by image_id""",
)
def file_inventory(v):
    i = F.col("image_id")
    paths = F.array(F.concat(F.lit("set/a/"), i, F.lit(".jpg")), F.when(i % 3 != 0, F.concat(F.lit("set/b/"), i, F.lit(".PNG"))), F.concat(F.lit("set/c/"), i, F.lit(".txt")))
    return files.filter_suffixes(v.images.select(F.explode(paths).alias("path")).filter("path is not null"), ["jpg", "png"])

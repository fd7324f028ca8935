"""Annotation files: COCO, label exports, box label lines, segmentation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.operators.datasets import name_classes
from tilewright.operators.ordered import collect_parts
from tilewright.sources.json_arrays import json_elements

COCO_SCHEMA = (
    "images array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>,"
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,segmentation:array<array<double>>>>,"
    "categories array<struct<id:bigint,name:string,supercategory:string>>"
)
EXPORT_SCHEMA = (
    "id bigint, data map<string,string>,"
    "annotations array<struct<completed_by:bigint,updated_by:bigint,was_cancelled:boolean,"
    "result array<struct<id:string,from_name:string,to_name:string,type:string,value:string,original_width:bigint,original_height:bigint>>>>"
)
EXPORT_SCHEMA = EXPORT_SCHEMA.replace("result array", "result:array")


def read_coco(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations, categories of COCO documents of any size, or of JSON lines without `multiline`.

    A large document is split over tasks and parsed once, element by element.
    """
    if multiline:
        found = json_elements(spark, path, 2)
        types = {f.name: f.dataType.elementType for f in StructType.fromDDL(COCO_SCHEMA).fields}
        part = lambda name: found.filter(F.col("section") == name).select(F.from_json("text", types[name]).alias("e")).select("e.*")
    else:
        doc = spark.read.schema(COCO_SCHEMA).json(path)
        part = lambda name: doc.select(F.inline(name))
    box = F.col("bbox")
    annotations = part("annotations").select(
        "id", "image_id", "category_id", "bbox", "segmentation",
        *[F.try_element_at(box, F.lit(i + 1)).alias(n) for i, n in enumerate("xywh")],
    )
    return part("images"), annotations, part("categories").distinct()


def read_label_export(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per region; tasks and annotations without regions keep a row with null region columns.

    An export is one array of tasks of any size, split over tasks, or JSON lines without `multiline`.
    """
    if multiline:
        tasks = json_elements(spark, path, 1).filter("section = ''").select(F.from_json("text", EXPORT_SCHEMA).alias("e")).select("e.*")
    else:
        tasks = spark.read.schema(EXPORT_SCHEMA).json(path)
    anns = tasks.select(F.col("id").alias("task_id"), "data", F.posexplode_outer("annotations").alias("annotation_index", "a"))
    flat = anns.select(
        "task_id", "data", "annotation_index", "a.completed_by", "a.updated_by", "a.was_cancelled",
        F.posexplode_outer("a.result").alias("region_index", "r"),
    )
    return flat.select(
        "task_id", "data", "annotation_index", "region_index", "completed_by", "updated_by", "was_cancelled",
        F.col("r.id").alias("region_id"), "r.from_name", "r.to_name", "r.type", "r.value", "r.original_width", "r.original_height",
    )


def rle_value(regions: DataFrame) -> DataFrame:
    """Typed run-length value of brush regions."""
    value = F.from_json("value", "format string, rle array<int>, brushlabels array<string>")
    return regions.withColumn("brush", value).select(*regions.columns, "brush.*")


def parse_yolo_lines(lines: DataFrame) -> DataFrame:
    """(stem, line) rows to class and normalised centre box."""
    part = F.split(F.trim("line"), r"\s+")
    names = ["xc", "yc", "w", "h"]
    return lines.filter(F.trim("line") != "").select(
        "stem", F.get(part, F.lit(0)).cast("int").alias("cls"), *[F.get(part, F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)]
    )


def read_yolo_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of all `.txt` label files; a file belongs to the `stem=...` folder above it, else its own name is the stem."""
    text = spark.read.text(directory, pathGlobFilter="*.txt", recursiveFileLookup=True)
    own = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    folder = F.regexp_extract("_metadata.file_path", r"/stem=([^/]+)/[^/]*$", 1)
    stem = F.when(folder != "", F.url_decode(folder)).otherwise(own)
    return parse_yolo_lines(text.select(stem.alias("stem"), F.col("value").alias("line")))


def yolo_line(cls, x, y, w, h, img_w, img_h):
    """Text of one label line, numbers to 6 decimals."""
    num = lambda e: F.format_string("%.6f", F.round(e, 6))
    return F.concat_ws(
        " ", cls.cast("string"), num((x + w / 2) / img_w), num((y + h / 2) / img_h), num(w / img_w), num(h / img_h)
    )


def write_yolo_labels(boxes: DataFrame, images: DataFrame, order: str = "ann_id", part_size: int = 10_000, chunk=None, hot: bool | None = None) -> DataFrame:
    """Newline-joined label text per image.

    A text holds at most `part_size` lines; an image with more has further parts, which
    the sink appends in part order.
    """
    sized = boxes.select("image_id", order, "category_id", "x", "y", "w", "h").join(
        images.select("image_id", F.col("w").alias("_iw"), F.col("h").alias("_ih")), "image_id"
    )
    c = F.col
    line = yolo_line(c("category_id"), c("x"), c("y"), c("w"), c("h"), c("_iw"), c("_ih"))
    parts = collect_parts(sized, ["image_id"], [order], line, part_size, chunk, hot)
    return parts.select("image_id", "part", F.array_join("items", "\n").alias("text"))


def save_yolo_labels(texts: DataFrame, directory: str, stem: str = "image_id") -> None:
    """One `.txt` label file for each stem, parts in order, which `read_yolo_labels` reads back.

    A stem's rows meet in one task and are streamed to its file; a file's size is that of its labels.
    """
    rows = texts.select(F.col(stem).cast("string").alias("stem"), "part", "text")
    rows.repartition("stem").sortWithinPartitions("stem", "part").select("stem", "text").write.partitionBy("stem").text(directory)


def read_segmentation_csv(spark: SparkSession, directory: str) -> DataFrame:
    """Mask rows with class display names; classes.csv has no header."""
    masks = spark.read.csv(f"{directory}/segmentations.csv", header=True, schema="MaskPath string, ImageID string, LabelName string")
    classes = spark.read.csv(f"{directory}/classes.csv", header=False, schema="class_id string, class_name string")
    renamed = masks.select(F.col("ImageID").alias("image_id"), F.col("MaskPath").alias("mask_name"), F.col("LabelName").alias("class_id"))
    return name_classes(renamed, classes)

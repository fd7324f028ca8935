"""Model outputs to regions: thresholds, label maps, key points, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import top_per_group

NO_ENTITY_SCORE = 2.0  # fixed value: score of a task without any entity


def label_map(ui_labels: DataFrame, model_labels: DataFrame) -> DataFrame:
    """(model_label, ui_label) from UI labels (label, ord, predicted_values).

    A UI label maps the model labels its comma list names; with none, the equal model
    label; else its lower-cased name where the model has one equal but for case. Later UI
    labels win a model label.
    """
    models = model_labels.select("name").distinct()
    listed = ui_labels.select("label", "ord", F.explode(F.split(F.coalesce("predicted_values", F.lit("")), ",")).alias("v"))
    listed = listed.withColumn("name", F.trim("v")).filter("name <> ''").join(models, "name")
    tier1 = listed.select("name", "label", "ord")
    rest = ui_labels.select("label", "ord").join(tier1.select("label").distinct(), "label", "left_anti")
    tier2 = rest.join(models.select("name", F.col("name").alias("label")), "label")
    rest = rest.join(tier2.select("label").distinct(), "label", "left_anti")
    lowered = models.select(F.lower("name").alias("_low")).distinct()
    tier3 = rest.withColumn("_low", F.lower("label")).join(lowered, "_low").select(F.col("_low").alias("name"), "label", "ord")
    pairs = tier1.unionByName(tier2.select("name", "label", "ord")).unionByName(tier3)
    best = top_per_group(pairs, ["name"], [F.desc("ord")], 1)
    return best.select(F.col("name").alias("model_label"), F.col("label").alias("ui_label"))


def filter_regions(dets: DataFrame, mapping: DataFrame, thr: float) -> DataFrame:
    """Detections with score >= thr and a mapped label, with that label."""
    return dets.filter(F.col("score") >= thr).join(mapping, "model_label").drop("model_label")


def pick_choice(probs: DataFrame, mapping: DataFrame, thr: float, mode: str = "single", keys: Sequence[str] = ("video_id", "frame")) -> DataFrame:
    """Choice region per item.

    single: best label among the mapped ones. multi: all labels with prob >= thr; unmapped
    ones count in the mean score but give no choice. Items scoring under thr have no row.
    """
    keys = list(keys)
    maps = mapping.select(F.col("model_label").alias("label"), "ui_label")
    if mode == "single":
        mapped = probs.join(maps, "label")
        best = F.max_by(F.struct("ui_label", "prob"), F.struct(F.col("prob"), -F.col("label_idx")))
        out = mapped.groupBy(*keys).agg(best.alias("b")).select(*keys, F.array("b.ui_label").alias("choices"), F.col("b.prob").alias("score"))
    elif mode == "multi":
        kept = probs.filter(F.col("prob") >= thr).join(maps, "label", "left")
        named = F.when(F.col("ui_label").isNotNull(), F.struct("label_idx", "ui_label"))
        grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(named)).alias("l"), F.avg("prob").alias("score"))
        out = grouped.select(*keys, F.col("l.ui_label").alias("choices"), "score")
    else:
        raise ValueError(f"unknown choice mode {mode}")
    return out.filter(F.col("score") >= thr)


def parent_regions(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with the id of their box, by image and box index."""
    ids = boxes.select("image_id", "bbox_index", F.concat(F.lit("bbox-"), "bbox_index").alias("parent_id"))
    return points.join(ids, ["image_id", "bbox_index"])


def filter_keypoints(points: DataFrame, boxes: DataFrame, mapping: DataFrame, point_map: DataFrame, thr: float, point_thr: float) -> DataFrame:
    """Key points of good boxes and the boxes as their parents, as one region table.

    `point_map` has key `model_label::index` and point_label.
    """
    good = boxes.filter(F.col("score") >= thr).join(mapping.select("model_label"), "model_label", "left_semi")
    parents = good.select(
        "image_id", "bbox_index", F.lit(None).cast("bigint").alias("point_index"), F.lit("rectanglelabels").alias("type"),
        F.col("model_label").alias("label"), F.concat(F.lit("bbox-"), "bbox_index").alias("region_id"), F.lit(None).cast("string").alias("parent_id"), "score",
    )
    named = points.filter(F.col("conf") >= point_thr).join(good.select("image_id", "bbox_index", "model_label"), ["image_id", "bbox_index"])
    named = named.withColumn("key", F.concat_ws("::", "model_label", "point_index")).join(point_map, "key")
    kids = named.select(
        "image_id", "bbox_index", F.col("point_index").cast("bigint").alias("point_index"), F.lit("keypointlabels").alias("type"),
        F.col("point_label").alias("label"), F.lit(None).cast("string").alias("region_id"), F.concat(F.lit("bbox-"), "bbox_index").alias("parent_id"), F.col("conf").alias("score"),
    )
    return parents.unionByName(kids)


def prediction_score(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean region score per task, 0 without regions."""
    mean = regions.groupBy("task_id").agg(F.avg("score").alias("score"))
    return tasks.select("task_id").join(mean, "task_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def least_confident(tasks: DataFrame, spans: DataFrame) -> DataFrame:
    """Least entity score per task, 2.0 without entities; scores count to 4 decimals."""
    low = spans.groupBy("task_id").agg(F.min(F.round("score", 4)).alias("score"))
    return tasks.select("task_id").join(low, "task_id", "left").withColumn("score", F.coalesce("score", F.lit(NO_ENTITY_SCORE)))


def best_mask(cands: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Highest-scoring candidate per prompt, the lowest `tie` on equal scores."""
    return top_per_group(cands, keys, [F.desc("score"), F.col(tie)], 1)

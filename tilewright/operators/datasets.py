"""Joins, filters, splits and checks on image / annotation / label tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.hashing import as_col
from tilewright.operators.ordered import collect_parts, number_rows, shuffle_rank, top_per_group


def total_rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


# ---- joins ---------------------------------------------------------------


def labels_to_images(labels: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with their image by stem, and the labels without one."""
    return labels.join(images, "stem"), labels.join(images.select("stem"), "stem", "left_anti")


def images_with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(masks, "stem", "left")


def name_classes(masks: DataFrame, classes: DataFrame) -> DataFrame:
    """Display name of a class id, the id itself when unknown."""
    named = masks.join(classes.select("class_id", "class_name"), "class_id", "left")
    return named.withColumn("class_name", F.coalesce("class_name", F.col("class_id").cast("string")))


def resolve_masks(masks: DataFrame, files: DataFrame, images: DataFrame) -> DataFrame:
    """Mask names to paths; masks without a file and masks of absent images go."""
    return masks.join(files.select("mask_name", "mask_path"), "mask_name").join(images.select("image_id"), "image_id", "left_semi")


def last_two_parts(path) -> Column:
    parts = F.split(as_col(path), "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1))


def annotations_by_path(images: DataFrame, files: DataFrame) -> DataFrame:
    """Join on folder and file name, whatever comes before."""
    left = images.withColumn("_key", last_two_parts("file_name"))
    right = files.select(F.col("path"), last_two_parts("path").alias("_key"))
    return left.join(right, "_key").drop("_key")


def annotations_by_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of the given images, box numbers cut to integers."""
    cut = annotations
    for c in ("x", "y", "w", "h"):
        cut = cut.withColumn(c, F.col(c).cast("bigint"))
    return cut.join(images.select("image_id"), "image_id", "left_semi")


def annotator_emails(annotations: DataFrame, users: DataFrame, columns: Sequence[str] = ("completed_by", "updated_by")) -> DataFrame:
    """User ids to email, '' when unknown."""
    out = annotations
    for c in columns:
        who = users.select(F.col("user_id").alias(f"_{c}"), F.col("email").alias(f"_e_{c}"))
        out = out.join(who, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_e_{c}", F.lit(""))).drop(f"_{c}", f"_e_{c}")
    return out.select(*annotations.columns)


def apply_label_mapping(spans: DataFrame, mapping: DataFrame) -> DataFrame:
    renamed = mapping.select("label", F.col("custom_label").alias("_to"))
    return spans.join(renamed, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to").select(*spans.columns)


def pair_by_position(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """i-th row with i-th row, cut to the shorter side."""
    a = number_rows(left, keys, left_order, "pos")
    b = number_rows(right, keys, right_order, "pos")
    return a.join(b, [*keys, "pos"])


# ---- filters -------------------------------------------------------------


def annotated_tasks(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    return tasks.join(regions.select("task_id"), "task_id", "left_semi")


def annotated_nested(tasks: DataFrame) -> DataFrame:
    """Same on nested task rows."""
    return tasks.filter(F.exists("annotations", lambda a: F.size(a["result"]) > 0))


def drop_skipped(annotations: DataFrame, level: str = "task") -> DataFrame:
    """level 'annotation': drop skipped rows. level 'task': drop tasks whose only annotation is skipped."""
    if level == "annotation":
        return annotations.filter(~F.coalesce("skipped", F.lit(False)))
    skipped = (
        annotations.groupBy("task_id")
        .agg(F.count("*").alias("n"), F.bool_or(F.coalesce("skipped", F.lit(False))).alias("s"))
        .filter((F.col("n") == 1) & F.col("s"))
    )
    return annotations.join(skipped.select("task_id"), "task_id", "left_anti")


def exclude_ids(df: DataFrame, ids: Sequence | DataFrame, key: str = "image_id") -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_anti")
    return df.filter(~F.col(key).isin(list(ids)))


def filter_classes(masks: DataFrame, classes: Sequence) -> DataFrame:
    """Masks of wanted classes; images without any are gone with their rows."""
    return masks.filter(F.col("category_id").isin(list(classes)))


def class_mask(pixels: DataFrame, classes: Sequence[int], inside: bool = True, name: str = "mask") -> DataFrame:
    hit = F.col("cls").isin(list(classes))
    return pixels.withColumn(name, hit if inside else ~hit)


def complete_crops(files: DataFrame, need_proc: bool = False) -> DataFrame:
    """Crop folders with a raw file, optionally also a processed one."""
    by_dir = files.groupBy("dir").agg(
        F.bool_or(F.col("kind") == "raw").alias("has_raw"), F.bool_or(F.col("kind") == "proc").alias("has_proc")
    )
    return by_dir.filter(F.col("has_raw") & F.col("has_proc") if need_proc else F.col("has_raw"))


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    """The row with this key; no row and several rows are both errors."""
    found = df.filter(F.col(key) == value).agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("r"))
    checked = (
        F.when(F.col("n") == 0, F.raise_error(F.lit(f"no row with {key}={value}")))
        .when(F.col("n") > 1, F.raise_error(F.lit(f"corrupted: several rows with {key}={value}")))
        .otherwise(F.lit(True))
    )
    return found.filter(checked).select("r.*")


def annotation_text_pairs(tasks: DataFrame, labels: Sequence[str], per_region: bool = False) -> DataFrame:
    """(task_id, text, choice, label index) of annotations that are not skipped.

    The first region counts, or with `per_region` every choice region gives a row.
    """
    anns = tasks.select("task_id", "text", F.posexplode("annotations").alias("annotation_index", "a"))
    anns = anns.filter(~F.coalesce("a.skipped", F.lit(False)))
    if per_region:
        regions = anns.select("task_id", "text", "annotation_index", F.posexplode("a.result").alias("region_index", "r"))
    else:
        regions = anns.select("task_id", "text", "annotation_index", F.lit(0).alias("region_index"), F.get("a.result", F.lit(0)).alias("r"))
    choice = F.get("r.choices", F.lit(0))
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), choice) - 1
    return regions.withColumn("choice", choice).filter(F.col("choice").isNotNull()).select(
        "task_id", "text", "annotation_index", "region_index", "choice", index.alias("label_idx")
    )


# ---- vocabularies, names, unions ----------------------------------------


def class_codes(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Used category ids to dense codes 1.., in id order, with 0 for the background."""
    used = annotations.select("category_id").distinct()
    coded = number_rows(used, [], ["category_id"], "code").join(categories.select("category_id", "name"), "category_id", "left")
    base = annotations.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("category_id"), F.lit(0).cast("bigint").alias("code"), F.lit("background").alias("name")
    )
    return base.unionByName(coded.select(F.col("category_id").cast("bigint"), "code", "name"))


def assign_names(df: DataFrame, cols: Sequence[str], k: int = 10, name: str = "name", hash_fn=None) -> DataFrame:
    """Short name per row from a hash of `cols`; two rows with one name are an error."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
    digest = F.sha2(text, 256) if hash_fn is None else hash_fn(text)
    named = df.withColumn(name, F.substring(digest, 1, k))
    twice = named.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1")
    checked = named.join(twice, name, "left")
    ok = F.when(F.col("_n").isNotNull(), F.raise_error(F.concat(F.lit("name used twice: "), F.col(name)))).otherwise(F.lit(True))
    return checked.filter(ok).select(*df.columns, name)


def collate_datasets(datasets: Sequence[tuple[DataFrame, DataFrame]], k: int = 16, hash_fn=None) -> DataFrame:
    """Union of (images, masks) pairs with one new name per pair; an image without mask is an error."""
    whole = None
    for i, (images, masks) in enumerate(datasets):
        pairs = images.select("stem", F.col("path").alias("image_path")).join(
            masks.select("stem", F.col("path").alias("mask_path")), "stem", "left"
        )
        pairs = pairs.select(F.lit(i).alias("dataset"), "stem", "image_path", "mask_path")
        whole = pairs if whole is None else whole.unionByName(pairs)
    ok = F.when(F.col("mask_path").isNull(), F.raise_error(F.concat(F.lit("no mask for "), F.col("image_path")))).otherwise(F.lit(True))
    return assign_names(whole.filter(ok), ["dataset", "stem"], k, hash_fn=hash_fn)


def label_vocabulary(labels: DataFrame, form: str = "sorted", order: str | None = None) -> DataFrame:
    """label, idx.

    'sorted': sorted distinct labels from 0. 'background': given order from 1 after
    'background' 0. 'bio': first-seen order, O then B-x / I-x pairs.
    """
    spark = labels.sparkSession
    if form == "sorted":
        distinct = labels.select("label").distinct()
        return number_rows(distinct, [], ["label"], "_rn").select("label", (F.col("_rn") - 1).alias("idx"))
    seen = labels.groupBy("label").agg(F.min(order).alias("_at"))
    ranked = number_rows(seen, [], ["_at", "label"], "_rn")
    if form == "background":
        zero = spark.range(1).select(F.lit("background").alias("label"), F.lit(0).cast("bigint").alias("idx"))
        return zero.unionByName(ranked.select("label", F.col("_rn").alias("idx")))
    zero = spark.range(1).select(F.lit("O").alias("label"), F.lit(0).cast("bigint").alias("idx"))
    pair = F.array(
        F.struct(F.concat(F.lit("B-"), "label").alias("label"), (2 * F.col("_rn") - 1).alias("idx")),
        F.struct(F.concat(F.lit("I-"), "label").alias("label"), (2 * F.col("_rn")).alias("idx")),
    )
    return zero.unionByName(ranked.select(F.inline(pair)))


def ordered_labels(labels: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct labels in given or sorted order."""
    if order is None:
        return labels.select("label").distinct().orderBy("label")
    return labels.groupBy("label").agg(F.min(order).alias("pos")).orderBy("pos", "label")


def unknown_labels(used: DataFrame, declared: DataFrame) -> DataFrame:
    return used.select("label").subtract(declared.select("label"))


def matched_class_names(wanted: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known names equal to a wanted one but for case, and the wanted names not known."""
    w = wanted.select("name", F.lower("name").alias("_k"))
    k = known.select(F.col("name").alias("known_name"), F.lower("name").alias("_k")).distinct()
    return w.join(k, "_k").drop("_k"), w.join(k, "_k", "left_anti").drop("_k")


def added_lines(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of the new text that the old one has not (as a multiset)."""

    def lines(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.explode(F.split("text", "\n")).alias("line"))

    return lines(new).exceptAll(lines(old))


def paths_present_both(a: DataFrame, b: DataFrame, key: str = "stem") -> DataFrame:
    return a.select(key).intersect(b.select(key))


# ---- counts --------------------------------------------------------------


def masks_per_image(
    masks: DataFrame, order: Sequence[str] = ("ann_id",), value: str = "mask_name", part_size: int = 10_000, chunk=None, hot: bool | None = None
) -> DataFrame:
    """Ordered mask list per image, in parts of bounded length; whether an image is `hot` is counted if not told."""
    return collect_parts(masks, ["image_id"], list(order), F.col(value), part_size, chunk, hot).withColumnRenamed("items", "masks")


def batch_stats(boxes: DataFrame) -> DataFrame:
    """Mean, least and most objects per image."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    return per.agg(F.round(F.avg("n"), 9).alias("mean_objects"), F.min("n").alias("min_objects"), F.max("n").alias("max_objects"))


def next_run_id(runs: DataFrame, col: str = "run_dir") -> DataFrame:
    """Greatest numeric folder name (1 if none) plus one, three digits."""
    number = F.when(F.col(col).rlike("^[0-9]+$"), F.col(col).try_cast("bigint"))
    return runs.agg((F.coalesce(F.max(number), F.lit(1)) + 1).alias("_n")).select(F.format_string("%03d", "_n").alias("run_id"))


# ---- splits --------------------------------------------------------------


def even_chunks(df: DataFrame, n: int, order: Sequence[str], name: str = "chunk") -> DataFrame:
    """n runs of rows as even as possible, the first ones one longer; numbered from 0."""
    if n <= 0:
        raise ValueError("the number of chunks must be positive")
    numbered = number_rows(df, [], order, "_rn").withColumn("_n", total_rows(df))
    size, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    at, long_rows = F.col("_rn") - 1, F.col("_n") % n * (F.floor(F.col("_n") / n) + 1)
    where = F.when(at < long_rows, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - long_rows) / F.greatest(size, F.lit(1))))
    return numbered.select(*df.columns, where.alias(name))


def batches(df: DataFrame, size: int, order: Sequence[str], name: str = "batch") -> DataFrame:
    numbered = number_rows(df, [], order, "_rn")
    return numbered.select(*df.columns, F.floor((F.col("_rn") - 1) / size).alias(name))


def split_dataset(df: DataFrame, train: float = 0.7, val: float = 0.2, test: float = 0.1, seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """Exact-size train / val / test split in seeded shuffle order."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    ranked = shuffle_rank(df, id_col, seed, name="_rn").withColumn("_n", total_rows(df))
    first = F.floor(F.col("_n") * F.lit(float(train)))
    second = first + F.floor(F.col("_n") * F.lit(float(val)))
    split = F.when(F.col("_rn") <= first, "train").when(F.col("_rn") <= second, "val").otherwise("test")
    return ranked.select(*df.columns, split.alias("split"))


def holdout_split(files: DataFrame, pct: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded share of rows as validation; the label is the parent folder."""
    ranked = shuffle_rank(files, "path", seed, name="_rn").withColumn("_n", total_rows(files))
    valid = F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(pct)))
    label = F.try_element_at(F.split("path", "/"), F.lit(-2))
    return ranked.select(*files.columns, label.alias("label"), valid.alias("is_valid"))


def cycle_to_n(df: DataFrame, n: int | Column, seed: int, id_col: str = "image_id") -> DataFrame:
    """A shuffled list repeated until it has n rows; `pos` runs from 1 to n (a number or a scalar column)."""
    ranked = shuffle_rank(df, id_col, seed, name="_rn").withColumn("_n", total_rows(df)).withColumn("_to", n if isinstance(n, Column) else F.lit(n))
    copies = F.floor((F.col("_to") - F.col("_rn")) / F.col("_n"))
    repeated = ranked.filter(F.col("_rn") <= F.col("_to")).withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
    return repeated.select(*df.columns, "cycle", (F.col("cycle") * F.col("_n") + F.col("_rn")).alias("pos"))


def path_exists_kinds(files: DataFrame, keys: Sequence[str], kind: str, needed: Sequence[str]) -> DataFrame:
    """Keys that have a file of every needed kind."""
    seen = files.groupBy(*keys).agg(*[F.bool_or(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(needed)])
    for i in range(len(needed)):
        seen = seen.filter(F.col(f"_{i}"))
    return seen.select(*keys)

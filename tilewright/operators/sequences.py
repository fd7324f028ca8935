"""Labelled sequences: range labels, runs, windows, tracks and their metrics.

Sequences are rows (seq_id, t, ...) with dense t from 1; any sequence may be huge, so
ordered steps go through the chunked helpers and range joins through time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import collect_parts, islands, number_rows, position_chunk, running
from tilewright.operators.range_labels import last_covering

BACKGROUND = "background"


# ---- ranges to rows ------------------------------------------------------


def until_ground_truth(ranges: DataFrame) -> DataFrame:
    """Ranges up to and including the first ground-truth annotation of their sequence."""
    stop = ranges.filter("ground_truth").groupBy("seq_id").agg(F.min("ord").alias("_stop"))
    kept = ranges.join(stop, "seq_id", "left")
    return kept.filter(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))).drop("_stop")


def label_rows(rows: DataFrame, ranges: DataFrame, background=BACKGROUND) -> DataFrame:
    """Label of the last range (by `ord`) that covers each row, both ends included; range ends take the rows' time type."""
    kind = rows.schema["t"].dataType
    usable = until_ground_truth(ranges).select("seq_id", "ord", F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"), "label")
    return last_covering(rows, usable).withColumn("range_label", F.coalesce("range_label", F.lit(background)))


def label_frames(ranges: DataFrame, labels: Sequence[str], n: int | None = None) -> DataFrame:
    """0/1 per (video, frame, label) from frame ranges, 1-based and inclusive.

    A video has n frames, or as many as its greatest range end.
    """
    set_frames = ranges.withColumn("frame", F.explode(F.sequence("lo", "hi"))).select("video_id", "frame", "label").distinct()
    sizes = ranges.groupBy("video_id").agg(F.max("hi").alias("_n") if n is None else F.lit(n).cast("bigint").alias("_n"))
    grid = sizes.withColumn("frame", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    hit = set_frames.withColumn("value", F.lit(1))
    return grid.drop("_n").join(hit, ["video_id", "frame", "label"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def first_of_region(regions: DataFrame) -> DataFrame:
    """Only the first range and the first label of each region, as (video_id, lo, hi, label)."""
    r = F.get("ranges", F.lit(0))
    return regions.select("video_id", r["start"].alias("lo"), r["end"].alias("hi"), F.get("labels", F.lit(0)).alias("label"))


# ---- runs ----------------------------------------------------------------


def dense_positions(rows: DataFrame, clock: str, keys: Sequence[str] = ("seq_id",), name: str = "t") -> DataFrame:
    """Add the place 1, 2, ... of each row in its sequence's order of `clock`, which may be any time or number.

    Windows, padding and chunks count by such places; times of equal value are an error of the input.
    """
    source = rows if clock != name else rows.withColumnRenamed(name, "_clock")
    out = number_rows(source, list(keys), [clock if clock != name else "_clock"], name if clock != name else "_place")
    return out if clock != name else out.drop("_clock").withColumnRenamed("_place", name)


def segments(rows: DataFrame, background: str | None = BACKGROUND, label: str = "label", chunk: Column | None = None) -> DataFrame:
    """Runs of equal consecutive labels: start, end, mean score, instant.

    `t` may be any clock: without `chunk` sequences are cut at quantiles of it, so chunks hold
    many rows whatever its unit; `position_chunk("t")` saves that pass for dense positions.
    """
    runs = islands(rows.select("seq_id", "t", label, "score"), ["seq_id"], ["t"], [label], "_run", chunk)
    out = runs.groupBy("seq_id", "_run").agg(
        F.first(label).alias("label"), F.min("t").alias("start"), F.max("t").alias("end"), F.avg("score").alias("score")
    ).drop("_run")
    out = out.withColumn("instant", F.col("start") == F.col("end"))
    return out if background is None else out.filter(F.col("label") != background)


def sequence_score(found: DataFrame) -> DataFrame:
    return found.groupBy("seq_id").agg(F.avg("score").alias("score"))


def threshold_segments(probs: DataFrame, thr: float) -> DataFrame:
    """Frames are dense numbers from 1. Per label the maximal frame runs with prob >= thr; `id` is idx_start_end, idx in order of opening."""
    state = probs.withColumn("_on", F.col("prob") >= thr)
    runs = islands(state, ["video_id", "label_idx"], ["frame"], ["_on"], "_run", position_chunk("frame"))
    found = runs.filter("_on").groupBy("video_id", "label_idx", "label", "_run").agg(
        F.min("frame").alias("start"), F.max("frame").alias("end"), F.avg("prob").alias("score")
    )
    ranked = number_rows(found.drop("_run"), ["video_id"], ["start", "label_idx"], "_rn", position_chunk("start"))
    idx = F.col("_rn") - 1
    return ranked.select("video_id", "label", "start", "end", "score", F.concat_ws("_", idx, "start", "end").alias("id"))


def entity_spans(tokens: DataFrame, split_on_b: bool = False) -> DataFrame:
    """Spans of consecutive tokens with one entity type, from B-/I-/O tags; mean score.

    Neighbouring entities of one type fuse unless `split_on_b`.
    """
    rows = tokens.withColumn("entity", F.regexp_replace("label", "^[BI]-", ""))
    state: list = ["entity"]
    if split_on_b:
        rows = running(rows, ["seq_id"], ["t"], sums={"_b": F.col("label").startswith("B-").cast("bigint")}, chunk=position_chunk("t"))
        state = ["entity", F.when(F.col("entity") != "O", F.col("_b"))]
    runs = islands(rows, ["seq_id"], ["t"], state, "_run", position_chunk("t"))
    return runs.filter("entity <> 'O'").groupBy("seq_id", "_run").agg(
        F.first("entity").alias("entity"), F.min("t").alias("start"), F.max("t").alias("end"), F.avg("score").alias("score")
    ).drop("_run")


# ---- tracks --------------------------------------------------------------


def track_lifespans(boxes: DataFrame) -> DataFrame:
    """enabled=false on the box before a frame gap and on the last box."""
    keys = ["video_id", "track_id"]
    ahead = running(boxes, keys, ["frame"], following={"_next": "frame"}, chunk=position_chunk("frame"))
    gap = F.col("_next").isNull() | (F.col("_next") - F.col("frame") > 1)
    return ahead.withColumn("enabled", ~gap).drop("_next")


def track_summary(boxes: DataFrame, label: str | None = None) -> DataFrame:
    """Per track: boxes, first and last frame, greatest score, and the label of the last box."""
    aggs = [F.count("*").alias("boxes"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("score").alias("score")]
    if label:
        aggs.append(F.max_by(label, "frame").alias("label"))
    return boxes.groupBy("video_id", "track_id").agg(*aggs)


def track_regions(boxes: DataFrame, value: Column, label: str | None = None, part_size: int = 10_000) -> DataFrame:
    """Summary of each track with its ordered box sequence, in parts of bounded length."""
    keys = ["video_id", "track_id"]
    parts = collect_parts(boxes, keys, ["frame"], value, part_size, position_chunk("frame"))
    return parts.withColumnRenamed("items", "sequence").join(track_summary(boxes, label), keys)


# ---- windows -------------------------------------------------------------


def sequence_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"))


def window_step(size: int, overlap: float) -> int:
    return max(1, int(size * (1 - overlap)))


def sliding_windows(rows: DataFrame, size: int, overlap: float = 0.5) -> DataFrame:
    """Windows of `size` rows of each sequence that is long enough, with a tail window to its end.

    Every row names the windows it is in, so nothing is compared with anything; (start, pos) are from 0.
    """
    step = window_step(size, overlap)
    long = sequence_lengths(rows).filter(F.col("n") >= size)
    at = F.col("t") - 1
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step))
    last = F.least(F.floor(at / step), F.floor((F.col("n") - size) / step))
    regular = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: (k * step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.col("n") - size
    has_tail = (F.floor(tail / step) * step < tail) & (at >= tail)
    starts = F.concat(regular, F.when(has_tail, F.array(tail)).otherwise(F.array().cast("array<bigint>")))
    return rows.join(long, "seq_id").withColumn("start", F.explode(starts)).withColumn("pos", at - F.col("start")).drop("n")


def pad_sequences(rows: DataFrame, size: int, mode: str = "reflect", values: Sequence[str] = ("score",), label: str | None = None) -> DataFrame:
    """Sequences shorter than `size` padded to one window of (pos, values, label).

    reflect: rows of the reversed sequence on both sides, the odd one in front; edge: first
    and last row repeated, size // 2 in front; zero: centred between zeros. Labels are -1
    on padding and stand where their row stands; a single row labels the whole window.
    """
    if mode not in ("reflect", "edge", "zero"):
        raise ValueError(f"unknown padding mode {mode}")
    short = sequence_lengths(rows).filter(F.col("n") < size)
    n, pos = F.col("n"), F.col("pos")
    pad = F.lit(size) - n
    centred = F.floor(pad / 2)
    zero = F.lit(mode == "zero") | (F.lit(mode == "reflect") & (n == 1))
    front = F.when(zero, centred).otherwise(F.lit(size // 2) if mode == "edge" else F.floor(pad / 2) + pad % 2)
    grid = short.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")))).withColumn("_front", front)
    at = pos - F.col("_front")
    real = (at >= 0) & (at < n)
    if mode == "edge":
        source = F.greatest(F.lit(0), F.least(n - 1, at))
    else:
        mirrored = F.when(at < 0, n - 1 - pos % n).otherwise(n - 1 - (at - n) % n)
        source = F.when(real, at).when(~zero, mirrored)
    grid = grid.select("seq_id", "n", "pos", real.alias("real"), (source + 1).cast("bigint").alias("t"))
    take = rows.join(short.select("seq_id"), "seq_id", "left_semi").select("seq_id", "t", *values, *([label] if label else []))
    joined = grid.join(take, ["seq_id", "t"], "left")
    out = ["seq_id", "pos", "real", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]]
    if label:
        if mode == "reflect":
            only = rows.groupBy("seq_id").agg(F.first(label).alias("_only"))
            joined = joined.join(only, "seq_id")
            shown = F.when(n == 1, F.col("_only")).when(F.col("real"), F.col(label)).otherwise(F.lit(-1))
        else:
            shown = F.when(F.col("real"), F.col(label)).otherwise(F.lit(-1))
        out.append(shown.alias(label))
    return joined.select(*out)


def chunk_pad_zero(rows: DataFrame, size: int, overlap: int = 2, values: Sequence[str] = ("score",)) -> DataFrame:
    """Windows from 0 in steps of size // overlap over the whole sequence, filled with zeros to full length."""
    step = max(1, size // overlap)
    sized = rows.join(sequence_lengths(rows), "seq_id")
    at = F.col("t") - 1
    first, last = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)), F.floor(at / step)
    starts = F.transform(F.sequence(first, last), lambda k: (k * step).cast("bigint"))
    kept = sized.withColumn("start", F.explode(starts)).select("seq_id", "start", (at - F.col("start")).alias("pos"), *values)
    lengths = sequence_lengths(rows)
    n, width = F.col("n"), F.least(F.col("n"), F.lit(size).cast("bigint"))
    first_open = F.floor((n - width) / step) + 1
    last_start = F.floor((n - 1) / step)
    open_windows = lengths.filter(first_open <= last_start).withColumn("_k", F.explode(F.sequence(first_open, last_start)))
    open_windows = open_windows.withColumn("start", (F.col("_k") * step).cast("bigint"))
    fill = open_windows.withColumn("pos", F.explode(F.sequence(n - F.col("start"), width - 1)))
    zeros = fill.select("seq_id", "start", "pos", *[F.lit(0).cast(rows.schema[v].dataType).alias(v) for v in values])
    return kept.unionByName(zeros)


def overlap_average(preds: DataFrame, lengths: DataFrame, size: int, keys: Sequence[str] = ("label_idx",), value: str = "prob") -> DataFrame:
    """Mean over all windows that cover a time step; a padded short window gives its centred slice."""
    joined = preds.join(lengths, "seq_id")
    front = F.floor((F.lit(size) - F.col("n")) / 2)
    at = F.when(F.col("n") >= size, F.col("start") + F.col("pos")).otherwise(F.col("pos") - front)
    placed = joined.withColumn("t", (at + 1).cast("bigint")).filter((F.col("t") >= 1) & (F.col("t") <= F.col("n")))
    return placed.groupBy("seq_id", "t", *keys).agg(F.avg(value).alias(value))


def argmax_label(probs: DataFrame, keys: Sequence[str] = ("video_id", "frame")) -> DataFrame:
    """Best label and score per step, the lowest index on ties."""
    best = F.max_by(F.struct("label_idx", "label", "prob"), F.struct(F.col("prob"), -F.col("label_idx")))
    return probs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.label_idx", "b.label", F.col("b.prob").alias("score"))


# ---- metrics -------------------------------------------------------------


def class_weights(labels: DataFrame, col: str = "label") -> DataFrame:
    """Count, percent and balancing weight per class; padding -1 is left out."""
    counts = labels.filter(F.col(col) != "-1" if labels.schema[col].dataType.simpleString() == "string" else F.col(col) != -1)
    counts = counts.groupBy(col).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    total, classes = whole.select("total").scalar(), whole.select("classes").scalar()
    return counts.select(
        F.col(col).alias("label"), "n", F.round(F.col("n") / total * 100, 9).alias("percent"), F.round(total / (classes * F.col("n")), 9).alias("weight")
    )


def class_metrics(pred: DataFrame) -> DataFrame:
    """Per class tp, predicted, actual, precision, recall, f1 (0 where undefined); truth -1 is left out."""
    confusion = pred.filter("truth <> -1").groupBy("truth", "pred").agg(F.count("*").alias("n"))
    right = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = confusion.select(F.col("truth").cast("bigint").alias("cls"), right.alias("tp"), F.lit(0).alias("p"), F.col("n").alias("a")).unionByName(
        confusion.select(F.col("pred").cast("bigint").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.col("n").cast("int").alias("p"), F.lit(0).cast("bigint").alias("a"))
    )
    per = sides.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("p").alias("predicted"), F.sum("a").alias("actual"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = per.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("actual")))
    both = F.col("precision") + F.col("recall")
    return per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def multiclass_metrics(pred: DataFrame) -> DataFrame:
    """Macro precision, recall, F1; balanced accuracy; least F1 above 0. One row."""
    return class_metrics(pred).agg(
        F.round(F.avg("precision"), 9).alias("precision"),
        F.round(F.avg("recall"), 9).alias("recall"),
        F.round(F.avg("f1"), 9).alias("f1"),
        F.round(F.avg(F.when(F.col("actual") > 0, F.col("recall"))), 9).alias("balanced_accuracy"),
        F.round(F.min(F.when(F.col("f1") > 0, F.col("f1"))), 9).alias("min_f1"),
    )


def multilabel_metrics(probs: DataFrame, thr: float = 0.5) -> DataFrame:
    """Macro precision, recall, F1, accuracy over labels; 0/0 counts as 1. Rows have label, prob, truth (0/1)."""
    on, true = F.col("prob") > thr, F.col("truth") == 1
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    per = probs.groupBy("label").agg(count(on & true, "tp"), count(on & ~true, "fp"), count(~on & true, "fn"), count(~on & ~true, "tn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return per.agg(
        F.round(F.avg(ratio(tp, tp + fp)), 9).alias("precision"), F.round(F.avg(ratio(tp, tp + fn)), 9).alias("recall"),
        F.round(F.avg(ratio(2 * tp, 2 * tp + fp + fn)), 9).alias("f1"), F.round(F.avg((tp + tn) / (tp + fp + fn + tn)), 9).alias("accuracy"),
    )



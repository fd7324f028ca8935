"""User models over rows and sequences, clustering, text classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.boxes import per_key
from tilewright.operators.clusters import best_centers
from tilewright.operators.ordered import number_rows
from tilewright.operators.sequences import overlap_average, pad_sequences, sequence_lengths, sliding_windows
from tilewright.session import cut_lineage, ship_package

_MODELS: dict = {}


def _load(key, factory):
    """One model per Python worker, however many partitions it works on."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def score_rows(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, keep: Sequence[str], batch: int = 1024) -> DataFrame:
    """Apply a batch model to rows. `factory` builds the model once per worker; the model
    maps a frame of up to `batch` rows to a frame of new columns described by `schema`.
    """
    keep, key = list(keep), f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', id(factory))}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    full = ", ".join([*(f"{c} {types[c]}" for c in keep), schema])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(key, factory)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at: at + batch].reset_index(drop=True)
                yield pd.concat([part[keep], model(part).reset_index(drop=True)], axis=1)

    ship_package(df.sparkSession)
    return df.mapInPandas(run, full)


def score_sequences(
    rows: DataFrame, factory: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, classes: int, values: Sequence[str] = ("score",), overlap: float = 0.5
) -> DataFrame:
    """Class probabilities per time step from a window model.

    A sequence is cut into overlapping windows of `size` rows (a short one is padded), each
    window is scored on its own, and the predictions that cover a step are averaged, so no
    task ever holds a whole sequence. The model maps (size, channels) to (size, classes).
    """
    values, key = list(values), f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', id(factory))}"
    long = sliding_windows(rows.select("seq_id", "t", *values), size, overlap).select("seq_id", "start", "pos", *values)
    short = pad_sequences(rows, size, "zero", values).select("seq_id", F.lit(0).cast("bigint").alias("start"), "pos", *values)

    def score(windows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        model, data = _load(key, factory), windows[values].to_numpy(dtype=float)
        probs = [np.asarray(model(data[a:b]), dtype=float).reshape(-1) for a, b in zip(bounds[:-1], bounds[1:])]
        out = {c: np.repeat(windows[c].to_numpy(), classes) for c in ("seq_id", "start", "pos")}
        return pd.DataFrame({**out, "label_idx": np.tile(np.arange(classes), len(windows)), "prob": np.concatenate(probs)})

    kind = rows.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {kind}, start bigint, pos bigint, label_idx bigint, prob double"
    preds = per_key(long.unionByName(short), ["seq_id", "start"], ["pos"], score, schema)
    return overlap_average(preds, sequence_lengths(rows), size)


def pipe(*fns: Callable) -> Callable:
    """Left-to-right chain of table functions."""
    return lambda df: reduce(lambda acc, fn: fn(acc), fns, df)


def compose(*fns: Callable) -> Callable:
    """Right-to-left chain of table functions."""
    return pipe(*reversed(fns))


# ---- clustering ----------------------------------------------------------


def spatial_features(pixels: DataFrame, images: DataFrame, weight: float = 0.5, channels: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Channels in 0..1 and weighted x, y in 0..1 as feature columns."""
    sized = pixels.join(images.select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h")), "image_id")
    return sized.select(
        "image_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in channels],
        (F.lit(weight) * F.col("x") / F.col("_w")).alias("fx"), (F.lit(weight) * F.col("y") / F.col("_h")).alias("fy"),
    )


def kmeans_rows(rows: DataFrame, features: Sequence[str], k: int, seed: int = 1, iterations: int = 20, starts: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """K-means of each image's rows; adds `cluster` and `cost` (squared distance to its centre).

    Equal rows are one weighted point. The first centre of a start is a seeded hash pick,
    each further one the point farthest from the centres so far. Lloyd's steps end after
    `iterations`, or when no centre moves by more than `tolerance` (squared distance); the
    start of least total cost is kept for each image. Rows are read to gather the points and
    to place each row at its nearest centre; the steps run over the points, for images of
    usual size within one task.
    """
    features = list(features)
    centers = best_centers(rows, features, k, seed, iterations, starts, tolerance)
    joined = rows.join(centers, "image_id")
    distance = lambda c: reduce(lambda a, b: a + b, [(F.col(f) - F.get(c, F.lit(i))) * (F.col(f) - F.get(c, F.lit(i))) for i, f in enumerate(features)])
    costs = F.transform("_centers", lambda c, i: F.struct(distance(c).alias("cost"), i.alias("i")))
    return joined.withColumn("_best", F.array_min(costs)).withColumn("cluster", F.col("_best.i")).withColumn("cost", F.col("_best.cost")).drop("_centers", "_best")


def background_segment(pixels: DataFrame, features: Sequence[str], k: int = 3, seed: int = 1, iterations: int = 20, starts: int = 10) -> DataFrame:
    """Cluster the non-black pixels; the cluster of the first one in reading order is background."""
    valid = reduce(lambda a, b: a | b, [F.col(f) != 0 for f in features])
    clustered = kmeans_rows(pixels.filter(valid), features, k, seed, iterations, starts)
    first = clustered.groupBy("image_id").agg(F.min_by("cluster", F.struct("y", "x")).alias("_bg"))
    return clustered.join(first, "image_id").withColumn("background", F.col("cluster") == F.col("_bg")).drop("_bg", "cost")


def kmeans_table(rows: DataFrame, features: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """One clustering of a whole table with the distributed ML estimator."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_v")


# ---- texts ---------------------------------------------------------------


WORD = r"(?U)\w+"  # two word characters or more up to a border, or one: every run of them


def grams_of(rows: DataFrame, max_ngram: int, to: str) -> DataFrame:
    """`rows` with the runs of 1 to `max_ngram` words of their text."""
    words = rows.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0))
    runs = lambda n: F.transform("_w", lambda _, i: F.when(i + n <= F.size("_w"), F.array_join(F.slice("_w", i + 1, n), " ")))
    return words.withColumn(to, F.array_compact(F.concat(*[runs(n) for n in range(1, max_ngram + 1)]))).drop("_w")


def gram_counts(rows: DataFrame, key: str, max_ngram: int) -> DataFrame:
    """(key, gram, tf): how often each row of (key, text) has each gram."""
    return grams_of(rows.select(key, "text"), max_ngram, "_g").select(key, F.explode("_g").alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def gram_dictionary(counts: DataFrame, n_rows: int) -> DataFrame:
    """(gram, at, idf): every gram of the training rows with its place in alphabetical order and its smoothed weight."""
    seen = counts.groupBy("gram").agg(F.count("*").alias("df"))
    placed = number_rows(seen, [], ["gram"], "_rn")
    return cut_lineage(placed.select("gram", (F.col("_rn") - 1).cast("int").alias("at"), (F.log((F.lit(1.0) + n_rows) / (F.col("df") + 1)) + 1).alias("idf")))


def gram_vectors(rows: DataFrame, counts: DataFrame, dictionary: DataFrame, size: int, key: str) -> DataFrame:
    """`rows` with `_x`: the sparse unit vector of tf * idf; a row without known grams has the zero vector."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    weighted = counts.join(dictionary, "gram").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (F.col("tf") * F.col("idf")).alias("w")))).alias("_l"))
    norm = F.sqrt(F.aggregate("_l.w", F.lit(0.0), lambda s, w: s + w * w))
    unit = weighted.select(F.col(key).alias("_key"), F.col("_l.at").alias("_at"), F.transform("_l.w", lambda w: w / norm).alias("_v"))
    # only the packing of finished arrays into Spark's vector type is Python
    pack = F.udf(lambda at, v: Vectors.sparse(size, at or [], v or []), VectorUDT())
    return rows.join(unit, rows[key] == unit["_key"], "left").withColumn("_x", pack("_at", "_v")).drop("_key", "_at", "_v")


def text_classifier(train: DataFrame, test: DataFrame, c: float = 10.0, max_ngram: int = 3, features: int | None = None, max_iter: int = 50):
    """TF-IDF of word 1..3-grams and logistic regression; returns predictions and the model.

    `train` has text, label; `test` has text. Without training rows, pass the label names
    themselves as texts (cold start). Each gram of the training texts is a feature of its
    own: grams meet their dictionary in a join, so no vocabulary passes the driver and none
    share a weight; the fitted coefficients are one number for each gram and class. For
    vocabularies too large for that, `features` hashes grams into so many places. Grams
    unseen in training weigh nothing. Coefficients (not the intercept) are held small by
    1 / (2 c), on features as they are.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, IndexToString, Normalizer, StringIndexer
    from pyspark.ml.functions import vector_to_array

    if features is None:
        rows = cut_lineage(train.select("text", "label").withColumn("_row", F.monotonically_increasing_id()))
        asked = cut_lineage(test.withColumn("_row", F.monotonically_increasing_id()))
        n_rows = max(1, rows.count())
        counts = cut_lineage(gram_counts(rows, "_row", max_ngram))
        vectors = gram_dictionary(counts, n_rows)
        size = vectors.count()
        known = gram_vectors(rows, counts, vectors, size, "_row")
        found = gram_vectors(asked, gram_counts(asked, "_row", max_ngram), vectors, size, "_row")
    else:
        rows = train.select("text", "label")
        hashed = HashingTF(inputCol="_g", outputCol="_tf", numFeatures=features)
        counted = cut_lineage(hashed.transform(grams_of(rows, max_ngram, "_g")).drop("_g", "text"))
        n_rows = max(1, counted.count())
        vectors = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
        unit = Normalizer(inputCol="_idf", outputCol="_x")
        known, found = (unit.transform(vectors.transform(d)).drop("_g", "_tf", "_idf") for d in (counted, hashed.transform(grams_of(test, max_ngram, "_g"))))
    indexer = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(known)
    learn = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_k", regParam=1.0 / (c * n_rows), maxIter=max_iter, tol=1e-8, standardization=False)
    kept = indexer.transform(known).select("_x", "_y").persist(StorageLevel.MEMORY_AND_DISK)
    fitted = learn.fit(kept)
    kept.unpersist()
    named = IndexToString(inputCol="_k", outputCol="prediction", labels=indexer.labels)
    scored = named.transform(fitted.transform(found)).withColumn("score", F.array_max(vector_to_array("_p")))
    return scored.select(*test.columns, "prediction", "score"), (vectors, fitted)

"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import blocks
from tilewright.llm.textops import LOWER, SPACE, SpanHash, byte_slices, id_and_text, ngrams, ranked, ready, words

BUCKETS = 1 << 14  # hashed words; their context vectors are a table of fixed size
DIMENSIONS = 32
NONZERO = 4  # of an index vector, each +1 or -1
REACH = 2  # words to either side that make a word's context
SAMPLE = 20_000  # most labelled documents that the network is fitted on, spread by hash
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.7
FEATURES = 2 * DIMENSIONS

_LOWER = np.frombuffer(LOWER, np.uint8)


def _byte_set(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _DIGIT = _byte_set(range(0x41, 0x5B)), _byte_set(range(0x30, 0x3A))
_SMALL = _byte_set([*range(0x61, 0x7B), *range(0x80, 0x100)])
_SYMBOL, _MARK = _byte_set(b"#*$%&|<>=_~^@\\{}[]+"), _byte_set(b"!?")


def index_vectors() -> np.ndarray:
    """A fixed sparse ternary vector for each bucket."""
    draw = np.random.default_rng(20_240_601)
    table = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    for row in range(BUCKETS):
        table[row, draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice((-1, 1), NONZERO)
    return table


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape bucket, first word of each text).

    A shape says what kinds of bytes a word holds, how long it is, and whether the word, or
    the word with the one before it, has occurred in the text before.
    """
    found = words(data, offsets, SPACE)
    hashes = SpanHash(_LOWER[data])(found.starts, found.ends)
    edges = np.stack([found.starts, found.ends], 1)
    count = lambda kind: np.diff(np.r_[0, np.cumsum(kind[data])][edges], axis=1)[:, 0]
    size = found.ends - found.starts
    upper, small, symbol, mark = count(_UPPER), count(_SMALL), count(_SYMBOL), count(_MARK)
    shape = np.zeros(len(size), np.int64)
    for flag in ((upper > 1) & (small == 0), (upper > 0) & (small > 0), symbol > 0, 2 * symbol > size, mark > 1, count(_DIGIT) > 0):
        shape = shape * 2 + flag
    same = np.zeros(len(size), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    pairs, at = ngrams(hashes, found.first, 2)
    again = np.zeros(len(size), bool)
    again[at] = ~ranked(pairs, found.text[at])[1]
    shape = (shape * 2 + same) * 2 + again
    shape = shape * 4 + np.minimum(3, size // 5)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), (shape * 0x9E3779B1 + 7) % (1 << 31) % BUCKETS, found.first


def context_sums(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, table: np.ndarray) -> None:
    """Add to each bucket of words and shapes the index vectors of the words and shapes near it."""
    word, shape, first = tokens(data, offsets)
    if not len(word):
        return
    own = index[word].astype(np.int32) + index[shape]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = np.zeros_like(own)
    for step in range(1, REACH + 1):
        same = (text[step:] == text[:-step])[:, None]
        near[step:] += own[:-step] * same
        near[:-step] += own[step:] * same
    for bucket in (word, shape):
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        table[bucket[order[begin]]] += np.add.reduceat(near[order], begin)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all documents, each of length one (or zero)."""
    spark = ready(docs.sparkSession)
    index = spark.sparkContext.broadcast(index_vectors())

    def run(batches):
        table = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0)):
                context_sums(data, offsets, index.value, table)
        yield from blocks.emit(table)

    total = blocks.add_up(docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, blocks.SCHEMA), (BUCKETS, DIMENSIONS), "int64")
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the words and mean vector of the shapes of each text; zeros for a text without words."""
    word, shape, first = tokens(data, offsets)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for k, bucket in enumerate((word, shape)):
            out[full, k * DIMENSIONS : (k + 1) * DIMENSIONS] = np.add.reduceat(vectors[bucket], first[full]) / np.diff(first)[full, None]
    return out


@dataclass
class Model:
    """Word vectors, the network, and the temperature of its probabilities."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float = 1.0

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, vectors: np.ndarray) -> Model:
    """Adam on the rows that are not for calibration, then the temperature of least loss on the others.

    Rows come in a fixed order and all draws are seeded. Without rows, or with one class
    only, the network is still defined: it tends to that class.
    """
    draw = np.random.default_rng(7)
    learn = ~calibrate if (~calibrate).any() else np.ones(len(x), bool)
    a, b = x[learn], y[learn].astype(float)
    mean = a.mean(0) if len(a) else np.zeros(FEATURES)
    scale = a.std(0) + 1e-3 if len(a) else np.ones(FEATURES)
    layers = [draw.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    a = (a - mean) / scale
    for _ in range(EPOCHS if len(a) else 0):
        order = draw.permutation(len(a))
        for at in range(0, len(a), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(a[rows] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -50, 50))) - b[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [a[rows].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, tuple(layers))
    if calibrate.any():
        logit, truth = model.logits(x[calibrate]), y[calibrate]
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        losses = [np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean() for t in heats]
        model.temperature = float(heats[int(np.argmin(losses))])
    return model


def residue(key: str, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors from all documents; the network from at most `sample` labelled ones.

    Only rows whose crc32(key) mod 4 is not 2 are learnt from; of those, remainder 3 sets the
    temperature. A key with contradicting labels counts with the smallest; null labels and
    labels without a document don't count.
    """
    vectors = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select(F.col(key).cast("bigint").alias("_k"), F.col(label).cast("int").alias("_y")).filter("_k is not null and _y in (0, 1)").groupBy("_k").agg(F.min("_y").alias("_y"))
    known = known.filter(residue("_k", 4) != 2).orderBy(F.xxhash64("_k"), "_k").limit(sample)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                pooled = pool(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in pooled], pa.binary())], ["_k", "_y", "pooled"])

    texts = docs.select(F.col(key).cast("bigint").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    known = F.broadcast(known)  # at most `sample` rows of two numbers
    rows = texts.join(known, "_k").select("_k", "_y", "_t").mapInArrow(run, "_k bigint, _y int, pooled binary")
    # a repeated document counts once, so at most `sample` rows reach the driver
    rows = rows.groupBy("_k").agg(F.min(F.struct("pooled", "_y")).alias("one")).select("_k", "one.*", residue("_k", 4).alias("part")).toPandas().sort_values("_k")
    x = np.frombuffer(b"".join(rows["pooled"]), np.float64).reshape(-1, FEATURES)
    return fit_network(x, rows["_y"].to_numpy(np.int64), rows["part"].to_numpy(np.int64) == 3, vectors)


def scorer(docs: DataFrame, model: Model):
    """A pandas UDF from text to the probability that the text is of label 1."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        found = [model.probabilities(pool(data, offsets, model.vectors)) for _, _, data, offsets in byte_slices(pa.array(texts, pa.large_string()))]
        return pd.Series(np.concatenate([np.zeros(0), *found]))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score (probability of label 1), predicted (1 from 0.7) for every document.

    Labels are read for training only; a score depends on the text alone. Null and empty
    texts have no words and get the score of an all-zero vector; repeated rows are scored
    each; a null key is scored (held_out null); an empty table gives none; other columns are
    not read. Two passes over the texts and one over the labelled sample; what leaves the
    tasks is a table of fixed size.
    """
    score = scorer(docs, train(docs, labels, key, text, label))
    scored = id_and_text(docs, key, text).select(key, (residue(key, 4) == 2).alias("held_out"), score(text).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))

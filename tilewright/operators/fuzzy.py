"""Most similar label of each line, by an index of q-grams and lengths with exact checks behind it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import similarity
from tilewright.operators.ordered import running
from tilewright.session import cut_lineage, ship_package

BLOCK_BYTES = 4 << 20  # label text that is broadcast at once
TRIED = 4  # labels of best bound whose distance sets what the others must reach
FEW = 64  # candidates at which no second bound is worth its time


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is two integers of one bit for each character of `a`."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rises, falls = every, 0  # steps of +1 and -1 down the column
    for c in b:
        same = places.get(c, 0)
        keep = (((same & rises) + rises) ^ rises) | same
        right_rise = falls | (every & ~(keep | rises))
        right_fall = rises & keep
        distance += bool(right_rise & top) - bool(right_fall & top)
        keep |= falls
        right_rise = (right_rise << 1 | 1) & every
        right_fall = right_fall << 1 & every
        rises = right_fall | (every & ~(keep | right_rise))
        falls = right_rise & keep
    return distance


def counted(items: Sequence[str]) -> list[tuple[str, int]]:
    """Each item with how often it came before, so that shared ones of two texts can be counted as a set."""
    seen: dict[str, int] = {}
    out = []
    for item in items:
        out.append((item, seen.get(item, 0)))
        seen[item] = seen.get(item, 0) + 1
    return out


class LabelIndex:
    """Bounds on the edit distance to every label, from what texts within k edits must share.

    With m the longer length: at least m - k characters, at least m - 1 - 2 k pairs of
    neighbouring characters (an edit breaks two at most), and lengths within k.
    """

    def __init__(self, labels: Sequence[str]) -> None:
        self.labels = list(labels)
        self.size = np.array([len(x) for x in self.labels], np.int64)
        self.pairs = self._postings([[x[i : i + 2] for i in range(len(x) - 1)] for x in self.labels])
        self.single = self._postings(self.labels)

    @staticmethod
    def _postings(texts) -> dict[tuple[str, int], np.ndarray]:
        lists: dict[tuple[str, int], list[int]] = {}
        for at, items in enumerate(texts):
            for item in counted(items):
                lists.setdefault(item, []).append(at)
        return {item: np.array(places, np.int64) for item, places in lists.items()}

    def _shared(self, postings, items) -> np.ndarray:
        found = [postings[item] for item in counted(items) if item in postings]
        return np.bincount(np.concatenate(found), minlength=len(self.size)) if found else np.zeros(len(self.size), np.int64)

    def candidates(self, line: str, reached: float = -1.0) -> np.ndarray:
        """Places of all labels that may be as similar as the best one, and at least `reached`."""
        longer = np.maximum(self.size, max(len(line), 1))
        shared = self._shared(self.pairs, [line[i : i + 2] for i in range(len(line) - 1)])
        least = np.maximum(np.abs(self.size - len(line)), -((shared - longer + 1) // 2))
        bound = 1 - np.maximum(least, 0) / longer
        reached = self._reach(line, bound, reached)
        if (bound >= reached - 1e-9).sum() > FEW:
            least = np.maximum(least, longer - self._shared(self.single, line) if line else longer)
            bound = 1 - np.minimum(least, longer) / longer if line else np.where(self.size == 0, 1.0, 0.0)
            reached = self._reach(line, bound, reached)
        return np.flatnonzero(bound >= reached - 1e-9)

    def _reach(self, line: str, bound: np.ndarray, reached: float) -> float:
        for at in np.argsort(-bound, kind="stable")[:TRIED]:
            if bound[at] > reached:
                reached = max(reached, 1 - edit_distance(line, self.labels[at]) / max(len(line), len(self.labels[at]), 1))
        return reached


def nearest_labels(lines: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(line, label, score, candidates) of each distinct line; `candidates` is how many labels were compared exactly.

    Labels go out in blocks of bounded size, so lines are never joined or copied; each block
    narrows a line's candidates to those whose bound reaches its best score by then, and the
    exact distances of these are a column expression. A null line has the first label and no
    score; no labels give no rows.
    """
    spark = lines.sparkSession
    ship_package(spark)
    clean = labels.filter("label is not null").select("label", F.col("ord").cast("bigint").alias("ord"))
    ranked = cut_lineage(running(clean, [], ["ord", "label"], sums={"_rank": F.lit(1).cast("bigint"), "_bytes": F.octet_length("label").cast("bigint")}))
    blocks = [r["b"] for r in ranked.select(F.floor((F.col("_bytes") - 1) / block_bytes).alias("b")).distinct().orderBy("b").collect()]
    best_type = "struct<score: double, rank: bigint, label: string>"
    found = lines.select("line").distinct().select("line", F.lit(None).cast(best_type).alias("m"), F.lit(0).cast("bigint").alias("candidates"))
    for b in blocks:
        part = ranked.filter(F.floor((F.col("_bytes") - 1) / block_bytes) == b).orderBy("_rank").select("label", "_rank").collect()
        texts, ranks = [r["label"] for r in part], [r["_rank"] for r in part]
        shared = spark.sparkContext.broadcast((texts, ranks))

        def run(batches, shared=shared):
            index = LabelIndex(shared.value[0])
            names, order = pa.array(shared.value[0], pa.string()), pa.array([-r for r in shared.value[1]], pa.int64())
            for batch in batches:
                sizes, places = [0], []
                scores = batch.column(1).field(0).to_pylist()
                for line, reached in zip(batch.column(0).to_pylist(), scores):
                    own = index.candidates(line, -1.0 if reached is None else reached) if line is not None else np.zeros(1, np.int64)
                    places.append(own)
                    sizes.append(sizes[-1] + len(own))
                at = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
                items = pa.StructArray.from_arrays([order.take(at), names.take(at)], ["rank", "label"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)], [*batch.schema.names, "_c"])

        near = found.mapInArrow(run, f"line string, m {best_type}, candidates bigint, _c array<struct<rank: bigint, label: string>>")
        scored = F.array_max(F.transform("_c", lambda x: F.struct(similarity("line", x["label"]).alias("score"), x["rank"].alias("rank"), x["label"].alias("label"))))
        best = F.when(F.col("m").isNull() | (scored > F.col("m")), scored).otherwise(F.col("m"))
        found = near.select("line", best.alias("m"), (F.col("candidates") + F.size("_c")).alias("candidates"))
    return found.filter("m is not null").select("line", F.col("m.label").alias("label"), F.col("m.score").alias("score"), "candidates")

"""Last covering range of each row, by a sweep over range borders.

A long sequence is cut into chunks of its time axis. A range goes to the two chunks that hold
its borders; of the ranges that cover a whole chunk only the last one can win there, and it
is found by covering runs of chunks with dyadic blocks. So neither rows nor ranges are copied
in proportion to a range's length.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import chunk_by_bounds, chunk_bounds
from tilewright.session import ship_package

LONG = 100_000  # rows from which a sequence is cut into chunks
SPLITS = 16  # parts of the time between two quantiles


def _number(df: DataFrame, column: str) -> Column:
    """A number in the order of a time column: long where it is exact, else double."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double")


def blocks_between(first: Column, last: Column, levels: int) -> Column:
    """Array of (level, block): dyadic blocks that make up the chunks first..last (none if last < first).

    At each level at most two blocks are needed, the one at each end that does not fill its parent.
    """
    out, lo, hi = [], first, last
    for level in range(levels + 1):
        odd_lo, even_hi = (lo <= hi) & (lo % 2 == 1), (lo <= hi) & (hi % 2 == 0)
        block = lambda n: F.struct(F.lit(level).alias("level"), n.cast("bigint").alias("block"))  # noqa: E731, B023
        out.append(F.when(odd_lo, block(lo)))
        out.append(F.when(even_hi, block(hi)))
        lo, hi = F.ceil(lo / 2), F.floor((hi - 1) / 2)
    return F.filter(F.array(*out), lambda b: b.isNotNull())


class Sweep:
    """The winning range between any two borders of a set of ranges."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, order: np.ndarray) -> None:
        # borders in order; at an equal value ranges open before a row is asked for, and close behind it
        self.at = np.unique(np.concatenate([lo, hi])) if len(lo) else lo
        # winners[2 i] holds at border i, winners[2 i + 1] between borders i and i + 1
        self.winners = np.full(2 * len(self.at) + 1, -1, np.int64)
        opened = np.argsort(lo, kind="stable")
        heap: list[tuple] = []
        at = 0
        for i, border in enumerate(self.at.tolist()):
            while at < len(opened) and lo[opened[at]] <= border:
                r = int(opened[at])
                heapq.heappush(heap, (-order[r], r, hi[r]))
                at += 1
            while heap and heap[0][2] < border:
                heapq.heappop(heap)
            if heap:
                self.winners[2 * i] = heap[0][1]
            while heap and heap[0][2] <= border:
                heapq.heappop(heap)
            if heap:
                self.winners[2 * i + 1] = heap[0][1]

    def __call__(self, times: np.ndarray) -> np.ndarray:
        """Place of the winning range of each time, or -1."""
        if not len(self.at):
            return np.full(len(times), -1, np.int64)
        right = np.searchsorted(self.at, times, "right") - 1
        exact = (right >= 0) & (self.at[np.maximum(right, 0)] == times)
        return np.where(right < 0, -1, self.winners[np.maximum(2 * right + 1 - exact, 0)])


def last_covering(rows: DataFrame, ranges: DataFrame, long: int = LONG) -> DataFrame:
    """`rows` (seq_id, t, ...) with `range_label`: the label of the covering range (lo, hi, both included) of greatest `ord`, or null.

    The greatest (ord, lo, hi) decides where ranges of a sequence share an `ord`. Rows without
    a sequence or time, and ranges with a null border, meet nothing.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kind = "double" if rows.schema["t"].dataType.simpleString().startswith(("float", "double", "decimal")) else "bigint"
    numbered = rows.select(F.col("seq_id").alias("_s"), _number(rows, "t").cast(kind).alias("_k"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    spans = ranges.select(F.col("seq_id").alias("_s"), "ord", _number(ranges, "lo").cast(kind).alias("_lo"), _number(ranges, "hi").cast(kind).alias("_hi"), F.col("label").alias("_label"))
    spans = spans.filter("_s is not null and _lo <= _hi")

    large = rows.groupBy("seq_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > long).select(F.col("seq_id").alias("_s"), F.lit(True).alias("_large"))
    if large.isEmpty():
        placed, near, far = numbered.withColumn("_c", F.lit(0).cast("bigint")), spans.withColumn("_c", F.lit(0).cast("bigint")), None
    else:
        bounds = chunk_bounds(numbered.join(large, "_s", "left_semi"), "_k")
        chunk = lambda c: F.when(F.col("_large"), chunk_by_bounds(F.col(c), bounds, SPLITS)).otherwise(F.lit(0).cast("bigint"))
        levels = max(1, len(bounds) * SPLITS).bit_length()
        placed = numbered.join(large, "_s", "left").withColumn("_c", chunk("_k"))
        ends = spans.join(large, "_s", "left").withColumn("_first", chunk("_lo")).withColumn("_last", chunk("_hi"))
        near = ends.withColumn("_c", F.explode(F.array_distinct(F.array("_first", "_last"))))
        # the last of the ranges that cover a block of chunks, then the last of the blocks above a chunk
        covered = ends.filter("_last - _first > 1").withColumn("_b", F.explode(blocks_between(F.col("_first") + 1, F.col("_last") - 1, levels)))
        best = F.max(F.struct("ord", "_lo", "_hi", "_label")).alias("_best")
        blocks = covered.groupBy("_s", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(best)
        chunks = placed.filter("_large").select("_s", "_c").distinct()
        above = chunks.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_block", F.expr("shiftright(_c, _level)"))
        far = above.join(blocks, ["_s", "_level", "_block"]).groupBy("_s", "_c").agg(F.max("_best").alias("_best")).select("_s", "_c", "_best.*")

    spread = ["_s", "_c", "ord", "_lo", "_hi", "_label"]
    all_spans = near.select(*spread) if far is None else near.select(*spread).unionByName(far.select(*spread))
    nothing = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    first = all_spans.select("_s", "_c", F.lit(0).alias("_kind"), F.col("ord").cast("bigint").alias("_o"), "_lo", "_hi", "_label", nothing("_k", numbered), nothing("_row", numbered))
    second = placed.select("_s", "_c", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_o"), nothing("_lo", spans), nothing("_hi", spans), nothing("_label", spans), "_k", "_row")
    # a chunk's ranges come before its rows, so rows are streamed and only ranges are held
    stream = first.unionByName(second).repartition("_s", "_c").sortWithinPartitions("_s", "_c", "_kind", "_o", "_lo", "_hi")
    row_type, label_type = (stream.schema[c].dataType.simpleString() for c in ("_row", "_label"))

    def run(batches):
        held: list[pa.RecordBatch] = []  # ranges of the chunk
        sweep, labels, now = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, chunk_, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            new = np.ones(batch.num_rows, bool)
            new[1:] = (chunk_[1:] != chunk_[:-1]) | (kinds[1:] != kinds[:-1]) | (seq[1:] != seq[:-1])
            cuts = np.flatnonzero(new)
            out_rows, out_labels = [], []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                own = (seq[lo], chunk_[lo])
                if own != now:
                    held, sweep, labels, now = [], None, None, own
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if sweep is None:
                    table = pa.Table.from_batches(held) if held else None
                    numbers = [table.column(c).to_numpy() for c in ("_lo", "_hi", "_o")] if held else [np.zeros(0)] * 3
                    # rows of the sort order: a later place wins among equal ord
                    sweep = Sweep(numbers[0], numbers[1], np.arange(len(numbers[0])))
                    labels = table.column("_label").combine_chunks() if held else None
                times = part.column(part.schema.get_field_index("_k"))
                known = times.is_valid().to_numpy(zero_copy_only=False)
                place = sweep(pc.fill_null(times, 0).to_numpy(zero_copy_only=False))
                hit = known & (place >= 0)
                out_rows.append(part.column(part.schema.get_field_index("_row")))
                out_labels.append(pa.nulls(hi - lo, batch.schema.field("_label").type) if labels is None else labels.take(pa.array(place, mask=~hit)))
            if out_rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out_rows), pa.concat_arrays(out_labels)], ["_row", "range_label"])

    return stream.mapInArrow(run, f"_row {row_type}, range_label {label_type}").select("_row.*", "range_label")

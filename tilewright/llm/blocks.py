"""Sums of fixed-size tables that every task fills: cut into blocks, added block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_ROWS = 256
SCHEMA = "block int, part int, cells binary"


def emit(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table (rows a multiple of BLOCK_ROWS) as rows of SCHEMA; empty blocks are left out."""
    part = TaskContext.get().partitionId()
    for b in range(len(table) // BLOCK_ROWS):
        block = table[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS]
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "part", "cells"])


def add_up(parts: DataFrame, shape: tuple[int, int], kind: str, add: np.ufunc = np.add) -> np.ndarray:
    """Sum (or another ufunc) over all tasks, as one array on the driver; its size is `shape`, whatever the input.

    Blocks are dealt by number and streamed in order of (block, part) through each task, which
    holds one block at a time; the order makes sums of floats repeatable.
    """

    def run(batches):
        held, number = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["block", "cells"])
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(2)):
                value = np.frombuffer(cells.as_buffer(), kind)
                if block != number:
                    if held is not None:
                        yield out()
                    held, number = np.zeros(len(value), kind), block
                add(held, value, out=held)
        if held is not None:
            yield out()

    # as many partitions as blocks at most; each block is one small stream of partial sums
    dealt = parts.repartition("block").sortWithinPartitions("block", "part")
    table = np.zeros(shape, kind)
    for row in dealt.mapInArrow(run, "block int, cells binary").collect():
        table[row["block"] * BLOCK_ROWS : (row["block"] + 1) * BLOCK_ROWS] = np.frombuffer(row["cells"], kind).reshape(-1, shape[1])
    return table

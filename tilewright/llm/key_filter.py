"""A Bloom filter of fixed size over 64-bit keys, so that a join shuffles few rows that it drops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import blocks
from tilewright.llm.textops import mix, ready

BITS = 1 << 24
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _places(keys: np.ndarray) -> list[np.ndarray]:
    own = keys.astype(np.int64).view(np.uint64)
    return [(mix(own ^ seed) % np.uint64(BITS)).astype(np.int64) for seed in _SEEDS]


def may_be_among(keys: DataFrame, key: str):
    """A pandas UDF from a key (not null) to whether it may be among `keys`; False is certain.

    The filter has 2^24 bits whatever the number of keys: more keys let more other rows
    through, up to all of them, and change no result of a join that follows.
    """
    spark = ready(keys.sparkSession)

    def run(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy()):
                bits[at] = True
        packed = np.packbits(bits)
        yield from blocks.emit(packed.reshape(-1, 64))

    found = blocks.add_up(keys.select(F.col(key).cast("bigint")).filter(F.col(key).isNotNull()).mapInArrow(run, blocks.SCHEMA), (BITS // 512, 64), "uint8", np.bitwise_or)
    shared = spark.sparkContext.broadcast(found.ravel())

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        out = np.ones(len(values), bool)
        for at in _places(values.to_numpy()):
            out &= (shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1
        return pd.Series(out)

    return check

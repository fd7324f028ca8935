"""Repeatable randomness: every draw is an integer taken from an md5 of seed and key.

The same seed gives the same rows on any number of partitions, and a retried task
draws the same numbers again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 28  # seven hex digits


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def digest(seed: int | str, *cols) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols]))


def hash_int(seed: int | str, *cols) -> Column:
    """Integer in 0 .. 2**28 - 1."""
    return F.conv(F.substring(digest(seed, *cols), 1, 7), 16, 10).cast("bigint")


def hashrand(seed: int | str, *cols, lo, hi) -> Column:
    """Integer in lo .. hi, both ends included; lo and hi may be columns."""
    lo, hi = as_col(lo), as_col(hi)
    return (lo + hash_int(seed, *cols) % (hi - lo + 1)).cast("bigint")


def hash_unit(seed: int | str, *cols) -> Column:
    """Double in [0, 1)."""
    return hash_int(seed, *cols) / F.lit(float(HASH_RANGE))

"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. Here a group is first cut into
chunks along its order, each chunk is worked on by its own task, and only one small
summary row per chunk is combined across the group (the *carry*). A key that holds a
third of all rows is then spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.hashing import as_col, digest, hash_int, HASH_RANGE
from tilewright.session import parallelism

CHUNK = "_chunk"
MAX_SEGMENTS = 64
SAMPLE = 10_000  # values that place the chunk borders of a text column
GROUP_LIMIT = 1000  # Spark limits rows per group before the shuffle up to this k
HOT_ROWS = 4_000_000  # a group up to this size is one task's work wherever it lies: its sort spills, a chunked one takes three more shuffles


def chunk_bounds(df: DataFrame, on) -> list[float]:
    """At most 63 distinct inner quantiles of a numeric order column (one small job)."""
    segments = min(MAX_SEGMENTS, 2 * parallelism(df.sparkSession))
    probs = [i / segments for i in range(segments + 1)]
    found = df.agg(F.percentile_approx(as_col(on).cast("double"), probs, 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def chunk_by_bounds(on, bounds: Sequence[float], splits: int) -> Column:
    """Monotone chunk number: quantile segment, then `splits` equal parts of the segment."""
    x = as_col(on).cast("double")
    if len(bounds) < 2:
        return F.lit(0).cast("bigint")
    pairs = list(zip(bounds, bounds[1:]))

    def leaf(i: int) -> Column:
        lo, hi = pairs[i]
        part = F.floor((x - lo) / (hi - lo) * splits)
        return F.lit(i * splits) + F.greatest(F.lit(0), F.least(F.lit(splits - 1), part))

    def tree(first: int, last: int) -> Column:
        if first == last:
            return leaf(first)
        middle = (first + last + 1) // 2
        return F.when(x < pairs[middle][0], tree(first, middle - 1)).otherwise(tree(middle, last))

    return tree(0, len(pairs) - 1).cast("bigint")


def quantile_chunk(df: DataFrame, on, bounds: Sequence[float] | None = None) -> Column:
    if bounds is None:
        bounds = chunk_bounds(df, on)
    splits = max(1, math.ceil(4 * parallelism(df.sparkSession) / max(1, len(bounds))))
    return chunk_by_bounds(on, bounds, splits)


def position_chunk(pos, size: int = 65_536) -> Column:
    """Chunk of a dense integer position."""
    return F.floor(as_col(pos) / size)


def hash_chunk(df: DataFrame, seed, *cols) -> Column:
    """Chunk for an order by `digest(seed, cols)`: even by construction, no job needed."""
    n = min(HASH_RANGE, 4 * parallelism(df.sparkSession))
    return F.floor(hash_int(seed, *cols) * n / F.lit(HASH_RANGE))


def numeric_key(df: DataFrame, name: str) -> Column:
    """Number that does not decrease along an order column of any plain type."""
    kind = df.schema[name].dataType.simpleString()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def text_chunk(df: DataFrame, name: str) -> Column:
    """Monotone chunk number along a text column: borders are quantiles of at most SAMPLE random values.

    The sample places the borders only; whatever they are, the order and the results stay.
    """
    rows = df.select(name).filter(F.col(name).isNotNull()).orderBy(F.rand(17)).limit(SAMPLE).collect()
    values = sorted({r[0].encode() for r in rows})
    segments = min(4 * MAX_SEGMENTS, 4 * parallelism(df.sparkSession), len(values))
    borders = sorted({values[len(values) * i // segments] for i in range(1, segments)}) if segments else []
    borders = [b.decode() for b in borders]

    def tree(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(F.col(name) < borders[middle], tree(first, middle)).otherwise(tree(middle + 1, last))

    return F.when(F.col(name).isNull(), -1).otherwise(tree(0, len(borders))).cast("bigint")


def _chunk(df: DataFrame, order: Sequence[str], chunk: Column | None) -> DataFrame:
    if chunk is None and df.schema[order[0]].dataType.simpleString() == "string":
        return df.withColumn(CHUNK, text_chunk(df, order[0]))
    return df.withColumn(CHUNK, quantile_chunk(df, numeric_key(df, order[0])) if chunk is None else chunk)


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Whether any group has more rows than one task should order (one job over the keys).

    Rows of a group are added up in the tasks before their counts are shuffled.
    """
    limit = HOT_ROWS if limit is None else limit
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("n")).first()["n"]
    return most is not None and most > limit


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    prev: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    chunk: Column | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Add running sums (current row included) and values of the previous / next row.

    `chunk` must not decrease along `order`; without it quantiles of the first order
    column are used. `order` must be total within a key. Where no group is `hot` (counted, if
    not told) a group is ordered in one task and stays where its key was dealt.
    """
    keys, order = list(keys), list(order)
    sums, prev, following = sums or {}, prev or {}, following or {}
    if keys and not (has_hot_group(df, keys) if hot is None else hot):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.select(
            *df.columns,
            *[F.sum(e).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, e in sums.items()],
            *[F.lag(c).over(whole).alias(n) for n, c in prev.items()],
            *[F.lead(c).over(whole).alias(n) for n, c in following.items()],
        )
    rows = _chunk(df, order, chunk)
    aggs = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    at = F.struct(*order)
    aggs += [F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"_p_{n}") for n, c in prev.items()]
    aggs += [F.min_by(F.struct(F.col(c).alias("v")), at).alias(f"_n_{n}") for n, c in following.items()]
    across = _over(keys).orderBy(CHUNK)
    carry = rows.groupBy(*keys, CHUNK).agg(*aggs).select(
        *keys,
        CHUNK,
        *[
            F.coalesce(F.sum(f"_s_{n}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_s_{n}")
            for n in sums
        ],
        *[F.lag(f"_p_{n}").over(across).alias(f"_p_{n}") for n in prev],
        *[F.lead(f"_n_{n}").over(across).alias(f"_n_{n}") for n in following],
    )
    within = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    joined = rows.join(carry, [*keys, CHUNK])
    out = [
        (F.sum(e).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_s_{n}")).alias(n)
        for n, e in sums.items()
    ]
    for n, c in prev.items():
        local = F.lag(F.struct(F.col(c).alias("v"))).over(within)
        out.append(F.coalesce(local, F.col(f"_p_{n}"))["v"].alias(n))
    for n, c in following.items():
        local = F.lead(F.struct(F.col(c).alias("v"))).over(within)
        out.append(F.coalesce(local, F.col(f"_n_{n}"))["v"].alias(n))
    return joined.select(*df.columns, *out)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", chunk: Column | None = None, hot: bool | None = None
) -> DataFrame:
    """row_number() that survives one hot key and works without any key."""
    return running(df, keys, order, sums={name: F.lit(1).cast("bigint")}, chunk=chunk, hot=hot)


def shuffle_rank(df: DataFrame, id_col: str, seed, keys: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Rank 1.. in the pseudo-random order of `digest(seed, id)`; ids break ties."""
    tagged = df.withColumn("_d", digest(seed, id_col))
    chunk = hash_chunk(df, seed, id_col)
    return number_rows(tagged, keys, ["_d", id_col], name, chunk).drop("_d")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: Sequence[Column | str],
    name: str = "island",
    chunk: Column | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Number the maximal runs of equal consecutive `state` in each key, from 1."""
    keys, order = list(keys), list(order)
    if keys and not (has_hot_group(df, keys) if hot is None else hot):
        whole = Window.partitionBy(*keys).orderBy(*order)
        state_of = df.withColumn("_st", F.struct(*[as_col(s).alias(f"s{i}") for i, s in enumerate(state)]))
        opens = F.when(F.row_number().over(whole) == 1, 1).when(F.lag("_st").over(whole).eqNullSafe(F.col("_st")), 0).otherwise(1)
        return state_of.withColumn("_f", opens.cast("bigint")).select(*df.columns, F.sum("_f").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    rows = _chunk(df, order, chunk).withColumn("_st", F.struct(*[as_col(s).alias(f"s{i}") for i, s in enumerate(state)]))
    within = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    changed = F.coalesce((~F.lag("_st").over(within).eqNullSafe(F.col("_st"))).cast("bigint"), F.lit(0))
    first = F.row_number().over(within) == 1
    flagged = rows.withColumn("_f", F.when(first, F.lit(0).cast("bigint")).otherwise(changed))
    at = F.struct(*order)
    across = _over(keys).orderBy(CHUNK)
    parts = flagged.groupBy(*keys, CHUNK).agg(
        F.sum("_f").alias("_n"), F.min_by("_st", at).alias("_a"), F.max_by("_st", at).alias("_z")
    )
    opens = F.when(F.lag("_z").over(across).eqNullSafe(F.col("_a")), 0).otherwise(1)
    parts = parts.withColumn("_open", opens.cast("bigint"))
    carry = parts.select(
        *keys,
        CHUNK,
        (
            F.sum("_open").over(across.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("_base"),
    )
    joined = flagged.join(carry, [*keys, CHUNK])
    local = F.sum("_f").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(*df.columns, (local + F.col("_base")).alias(name))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n rows of each group.

    Up to 1000 Spark cuts each group before the shuffle by itself; above that the
    group is salted and cut per salt first, so no task sees a whole hot group.
    """
    keys = list(keys)

    def cut(frame: DataFrame, by: list[str], k: int) -> DataFrame:
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
        return frame.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")

    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(4 * parallelism(df.sparkSession))))
        df = cut(salted, [*keys, "_salt"], n).drop("_salt")
    return cut(df, keys, n)


def collect_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, size: int = 10_000, chunk: Column | None = None, hot: bool | None = None
) -> DataFrame:
    """Ordered lists of bounded length: (keys, part, items); the parts in order are the whole list."""
    numbered = number_rows(df, keys, order, "_rn", chunk, hot)
    return (
        numbered.withColumn("part", F.floor((F.col("_rn") - 1) / size))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_rn"), value.alias("v")))).alias("_l"))
        .select(*keys, "part", F.col("_l.v").alias("items"))
    )

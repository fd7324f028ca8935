"""Last covering range by sweeps and chunks, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import range_labels as rl


def plain(rows, ranges):
    out = []
    for s, t, extra in rows:
        over = [(o, lo, hi, label) for q, o, lo, hi, label in ranges if q == s and q is not None and None not in (t, lo, hi) and lo <= t <= hi]
        out.append((s, t, extra, max(over, key=lambda r: r[:3])[3] if over else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def data():
    """A hot sequence with a ms clock and ranges that span it, small ones, ties of ord, points, nulls."""
    draw = random.Random(11)
    start = 1_700_000_000_000
    rows = [("hot", start + draw.randrange(4000) * 1000, "x") for _ in range(1500)] + [("hot", start, "first")] * 200
    ranges = [("hot", k, start + a, start + a + size, f"h{k}") for k in range(60) for a, size in [(draw.randrange(4_000_000), draw.choice([0, 1000, 50_000, 3_000_000]))]]
    ranges += [("hot", 70, start - 5, start + 10**9, "all"), ("hot", 2, start, start + 4_000_000, "span"), ("hot", 71, start + 9, start + 3, "none"), ("hot", 80, None, start, "null"), ("hot", 59, start + 1000, start + 2_000_000, "tie")]
    for s in ("a", "b", None):
        rows += [(s, draw.randrange(40), "y") for _ in range(50)] + [(s, None, "z")]
        ranges += [(s, k, lo, lo + draw.randrange(12), f"{s}{k}") for k in range(8) for lo in [draw.randrange(40)]]
    rows += [("bare", 5, "w")]
    return rows, ranges


@pytest.mark.parametrize("long", [100_000, 100, 1])
@pytest.mark.parametrize("without", [(), ("all",)])
def test_last_covering(spark, data, long, without):
    rows, ranges = data[0], [r for r in data[1] if r[4] not in without]
    left = spark.createDataFrame(rows, "seq_id string, t bigint, _lo string").repartition(3)
    right = spark.createDataFrame(ranges, "seq_id string, ord bigint, lo bigint, hi bigint, label string")
    got = sorted((tuple(r) for r in rl.last_covering(left, right, long).collect()), key=repr)
    assert got == plain(rows, ranges)


def test_times_and_fractions(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([(1, at(s)) for s in range(5)], "seq_id int, t timestamp")
    ranges = spark.createDataFrame([(1, 1, at(1), at(3), 7), (1, 2, at(3), at(9), 8)], "seq_id int, ord int, lo timestamp, hi timestamp, label int")
    assert [r["range_label"] for r in rl.last_covering(rows, ranges, 1).orderBy("t").collect()] == [None, 7, 7, 8, 8]
    numbers = rows.select("seq_id", (F.second("t") / 2).alias("t"))
    spans = spark.createDataFrame([(1, 1, 0.25, 1.0, "x")], "seq_id int, ord int, lo double, hi double, label string")
    assert [r["range_label"] for r in rl.last_covering(numbers, spans).orderBy("t").collect()] == [None, "x", "x", None, None]
    assert rl.last_covering(numbers.limit(0), spans).collect() == [] and rl.last_covering(numbers, spans.limit(0)).filter("range_label is null").count() == 5


def test_blocks_cover_exactly_and_are_few(spark):
    levels = 7
    pairs = spark.createDataFrame([(a, b) for a in range(0, 100, 3) for b in range(a - 2, 100, 5)], "a bigint, b bigint")
    for r in pairs.withColumn("blocks", rl.blocks_between(F.col("a"), F.col("b"), levels)).collect():
        cells = [c for block in r["blocks"] for c in range(block["block"] << block["level"], (block["block"] + 1) << block["level"])]
        assert sorted(cells) == list(range(r["a"], r["b"] + 1)) and len(r["blocks"]) <= 2 * levels

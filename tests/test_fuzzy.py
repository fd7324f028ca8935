"""Fuzzy labels against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import fuzzy, texts


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(draw, letters, longest):
    return "".join(draw.choice(letters) for _ in range(draw.randrange(longest + 1)))


def test_edit_distance():
    draw = random.Random(1)
    for _ in range(3000):
        a, b = words(draw, "abcé漢", 9), words(draw, "abcé漢", 9)
        assert fuzzy.edit_distance(a, b) == plain_distance(a, b)
    a, b = words(draw, "ab", 400), words(draw, "ab", 400)
    assert fuzzy.edit_distance(a, b) == plain_distance(a, b)


@pytest.fixture(scope="module")
def data():
    """Labels in several alphabets, copies and near copies of them, and lines that share nothing with any."""
    draw = random.Random(2)
    labels = list({words(draw, letters, longest) for letters, longest in [("abc", 4), ("abcdefgh ", 14), ("ABCDEF é漢", 20)] for _ in range(150)} | {""})
    draw.shuffle(labels)
    lines = [words(draw, letters, 16) for letters in ("abc", "abcdefgh ", "xyz", "ABCxyz é") for _ in range(60)] + ["", "x" * 300]
    for label in labels[::4]:
        at = draw.randrange(len(label) + 1)
        lines += [label, label[:at] + "q" + label[at:], label[: max(0, at - 1)] + label[at:]]
    return lines, labels


@pytest.mark.parametrize("block_bytes", [1 << 22, 700])
def test_nearest_labels_against_all_pairs(spark, data, block_bytes):
    lines, labels = data
    left = spark.createDataFrame([(x,) for x in [*lines, *lines[:9], None]], "line string").repartition(3)
    right = spark.createDataFrame([(x, i * 2) for i, x in enumerate(labels)] + [(None, 0), (labels[0], 999_999)], "label string, ord int")
    got = {r["line"]: (r["label"], pytest.approx(r["score"])) for r in fuzzy.nearest_labels(left, right, block_bytes).collect()}
    assert got.pop(None)[0] == labels[0] and got.keys() == set(lines)
    for line in set(lines):
        score = lambda x: 1 - plain_distance(line, x) / max(len(line), len(x), 1)  # noqa: B023, E731
        best = max(range(len(labels)), key=lambda i: (score(labels[i]), -i))
        assert got[line] == (labels[best], score(labels[best])), line


def test_few_candidates_for_lines_near_a_label(spark):
    draw = random.Random(3)
    labels = list({words(draw, "abcdefghijklmnopqrstuvwxyz ", 30) + "end" for _ in range(3000)})
    lines = [x[:5] + "#" + x[6:] for x in labels[:400] if len(x) > 12]
    found = fuzzy.nearest_labels(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, ord bigint"))
    measured = found.agg(F.avg("candidates").alias("n"), F.min("score").alias("s")).first()
    assert measured["n"] < 0.01 * len(labels) and measured["s"] > 0.9


def test_empty_tables(spark):
    lines, labels = spark.createDataFrame([("a",)], "line string"), spark.createDataFrame([("a", 1)], "label string, ord bigint")
    assert texts.fuzzy_label(lines, labels.limit(0)).collect() == [] and texts.fuzzy_label(lines.limit(0), labels).collect() == []
    assert [tuple(r) for r in texts.fuzzy_label(lines, labels).collect()] == [("a", "a", 1.0)]

"""The text classifier against its formulas in numpy."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tilewright.operators import scoring as sc


def grams(text):
    w = re.findall(r"(?u)\b\w\w+\b|\w", text.lower())
    return collections.Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain_probabilities(train, test, c):
    """Softmax regression with a ridge on all but the intercepts, by plain descent on exact TF-IDF features; two classes share one weight vector."""
    docs = [grams(t) for t, _ in train]
    df = collections.Counter(g for d in docs for g in d)
    place = {g: i for i, g in enumerate(sorted(df))}

    def vector(counts):
        x = np.zeros(len(place))
        for g, n in counts.items():
            if g in place:
                x[place[g]] = n * (math.log((1 + len(docs)) / (1 + df[g])) + 1)
        return x / (np.linalg.norm(x) or 1)

    x, labels = np.array([vector(d) for d in docs]), sorted({label for _, label in train})
    y = np.eye(len(labels))[[labels.index(label) for _, label in train]]
    two = len(labels) == 2
    w, b = np.zeros((len(place), len(labels))), np.zeros(len(labels))
    spread = lambda w, b: (lambda z: np.exp(z - z.max(1, keepdims=True)))(x @ w + b)
    for _ in range(40_000):
        p = spread(w, b)
        p /= p.sum(1, keepdims=True)
        if two:  # logit u = w1 - w0 with the ridge on u
            g = c * x.T @ (p - y)[:, 1] + w[:, 1]
            step_b = c * (p - y)[:, 1].sum()
            w[:, 1] -= 0.02 * g
            b[1] -= 0.02 * step_b
        else:
            w -= 0.02 * (c * x.T @ (p - y) + w)
            b -= 0.02 * c * (p - y).sum(0)
    z = np.array([vector(grams(t)) for t in test]) @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    return labels, p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("classes", [["good", "bad"], ["a", "b", "c"]])
def test_probabilities_of_an_exact_model(spark, classes):
    draw = random.Random(4)
    word = {k: [f"{k}word", "I", "the", "Été", "x1", "day"] for k in classes}
    train = [(" ".join(draw.choices(word[k], k=draw.randrange(1, 7))) + "!", k) for k in classes for _ in range(9)]
    test = [t for t, _ in train[::5]] + ["", "nothing known", "the i day", "Été " + word[classes[0]][0]]
    labels, want = plain_probabilities(train, test, 10.0)
    found = sc.text_classifier(spark.createDataFrame(train, "text string, label string"), spark.createDataFrame([(k, t) for k, t in enumerate(test)], "id int, text string"), max_iter=200)[0]
    for r in found.collect():
        assert r["score"] == pytest.approx(want[r["id"]].max(), abs=2e-3) and want[r["id"]][labels.index(r["prediction"])] == pytest.approx(r["score"], abs=2e-3)
    assert found.count() == len(test)


def test_grams_are_counted_whole(spark):
    rows = spark.createDataFrame([(1, "A b, a B! é_1"), (2, None), (3, " - ")], "k int, text string")
    got = {(r["k"], r["gram"]): r["tf"] for r in sc.gram_counts(rows, "k", 3).collect()}
    assert got == {(1, g): n for g, n in grams("A b, a B! é_1").items()}


def test_cold_start_on_label_names(spark):
    labels = spark.createDataFrame([("sports news", "sports news"), ("weather", "weather")], "text string, label string")
    found = sc.text_classifier(labels, spark.createDataFrame([("the weather today",), (None,)], "text string"))[0].collect()
    assert {r["text"]: r["prediction"] for r in found}["the weather today"] == "weather" and len(found) == 2

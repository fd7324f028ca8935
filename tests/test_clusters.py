"""K-means of groups in one task and in rounds over blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import clusters as cl
from tilewright.operators import scoring as sc


@pytest.fixture(scope="module")
def points():
    """Blobs, copies, a group of one point, a group of fewer points than clusters."""
    draw = random.Random(4)
    rows = []
    for image in range(4):
        for cx, cy in ((0, 0), (50, 10), (10, 80)):
            rows += [(image, cx + draw.randrange(8), cy + draw.randrange(8)) for _ in range(60)]
    return rows + [(7, 1, 1)] * 5 + [(8, 0, 0), (8, 9, 9), (8, 9, 9)] + [(9, draw.randrange(100), draw.randrange(100)) for _ in range(150)]


@pytest.mark.parametrize("k,starts", [(3, 4), (2, 1)])
def test_rounds_give_what_one_task_gives(spark, points, k, starts):
    df = spark.createDataFrame(points, "image_id bigint, a bigint, b bigint").repartition(5)
    whole = {r["image_id"]: np.array(r["_centers"]) for r in cl.best_centers(df, ["a", "b"], k, 1, 20, starts, 1e-6).collect()}
    parts = {r["image_id"]: np.array(r["_centers"]) for r in cl.best_centers(df, ["a", "b"], k, 1, 20, starts, 1e-6, block=20).collect()}
    assert whole.keys() == parts.keys() == {0, 1, 2, 3, 7, 8, 9}
    assert all(np.allclose(whole[i], parts[i]) for i in whole)
    assert len(whole[7]) == 1 and len(whole[8]) == 2


def test_blobs_are_found_and_rows_kept(spark, points):
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(points)], "image_id bigint, a bigint, b bigint, k int")
    rows = sc.kmeans_rows(df, ["a", "b"], 3).collect()
    assert sorted(r["k"] for r in rows) == list(range(len(points)))
    for image in range(4):
        own = [r for r in rows if r["image_id"] == image]
        blob = {(r["a"] > 30, r["b"] > 40): r["cluster"] for r in own}
        assert len(set(blob.values())) == 3 and all(blob[r["a"] > 30, r["b"] > 40] == r["cluster"] for r in own)
    assert all(r["cost"] == 0 for r in rows if r["image_id"] in (7, 8))


def test_sums_match_plain_loops():
    draw = np.random.default_rng(2)
    points, weights, centers = draw.random((40, 3)), draw.integers(1, 5, 40).astype(float), draw.random((2, 3, 3))
    centers[1, 2] = np.nan
    sums = cl.sums_of(points, weights, centers)
    for s in range(2):
        near = [min((((p - c) ** 2).sum(), j) for j, c in enumerate(centers[s]) if not np.isnan(c).any()) for p in points]
        for j in range(3):
            mine = [i for i, (_, own) in enumerate(near) if own == j]
            assert np.allclose(sums[s, j, :3], (points[mine] * weights[mine, None]).sum(0)) and np.isclose(sums[s, j, 3], weights[mine].sum())
            assert np.isclose(sums[s, j, 4], sum(near[i][0] * weights[i] for i in mine))


def test_no_rows(spark):
    df = spark.createDataFrame([], "image_id bigint, a double")
    assert sc.kmeans_rows(df, ["a"], 2).collect() == []
    assert sc.background_segment(df.select("image_id", F.lit(0).alias("y"), F.lit(0).alias("x"), "a"), ["a"]).collect() == []

"""Chunked windows against plain ones, with one key holding most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.operators import ordered as o


@pytest.fixture(scope="module")
def hot(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"),
        ((F.col("id") * 7919) % 4001).alias("t"),
        ((F.col("id") * 31) % 17).alias("v"),
        F.when((F.col("id") * 31) % 17 < 5, F.lit(None)).otherwise((F.col("id") * 7919 % 4001 / 9).cast("int") % 3).alias("s"),
    )
    return rows.persist()


def chunks():
    return [None, F.floor(F.col("t") / 13), F.lit(0), F.floor(F.col("t") / 4001)]


@pytest.mark.parametrize("i", range(4))
def test_running(hot, i):
    w = Window.partitionBy("k").orderBy("t")
    want = hot.select("*", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.lag("s").over(w).alias("before"), F.lead("s").over(w).alias("after"))
    got = o.running(hot, ["k"], ["t"], sums={"total": F.col("v")}, prev={"before": "s"}, following={"after": "s"}, chunk=chunks()[i])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("i", range(4))
def test_islands(hot, i):
    w = Window.partitionBy("k").orderBy("t")
    flag = F.when(F.row_number().over(w) == 1, 1).when(F.lag("s").over(w).eqNullSafe(F.col("s")), 0).otherwise(1)
    want = hot.withColumn("f", flag).select(*hot.columns, F.sum("f").over(w).alias("island"))
    got = o.islands(hot, ["k"], ["t"], ["s"], chunk=chunks()[i])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_number_without_keys_and_text_order(spark):
    rows = spark.range(3000).select(F.concat(F.lit("n-"), (F.col("id") * 7919 % 3001).cast("string")).alias("name"))
    want = {r["name"]: i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: r["name"]))}
    got = o.number_rows(rows, [], ["name"]).collect()
    assert {r["name"]: r["rn"] for r in got} == want


def test_hot_key_is_spread(hot):
    chunk = o.quantile_chunk(hot, F.col("t"))
    per = hot.withColumn("c", chunk).filter("k = 7").groupBy("c").count().collect()
    assert len(per) >= 8 and max(r["count"] for r in per) < 400


def test_top_per_group_above_limit(hot):
    got = o.top_per_group(hot, ["k"], ["t"], 1200).groupBy("k").count().collect()
    sizes = {r["k"]: r["count"] for r in hot.groupBy("k").count().collect()}
    assert {r["k"]: r["count"] for r in got} == {k: min(1200, n) for k, n in sizes.items()}


def test_collect_parts_keeps_everything(hot):
    parts = o.collect_parts(hot, ["k"], ["t"], F.col("t"), size=100).collect()
    assert max(len(r["items"]) for r in parts) == 100
    whole = {}
    for r in sorted(parts, key=lambda r: (r["k"], r["part"])):
        whole.setdefault(r["k"], []).extend(r["items"])
    assert sum(map(len, whole.values())) == 4000 and all(v == sorted(v) for v in whole.values())


def test_same_seed_same_rows_on_any_partitioning(spark):
    rows = spark.range(500).select(F.col("id").alias("image_id"))
    one = o.shuffle_rank(rows.repartition(1), "image_id", 3).collect()
    many = o.shuffle_rank(rows.repartition(8), "image_id", 3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert sorted(r["rn"] for r in one) == list(range(1, 501))


def test_text_with_a_common_prefix_has_many_chunks(spark):
    names = spark.range(10_000).select(F.format_string("image_%08d", "id").alias("name"), F.lit(1).alias("k"))
    chunked = names.withColumn("c", o.text_chunk(names, "name"))
    sizes = [r["count"] for r in chunked.groupBy("c").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4000
    got = o.number_rows(names, ["k"], ["name"]).orderBy("name").limit(5).collect()
    assert [r["rn"] for r in got] == [1, 2, 3, 4, 5]
    assert o.number_rows(names, ["k"], ["name"]).agg(F.sum("rn")).first()[0] == 10_000 * 10_001 // 2


def test_text_order_with_nulls_and_ties_of_prefixes(spark):
    rows = spark.createDataFrame([(n,) for n in ["b", "", "ab", "a", None, "é", "aa", "Z"]], "name string")
    got = {r["name"]: r["rn"] for r in o.number_rows(rows, [], ["name"]).collect()}
    assert got == {None: 1, "": 2, "Z": 3, "a": 4, "aa": 5, "ab": 6, "b": 7, "é": 8}


@pytest.mark.parametrize("i", range(4))
def test_hot_groups_are_chunked(hot, i, monkeypatch):
    monkeypatch.setattr(o, "HOT_ROWS", 1000)
    assert o.has_hot_group(hot, ["k"]) and not o.has_hot_group(hot, ["k"], 3000)
    test_running(hot, i)
    test_islands(hot, i)


def test_groups_without_a_hot_one_are_dealt_once(hot):
    plan = o.number_rows(hot, ["k"], ["t"]).groupBy("k").agg(F.max("rn"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

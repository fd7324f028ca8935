"""Files of given names: order of parts, whole files only, refused names."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tilewright.sources import files
from tilewright.sources.named_files import write_named_files, write_one_file


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_rows_of_a_path_are_one_file_in_order(spark, tmp_path):
    rows = [("a/b/one.txt", k, f"line {k}\n") for k in range(3000)] + [("two é.bin", 0, "é"), ("empty", 0, None), ("gaps", 1, None), ("gaps", 0, "x"), ("gaps", 2, "y")]
    df = spark.createDataFrame(rows, "path string, part int, content string").orderBy(F.rand(3)).repartition(6)
    for _ in range(2):  # writing again leaves the same files
        write_named_files(df, str(tmp_path / "out"), "part")
    got = {k: v for k, v in tree(tmp_path / "out").items() if not k.endswith(".crc")}
    assert got == {"a/b/one.txt": "".join(f"line {k}\n" for k in range(3000)).encode(), "two é.bin": "é".encode(), "empty": b"", "gaps": b"xy"}


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../x", "", "a/", None, "."])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name of a file"):
        write_named_files(spark.createDataFrame([(name, b"1")], "path string, content binary"), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "x")


def test_no_rows_and_file_urls(spark, tmp_path):
    df = spark.createDataFrame([("k.json", "{}")], "path string, content string")
    write_named_files(df.limit(0), str(tmp_path / "none"))
    write_named_files(df, f"file:{tmp_path}/url")
    assert tree(tmp_path / "none") == {} and tree(tmp_path / "url") == {"k.json": b"{}"}


def test_metadata_files_hold_all_columns(spark, tmp_path):
    df = spark.sql("select 'i1' as image_id, timestamp'2024-01-02 03:04:05.678901' as at, array(1.5, null) as xs, cast(null as string) as no")
    files.write_metadata_files(df, str(tmp_path / "meta"))
    assert tree(tmp_path / "meta") == {"i1.json": b'{"image_id":"i1","at":"2024-01-02T03:04:05.678901Z","xs":[1.5,null]}'}


def test_listing_leaves_the_driver_out(spark, tmp_path):
    for name in ("a.jpg", "b/a.PNG", "b/c/d.png", "b/.hidden.png", "_tmp/e.png", "k=1/_x=2/f g%20.jpg", "b/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "empty").mkdir()
    listed = files.list_paths(spark, str(tmp_path))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path")
    assert sorted(listed.collect()) == sorted(want.collect())
    assert listed.count() == 5 and "binaryFile" not in listed._jdf.queryExecution().executedPlan().toString()
    assert files.list_paths(spark, f"file://{tmp_path}/a.jpg").collect() == [(f"file:{tmp_path}/a.jpg",)]


def most_read(spark, run):
    """Most rows that one task reads from a shuffle while `run` runs."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    as_list = jvm.scala.jdk.javaapi.CollectionConverters.asJava
    none, no_quantiles = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = lambda: {s.stageId(): s for s in as_list(store.stageList(none, False, False, no_quantiles, none))}
    before = stages()
    run()
    read = [0]
    for i, stage in stages().items():
        if i not in before and stage.shuffleReadRecords():
            tasks = as_list(store.taskList(i, stage.attemptId(), 1000))
            read += [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined()]
    return max(read)


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    (tmp_path / "out").mkdir()
    rows = spark.range(20_000).repartition(6).select(F.concat(F.col("id").cast("string"), F.lit(",é\n")).alias("content")).union(spark.sql("select cast(null as string)"))
    rows = spark.createDataFrame(rows.collect(), "content string").repartitionByRange(5, "content").sortWithinPartitions("content")
    want = "[" + "".join(r[0] or "" for r in rows.collect()) + "null, é" + "]"
    for file in (f"{tmp_path}/out/a.json", f"file:{tmp_path}/out/b.json"):
        write_one_file(file, ["[", rows, rows.limit(0), "null, é", spark.createDataFrame([], "content string"), "]"])
    assert tree(tmp_path / "out") == {"a.json": want.encode(), "b.json": want.encode()}
    assert most_read(spark, lambda: write_one_file(f"{tmp_path}/out/a.json", [rows])) < 10_000


@pytest.mark.parametrize("name", ["coco_file", "export_file"])
def test_no_task_holds_a_whole_document(spark, name):
    import __spark_entry__ as entry

    query = entry.queries()[name]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small inputs stay spread too
    try:
        assert most_read(spark, lambda: query(spark, "/root/testdata/sf0.001").count()) < 4000  # of 6,000 boxes
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_listing_of_many_files_holds_a_part_of_them_at_once(spark, monkeypatch):
    import __spark_entry__ as entry
    from check_oracle import compare, connect
    from tilewright.plans import files as plan

    most, remove = [], plan.remove_folders

    def counted(session, folders):
        most.append(sum(len(names) for f in folders for _, _, names in os.walk(re.sub("^file:/+", "/", f))))
        remove(session, folders)
        assert not any(os.path.exists(f) for f in folders)

    monkeypatch.setattr(plan, "TREE", 150)
    monkeypatch.setattr(plan, "remove_folders", counted)
    found = entry.queries()["list_files"](spark, "/root/testdata/sf0.001")
    cur = connect("/root/testdata/sf0.001").execute(entry.oracle_sql()["list_files"])
    assert compare(found.columns, found.collect(), [d[0] for d in cur.description], cur.fetchall()) is None
    assert len(most) == 3 and max(most) < 250 and 533 - 250 < sum(most) < 533  # the last tree stays

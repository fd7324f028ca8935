"""Elements of large JSON documents against the json library, at many split sizes."""

import json
import random

import pytest

from tilewright.sources import annotations as ann
from tilewright.sources.json_arrays import json_elements, own_text


def odd(draw, depth=0):
    """A value with brackets, quotes and backslashes in its strings."""
    kind = draw.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return "".join(draw.choice(['"', "\\", "{", "}", "[", "]", "é", "漢", "\n", ",", ":", "a", " "]) for _ in range(draw.randrange(9)))
    if kind < 3:
        return draw.choice([1, 2.5, None, True, -7])
    if kind < 5:
        return {f"k{i}": odd(draw, depth + 1) for i in range(draw.randrange(4))}
    return [odd(draw, depth + 1) for _ in range(draw.randrange(4))]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [97, 400, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_a_document(spark, tmp_path, small_splits, size, indent):
    small_splits(size)
    draw = random.Random(size)
    make = lambda n: [{"id": k, "v": odd(draw), "w": {"x": [odd(draw)]}} for k in range(n)]
    docs = [
        {"info": {"images": [{"no": 1}], "n": {"m": {}}}, "images": make(20), "empty": [], "nums": [1, 2, [3]], "annotations [x": make(25), "last": {"a": {"b": 1}}, "t": 'x"}{'},
        {"images": [], "s": "]}", "annotations [x": make(3)},
        {},
    ]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(k)) + ("\n" if k else ""), encoding="utf-8")
    got = sorted((r["file"][-6:], r["section"], json.dumps(json.loads(r["text"]))) for r in json_elements(spark, str(tmp_path), 2).collect())
    want = sorted((f"{k}.json", name, json.dumps(e)) for k, doc in enumerate(docs) for name, value in doc.items() if isinstance(value, list) for e in value if isinstance(e, dict))
    assert got == want


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_one_large_array_over_many_tasks(spark, tmp_path, small_splits, size):
    small_splits(size)
    draw = random.Random(3)
    tasks = [{"id": k, "v": odd(draw), "long": "}" * 300 if k == 5 else ""} for k in range(60)]
    (tmp_path / "e.json").write_text(json.dumps(tasks))
    found = json_elements(spark, str(tmp_path / "e.json"), 1)
    assert sorted((r["section"], r["text"]) for r in found.collect()) == sorted(("", json.dumps(t)) for t in tasks)


def test_coco_and_export_files(spark, tmp_path, small_splits):
    small_splits(120)
    images = [{"id": k, "file_name": f"{k}.jpg", "width": 10 + k, "height": 9} for k in range(12)]
    boxes = [{"id": k, "image_id": k % 12, "category_id": 1, "bbox": [k, 1.5, 2, 3], "segmentation": [[1, 2, 3]]} for k in range(40)]
    (tmp_path / "c.json").write_text(json.dumps({"info": {"year": 1}, "images": images, "annotations": boxes, "categories": [{"id": 1, "name": "a", "supercategory": "b"}]}, indent=2))
    pics, anns, cats = ann.read_coco(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, pics.collect())) == [(k, f"{k}.jpg", 10 + k, 9) for k in range(12)]
    assert sorted((r["id"], r["x"], r["h"], r["segmentation"]) for r in anns.collect()) == [(k, float(k), 3.0, [[1.0, 2.0, 3.0]]) for k in range(40)]
    assert [tuple(r) for r in cats.collect()] == [(1, "a", "b")]
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "c.json")).select("_metadata.file_block_start").distinct().count() > 20
    tasks = [{"id": k, "data": {"image": "x"}, "annotations": [{"completed_by": 3, "result": [{"id": "r", "value": {"a": ["}"]}}] if k % 2 else []}] if k else []} for k in range(9)]
    (tmp_path / "e.json").write_text(json.dumps(tasks))
    got = sorted((r["task_id"], r["completed_by"], r["value"]) for r in ann.read_label_export(spark, str(tmp_path / "e.json")).collect())
    assert got == [(k, 3 if k else None, '{"a":["}"]}' if k % 2 else None) for k in range(9)]


def test_own_text():
    assert own_text(b'"a": {"b": 1}, "images": [ {"c": {"d": "}"}}', 2) == b'{"c": {"d": "}"}}'

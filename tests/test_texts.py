"""Spans, tags and sub-tokens over whole texts give the rows of the row-wise operators, and no token is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilewright.operators import texts as tx


@pytest.fixture(params=[3, 10_000])
def odd(spark, request, monkeypatch):
    draw = random.Random(5)
    words = ["", "a", "bé", "日本語", "longer-word", "x" * 40]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 30)))) for i in range(40)] + [(50, ""), (51, " "), (52, None), (53, "   a")]
    spans = []
    for i, text in docs:
        at = 0
        while text is not None and draw.random() < 0.9 and at < len(text) + 20:
            end = at + draw.randrange(0, 25)
            spans.append((i, len(spans), at, end, draw.choice("ABC")))
            at = end + draw.randrange(0, 9)
    spans += [(52, 900, 0, 3, "A"), (99, 901, 0, 3, "A"), (None, 902, 0, 3, "A"), (53, 903, 2**61, 2**62, "B")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(spans, "doc_id bigint, span_id bigint, start bigint, end bigint, label string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("compat", [False, True])
def test_token_spans_of_texts(odd, compat):
    docs, spans = odd
    spans = spans.unionByName(docs.select("doc_id", F.lit(999).cast("bigint").alias("span_id"), F.lit(None).cast("bigint").alias("start"), F.lit(4).cast("bigint").alias("end"), F.lit("A").alias("label")))
    assert ordered(tx.char_to_token_spans_of_texts(docs, spans, compat=compat)) == ordered(tx.char_to_token_spans(tx.tokenize(docs), spans, compat=compat))


def test_tags_of_texts(odd):
    docs, spans = odd
    spans = spans.filter("start < 1000000")
    got = tx.bio_tags_of_texts(docs, spans, ["A", "B", "C"])
    assert ordered(got) == ordered(tx.bio_tags(tx.tokenize(docs), spans, ["A", "B", "C"]))


def test_labels_of_sub_tokens(spark, odd):
    rows = [(1, [None, 0, 0, 1, None, 1, 1, 2, 7], [5, 6, 7]), (2, [], [1]), (3, None, None), (4, [0, 0], []), (5, [0, 1], [8, None])]
    texts = spark.createDataFrame(rows, "doc_id bigint, words array<int>, tags array<int>")
    pieces = texts.select("doc_id", F.posexplode("words").alias("pos", "word_idx"))
    tags = texts.select("doc_id", F.posexplode("tags").alias("idx", "tag_id"))
    assert ordered(tx.align_subwords_of_texts(texts)) == ordered(tx.align_subwords(pieces, tags))


@pytest.mark.parametrize("name", ["align_subwords", "char_to_token_spans", "bio_tags"])
def test_no_token_is_shuffled(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= 2  # texts and spans by id, spans once more

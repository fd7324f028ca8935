"""Corpus pipeline over `documents`: rules, classifier, near duplicates, decontamination, token ids.

Every stage but the last returns the columns of the documents that it keeps. Decisions that
come from the text alone filter rows in place; those that need other documents are joined by
a hash of (doc_id, text), so null or repeated ids do no harm, and a filter of fixed size lets
only rows that may have to go be shuffled. Null texts count as empty ones (the rules reject them),
repeated rows are judged alike, an empty table passes through all stages, and columns of the
table may have any names; all but the last stage hand them on as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.byte_bpe import encode_decode
from tilewright.llm.dart_minhash import near_duplicates
from tilewright.llm.decontaminate import contaminated
from tilewright.llm.key_filter import may_be_among
from tilewright.llm.quality_classifier import THRESHOLD, scorer, train
from tilewright.llm.quality_rules import keeps
from tilewright.session import cut_lineage, shared_dir


def key() -> Column:
    """What tells rows apart: id and text; also where the id is null."""
    return F.xxhash64("doc_id", "text")


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not in `gone` (_k); of rows with a key in `repeated` one stays."""
    doubtful = gone if repeated is None else gone.unionByName(repeated)
    maybe = may_be_among(doubtful, "_k")(key())
    own = "_k"  # a name that no column of the documents has
    while own in {c.lower() for c in docs.columns}:
        own = f"_{own}"
    sure = docs.filter(~maybe)
    asked = docs.filter(maybe).withColumn(own, key()).join(gone.select(F.col("_k").alias(own)), own, "left_anti")
    if repeated is not None:
        asked = asked.dropDuplicates([own])
    return sure.unionByName(asked.drop(own))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go, so null and empty texts do too; repeated rows are judged alike."""
    return docs.filter(keeps(spark)(F.coalesce("text", F.lit(""))))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score below the threshold go; null texts are scored as empty ones, an empty table stays empty."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(scorer(docs, model)(F.coalesce("text", F.lit(""))) >= THRESHOLD)


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class the document with the smallest doc_id stays (null ids last), of rows equal in id and text one.

    Null and empty texts are in no class.
    """
    found = near_duplicates(docs.select(key().alias("_k"), "text"), key="_k").filter("class_size > 1")
    # rows equal in id and text share a key and a class: one row for all of them before any join
    members = cut_lineage(found.groupBy("_k").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n")))
    ids = docs.select(key().alias("_k"), "doc_id").join(members, "_k")
    first = ids.groupBy("class_id").agg(F.min_by("_k", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "_k")).alias("_k")).select("_k")
    gone = cut_lineage(members.select("_k").join(first, "_k", "left_anti"))
    repeated = cut_lineage(members.filter("n > 1").select("_k").join(first, "_k", "left_semi"))
    return without(docs, gone, repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a copy of a test item go, all rows of equal id and text; null texts hold none and stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs.select(key().alias("_k"), "text"), items, key="_k")
    return without(docs, cut_lineage(found.select("_k").distinct()))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of every document, and digests of the ids and of the decoded text; null texts as empty, other columns go."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicate_classes),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
ORACLE_SQL = None  # a trained classifier has no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""One registered query for each operator, with production parameters, over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import chat_rotation, collocations, dart_minhash, simhash, turn_repair
from tilewright.llm import quality_rules as rules
from tilewright.llm.byte_bpe import encode_decode
from tilewright.llm.decontaminate import contaminated
from tilewright.llm.html_text import extract_text
from tilewright.llm.licenses import scan_licenses
from tilewright.llm.maxent_lm import score_texts
from tilewright.llm.quality_classifier import quality_scores
from tilewright.llm.registry import ORACLES, QUERIES, query
from tilewright.llm.textops import table
from tilewright.llm.url_filter import filter_urls

__all__ = ["ORACLES", "QUERIES"]


@query("op8_quality_rules", sql=rules.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_dart_minhash", sql=dart_minhash.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_license_notices")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op5_maxent_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query("op2_chat_rotation", sql=chat_rotation.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_rotation.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return found.withColumn("masks", F.array_join(spans, ","))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query("op13_collocations", sql=collocations.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op11_turn_repair", sql=turn_repair.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(turn_repair.damage(table(spark, sf_dir, "conversations")), lost="lost")

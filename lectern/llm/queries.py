"""The training-data operators as registered queries, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, conversations, decontamination, license_scan, minhash, packing, pii, quality_classifier, quality_rules, runs, secret_scan, toxicity, warc
from lectern.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.annotate(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep_text=False)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def echoed(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by id, says its end over and over; a null id leaves the words as they are."""
    if doc_id is None or not words:
        return words
    g, h = divmod(zlib.crc32(doc_id.encode()), 10)
    if h:
        return words
    n, a = len(words), g % len(words)
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"), rewrite=echoed)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)


def damaged(df: DataFrame) -> DataFrame:
    """conversations with faults by hash of id and turn; a row that is dropped stays as a witness of its conversation, not ``present``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20).alias("fault")
    rows = df.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(rows, present=rows["present"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_warc, op4_quality_classifier, op5_toxicity, op6_quality_rules, op7_byte_bpe, op8_minhash, op9_pii, op10_decontamination,
                                   op11_periodic_runs, op12_packing, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    from lectern.llm import oracles

    return oracles.oracle_sql()

"""The corpus pipeline: toxicity, near-dedup, decontamination, secret scan, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet to the shared folder and rereads it as the next one's input, so
a lost executor costs the stage that it was in and no more.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, minhash, secret_scan, toxicity
from lectern.llm.common import durable, swept, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is probably toxic go.

    A text without a word of the model (null, empty) has the severity of such
    texts and stays; repeated rows are judged one by one; without labels of both
    kinds all stay; an empty table gives an empty table; columns other than
    COLUMNS are not read.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.annotate(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays: the first row of those with the smallest id.

    Rows are told apart by a number written with them, so null and repeated ids
    neither save a copy nor cost a document that is like no other. Documents
    without words (null, empty) are like none and stay; an empty table gives an
    empty table; columns other than COLUMNS are not read.
    """
    numbered = durable(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "pipeline-numbered")
    # written, so that Spark knows its size: while it is small, no text is shuffled
    gone = durable(minhash.judge(numbered, row_col="_row").where(~F.col("kept")).select(F.col("row").alias("_row")), "pipeline-gone")
    return numbered.join(gone, "_row", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's passages in a twentieth of their words or more go.

    Null and empty texts hold none and stay; repeated rows are judged one by
    one; an empty benchmark removes nothing; an empty table gives an empty
    table; columns other than COLUMNS are not read.
    """
    found = decontamination.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars counts anew where one was; all documents stay.

    A null text stays null, an empty one empty; rows that repeat an id or have
    none are scanned one by one; an empty table gives an empty table; columns
    other than COLUMNS are not read.
    """
    found = secret_scan.annotate(docs.select(*COLUMNS))
    text = F.when(F.size("spans") > 0, secret_scan.redact(F.coalesce("text", F.lit("")), F.col("spans"))).otherwise(F.col("text"))
    n_chars = F.when(F.size("spans") > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("_text", text).select("doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, as their number and digest, and the digest of what they decode to.

    A null text counts as empty and has no ids; repeated rows are coded one by
    one; an empty table gives an empty table; columns other than COLUMNS are not
    read.
    """
    coded = bpe.annotate(docs.select(*COLUMNS), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep_text=False)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("byte-level bpe", bpe_stage),
]
#: Toxicity is a fitted model and near-dedup a randomised search, which SQL can't express; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # once a stage is written, what it was made from is needed no more
        with swept() as kept:
            docs = kept(durable(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

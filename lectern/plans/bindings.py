"""The engine's entities bound to the driver's tables, once as DataFrames and once as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    category = F.when(F.col("toxic") == 1, "ai").when(F.col("quality") == 0, "topic").when(F.col("quality") == 1, "past")
    kps = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("KP-"), F.col("doc_id") % 7), F.concat(F.lit("KP-"), F.col("doc_id") % 11)))
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("topic"), F.col("text").alias("question"),
        (F.col("n_chars") % 12).alias("marks"), (F.col("doc_id") % 5).alias("difficulty"),
        F.concat(F.lit("Paper "), F.col("doc_id") % 3 + 1).alias("paper_type"),
        F.substring_index("text", " ", 1).alias("command_term"), F.col("doc_id").alias("created_at"), category.alias("category"),
        kps.alias("knowledge_point_ids"))


QUESTIONS = """
q AS (SELECT d.doc_id AS id, lang AS subject, source AS topic, text AS question, n_chars % 12 AS marks, d.doc_id % 5 AS difficulty,
       'Paper ' || (d.doc_id % 3 + 1) AS paper_type, split_part(text, ' ', 1) AS command_term, d.doc_id AS created_at,
       CASE WHEN toxic = 1 THEN 'ai' WHEN quality = 0 THEN 'topic' WHEN quality = 1 THEN 'past' END AS category,
       CASE WHEN d.doc_id % 13 = 0 THEN []::VARCHAR[] ELSE ['KP-' || (d.doc_id % 7), 'KP-' || (d.doc_id % 11)] END AS kps
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learner events: question_id, kind (correct, incorrect, completed, add), ts, event_id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (F.when(F.col("event_type").isin("purchase", "click"), "correct").when(F.col("event_type") == "error", "incorrect")
            .when(F.col("event_type") == "view", "completed").otherwise("add"))
    return e.select((k * 2 + F.col("user_id") % 2).alias("question_id"), kind.alias("kind"), "ts", "event_id", "user_id")


ATTEMPTS = """
a AS (SELECT (props ->> '$.k')::BIGINT * 2 + user_id % 2 AS question_id, ts, event_id, user_id,
       CASE WHEN event_type IN ('purchase', 'click') THEN 'correct' WHEN event_type = 'error' THEN 'incorrect'
            WHEN event_type = 'view' THEN 'completed' ELSE 'add' END AS kind FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lines: doc_id, pos, line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = """
lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Few bytes that are dear to work on, dealt by key to many tasks: a file's splits and merged partitions would go by bytes."""
    return df.repartition(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)

"""Learner progress and spaced repetition as folds of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Days until the next review after 1, 2, ... correct answers.
SRS_DAYS = (1, 3, 7, 16, 35)


def progress(events: DataFrame) -> DataFrame:
    """Per question: attempts, counters, last result, and status by the last of its events."""
    at = F.struct("ts", "event_id")
    tried = F.col("kind").isin("correct", "incorrect")
    e = events.where(F.col("kind") != "add")
    status = F.when(F.col("kind") == "incorrect", "wrong").otherwise(F.col("kind"))
    return e.groupBy("question_id").agg(
        F.count_if(tried).alias("attempts"), F.count_if(F.col("kind") == "correct").alias("correct_count"),
        F.count_if(F.col("kind") == "incorrect").alias("wrong_count"), F.max_by(status, at).alias("status"),
        F.max_by(F.when(tried, F.col("kind")), F.when(tried, at)).alias("last_result"), F.max(F.when(tried, F.col("ts"))).alias("last_seen"),
        F.max(F.when(F.col("kind") == "completed", F.col("ts"))).alias("completed_at"))


def srs(events: DataFrame) -> DataFrame:
    """The wrong-answer notebook in closed form.

    The anchor is the last incorrect answer, else the first manual add; the level
    is the number of correct answers since, 5 at most. Two map-side combined
    aggregates and a join on the question, no ordered window over a question's events.
    """
    at = F.struct("ts", "event_id")
    of = lambda kind: F.when(F.col("kind") == kind, at)
    anchor = events.groupBy("question_id").agg(
        F.max(of("incorrect")).alias("wrong"), F.min(of("add")).alias("added"), F.count_if(F.col("kind") == "incorrect").alias("times_wrong"))
    anchor = anchor.select("question_id", F.coalesce("wrong", "added").alias("anchor"), "times_wrong").where("anchor is not null")
    since = events.where("kind = 'correct'").join(anchor.select("question_id", "anchor"), "question_id").where(at > F.col("anchor"))
    since = since.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_correct"))
    level = F.least(F.coalesce("n", F.lit(0)), F.lit(len(SRS_DAYS)))
    days = F.element_at(F.array(*map(F.lit, SRS_DAYS)), F.greatest(level, F.lit(1)).cast("int"))
    due = F.when(level == 0, F.col("anchor.ts")).otherwise(F.col("last_correct") + F.make_dt_interval(days))
    return anchor.join(since, "question_id", "left").select(
        "question_id", level.cast("long").alias("srs_level"), "times_wrong", due.alias("next_review_at"))


def by_topic(state: DataFrame, items: DataFrame) -> DataFrame:
    """Counts and integer accuracy by topic; state rows without an item vanish."""
    j = state.join(items.select(F.col("id").alias("question_id"), "topic"), "question_id")
    return _accuracy(j.groupBy("topic").agg(F.count(F.lit(1)).alias("attempted"), F.sum("correct_count").alias("correct"), F.sum("wrong_count").alias("wrong")))


def by_knowledge_point(state: DataFrame, items: DataFrame) -> DataFrame:
    """As :func:`by_topic` by knowledge point; items without one, and unknown items, count as '(unlinked)'."""
    j = state.join(items.select(F.col("id").alias("question_id"), "knowledge_point_ids"), "question_id", "left")
    kps = F.when(F.coalesce(F.size("knowledge_point_ids"), F.lit(0)) > 0, F.col("knowledge_point_ids")).otherwise(F.array(F.lit("(unlinked)")))
    j = j.select("correct_count", "wrong_count", F.explode(kps).alias("kp"))
    return _accuracy(j.groupBy("kp").agg(F.count(F.lit(1)).alias("attempted"), F.sum("correct_count").alias("correct"), F.sum("wrong_count").alias("wrong")))


def _accuracy(df: DataFrame) -> DataFrame:
    n = F.col("correct") + F.col("wrong")
    return df.withColumn("accuracy", F.when(n > 0, F.round(100.0 * F.col("correct") / n)).otherwise(0.0).cast("long"))


def due(notebook: DataFrame, now) -> DataFrame:
    """Entries to review: not mastered and due; no date means not due."""
    return notebook.where((F.col("mastered") == 0) & (F.col("next_review_at") <= F.lit(now)))


def report_state(events: DataFrame) -> DataFrame:
    """Reports by id: last status, and the time it was last closed, which reopening does not clear."""
    at = F.struct("ts", "event_id")
    return events.groupBy("report_id").agg(
        F.max_by("status", at).alias("status"), F.max(F.when(F.col("status") != "open", F.col("ts"))).alias("resolved_at"), F.min("ts").alias("created_at"))

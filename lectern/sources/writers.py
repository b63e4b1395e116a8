"""Sinks: snapshots swapped in whole, JSON exports and HTML worksheets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import escape_html


def snapshot(df: DataFrame, base: str) -> str:
    """Write a new version under ``base`` and return its path; readers of older versions are not disturbed."""
    path = f"{base.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_partitions(df: DataFrame, path: str, part: str) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def worksheets(items: DataFrame, by: str, order: str) -> DataFrame:
    """(by, html): a question section and an answer key per group; an image stands in for the text where there is one."""
    def body(text: str, image: str):
        return F.when(F.coalesce(F.col(image), F.lit("")) != "", F.concat(F.lit('<img src="'), escape_html(F.col(image)), F.lit('">'))).otherwise(escape_html(F.coalesce(F.col(text), F.lit(""))))

    one = F.struct(F.col(order).alias("o"), F.concat(F.lit("<li>"), body("question", "question_image"), F.lit("</li>")).alias("q"),
                   F.concat(F.lit("<li>"), body("answer", "answer_image"), F.lit("</li>")).alias("a"))
    g = items.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("x"))
    part = lambda c: F.array_join(F.transform("x", lambda y: y[c]), "")
    return g.select(by, F.concat(F.lit("<section><ol>"), part("q"), F.lit("</ol></section><section><h2>Answers</h2><ol>"), part("a"), F.lit("</ol></section>")).alias("html"))

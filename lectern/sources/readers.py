"""Sources: JSON documents and folders, JSON lines, chunked lines, and file trees named by a grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_items(spark: SparkSession, path: str, schema: str, field: str = "questions") -> DataFrame:
    """Records of JSON files that hold an array, or an object with the array under ``field``.

    A file is one value; ``path`` may be a folder or a pattern. Files that don't parse give no rows; :func:`json_warnings` names them.
    """
    return _parsed(spark, path, schema, field).select("file", F.posexplode("items").alias("index", "r")).select("file", "index", "r.*")


def json_warnings(spark: SparkSession, path: str, schema: str, field: str = "questions", key: str = "id") -> DataFrame:
    """(file, warning): files that don't parse, and how many records of the others lack ``key``."""
    p = _parsed(spark, path, schema, field).withColumn("lost", F.size(F.filter("items", lambda x: F.coalesce(x[key].cast("string"), F.lit("")) == "")))
    warning = F.when(F.col("items").isNull(), "not parsed").when(F.col("lost") > 0, F.concat_ws(" ", F.col("lost").cast("string"), F.lit(f"without {key}")))
    return p.select("file", warning.alias("warning")).where("warning is not null")


def _parsed(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.from_json("value", f"array<struct<{schema}>>")
    held = F.from_json("value", f"struct<{field}:array<struct<{schema}>>>")[field]
    return raw.select("file", F.when(F.startswith(F.ltrim("value"), F.lit("[")), bare).otherwise(held).alias("items"))


def json_lines(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """JSON lines; bad lines are dropped."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.where("_corrupt is null").drop("_corrupt")
    return df.where(where) if where else df


def merged_chunks(spark: SparkSession, path: str, schema: str, by: str, order: list[str]) -> DataFrame:
    """All chunk files of all groups, renumbered in order within each group."""
    df = json_lines(spark, path, schema)
    return df.withColumn("in_book_order", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def file_tree(spark: SparkSession, path: str, pattern: str, names: list[str], min_year: int | None = None, exclude: str | None = None) -> DataFrame:
    """Files below ``path`` whose path matches the grammar, one column per group; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    df = listed.where(F.regexp_like("path", F.lit(pattern)))
    df = df.select("path", "length", *(F.regexp_extract("path", pattern, k + 1).alias(n) for k, n in enumerate(names)))
    if exclude:
        df = df.where(~F.regexp_like("path", F.lit(exclude)))
    return df.where(F.col("year").try_cast("int") >= min_year) if min_year is not None else df


def paired_files(papers: DataFrame, schemes: DataFrame) -> DataFrame:
    """Each paper with the first markscheme of its folder whose stem equals or contains its own."""
    j = papers.join(schemes, "folder").where((F.col("stem") == F.col("scheme_stem")) | F.contains("scheme_stem", F.col("stem")))
    rank = F.struct((F.col("stem") != F.col("scheme_stem")).alias("x"), F.col("scheme"))
    return papers.join(j.groupBy("folder", "stem").agg(F.min_by("scheme", rank).alias("scheme")), ["folder", "stem"], "left")

"""Integrity and coverage reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers that mean there is none.
SENTINELS = ("__AI_FILL__", "[Answer pending")


def answered(c: Column) -> Column:
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    return ~blank & ~reduce(Column.__or__, [F.startswith(c, F.lit(s)) for s in SENTINELS])


def integrity(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(check_name, ok, detail) of frames with one row (ok boolean, detail bigint)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_name"), "ok", F.col("detail").cast("long").alias("detail")) for name, df in checks])


def unique(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("detail"))
    return n.select((F.col("detail") == 0).alias("ok"), "detail")


def none_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("detail")).select((F.col("detail") == 0).alias("ok"), "detail")


def no_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("detail")).select((F.col("detail") == 0).alias("ok"), "detail")


def same_total(rows: DataFrame, declared: DataFrame, n: str) -> DataFrame:
    """The rows are as many as ``declared`` counts in sum; ``detail`` is by how many they differ."""
    one = rows.agg(F.count(F.lit(1)).alias("x")).unionByName(declared.agg((-F.coalesce(F.sum(n), F.lit(0))).cast("long").alias("x")))
    d = one.agg(F.abs(F.sum("x")).alias("detail"))
    return d.select((F.col("detail") == 0).alias("ok"), "detail")


def totals_agree(parents: DataFrame, children: DataFrame, key: str, n: str) -> DataFrame:
    """Every parent declares in ``n`` as many children as it has; a null declares nothing and is no fault."""
    c = children.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return none_where(parents.join(c, key, "left"), F.col(n) != F.coalesce("_c", F.lit(0)))


def unshared(df: DataFrame, path: str) -> DataFrame:
    """No two rows have the same path; ``detail`` counts the rows after the first of each. Nulls share nothing."""
    g = df.where(F.col(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    d = g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("detail"))
    return d.select((F.col("detail") == 0).alias("ok"), "detail")


def coverage(parents: DataFrame, children: DataFrame, key: str, answer: Column, has_answers: str) -> DataFrame:
    """Per parent: items, answered items, misleading flag and a four-state status."""
    c = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(answer).alias("n_answered"))
    j = parents.join(c, key, "left").fillna(0, ["n_items", "n_answered"])
    misleading = (F.col(has_answers) == 1) & (F.col("n_answered") == 0)
    status = (F.when(F.col("n_items") == 0, "empty").when(F.col("n_answered") == 0, "none").when(F.col("n_answered") < F.col("n_items"), "partial").otherwise("full"))
    return j.select(key, "n_items", "n_answered", misleading.alias("misleading"), status.alias("status"))


def rollup_unlimited(df: DataFrame, value: str) -> Column:
    """A sum in which one null (unlimited) makes the whole unlimited."""
    return F.when(F.bool_or(F.col(value).isNull()), None).otherwise(F.sum(value))

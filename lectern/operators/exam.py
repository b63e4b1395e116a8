"""Exam assembly: seeded order, count mode, and greedy filling by marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portable_order(key: Column) -> Column:
    """A seeded order any SQL engine can reproduce."""
    return (key * 7919) % 10007


def pool(items: DataFrame, used: DataFrame | None = None, authored: str | None = None, **equal) -> DataFrame:
    """Candidates: equalities, author filter, minus used ids."""
    for k, v in equal.items():
        items = items.where(F.col(k) == v)
    if authored is not None:
        items = items.where((F.col("authored_by") == "ai") if authored == "ai" else ~F.col("authored_by").eqNullSafe("ai"))
    return items.join(used.select("id").distinct(), "id", "left_anti") if used is not None else items


def by_count(candidates: DataFrame, n: int, order: Column) -> DataFrame:
    return candidates.withColumn("_o", order).orderBy("_o", "id").limit(n).drop("_o")


def by_marks(candidates: DataFrame, target: int, order: Column) -> DataFrame:
    """(position, id, marks): first fit in seeded order, then, if short, the smallest of the rest until the target is met.

    An item of 0 or unknown marks counts 1. First fit needs a bounded list: an
    item beyond the smallest ``target`` of any one mark value can't be taken (each
    taken item uses a mark at least), so per mark value only the first ``target``
    items in order are gathered, target * target rows at most.
    """
    from pyspark.sql.window import Window

    m = F.when(F.coalesce("marks", F.lit(0)) == 0, 1).otherwise(F.col("marks")).cast("long")
    c = candidates.select("id", m.alias("m"), order.alias("o")).where(F.col("m") > 0)
    w = Window.partitionBy("m").orderBy("o", "id")
    few = c.withColumn("k", F.row_number().over(w)).where((F.col("k") <= target) & (F.col("m") <= target))
    # one larger item may close the gap in the second pass
    extra = c.where(F.col("m") > target).orderBy("m", "o", "id").limit(1)
    every = few.drop("k").unionByName(extra)
    arr = every.agg(F.sort_array(F.collect_list(F.struct("o", "id", "m"))).alias("xs"))
    start = F.struct(F.lit(target).cast("long").alias("left"), F.array().cast("array<struct<id:bigint,m:bigint>>").alias("out"),
                     F.array().cast("array<struct<m:bigint,o:bigint,id:bigint>>").alias("rest"))

    def fit(s: Column, x: Column) -> Column:
        ok = x["m"] <= s["left"]
        one = F.struct(x["id"].cast("long").alias("id"), x["m"].alias("m"))
        other = F.struct(x["m"].alias("m"), x["o"].cast("long").alias("o"), x["id"].cast("long").alias("id"))
        return F.struct(F.when(ok, s["left"] - x["m"]).otherwise(s["left"]).alias("left"),
                        F.when(ok, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"),
                        F.when(ok, s["rest"]).otherwise(F.concat(s["rest"], F.array(other))).alias("rest"))

    one = arr.select(F.aggregate("xs", start, fit).alias("s")).select("s.*")

    def fill(s: Column, x: Column) -> Column:
        more = s["left"] > 0
        add = F.struct(x["id"].alias("id"), x["m"].alias("m"))
        return F.struct(F.when(more, s["left"] - x["m"]).otherwise(s["left"]).alias("left"), F.when(more, F.concat(s["out"], F.array(add))).otherwise(s["out"]).alias("out"))

    out = F.aggregate(F.sort_array("rest"), F.struct("left", "out"), fill)["out"]
    return one.select(F.posexplode(out).alias("p", "x")).select((F.col("p") + 1).cast("long").alias("position"), "x.id", F.col("x.m").alias("marks"))

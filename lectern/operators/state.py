"""Keyed state as pure functions: (old, delta) -> new.

Parquet tables take no UPDATE or MERGE, so every mutation gives the next
snapshot. All of them are idempotent but :func:`toggle`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(delta: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row of each key that came last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return delta.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(delta: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.asc(seq))
    return delta.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Whole rows are replaced; columns that ``new`` lacks fall back to their defaults."""
    for c in old.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit((defaults or {}).get(c)).cast(old.schema[c].dataType))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def merge_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Only the columns of ``update`` change on a match; rows without a match are inserted."""
    update = list(update if update is not None else [c for c in new.columns if c not in keys])
    o = old.withColumn("_o", F.lit(True))
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys)).withColumn("_m", F.lit(True))
    both = o.join(n, list(keys), "full")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        taken = F.col("_m").isNotNull() if c in update else F.col("_m").isNotNull() & F.col("_o").isNull()
        return F.when(taken, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*keys, *(value(c) for c in old.columns if c not in keys))


def patch(old: DataFrame, patches: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Dynamic PATCH: ``patches`` has per field a struct (set, val); unset fields keep their value."""
    p = patches.select(*keys, *(F.col(f).alias(f"_p_{f}") for f in fields))
    both = old.join(p, list(keys), "left")
    new = {f: F.when(F.coalesce(F.col(f"_p_{f}.set"), F.lit(False)), F.col(f"_p_{f}.val")).otherwise(F.col(f)) for f in fields}
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    fresh = first_wins(new, keys, seq).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def toggle(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Present keys go, absent ones come."""
    gone = old.join(new.select(*keys), list(keys), "left_anti")
    return gone.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is null stay."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def cascade_delete(header: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """Header and child tables without the rows of the keys that go."""
    ids = gone.select(F.col(key)).distinct()
    cut = [c.join(ids.withColumnRenamed(key, fk), fk, "left_anti") for c, fk in children]
    return (header.join(ids, key, "left_anti"), *cut)


def replace_partition(old: DataFrame, new: DataFrame, part: str, where: Column | None = None) -> DataFrame:
    """All rows of the partitions that ``new`` has (or that ``where`` names) give way to it."""
    kept = old.join(new.select(part).distinct(), part, "left_anti") if where is None else delete_where(old, where)
    return kept.unionByName(new.select(*old.columns))


def upsert_keeping(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    """Replace-upsert in which matched rows keep their first value of ``keep``."""
    before = old.select(*keys, F.col(keep).alias("_before"))
    new = new.join(before, list(keys), "left").withColumn(keep, F.coalesce("_before", F.col(keep))).drop("_before")
    return replace_upsert(old, new, keys)


def update_where(df: DataFrame, updates: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """Ordered conditional updates: a later one sees and overrides an earlier one."""
    for condition, column, value in updates:
        df = df.withColumn(column, F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(column)))
    return df


def map_update(old: DataFrame, mapping: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Non-empty values of ``mapping`` replace; unknown keys and empty values change nothing."""
    m = mapping.select(*keys, *(F.nullif(F.col(c), F.lit("")).alias(f"_m_{c}") for c in columns))
    both = old.join(m, list(keys), "left")
    return both.select(*(F.coalesce(f"_m_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failures with their message) in one pass each."""
    tested = rows.withColumn("error", error)
    return tested.where("error is null").drop("error"), tested.where("error is not null")


def replicate(source: DataFrame, target_columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns both sides know, and those dropped on the way."""
    return source.select(*(c for c in source.columns if c in target_columns)), [c for c in source.columns if c not in target_columns]


def orphans(rows: DataFrame, kept: DataFrame, keys: Sequence[str], guard: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to stay, rows to delete): those without a key in ``kept`` go, but never where ``guard`` holds. Nothing is deleted by asking."""
    lost = rows.join(kept.select(*keys).distinct().withColumn("_kept", F.lit(True)), list(keys), "left").withColumn("_gone", F.col("_kept").isNull() & ~F.coalesce(guard, F.lit(False)))
    return lost.where("not _gone").drop("_kept", "_gone"), lost.where("_gone").drop("_kept", "_gone")


def verified_copy(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replicates ``source`` into ``target``'s columns and counts: (copied, expected, ok), from the keys found after the merge."""
    common, _ = replicate(source, target.columns)
    after = merge_upsert(target, common, list(keys))
    found = after.select(*keys).distinct().join(common.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("copied"))
    return found.crossJoin(common.select(*keys).distinct().agg(F.count(F.lit(1)).alias("expected"))).withColumn("ok", F.col("copied") == F.col("expected"))


def cascade_repoint(children: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Rows that point to a collapsed duplicate point to the row that stays (old, new); equal rows are one."""
    j = children.join(mapping.select(F.col("old").alias(key), "new"), key, "left")
    return j.select(*(F.coalesce("new", key).alias(key) if c == key else F.col(c) for c in children.columns)).distinct()

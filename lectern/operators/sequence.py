"""Sequence operators over ordered rows and arrays: spans, fills, runs, walks, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def span_ends(df: DataFrame, by: Sequence[str], start: str, end_default: Column) -> DataFrame:
    """A span ends where the next one starts."""
    return df.withColumn("span_end", F.coalesce(F.lead(start).over(_w(by, start)), end_default))


def prefix_offsets(df: DataFrame, by: Sequence[str], order: str, length: Column, joiner: int = 1) -> DataFrame:
    """Where each piece starts in the joined whole."""
    before = _w(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start_at", F.coalesce(F.sum(length + joiner).over(before), F.lit(0)).cast("long"))


def forward_fill(df: DataFrame, by: Sequence[str], order: str, label: Column, stop: Column | None = None) -> DataFrame:
    """The last label so far; a row where ``stop`` holds breaks the inheritance."""
    mark = F.when(stop, F.struct(F.lit(None).cast("string").alias("l"))) if stop is not None else F.lit(None).cast("struct<l:string>")
    state = F.coalesce(F.when(label.isNotNull(), F.struct(label.alias("l"))), mark)
    return df.withColumn("filled", F.last(state, True).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))["l"])


def gap_groups(df: DataFrame, by: Sequence[str], order: str, gap: float, name: str = "grp") -> DataFrame:
    """A new group wherever the step from the row before exceeds ``gap``."""
    step = F.col(order) - F.lag(order).over(_w(by, order))
    d = df.withColumn("_new", F.coalesce((step > gap).cast("int"), F.lit(0)))
    return d.withColumn(name, F.sum("_new").over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def anchored_groups(tops: Column, tolerance: float) -> Column:
    """Sorted positions grouped by distance to each group's first member: array<struct<anchor,n>>."""
    start = F.array().cast("array<struct<anchor:double,n:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, F.size(acc))
        same = F.when(F.size(acc) > 0, x - last["anchor"] <= tolerance).otherwise(False)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["anchor"].alias("anchor"), (last["n"] + 1).alias("n"))))
        fresh = F.concat(acc, F.array(F.struct(x.alias("anchor"), F.lit(1).cast("long").alias("n"))))
        return F.when(same, grown).otherwise(fresh)

    return F.aggregate(F.sort_array(tops.cast("array<double>")), start, add)


def islands(df: DataFrame, by: Sequence[str], order: str, condition: Column, least: int = 3) -> DataFrame:
    """Runs of consecutive rows that meet ``condition``: first, last, n, and their texts joined."""
    d = df.withColumn("_in", condition).where("_in").withColumn("_g", F.col(order) - F.row_number().over(_w(by, order)))
    g = d.groupBy(*by, "_g").agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count(F.lit(1)).alias("n"),
                                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: F.trim(x["line"])), " ").alias("joined"))
    return g.where(F.col("n") >= least).drop("_g")


def expected_walk(hits: Column, first: int = 1, cap: int = 1 << 30) -> Column:
    """Accept hits (pos, n) in order while n is the expected number; array<struct<pos,n>>."""
    start = F.struct(F.lit(first).cast("long").alias("e"), F.array().cast("array<struct<pos:bigint,n:bigint>>").alias("out"))

    def add(s: Column, h: Column) -> Column:
        ok = (h["n"] == s["e"]) & (s["e"] <= cap)
        one = F.struct(h["pos"].cast("long").alias("pos"), h["n"].cast("long").alias("n"))
        return F.struct(F.when(ok, s["e"] + 1).otherwise(s["e"]).alias("e"), F.when(ok, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.sort_array(hits), start, add, lambda s: s["out"])


def bounded_gap_run(numbers: Column, first_max: int = 3, gap: int = 3) -> Column:
    """Monotone run: the first number is at most ``first_max``; then repeats and steps up to ``gap`` are accepted."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        ok = F.when(s["last"].isNull(), x <= first_max).otherwise(x.between(s["last"], s["last"] + gap))
        return F.struct(F.when(ok, x).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(numbers.cast("array<bigint>"), start, add, lambda s: s["out"])


def longest_run(df: DataFrame, by: Sequence[str], order: str, value: str, max_step: int = 1) -> DataFrame:
    """Per group the longest run of rows that each rise by 1 to ``max_step``; the earliest among equals."""
    step = F.col(value) - F.lag(value).over(_w(by, order))
    d = df.withColumn("_b", F.when(step.between(1, max_step), 0).otherwise(1))
    d = d.withColumn("_g", F.sum("_b").over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*by, "_g").agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(*by).agg(F.max_by(F.struct("first_pos", "last_pos", "n"), F.struct("n", (-F.col("first_pos")).alias("p"))).alias("r"))
    return best.select(*by, "r.first_pos", "r.last_pos", "r.n")


def page_gate(df: DataFrame, by: Sequence[str], order: str, kind: Column, name: str = "taken") -> DataFrame:
    """'head' pages are always taken, 'numbered' ones only right after a taken page; anything else breaks the chain."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(F.when(kind != "numbered", kind), True).over(w) == "head", F.lit(False)))


def coverage_gaps(df: DataFrame, by: Sequence[str], low: str, high: str, cell: int = 5, least: int = 25) -> DataFrame:
    """Uncovered stretches of at least ``least`` between covered cells: gutters (gap_start, gap_end)."""
    cells = df.select(*by, F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))).alias("c")).distinct()
    nxt = F.lead("c").over(_w(by, "c"))
    g = cells.withColumn("_n", nxt).where((F.col("_n") - F.col("c") - 1) * cell >= least)
    return g.select(*by, ((F.col("c") + 1) * cell).cast("long").alias("gap_start"), (F.col("_n") * cell).cast("long").alias("gap_end"))


def span_pages(df: DataFrame, first: str, last: str) -> DataFrame:
    """A row per page of a span, telling whether it is the first, a middle or the last page."""
    p = df.withColumn("page", F.explode(F.sequence(F.col(first), F.col(last))))
    part = F.when(F.col("page") == F.col(first), "first").when(F.col("page") == F.col(last), "last").otherwise("middle")
    return p.withColumn("part", part)


def upper_median(df: DataFrame, by: Sequence[str], value: str, at: float = 0.5) -> DataFrame:
    """The element at floor(n * ``at``) of the sorted values: no interpolation. Equal values are one counted row."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(_w(by, value).rowsBetween(Window.unboundedPreceding, 0))
    d = c.withColumn("_u", upto).withColumn("_k", F.floor(F.sum("_c").over(Window.partitionBy(*by)) * at))
    return d.where((F.col("_u") > F.col("_k")) & (F.col("_u") - F.col("_c") <= F.col("_k"))).select(*by, F.col(value).alias("median"))


def density_start(df: DataFrame, by: Sequence[str], page: str, flag: str, share: float = 0.25, least: int = 3, tail: float = 0.2) -> DataFrame:
    """First page of the back matter: flagged pages from it on are at least ``share`` of the rest and ``least`` in number, in the last ``tail``."""
    rest = Window.partitionBy(*by).orderBy(F.col(page).desc()).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = df.withColumn("_f", F.sum(F.col(flag).cast("int")).over(rest)).withColumn("_r", F.count(F.lit(1)).over(rest)).withColumn("_p", n - F.col("_r")).withColumn("_n", n)
    ok = F.col(flag) & (F.col("_f") >= least) & (F.col("_f") >= share * F.col("_r")) & (F.col("_p") >= (1 - tail) * F.col("_n"))
    return d.where(ok).groupBy(*by).agg(F.min(page).alias("start_page"))

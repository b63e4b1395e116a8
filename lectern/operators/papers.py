"""Papers and their markschemes, from lines to records: the walks over both, the gate that lets a paper through, spans, marks and skip reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import command_term
from lectern.operators.sequence import expected_walk

# A question's head, the table of a markscheme, and where a question states its marks.
HEAD = r"^\s*(\d{1,2})\.(?:\s|$)"
TABLE = r"^\s*(?:Question|Q)\s+Answers\s+Notes\s+Total"
MAXIMUM = r"(?i)\[Maximum mark:\s*(\d+)\]|\[(\d+)\s*marks?\]"
EACH = r"\[(\d+)\]"
#: The highest number that a walk counts to.
LAST = 60


def paper_walks(lines: DataFrame, by: Sequence[str], head: str = HEAD, table: str | None = None, least: int = 6, most: int = 25) -> DataFrame:
    """(by, n, questions, answers, skip): the walks 1, 2, 3 … over the lines (side, page, pos, line) of a paper (side ``q``) and of its markscheme (``m``).

    ``n`` is what the markscheme counts to, the paper's own count where it counts to nothing. With ``table`` its walk begins at that line, if there is
    one. A paper is skipped for the first of: ``no markscheme``, ``too few`` or ``too many`` questions, ``questions missing``, ``answers missing``.
    """
    n = F.regexp_extract("line", head, 1).try_cast("long")
    d = lines.where(F.col("side").isin("q", "m")).select(*by, "side", "pos", n.alias("n"), F.col("line"))
    if table is not None:
        since = F.min(F.when((F.col("side") == "m") & F.regexp_like("line", F.lit(table)), F.col("pos"))).over(Window.partitionBy(*by))
        d = d.withColumn("_since", since).withColumn("n", F.when((F.col("side") == "q") | F.col("_since").isNull() | (F.col("pos") >= F.col("_since")), F.col("n")))
    hit = lambda side: F.collect_list(F.when((F.col("side") == side) & F.col("n").between(1, LAST), F.struct("pos", "n")))
    # what is gathered are a paper's numbered lines, never its text
    g = d.groupBy(*by).agg(hit("q").alias("_q"), hit("m").alias("_m"), F.bool_or(F.col("side") == "m").alias("_there"))
    g = g.withColumn("_q", expected_walk(F.col("_q"), cap=LAST)).withColumn("_m", expected_walk(F.col("_m"), cap=LAST))
    g = g.withColumn("n", F.when(F.size("_m") > 0, F.size("_m")).otherwise(F.size("_q")).cast("long")).withColumn("_q", F.slice("_q", F.lit(1), F.greatest(F.col("n").cast("int"), F.lit(0))))
    skip = (F.when(~F.col("_there"), "no markscheme").when(F.col("n") < least, "too few").when(F.col("n") > most, "too many")
            .when(F.size("_q") != F.col("n"), "questions missing").when(F.size("_m") != F.col("n"), "answers missing"))
    return g.select(*by, "n", F.col("_q").alias("questions"), F.col("_m").alias("answers"), skip.alias("skip"))


def spans(lines: DataFrame, starts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, side, n, text, page, last_page): the lines from each start (by, side, n, pos) to the next of its side. A span ends on the page before
    the next start's, if that is no page before its own; the last one on the page of its last line."""
    key = [*by, "side"]
    s = starts.withColumn("_n", F.col("n")).select(*key, "pos", "_n")
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = lines.join(s, [*key, "pos"], "left").withColumn("n", F.max("_n").over(so_far)).where("n is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n")
    g = l.groupBy(*key, "n").agg(body.alias("text"), F.min("page").alias("page"), F.max("page").alias("_end"))
    after = F.lead("page").over(Window.partitionBy(*key).orderBy("n"))
    return g.withColumn("last_page", F.when(after.isNotNull(), F.greatest("page", after - 1)).otherwise(F.col("_end"))).drop("_end")


def stated_marks(text: Column, rule: str) -> Column:
    """``maximum``: what the first 220 characters state; ``each``: the sum of all marks in brackets. Null where there are none."""
    if rule == "maximum":
        first = F.substring(text, 1, 220)
        return F.coalesce(*(F.nullif(F.regexp_extract(first, MAXIMUM, k), F.lit("")) for k in (1, 2))).try_cast("long")
    every = F.transform(F.regexp_extract_all(text, F.lit(EACH), F.lit(1)), lambda x: x.try_cast("long"))
    return F.nullif(F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0).cast("long"))


def paper_records(lines: DataFrame, by: Sequence[str], marks: str = "maximum", **gate) -> DataFrame:
    """One record per question of every paper that passes the gate of `paper_walks`: (by, number, question, answer, marks, command_term, page,
    last_page, answer_page, answer_last_page). Answers go to questions by number; a paper that fails gives none."""
    w = paper_walks(lines, by, **gate).where("skip is null")
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.col(c).alias("x"))
    s = w.select(*by, F.explode(F.array(side("q", "questions"), side("m", "answers"))).alias("s")).select(*by, "s.side", F.explode("s.x").alias("x")).select(*by, "side", "x.n", "x.pos")
    p = spans(lines.select(*by, "side", "page", "pos", "line"), s, by)
    pick = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    g = p.groupBy(*by, "n").agg(pick("q", "text").alias("question"), pick("m", "text").alias("answer"), pick("q", "page").alias("page"), pick("q", "last_page").alias("last_page"),
                                pick("m", "page").alias("answer_page"), pick("m", "last_page").alias("answer_last_page"))
    body = F.regexp_replace("question", r"^\s*\d{1,2}\.\s*", "")
    return g.select(*by, F.col("n").alias("number"), "question", "answer", stated_marks(F.col("question"), marks).alias("marks"), command_term(body).alias("command_term"), "page", "last_page", "answer_page", "answer_last_page")


def skip_reasons(walks: DataFrame) -> DataFrame:
    """(reason, papers): how many papers were let through (``taken``) and how many were skipped for each reason."""
    return walks.groupBy(F.coalesce("skip", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("papers"))

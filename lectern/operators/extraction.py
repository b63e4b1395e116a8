"""Document extraction over lines, marks and spans: merging, splitting, indexing and grounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Signs of an answer in a region, and the phrase of an empty page.
ANSWER_SIGNS = r"(?i)\[\d+\s*marks?\]|«|\baward\b|\[N/?A\]"
SPACER_PHRASE, SPACER_CHARS = "Please do not write", 180


def merge_parts(items: DataFrame) -> DataFrame:
    """Sub-questions (id ``...Q<n><letter>``) merged into their parent, where it has two or more.

    The head comes from the first part; marks from ``[Maximum mark: N]`` there, else the largest part's;
    distinct answers are joined, each after its letter.
    """
    p = items.select("*", F.regexp_extract("id", r"^(.*Q\d+)([a-z])$", 1).alias("parent"), F.regexp_extract("id", r"^(.*Q\d+)([a-z])$", 2).alias("letter")).where("parent <> ''")
    g = p.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("letter", "question", "answer", "marks"))).alias("x")).where(F.size("x") >= 2)
    head = F.get("x", F.lit(0))
    told = F.regexp_extract(head["question"], r"\[Maximum mark: (\d+)\]", 1).try_cast("long")
    fresh = F.filter("x", lambda a, i: ~F.exists(F.slice("x", F.lit(1), i), lambda b: b["answer"] == a["answer"]))
    return g.select("parent", F.size("x").cast("long").alias("n_parts"), F.array_join(F.transform("x", lambda a: a["question"]), "\n").alias("question"),
                    F.array_join(F.transform(fresh, lambda a: F.concat(F.lit("("), a["letter"], F.lit(") "), a["answer"])), "\n").alias("answer"),
                    F.coalesce(told, F.array_max(F.transform("x", lambda a: a["marks"]))).cast("long").alias("marks"))


def split_bands(bands: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bands (y0, y1) split at the cuts (y) strictly inside them, renumbered from the top; what stands twice counts once.

    Equal starts of a band follow each other in its window, so the last of them is taken there: no task holds a table of all rows.
    """
    inside = bands.join(cuts, list(by)).where("y > y0 and y < y1").select(*by, "y0", "y1", F.col("y").alias("start"))
    starts = bands.select(*by, "y0", "y1", F.col("y0").alias("start")).unionByName(inside)
    after = F.lead(F.struct("start")).over(Window.partitionBy(*by, "y0", "y1").orderBy("start"))
    s = starts.withColumn("_next", after).where(F.col("_next").isNull() | ~F.col("_next.start").eqNullSafe(F.col("start"))).withColumn("end", F.coalesce("_next.start", "y1"))
    return s.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", "y0"))).select(*by, "number", "start", "end")


def spilled_options(pages: DataFrame, by: Sequence[str], order: str, first: str, last: str) -> DataFrame:
    """Runs of blocks whose first option letter follows the last one of the block before: one question over a break."""
    w = Window.partitionBy(*by).orderBy(order)
    follows = F.coalesce(F.ascii(F.col(first)) - F.lag(F.ascii(F.col(last))).over(w) == 1, F.lit(False))
    d = pages.withColumn("_new", (~follows).cast("int"))
    return d.withColumn("question", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def code_page_spans(hits: DataFrame, by: Sequence[str], code: str, page: str, region: str) -> DataFrame:
    """First page of each code in each region, and the page before the next code's first one (the last: open)."""
    first = hits.groupBy(*by, region, code).agg(F.min(page).alias("first_page"))
    w = Window.partitionBy(*by, region).orderBy("first_page", code)
    return first.withColumn("last_page", F.greatest(F.lead("first_page").over(w) - 1, F.col("first_page")))


def markscheme_rows(lines: DataFrame, by: Sequence[str], order: str, line: str, opens: str | None = None) -> DataFrame:
    """Lines grouped under the last number (and letter) that opened a row: (by, number, letter, content).

    One or two digits open a row, more of them only before a point or bracket. ``opens`` is the column that is looked at, if not the line.
    """
    head = opens or line
    number = F.nullif(F.regexp_extract(head, r"^\s*(\d{1,2}\b|\d+(?=[.)]))", 1), F.lit("")).try_cast("int")
    letter = F.nullif(F.regexp_extract(head, r"^\s*(?:(?:\d{1,2}\b|\d+(?=[.)]))\W*)?\(?([a-h])\)", 1), F.lit(""))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(number.isNotNull() | letter.isNotNull(), F.struct(number.isNotNull().alias("fresh"), letter.alias("letter")))
    d = lines.withColumn("number", F.last(number, True).over(w)).withColumn("_k", F.last(key, True).over(w))
    d = d.withColumn("letter", F.col("_k.letter")).where("number is not null")
    g = d.groupBy(*by, "number", "letter").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t")))).alias("x"))
    return g.select(*by, "number", "letter", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("content"))


def nearest_separator(anchor: Column, separators: Column, clear: float = 4.0) -> Column:
    """The first separator more than ``clear`` below the anchor, or null."""
    return F.array_min(F.filter(separators, lambda s: s > anchor + clear))


def narrowed_part(marks: DataFrame, by: Sequence[str], letter: str, pos: str, letters: Sequence) -> DataFrame:
    """Each lettered mark with the first later mark of a higher letter: the extent of a sub-part.

    ``letters`` are the letters there are, in order, so the nearest later place of each is one growing minimum.
    """
    w = Window.partitionBy(*by).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = [F.when(F.col(letter) < F.lit(x), F.min(F.when(F.col(letter) == F.lit(x), F.col(pos))).over(w)) for x in letters]
    return marks.withColumn("part_end", F.least(*later))


def grounded_prompt(question: Column, answer: Column, explanation: Column, subject: Column, limits: tuple[int, int] = (2500, 1200)) -> Column:
    """The context of a tutor request: fields that are present, one a line, long ones cut."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.nullif(c, F.lit("")))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    return F.concat_ws("\n", line("Subject", F.coalesce(F.nullif(subject, F.lit("")), F.lit("unknown"))), line("Question", cut(question, limits[0])),
                       line("Answer", cut(answer, limits[1])), line("Explanation", cut(explanation, limits[1])))


def region_has_answer(c: Column) -> Column:
    return F.regexp_like(c, F.lit(ANSWER_SIGNS))


def is_cover(c: Column) -> Column:
    """A page with a digit and fewer than three letters or digits once its title is gone."""
    body = F.regexp_replace(c, r"(?i)^\s*(topic|paper|section)\s+\w+", "")
    return F.regexp_like(c, F.lit(r"\d")) & (F.length(F.regexp_replace(body, r"[^A-Za-z0-9]", "")) < 3)


def is_spacer(c: Column) -> Column:
    return F.contains(c, F.lit(SPACER_PHRASE)) & (F.length(c) < SPACER_CHARS)

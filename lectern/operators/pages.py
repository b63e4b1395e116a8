"""Pages of books and of screenshots: their kinds, questions that run over several pages, the regions of a page and the crops of a question.

Lines are rows (by, page, top, x0, text), tops measured from the page's upper edge. What is decided for a page looks at that page's lines
alone, so pages spread over tasks; what runs over pages is a window over the lines of one stretch of pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import let
from lectern.operators.sequence import page_gate

# Headings of exercises, headings of pages that hold none, front matter, and the lines that open a question or a part of one.
EXERCISES = (r"end[\s\-]?of[\s\-]?topic\s+questions?", r"end[\s\-]?of[\s\-]?chapter\s+exercises?", r"mixed\s+practice", r"mixed\s+review", r"review\s+questions?",
             r"chapter\s+review", r"practice\s+questions?", r"exercise\s+\d+", r"exercises?", r"questions?", r"problems?", r"test\s+yourself", r"self[\s\-]?test")
EXCLUDED = (r"worked\s+example", r"example\s+\d+", r"let\s+us\s+(explore|investigate)", r"solution\s+to", r"key\s+idea", r"in\s+this\s+section", r"table\s+of\s+contents",
            r"\bcontents\b", r"index\b", r"how\s+to\s+use\s+this\s+book", r"introduction\b", r"foreword\b", r"acknowledgements?", r"^\s*\d{0,4}\s*answers\b")
FRONT = r"^\s*(introduction|about\s+this\s+book|how\s+to\s+use\s+this|preface|acknowledgements?|contents|index|welcome\s+to)\b"
BANNER = r"^\s*(index|glossary)\b"
LEADERS = r"\.{6,}"
LETTER = r"^\(?[a-eA-E]\)?[.)]?\s+\S"
RUNNING = r"^(HL|IB|Paper|Name|Date|Candidate|Page|Turn over|Total|Maximum|For examiner|This document|Read these|Instructions|–\s*\d|\.\s*\d)$"
#: A number opens a question before a capital, before a part's letter and a word, or alone on its line.
OPENING = r"^(?:(\d{1,3})[.)]?\s+(?:[A-Z]|[a-z]\s+[A-Za-z])|\s*(\d{1,3})\s*$)"


def opening_number(text: Column) -> Column:
    """The number that opens a question at the start of a line, else null; a row of numbers (``0 1 2 3``) and a formula (``1 x = 2``) open none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, OPENING, k), F.lit("")) for k in (1, 2))).cast("int")


def _marginal(top: Column, text: Column, height: Column) -> Column:
    return ((top.between(0, 0.05 * height) & (top != 0.05 * height)) | (top > 0.94 * height)) & (F.length(text) < 15)


def page_kinds(lines: DataFrame, by: Sequence[str], height: Column, width: Column, headers: Sequence[str] = EXERCISES, markers: int = 1, margin: float = 0.20, exclude: str | None = None) -> DataFrame:
    """Pages by kind: (by, page, kind, header).

    A page with an excluded heading in its first 400 characters, front matter in its first 600, six rows of dot leaders, a banner of an index or
    ``exclude`` anywhere is of no kind (null). Of the others, one with an exercise heading in its first eight lines is a ``head``, one with
    ``markers`` numbers at the left margin is ``numbered``, one with two letters there a ``continuation``. Lines without a text count as empty
    ones; equal tops go by x0, then by text.
    """
    text = F.coalesce("text", F.lit(""))
    inside = (F.col("x0") <= margin * width) & ~_marginal(F.col("top"), text, height)
    number = opening_number(text).isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    g = lines.groupBy(*by, "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", text.alias("t")))), lambda x: x["t"]).alias("_l"),
        count(F.regexp_like(text, F.lit(LEADERS))).alias("_dots"), count(inside & number).alias("_digits"), count(inside & ~number & F.regexp_like(text, F.lit(LETTER))).alias("_letters"))
    g = g.withColumn("_t", F.array_join("_l", "\n")).withColumn("_h", F.array_join(F.slice("_l", 1, 8), "\n"))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    none = (like(F.substring("_t", 1, 400), "(?imd)" + "|".join(EXCLUDED)) | like(F.substring("_t", 1, 600), "(?imd)" + FRONT) | (F.col("_dots") >= 6) | like(F.col("_t"), "(?i)" + BANNER))
    if exclude is not None:
        none = none | like(F.col("_t"), exclude)
    header = F.regexp_extract("_h", "(?i)(" + "|".join(f"(?:{h})" for h in headers) + ")", 1)
    g = g.withColumn("_head", F.when(~none, header)).withColumn("kind", F.when(none, F.lit(None)).when(F.col("_head") != "", "head").when(F.col("_digits") >= markers, "numbered").when(F.col("_letters") >= 2, "continuation"))
    return g.select(*by, "page", "kind", F.when(F.col("kind") == "head", F.trim("_head")).otherwise(F.col("kind")).alias("header"))


def stitched_questions(lines: DataFrame, kinds: DataFrame, by: Sequence[str], height: Column, width: Column, margin: float = 0.20) -> DataFrame:
    """Questions over pages: (by, ordinal, number, page, last_page, pages, text).

    A head opens a stretch of exercises, which the numbered and continuation pages right after it go on with; any other page ends it. A question
    runs from its number at the left margin to the next one of its stretch, so what a continuation holds joins the question before it. Numbers
    on a continuation open nothing; short lines at the upper and lower edge are left out.
    """
    chain = F.when(F.col("kind").isin("numbered", "continuation"), "numbered").otherwise(F.coalesce("kind", F.lit("other")))
    k = page_gate(kinds, by, "page", chain)
    pages = Window.partitionBy(*by).orderBy("page")
    k = k.withColumn("_run", F.count(F.when(F.coalesce(F.col("kind"), F.lit("")) == "head", 1)).over(pages.rowsBetween(Window.unboundedPreceding, 0))).where("taken").select(*by, "page", "kind", "_run")
    l = lines.withColumn("text", F.coalesce("text", F.lit(""))).where(~_marginal(F.col("top"), F.col("text"), height)).join(k, [*by, "page"])
    number = F.when((F.col("x0") <= margin * width) & (F.col("kind") != "continuation"), opening_number(F.col("text")))
    line = F.struct("page", "top", "x0", "text")
    so_far = Window.partitionBy(*by, "_run").orderBy("page", "top", "x0", "text").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("_n", number).withColumn("_q", F.count("_n").over(so_far)).where("_q > 0")
    q = l.groupBy(*by, "_run", "_q").agg(
        F.max("_n").alias("number"), F.min("page").alias("page"), F.max("page").alias("last_page"), F.count_distinct("page").alias("pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n").alias("text"))
    return q.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("_run", "_q")).cast("long")).select(*by, "ordinal", "number", "page", "last_page", "pages", "text")


def page_regions(pages: DataFrame, lines: DataFrame, rules: DataFrame, anchors: DataFrame, by: Sequence[str], wide: float = 0.5, least: float = 14, band: float = 90) -> DataFrame:
    """Question regions of every page (by, page, height, width): (by, ordinal, page, top, bottom, method).

    Three ways compete for a page, in this order. ``rules``: the stretches between horizontal rules (top, x0, x1) that span ``wide`` of the page,
    if any is ``least`` tall; but if they give a single region where two numbers or more stand, the numbers win. ``numbers``: from each anchor
    (top) to the next or the next rule. ``page``: the whole of it. A region begins at its first line (top, bottom, text) that is no furniture and
    ends no higher than its stretch does. A document's first page gives up a short first region at its upper and a short last one at its lower
    edge if it has more than one. Pages without lines, rules or anchors keep their stretches as they are.
    """
    key = [*by, "page"]
    text = F.trim(F.coalesce("text", F.lit("")))
    running = F.regexp_like(text, F.lit("(?i)" + RUNNING)) & (F.size(F.split(text, r"\s+")) <= 10)
    # furniture needs the page's height, so lone page numbers go when lines meet their page
    l = lines.where((text != "") & ~running).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("top").cast("double").alias("t"), F.col("bottom").cast("double").alias("b"), F.regexp_like(text, F.lit(r"^\d{1,3}$")).alias("lone")))).alias("_l"))
    s = rules.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(F.round(F.col("top").cast("double"), 1).alias("t"), (F.col("x1") - F.col("x0")).cast("double").alias("w")))).alias("_s"))
    a = anchors.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("top").cast("double"))).alias("_a"))
    d = pages.withColumn("height", F.col("height").cast("double")).join(l, key, "left").join(s, key, "left").join(a, key, "left")
    h = F.col("height")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    d = d.withColumn("_l", F.filter(none("_l", "struct<t:double,b:double,lone:boolean>"), lambda x: ~(x["lone"] & (x["t"] > 0.9 * h))))
    tops = F.array_distinct(F.transform(F.filter(none("_s", "struct<t:double,w:double>"), lambda x: x["w"] >= wide * F.col("width")), lambda x: x["t"]))
    apart = lambda kept, x: F.when(F.coalesce(x - F.try_element_at(kept, F.lit(-1)) > 3, F.lit(True)), F.concat(kept, F.array(x))).otherwise(kept)
    d = d.withColumn("_s", F.aggregate(tops, F.array().cast("array<double>"), apart)).withColumn("_a", none("_a", "double"))
    region = lambda t, b: F.struct(t.cast("double").alias("t"), b.cast("double").alias("b"))

    def trimmed(r: Column) -> Column:
        def bounds(own: Column) -> Column:
            last = F.array_max(F.transform(own, lambda x: x["t"]))
            low = F.array_max(F.transform(F.filter("_l", lambda x: F.abs(x["t"] - last) < 4), lambda x: x["b"]))
            return F.when(F.size(own) > 0, region(F.array_min(F.transform(own, lambda x: x["t"])), F.greatest(r["b"], low))).otherwise(r)

        return let(F.filter("_l", lambda x: x["t"].between(r["t"] - 1, r["b"] + 1)), bounds)

    tall = lambda r: r["b"] - r["t"] >= least
    edges = lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda t, i: region(t, F.get(e, i + 1)))
    gaps = let(F.concat(F.array(F.lit(0.0)), "_s", F.array(h)), edges)
    by_rule = F.filter(F.transform(F.filter(gaps, tall), trimmed), tall)
    below = lambda t: F.array_min(F.filter("_s", lambda x: x > t + 4)) - 1
    by_number = F.transform("_a", lambda t, i: trimmed(region(t, F.least(F.coalesce(F.get(F.col("_a"), i + 1) - 2, h), F.coalesce(below(t), h)))))
    whole = F.array(trimmed(region(F.lit(0.0), h)))
    d = d.withColumn("_r", F.when(F.size("_s") > 0, by_rule).otherwise(F.array().cast("array<struct<t:double,b:double>>")))
    method = (F.when((F.size("_r") > 0) & ~((F.size("_r") <= 1) & (F.size("_a") >= 2)), "rules").when(F.size("_a") > 0, "numbers").otherwise("page"))
    d = d.withColumn("method", method)
    d = d.withColumn("_r", F.array_sort(F.when(F.col("method") == "rules", F.col("_r")).when(F.col("method") == "numbers", by_number).otherwise(whole)))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("page")) == 1
    short = lambda r: r["b"] - r["t"] < band
    opening = (F.col("_r")[0]["t"] <= 0.5) & short(F.col("_r")[0])
    closing = lambda r: (r["b"] >= h - 1) & short(r)
    d = d.withColumn("_many", first & (F.size("_r") > 1)).withColumn("_r", F.when(F.col("_many") & opening, F.slice("_r", F.lit(2), F.size("_r"))).otherwise(F.col("_r")))
    d = d.withColumn("_r", F.when(F.col("_many") & closing(F.try_element_at("_r", F.lit(-1))), F.slice("_r", F.lit(1), F.size("_r") - 1)).otherwise(F.col("_r")))
    e = d.select(*key, "method", F.posexplode("_r").alias("_k", "_x"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("page", "_k")).cast("long")
    return e.select(*by, place.alias("ordinal"), "page", F.col("_x.t").alias("top"), F.col("_x.b").alias("bottom"), "method")


def page_frames(lines: DataFrame, by: Sequence[str], height: Column, head: float = 0.085, foot: float = 0.915, body: float = 1.02) -> DataFrame:
    """(by, page, height, ctop, cbot, left, right): the part of a page between its running head and foot.

    The first line (top, bottom, x0, x1, size, text) gives way if it stands in the page's upper ``head`` and is set no larger than ``body`` times
    the page's text size, the upper median over its words; the last likewise in the lower part.
    """
    key = [*by, "page"]
    # a page has few sizes: their word counts are summed up, not the words sorted
    words = lines.groupBy(*key, "size").agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))).alias("_c")).where("_c > 0")
    w = Window.partitionBy(*key)
    below = F.sum("_c").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    common = words.withColumn("_b", below).withColumn("_m", F.floor(F.sum("_c").over(w) / 2)).where("_b > _m").groupBy(*key).agg(F.min("size").alias("body"))
    edge = F.struct("top", "x0", "bottom", "size")
    g = lines.groupBy(*key).agg(F.min(edge).alias("_f"), F.max(edge).alias("_e"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.max(height).cast("double").alias("height"))
    g = g.join(common, key, "left")
    ctop = F.when((F.col("_f.top") < head * F.col("height")) & (F.col("_f.size") <= body * F.col("body")), F.col("_f.bottom")).otherwise(0)
    cbot = F.when((F.col("_e.top") > foot * F.col("height")) & (F.col("_e.size") <= body * F.col("body")), F.col("_e.top")).otherwise(F.col("height"))
    return g.select(*key, "height", ctop.cast("double").alias("ctop"), cbot.cast("double").alias("cbot"), F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))


def question_crops(questions: DataFrame, frames: DataFrame, by: Sequence[str], section: str, width: float, most: int = 4, room: float = 58, lead: float = 8, gap: float = 5, pad: float = 14,
                   scale: float = 1.8, sliver: tuple[int, int] = (80, 26)) -> DataFrame:
    """The rectangles that show a question, in order: (by, section, page, top, number, tile, tile_page, x0, y0, x1, y1).

    A question (page, top, number) runs to the next of its section, over at most ``most`` pages, and the last one to the end of its own page; one
    that would be lower than ``room`` is given that room. Each page's rectangle lies within its frame. Rectangles under 4 tall are left out, and
    so are questions whose picture at ``scale`` would be a sliver.
    """
    w = Window.partitionBy(*by, section).orderBy("page", "top", "number")
    q = questions.select(*by, section, "page", "top", "number").withColumn("_n", F.lead(F.struct("page", "top")).over(w))
    q = q.withColumn("_end", F.coalesce("_n.page", "page")).withColumn("tile_page", F.explode(F.sequence("page", F.least("_end", F.col("page") + most - 1))))
    j = q.join(frames.withColumnRenamed("page", "tile_page"), [*by, "tile_page"])
    own, last = F.col("tile_page") == F.col("page"), F.col("tile_page") == F.col("_end")
    cramped = own & last & (F.col("_n.top") - F.col("top") < room)
    end = F.when(cramped, F.least(F.col("top") + room, F.col("cbot"))).otherwise(F.col("_n.top"))
    top = F.when(own, F.greatest(F.col("top") - lead, F.col("ctop"))).otherwise(F.col("ctop"))
    # the last question ends with its page
    bottom = F.when(last & F.col("_n").isNotNull(), F.least(end - gap, F.col("cbot"))).when(last, F.col("cbot") - gap).otherwise(F.col("cbot"))
    # every rectangle of a question is as wide as its first page's text
    mine = Window.partitionBy(*by, section, "page", "top", "number")
    edge = lambda c: F.min_by(c, "tile_page").over(mine)
    j = j.withColumn("x0", F.greatest(edge("left") - pad, F.lit(0.0))).withColumn("x1", F.least(edge("right") + pad, F.lit(float(width))))
    j = j.withColumn("y0", top.cast("double")).withColumn("y1", bottom.cast("double")).where("y1 - y0 >= 4")
    j = j.withColumn("tile", F.row_number().over(mine.orderBy("tile_page")).cast("long")).withColumn("_tall", F.sum(F.col("y1") - F.col("y0")).over(mine))
    j = j.where(((F.col("x1") - F.col("x0")) * scale >= sliver[0]) & (F.col("_tall") * scale >= sliver[1]))
    return j.select(*by, section, "page", "top", "number", "tile", "tile_page", "x0", "y0", "x1", "y1")

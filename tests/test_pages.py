"""Kinds of pages, stitched questions, competing regions and crops, on pages worked out by hand and by a plain rule in Python."""

import random

from pyspark.sql import functions as F

from lectern.operators import pages

LINE = "doc long, page long, top double, bottom double, x0 double, x1 double, size double, text string"


def set_lines(spark, rows):
    return spark.createDataFrame([(d, p, float(t), float(t) + 10, float(x), 400.0, 10.0, s) for d, p, t, x, s in rows], LINE)


def kinds(spark, rows, **kw):
    got = pages.page_kinds(set_lines(spark, rows), ["doc"], F.lit(800), F.lit(600), **kw).collect()
    return {r["page"]: (r["kind"], r["header"]) for r in got}


PAGES = [
    (1, 0, 50, 60, "Chapter 3 Review  questions"), (1, 0, 100, 60, "1. Find x"), (1, 0, 160, 60, "see above"),
    (1, 1, 50, 60, "(a) first"), (1, 1, 90, 60, "b) second"), (1, 1, 10, 60, "3 Sets"),  # the running head is no number
    (1, 2, 50, 60, "tail of it"), (1, 2, 90, 60, "2 a Draw it"), (1, 2, 130, 200, "7. Indented"), (1, 2, 170, 60, "0 1 2 3"), (1, 2, 200, 60, "1 x = 2"), (1, 2, 790, 60, "44"),
    (1, 3, 50, 60, "Worked example 5"), (1, 3, 90, 60, "3. Find y"),
    (1, 4, 50, 60, "4. Not right after"),
    (1, 5, 50, 60, "Exercise 9"), (1, 5, 80, 60, "12"), (1, 5, 90, 60, None),
    (1, 6, 50, 60, "nothing here"),
    *((1, 7, 40 + 20 * k, 60, f"1. Part {k} ........ {k}") for k in range(6)),
    (1, 8, 50, 60, "Glossary"), (1, 8, 90, 60, "1. Alpha"),
    *((1, 9, 40 + 20 * k, 60, "plain") for k in range(8)), (1, 9, 300, 60, "questions come late"),
]


def test_kinds_of_pages(spark):
    got = kinds(spark, PAGES)
    assert got == {0: ("head", "Review  questions"), 1: ("continuation", "continuation"), 2: ("numbered", "numbered"), 3: (None, None), 4: ("numbered", "numbered"),
                   5: ("head", "Exercise 9"), 6: (None, None), 7: (None, None), 8: (None, None), 9: (None, None)}
    assert kinds(spark, PAGES, markers=2)[2] == (None, None) and kinds(spark, PAGES, exclude="Draw")[2] == (None, None)
    assert kinds(spark, []) == {}


def test_questions_over_pages(spark):
    l = set_lines(spark, PAGES)
    k = pages.page_kinds(l, ["doc"], F.lit(800), F.lit(600))
    got = pages.stitched_questions(l.withColumn("kind", F.lit("clash")).drop("kind"), k, ["doc"], F.lit(800), F.lit(600)).orderBy("ordinal").collect()
    assert [(r["number"], r["page"], r["last_page"], r["pages"], r["text"]) for r in got] == [
        (1, 0, 2, 3, "1. Find x\nsee above\n(a) first\nb) second\ntail of it"),
        (2, 2, 2, 1, "2 a Draw it\n7. Indented\n0 1 2 3\n1 x = 2"), (12, 5, 5, 1, "12\n")]


def plain_regions(page, lines, rules, anchors, first):
    """The rule for one page, by loops."""
    height, width = page
    lines = sorted((t, b) for t, b, s in lines if s.strip() and not (s.strip().isdigit() and t > 0.9 * height) and s != "Turn over")
    seps = []
    for t in sorted({round(t, 1) for t, x0, x1 in rules if x1 - x0 >= 0.5 * width}):
        if not seps or t - seps[-1] > 3:
            seps.append(t)
    anchors = sorted(anchors)

    def trim(t, b):
        own = [x for x in lines if t - 1 <= x[0] <= b + 1]
        if not own:
            return t, b
        last = own[-1][0]
        return own[0][0], max([b] + [x[1] for x in lines if abs(x[0] - last) < 4])

    edges = [0.0, *seps, height]
    ruled = [r for r in (trim(*e) for e in zip(edges, edges[1:]) if e[1] - e[0] >= 14) if r[1] - r[0] >= 14] if seps else []
    if ruled and not (len(ruled) == 1 and len(anchors) >= 2):
        method, out = "rules", ruled
    elif anchors:
        method, out = "numbers", []
        for i, t in enumerate(anchors):
            end = anchors[i + 1] - 2 if i + 1 < len(anchors) else height
            out.append(trim(t, min([end] + [s - 1 for s in seps if s > t + 4][:1])))
    else:
        method, out = "page", [trim(0.0, height)]
    out = sorted(out)
    if first and len(out) > 1:
        if out[0][0] <= 0.5 and out[0][1] - out[0][0] < 90:
            out = out[1:]
        if out and out[-1][1] >= height - 1 and out[-1][1] - out[-1][0] < 90:
            out = out[:-1]
    return [(t, b, method) for t, b in out]


def test_regions_are_those_of_the_plain_rule(spark):
    r = random.Random(5)
    page, line, rule, anchor, want = [], [], [], [], {}
    for doc in range(40):
        want[doc] = []
        for p in range(3):
            h, w = 400.0, 300.0
            ls = [(float(t), float(t) + 9, r.choice(["text", "text", "7", "Turn over", " "])) for t in (r.randrange(0, 400) for _ in range(r.randrange(0, 9)))]
            rs = [(r.randrange(0, 4000) / 10 + r.choice([0, 0.04]), 0.0, r.choice([100.0, 200.0])) for _ in range(r.choice([0, 0, 1, 3]))]
            rs += [(t + 2, x0, x1) for t, x0, x1 in rs[:1]] + ([(399.0, 0.0, 300.0)] if r.random() < 0.2 else [])
            an = [float(t) for t in r.sample(range(0, 390), r.choice([0, 1, 2, 3]))]
            page.append((doc, p, h, w))
            line += [(doc, p, *x) for x in ls]
            rule += [(doc, p, *x) for x in rs]
            anchor += [(doc, p, x) for x in an]
            want[doc] += [(p, *x) for x in plain_regions((h, w), ls, rs, an, p == 0)]
    got = pages.page_regions(spark.createDataFrame(page, "doc long, page long, height double, width double"), spark.createDataFrame(line, "doc long, page long, top double, bottom double, text string"),
                             spark.createDataFrame(rule, "doc long, page long, top double, x0 double, x1 double"), spark.createDataFrame(anchor, "doc long, page long, top double"), ["doc"])
    found = {d: [] for d in want}
    for x in got.orderBy("doc", "ordinal").collect():
        found[x["doc"]].append((x["page"], round(x["top"], 6), round(x["bottom"], 6), x["method"]))
    assert found == {d: [(p, round(t, 6), round(b, 6), m) for p, t, b, m in rows] for d, rows in want.items()}
    assert {x[3] for rows in found.values() for x in rows} == {"rules", "numbers", "page"}


def test_crops_cover_a_question_once(spark):
    rows = [(1, 0, 20, 60, "Running head"), (1, 0, 100, 60, "1. A"), (1, 0, 130, 60, "2. B"), (1, 0, 780, 60, "9"), (1, 1, 300, 80, "text"), (1, 2, 60, 60, "3. C"), (1, 2, 500, 60, "more")]
    l = set_lines(spark, rows)
    f = pages.page_frames(l, ["doc"], F.lit(800))
    assert {(x["page"], x["ctop"], x["cbot"]) for x in f.collect()} == {(0, 30.0, 780.0), (1, 0.0, 800.0), (2, 70.0, 800.0)}
    q = l.withColumn("number", pages.opening_number(F.col("text"))).where("number < 9").withColumn("section", F.lit("s"))
    got = pages.question_crops(q, f, ["doc"], "section", 600).orderBy("page", "top", "tile").collect()
    assert [(x["number"], x["tile"], x["tile_page"], x["x0"], x["x1"], x["y0"], x["y1"]) for x in got] == [
        (1, 1, 0, 46.0, 414.0, 92.0, 153.0),  # the next number is near: 58 of room
        (2, 1, 0, 46.0, 414.0, 122.0, 780.0), (2, 2, 1, 46.0, 414.0, 0.0, 800.0),  # no rectangle above the next number on its page
        (3, 1, 2, 46.0, 414.0, 70.0, 795.0)]
    far = pages.question_crops(q.where("number <> 2").withColumn("page", F.when(F.col("number") == 3, 9).otherwise(F.col("page"))), f, ["doc"], "section", 600).where("number = 1")
    assert [x["tile_page"] for x in far.orderBy("tile").collect()] == [0, 1, 2]
    assert pages.question_crops(q, f, ["doc"], "section", 50).count() == 0 and pages.question_crops(q.limit(0), f, ["doc"], "section", 600).count() == 0

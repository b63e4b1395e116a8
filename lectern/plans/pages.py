"""Book pages as queries: lines of documents set on pages of twelve, with exercise headings, numbers and parts at places that their position gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import pages
from lectern.plans.bindings import LINES, lines, table
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()
HEIGHT, WIDTH = 800, 600


def _set(spark, sf):
    """Lines on pages: doc, page, top, bottom, x0, x1, size, text, nr (place on the page)."""
    p, doc = F.col("pos"), F.col("doc_id")
    page, nr = F.floor(p / 12), p % 12
    v = (doc * 7 + page * 5) % 11
    opened = (F.when((nr == 0) & (v < 3), "Mixed practice ").when((nr == 0) & (v == 3), "Worked example ").when((nr == 0) & (v == 4), "Index ").when((nr > 2) & (v == 5), ".......")
              .when((nr % 4 == 1) & (v % 4 < 2), F.concat((p % 9 + 1).cast("string"), F.lit(". Find "))).when((nr % 3 == 1) & (v % 4 == 2), "(a) then ").otherwise(""))
    text = F.concat(opened, F.substring("line", 1, 40))
    top = (nr * 64 + 30 + doc % 7).cast("double")
    return lines(spark, sf).select(F.col("doc_id").alias("doc"), page.alias("page"), top.alias("top"), (top + 12).alias("bottom"), F.when((p + doc) % 6 == 0, 200.0).otherwise(60.0).alias("x0"),
                                   (300.0 + p % 5 * 40).alias("x1"), F.when(nr == 0, 14.0 - v % 2 * 4).otherwise(10.0).alias("size"), text.alias("text"), nr.cast("long").alias("nr"))


_SET = f"""{LINES}, l0 AS (SELECT doc_id, pos, line, pos // 12 AS page, pos % 12 AS nr, (doc_id * 7 + pos // 12 * 5) % 11 AS v FROM lines),
l AS (SELECT doc_id AS doc, page, nr, v, (nr * 64 + 30 + doc_id % 7)::DOUBLE AS top, (nr * 64 + 42 + doc_id % 7)::DOUBLE AS bottom, CASE WHEN (pos + doc_id) % 6 = 0 THEN 200.0 ELSE 60.0 END AS x0, 300.0 + pos % 5 * 40 AS x1, CASE WHEN nr = 0 THEN 14.0 - v % 2 * 4 ELSE 10.0 END AS size,
  CASE WHEN nr = 0 AND v < 3 THEN 'Mixed practice ' WHEN nr = 0 AND v = 3 THEN 'Worked example ' WHEN nr = 0 AND v = 4 THEN 'Index ' WHEN nr > 2 AND v = 5 THEN '.......' WHEN nr % 4 = 1 AND v % 4 < 2 THEN (pos % 9 + 1) || '. Find ' WHEN nr % 3 = 1 AND v % 4 = 2 THEN '(a) then ' ELSE '' END || left(line, 40) AS text FROM l0),
m AS (SELECT *, ((top >= 0 AND top < 40.0) OR top > 752.0) AND length(text) < 15 AS edge, coalesce(nullif(regexp_extract(text, '^(\\d{{1,3}})[.)]?\\s+(?:[A-Z]|[a-z]\\s+[A-Za-z])', 1), ''), nullif(regexp_extract(text, '^\\s*(\\d{{1,3}})\\s*$', 1), ''))::INT AS n FROM l)"""
_EXERCISE = "|".join(f"(?:{h})" for h in pages.EXERCISES)
_KINDS = f"""c AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY top, x0, text) AS t, string_agg(text, chr(10) ORDER BY top, x0, text) FILTER (nr < 8) AS h, count(*) FILTER (regexp_matches(text, '\\.{{6,}}')) AS dots,
  count(*) FILTER (x0 <= 120 AND NOT edge AND n IS NOT NULL) AS digits, count(*) FILTER (x0 <= 120 AND NOT edge AND n IS NULL AND regexp_matches(text, '{pages.LETTER}')) AS letters FROM m GROUP BY 1, 2),
f AS (SELECT *, regexp_extract(h, '(?i)({_EXERCISE})', 1) AS head, regexp_matches(left(t, 400), '(?im){"|".join(pages.EXCLUDED)}') OR regexp_matches(left(t, 600), '(?im){pages.FRONT}') OR dots >= 6 OR regexp_matches(t, '(?i){pages.BANNER}') AS bad FROM c),
k AS (SELECT doc, page, CASE WHEN bad THEN NULL WHEN head <> '' THEN 'head' WHEN digits >= 1 THEN 'numbered' WHEN letters >= 2 THEN 'continuation' END AS kind, head FROM f)"""


def _kinds(spark, sf):
    return pages.page_kinds(_set(spark, sf), ["doc"], F.lit(HEIGHT), F.lit(WIDTH))


@register(f"WITH {_SET}, {_KINDS} SELECT doc, page, kind, CASE WHEN kind = 'head' THEN head ELSE kind END AS header FROM k")
def exercise_pages(spark, sf):
    return _kinds(spark, sf)


@register(f"""WITH RECURSIVE {_SET}, {_KINDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS j FROM k),
r AS (SELECT doc, 0::BIGINT AS j, 0::BIGINT AS page, 0::BIGINT AS run, false AS taken, NULL::VARCHAR AS kind FROM (SELECT DISTINCT doc FROM o)
  UNION ALL SELECT o.doc, o.j, o.page, r.run + CASE WHEN o.kind = 'head' THEN 1 ELSE 0 END, coalesce(o.kind = 'head' OR (o.kind IN ('numbered', 'continuation') AND r.taken), false), o.kind FROM r JOIN o ON o.doc = r.doc AND o.j = r.j + 1),
s AS (SELECT m.doc, run, m.page, top, x0, text, CASE WHEN x0 <= 120 AND kind <> 'continuation' THEN n END AS n FROM m JOIN r ON r.doc = m.doc AND r.page = m.page AND r.j > 0 AND taken WHERE NOT edge),
q AS (SELECT *, count(n) OVER (PARTITION BY doc, run ORDER BY page, top ROWS UNBOUNDED PRECEDING) AS q FROM s), g AS (SELECT doc, run, q, max(n) AS number, min(page) AS page, max(page) AS last_page, count(DISTINCT page) AS pages, md5(string_agg(text, chr(10) ORDER BY page, top)) AS text FROM q WHERE q > 0 GROUP BY 1, 2, 3)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY run, q) AS ordinal, number, page, last_page, pages, text FROM g""")
def stitched_questions(spark, sf):
    s = _set(spark, sf)
    q = pages.stitched_questions(s, _kinds(spark, sf), ["doc"], F.lit(HEIGHT), F.lit(WIDTH))
    return q.withColumn("text", F.md5(F.col("text").cast("binary")))


_RULED = f"""p AS (SELECT DISTINCT doc, page FROM l), s AS (SELECT doc, page, top - 6 AS y FROM l WHERE nr % 5 = 3 AND v % 3 = 0 AND x1 >= 340 UNION SELECT doc, page, 795.0 FROM l WHERE v % 4 = 3 AND v % 3 <> 0),
a AS (SELECT DISTINCT doc, page, top FROM m WHERE n IS NOT NULL AND x0 <= 120), c AS (SELECT doc, page, top, bottom FROM l WHERE trim(text) <> '' AND NOT (length(trim(text)) < 4 AND regexp_matches(trim(text), '^\\d{{1,3}}$') AND top > 720) AND NOT regexp_matches(trim(text), '(?i){pages.RUNNING}')),
sc AS (SELECT doc, page, count(*) AS ns FROM s GROUP BY 1, 2), ac AS (SELECT doc, page, count(*) AS na FROM a GROUP BY 1, 2),
rb AS (SELECT doc, page, y AS t, lead(y) OVER (PARTITION BY doc, page ORDER BY y) AS b FROM (SELECT doc, page, y FROM s UNION ALL SELECT doc, page, 0.0 FROM s GROUP BY 1, 2 UNION ALL SELECT doc, page, 800.0 FROM s GROUP BY 1, 2)),
an AS (SELECT doc, page, top, lead(top) OVER (PARTITION BY doc, page ORDER BY top) - 2 AS nx FROM a), ab AS (SELECT an.doc, an.page, top AS t, least(coalesce(any_value(nx), 800.0), coalesce(min(y) - 1, 800.0)) AS b FROM an LEFT JOIN s ON s.doc = an.doc AND s.page = an.page AND y > top + 4 GROUP BY 1, 2, 3),
x AS (SELECT 'rules' AS method, doc, page, t, b FROM rb WHERE b - t >= 14 UNION ALL SELECT 'numbers', doc, page, t, b FROM ab UNION ALL SELECT 'page', doc, page, 0.0, 800.0 FROM p),
y AS (SELECT method, x.doc, x.page, t, b, coalesce(min(top), t) AS t1, max(top) AS lt FROM x LEFT JOIN c ON c.doc = x.doc AND c.page = x.page AND top BETWEEN t - 1 AND b + 1 GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT method, y.doc, y.page, t1 AS t, greatest(b, coalesce(max(bottom), 0)) AS b FROM y LEFT JOIN c ON c.doc = y.doc AND c.page = y.page AND abs(top - lt) < 4 GROUP BY 1, 2, 3, t1, y.t, b),
w AS (SELECT * FROM z WHERE method <> 'rules' OR b - t >= 14), wn AS (SELECT doc, page, count(*) AS nr FROM w WHERE method = 'rules' GROUP BY 1, 2),
d AS (SELECT p.doc, p.page, CASE WHEN coalesce(nr, 0) > 0 AND NOT (nr <= 1 AND coalesce(na, 0) >= 2) THEN 'rules' WHEN coalesce(na, 0) > 0 THEN 'numbers' ELSE 'page' END AS method, p.page = min(p.page) OVER (PARTITION BY p.doc) AS first FROM p LEFT JOIN wn USING (doc, page) LEFT JOIN ac USING (doc, page)),
e AS (SELECT w.*, first, row_number() OVER (PARTITION BY w.doc, w.page ORDER BY t, b) AS i, count(*) OVER (PARTITION BY w.doc, w.page) AS c FROM w JOIN d USING (doc, page, method)),
g AS (SELECT * FROM e WHERE NOT (first AND c > 1 AND b - t < 90 AND ((i = 1 AND t <= 0.5) OR (i = c AND b >= 799))))"""


@register(f"WITH {_SET}, {_RULED} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, i) AS ordinal, page, t AS top, b AS bottom, method FROM g")
def screenshot_regions(spark, sf):
    s = _set(spark, sf)
    v = (F.col("doc") * 7 + F.col("page") * 5) % 11
    across = s.where((F.col("nr") % 5 == 3) & (v % 3 == 0)).select("doc", "page", (F.col("top") - 6).alias("top"), F.lit(0.0).alias("x0"), (F.col("x1") - 40).alias("x1"))
    foot = s.where((v % 4 == 3) & (v % 3 != 0)).select("doc", "page", F.lit(795.0).alias("top"), F.lit(0.0).alias("x0"), F.lit(600.0).alias("x1")).distinct()
    a = s.where((F.col("x0") <= 120) & pages.opening_number(F.col("text")).isNotNull())
    p = s.select("doc", "page", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width")).distinct()
    return pages.page_regions(p, s, across.unionByName(foot), a, ["doc"])


@register(f"""WITH {_SET}, u AS (SELECT doc, page, size, sum(len(regexp_extract_all(text, '\\S+'))) AS c FROM l GROUP BY 1, 2, 3), u2 AS (SELECT *, sum(c) OVER (PARTITION BY doc, page ORDER BY size ROWS UNBOUNDED PRECEDING) AS b, sum(c) OVER (PARTITION BY doc, page) AS t FROM u), u3 AS (SELECT doc, page, min(size) AS body FROM u2 WHERE c > 0 AND b > t // 2 GROUP BY 1, 2),
fr AS (SELECT l.doc, l.page, CASE WHEN min(top) < 68.0 AND arg_min(size, top) <= 1.02 * any_value(body) THEN arg_min(bottom, top) ELSE 0.0 END AS ctop, CASE WHEN max(top) > 732.0 AND arg_max(size, top) <= 1.02 * any_value(body) THEN max(top) ELSE 800.0 END AS cbot, min(x0) AS lft, max(x1) AS rgt FROM l LEFT JOIN u3 USING (doc, page) GROUP BY 1, 2),
q AS (SELECT doc, page // 6 AS section, page, top, n AS number, lead(page) OVER w AS np, lead(top) OVER w AS nt FROM m WHERE n IS NOT NULL AND x0 <= 120 WINDOW w AS (PARTITION BY doc, page // 6 ORDER BY page, top, n)), t AS (SELECT *, unnest(range(page, least(coalesce(np, page), page + 3) + 1)) AS tile_page FROM q),
j AS (SELECT t.*, greatest(f0.lft - 14, 0.0) AS x0, least(f0.rgt + 14, 600.0) AS x1, CASE WHEN tile_page = t.page THEN greatest(top - 8, f.ctop) ELSE f.ctop END AS y0,
  CASE WHEN tile_page < coalesce(np, t.page) THEN f.cbot WHEN np IS NULL THEN f.cbot - 5 WHEN np = t.page AND nt - top < 58 THEN least(least(top + 58, f.cbot) - 5, f.cbot) ELSE least(nt - 5, f.cbot) END AS y1 FROM t JOIN fr f ON f.doc = t.doc AND f.page = tile_page JOIN fr f0 ON f0.doc = t.doc AND f0.page = t.page),
o AS (SELECT *, sum(y1 - y0) OVER (PARTITION BY doc, section, page, top, number) AS tall, row_number() OVER (PARTITION BY doc, section, page, top, number ORDER BY tile_page) AS tile FROM j WHERE y1 - y0 >= 4)
SELECT doc, section, page, top, number, tile, tile_page, x0::DOUBLE AS x0, y0, x1::DOUBLE AS x1, y1 FROM o WHERE (x1 - x0) * 1.8 >= 80 AND tall * 1.8 >= 26""")
def question_crops(spark, sf):
    s = _set(spark, sf)
    q = s.withColumn("number", pages.opening_number(F.col("text"))).where("number is not null and x0 <= 120").withColumn("section", F.floor(F.col("page") / 6))
    return pages.question_crops(q, pages.page_frames(s, ["doc"], F.lit(HEIGHT)), ["doc"], "section", WIDTH)

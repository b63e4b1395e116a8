"""Page geometry and the segmentation of papers as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import layout, segment
from lectern.plans.bindings import LINES, lines, table
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()
_I = "i AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS pos, max(l_quantity)::BIGINT AS qty, max(l_partkey) AS v FROM lineitem GROUP BY 1, 2)"


def _i(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.max("l_quantity").cast("long").alias("qty"), F.max("l_partkey").alias("v"))


def _md5(c):
    return F.md5(c.cast("binary"))


@register("""WITH w AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 40) * 20.0 AS lx, (l_partkey % 40) * 20.0 + l_linenumber AS x0, 5.0 + l_quantity / 4 AS size, l_quantity::BIGINT || CASE l_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN ')' ELSE '' END AS t, repeat('x', l_linenumber * 2) AS rest FROM lineitem),
m AS (SELECT *, count(*) OVER (PARTITION BY page ORDER BY lx RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS m FROM w)
SELECT page, id, regexp_extract(t, '\\d+')::INT AS number FROM m WHERE regexp_extract(t, '\\d+')::INT BETWEEN 1 AND 30 AND size BETWEEN 7.0 AND 19.0 AND x0 - lx <= 3 AND length(rest) >= 6 AND m >= 12""")
def question_words(spark, sf):
    i = table(spark, sf, "lineitem")
    lx = (F.col("l_partkey") % 40) * 20.0
    t = F.concat(F.col("l_quantity").cast("long"), F.when(F.col("l_partkey") % 3 == 0, ".").when(F.col("l_partkey") % 3 == 1, ")").otherwise(""))
    w = i.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), lx.alias("line_x0"), (lx + F.col("l_linenumber")).alias("x0"), (5.0 + F.col("l_quantity") / 4).alias("size"), t.alias("text"),
                 F.concat(t, F.lit(" "), F.repeat(F.lit("x"), F.col("l_linenumber") * 2)).alias("line_text"))
    return layout.question_numbers(w, ["page"], 10.0, high=30, margins=12).select("page", "id", "number")


@register(f"""WITH {_I}, w AS (SELECT doc, pos, v % 100 AS x, qty AS y FROM i), f AS (SELECT doc, v % 60 AS x, qty % 30 AS y FROM i WHERE pos % 2 = 0)
SELECT doc, pos FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc = w.doc AND w.x BETWEEN f.x - 6 AND f.x + 36 AND w.y BETWEEN f.y - 6 AND f.y + 16)""")
def clear_words(spark, sf):
    i = _i(spark, sf)
    f = i.where("pos % 2 = 0").select("doc", (F.col("v") % 60).alias("fx0"), (F.col("qty") % 30).alias("fy0")).withColumn("fx1", F.col("fx0") + 30).withColumn("fy1", F.col("fy0") + 10)
    return layout.clear_of_figures(i.select("doc", "pos", (F.col("v") % 100).alias("x0"), F.col("qty").alias("y0")), f, ["doc"]).select("doc", "pos")


@register(f"""WITH {LINES}, g AS (SELECT doc_id, pos // 4 AS band, sum(length(line)) FILTER (pos % 7 < 4) AS l, sum(length(line)) AS t FROM lines GROUP BY 1, 2), h AS (SELECT doc_id, band, coalesce(l, 0)::BIGINT AS l, (t - coalesce(l, 0))::BIGINT AS r FROM g)
SELECT doc_id, band, l AS left_chars, r AS right_chars, CASE WHEN l + r >= 20 AND greatest(l, r) >= 0.8 * (l + r) THEN CASE WHEN l >= r THEN 'right' ELSE 'left' END END AS figure_side FROM h""")
def lopsided_bands(spark, sf):
    d = lines(spark, sf).select("doc_id", F.floor(F.col("pos") / 4).alias("band"), F.when(F.col("pos") % 7 < 4, 10).otherwise(400).alias("x0"), F.col("line").alias("text"))
    return layout.lopsided(d, ["doc_id", "band"], 300)


@register(f"""WITH {_I}, b AS (SELECT doc, pos AS band, 50 AS x0, pos * 100 AS y0, 400 AS x1, pos * 100 + 40 + qty AS y1 FROM i), m AS (SELECT doc, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS h FROM b GROUP BY 1),
g AS (SELECT doc, (v % 60)::BIGINT AS ix0, qty * 12 AS iy0, v % 60 + 200 + CASE v % 5 WHEN 0 THEN 400 ELSE 0 END AS ix1, qty * 12 + 30 AS iy1 FROM i WHERE pos % 2 = 1),
o AS (SELECT b.doc, band, min(ix0) AS a, min(iy0) AS c, max(ix1) AS d, max(iy1) AS e FROM b JOIN m USING (doc) JOIN g ON g.doc = b.doc AND (iy0 + iy1) / 2.0 BETWEEN y0 - 0.4 * h AND y1 + 0.4 * h AND ((ix0 >= x0 - 10 AND ix1 <= x1 + 10) OR (ix0 < 5 AND ix1 > 595)) GROUP BY 1, 2)
SELECT b.doc, b.band, least(x0, a - 4)::BIGINT AS x0, least(y0, c - 4)::BIGINT AS y0, greatest(x1, d + 4)::BIGINT AS x1, greatest(y1, e + 4)::BIGINT AS y1 FROM b LEFT JOIN o ON o.doc = b.doc AND o.band = b.band""")
def grown_bands(spark, sf):
    i = _i(spark, sf)
    y = F.col("pos") * 100
    b = i.select("doc", F.col("pos").alias("band"), F.lit(50).cast("long").alias("x0"), y.alias("y0"), F.lit(400).cast("long").alias("x1"), (y + 40 + F.col("qty")).alias("y1"))
    x = F.col("v") % 60
    g = i.where("pos % 2 = 1").select("doc", x.alias("ix0"), (F.col("qty") * 12).alias("iy0"), (x + 200 + F.when(F.col("v") % 5 == 0, 400).otherwise(0)).alias("ix1"), (F.col("qty") * 12 + 30).alias("iy1"))
    return layout.grown_bands(b, g, ["doc"], 600)


@register("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents), t AS (SELECT conv_id AS doc_id, lower(regexp_extract(text, '[A-Za-z]{4,}')) AS w FROM conversations WHERE turn = 0 AND role = 'user'),
t1 AS (SELECT doc_id, min(w) AS w FROM t WHERE w <> '' GROUP BY 1), j AS (SELECT w.doc_id, pos, lower(trim(word)) = t1.w AS same FROM w JOIN t1 USING (doc_id) WHERE starts_with(lower(trim(word)), left(t1.w, 5)))
SELECT doc_id, coalesce(min(pos) FILTER (same), min(pos))::BIGINT * 2 AS top FROM j GROUP BY 1""")
def first_word_tops(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    c = table(spark, sf, "conversations").where("turn = 0 and role = 'user'").select(F.col("conv_id").alias("doc_id"), F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0)).alias("w")).where("w <> ''")
    return layout.first_word_top(w, c.groupBy("doc_id").agg(F.min("w").alias("text")), ["doc_id"], lambda k: k * 2)


@register(f"""WITH RECURSIVE {_I}, h AS (SELECT doc, pos, 9.0 + qty % 4 AS size, (v % 3) * 20 AS x0, pos * 14 AS top, pos * 14 + 10 AS bottom, 't' || v AS t FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM h WHERE size >= 11),
r AS (SELECT doc, k, top, bottom, size, x0, t, k AS head, false AS joined FROM b WHERE k = 1
  UNION ALL SELECT b.doc, b.k, b.top, b.bottom, b.size, b.x0, b.t, CASE WHEN f THEN r.head ELSE b.k END, f FROM (SELECT r.*, NOT r.joined AND abs(b.top - r.bottom) < r.size * 2 AND abs(b.x0 - r.x0) < 30 AS f FROM r JOIN b ON b.doc = r.doc AND b.k = r.k + 1) r JOIN b ON b.doc = r.doc AND b.k = r.k + 1)
SELECT doc, min(top) AS top, max(bottom) AS bottom, string_agg(t, ' ' ORDER BY k) AS text FROM r GROUP BY doc, head""")
def heading_wraps(spark, sf):
    h = _i(spark, sf).select("doc", "pos", (9.0 + F.col("qty") % 4).alias("size"), ((F.col("v") % 3) * 20).alias("x0"), (F.col("pos") * 14).alias("top"), (F.col("pos") * 14 + 10).alias("bottom"), F.concat(F.lit("t"), "v").alias("text"))
    return layout.wrapped_headings(h, ["doc"], "pos", 10.0)


@register("""WITH l AS (SELECT DISTINCT l_suppkey AS page, l_partkey % 300 * 4 AS x, l_quantity::BIGINT AS y FROM lineitem), s AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) > 24 THEN 1 ELSE 0 END AS b FROM l),
c AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY x RANGE UNBOUNDED PRECEDING)::BIGINT AS col FROM s) SELECT page, x, y, col AS "column", row_number() OVER (PARTITION BY page ORDER BY col, y, x)::INT AS place FROM c""")
def column_order(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 300 * 4).alias("x"), F.col("l_quantity").cast("long").alias("y")).distinct()
    return layout.reading_order(l, ["page"], "x", "y", 24)


@register("""WITH l AS (SELECT DISTINCT l_suppkey AS page, l_partkey % 3000 AS x FROM lineitem), s AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) > 10 THEN 1 ELSE 0 END AS b FROM l), g AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT page, round(avg(x), 6) AS centre, count(*) AS n FROM g GROUP BY page, g""")
def centre_clusters(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 3000).alias("x")).distinct()
    return layout.position_clusters(l, ["page"], "x", 10).select("page", F.round("centre", 6).alias("centre"), "n")


@register("""WITH RECURSIVE p AS (SELECT page, x, row_number() OVER (PARTITION BY page ORDER BY x) AS k FROM (SELECT DISTINCT l_suppkey AS page, l_quantity::DOUBLE AS x FROM lineitem)),
r AS (SELECT page, k, x AS last, x AS kept FROM p WHERE k = 1 UNION ALL SELECT p.page, p.k, CASE WHEN p.x - r.last > 3 THEN p.x ELSE r.last END, CASE WHEN p.x - r.last > 3 THEN p.x END FROM r JOIN p ON p.page = r.page AND p.k = r.k + 1)
SELECT page, kept FROM r WHERE kept IS NOT NULL""")
def spaced_separators(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("x"))
    return layout.spaced_positions(l, ["page"], "x").select("page", F.explode("kept").alias("kept"))


@register(f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id AS label, pos, CASE WHEN pos % 3 = 0 THEN ((pos % 30) // 3 + 1) || '. ' ELSE '' END || line AS line FROM lines), s AS (SELECT *, nullif(regexp_extract(line, '^(\\d{{1,3}})[.):]?\\s+\\S', 1), '')::BIGINT AS n FROM l),
q AS (SELECT DISTINCT doc_id AS label, m AS number FROM documents, (VALUES (1), (2), (4), (5), (9)) v(m)), w AS (SELECT label, number, row_number() OVER (PARTITION BY label ORDER BY number) AS k FROM q),
r AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS since, NULL::BIGINT AS number, NULL::BIGINT AS at_pos FROM (SELECT DISTINCT label FROM w)
  UNION ALL SELECT w.label, w.k, coalesce(f.p + 1, r.since), w.number, f.p FROM r JOIN w ON w.label = r.label AND w.k = r.k + 1 LEFT JOIN LATERAL (SELECT min(s.pos) AS p FROM s WHERE s.label = r.label AND s.pos >= r.since AND s.n = w.number) f ON true),
e AS (SELECT r.label, r.number, r.at_pos, (SELECT min(s.pos) FROM s JOIN q ON q.label = s.label AND q.number = s.n WHERE s.label = r.label AND s.pos > r.at_pos AND s.n > r.number) AS fin FROM r WHERE at_pos IS NOT NULL),
b AS (SELECT e.label, e.number, {r"regexp_replace(string_agg(s.line, chr(10) ORDER BY s.pos), '^\s+|\s+$', '', 'g')"} AS answer FROM e JOIN s ON s.label = e.label AND s.pos >= e.at_pos AND (e.fin IS NULL OR s.pos < e.fin) GROUP BY 1, 2)
SELECT label, number, md5(answer) AS answer FROM b WHERE length(answer) > 10""")
def label_answers(spark, sf):
    p = F.col("pos")
    s = lines(spark, sf).select(F.col("doc_id").alias("label"), "pos", F.concat(F.when(p % 3 == 0, F.concat(F.floor((p % 30) / 3) + 1, F.lit(". "))).otherwise(""), "line").alias("line"))
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("label"), F.explode(F.array(*map(F.lit, (1, 2, 4, 5, 9)))).alias("number")).distinct()
    return segment.split_by_label(q, s).select("label", F.col("number").cast("int").alias("number"), _md5(F.col("answer")).alias("answer"))


@register(f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id AS label, pos, CASE pos % 5 WHEN 0 THEN (pos % 20 // 5 + 1) || '. ' || line WHEN 2 THEN left(line, 25) || ' ' || (pos % 45 // 5 + 1) || ') Thus ' || substr(line, 26) WHEN 3 THEN left(line, 9) || ' 1.' || (pos % 9) || ' Km/' || (pos % 9) || ' At (' || (pos % 7 + 3) || ' (' || line ELSE line END AS line FROM lines),
s AS (SELECT *, nullif(regexp_extract(line, '^(\\d{{1,3}})[.):]?\\s+\\S', 1), '')::BIGINT AS n FROM l), q AS (SELECT DISTINCT doc_id AS label, m AS number FROM documents, (VALUES (1), (2), (4), (5), (7), (9)) v(m)), w AS (SELECT label, number, row_number() OVER (PARTITION BY label ORDER BY number) AS k FROM q),
r AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS since, NULL::BIGINT AS number, NULL::BIGINT AS at_pos FROM (SELECT DISTINCT label FROM w)
  UNION ALL SELECT w.label, w.k, coalesce(f.p + 1, r.since), w.number, f.p FROM r JOIN w ON w.label = r.label AND w.k = r.k + 1 LEFT JOIN LATERAL (SELECT min(s.pos) AS p FROM s WHERE s.label = r.label AND s.pos >= r.since AND s.n = w.number) f ON true),
e AS (SELECT r.label, r.number, r.at_pos, (SELECT min(s.pos) FROM s JOIN q ON q.label = s.label AND q.number = s.n WHERE s.label = r.label AND s.pos > r.at_pos AND s.n > r.number) AS fin FROM r WHERE at_pos IS NOT NULL),
b AS (SELECT e.label, e.number, {r"regexp_replace(string_agg(s.line, chr(10) ORDER BY s.pos), '^\s+|\s+$', '', 'g')"} AS answer FROM e JOIN s ON s.label = e.label AND s.pos >= e.at_pos AND (e.fin IS NULL OR s.pos < e.fin) GROUP BY 1, 2), b1 AS (SELECT * FROM b WHERE length(answer) > 10),
t AS (SELECT label, string_agg(line, chr(10) ORDER BY pos) AS t FROM l GROUP BY 1), c0 AS (SELECT label, line, line || chr(10) || coalesce(lead(line) OVER o || chr(10) || coalesce(lead(line, 2) OVER o, ''), '') AS t, coalesce(sum(length(line) + 1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l WINDOW o AS (PARTITION BY label ORDER BY pos)),
c AS (SELECT label, off, t, unnest(range(1, length(line) + 1)) AS i FROM c0 WHERE regexp_matches(t, '[1-9][0-9]?[0-9]?[.):]?\\s+[A-Z(]')), c1 AS (SELECT label, off, i, substr(t, i, 60) AS x FROM c WHERE substr(t, i, 1) BETWEEN '1' AND '9' AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[A-Za-z0-9./]'))),
m AS (SELECT c1.label, off + i - 1 AS at_pos, regexp_extract(x, '^([1-9]\\d{{0,2}})', 1)::BIGINT AS n, off + i - 1 + length(regexp_extract(x, '^[1-9]\\d{{0,2}}[.):]?\\s+')) AS fin FROM c1 WHERE regexp_matches(x, '^[1-9]\\d{{0,2}}[.):]?\\s+[A-Z(]')),
p AS (SELECT label, number, row_number() OVER (PARTITION BY label ORDER BY number) AS k FROM (SELECT label, number FROM q EXCEPT SELECT label, number FROM b1)),
r2 AS (SELECT label, 0::BIGINT AS k, 0::BIGINT AS since, NULL::BIGINT AS number, NULL::BIGINT AS at_pos FROM (SELECT DISTINCT label FROM p)
  UNION ALL SELECT p.label, p.k, coalesce(f.f::BIGINT, r2.since), p.number, f.p::BIGINT FROM r2 JOIN p ON p.label = r2.label AND p.k = r2.k + 1 LEFT JOIN LATERAL (SELECT min(m.at_pos) AS p, min(m.fin) AS f FROM m WHERE m.label = r2.label AND m.at_pos >= r2.since AND m.n = p.number) f ON true),
h AS (SELECT label, number, at_pos, since FROM r2 WHERE at_pos IS NOT NULL), x AS (SELECT h.label, h.number, m.n, min(m.at_pos) AS fin FROM h JOIN q ON q.label = h.label AND q.number > h.number JOIN m ON m.label = h.label AND m.n = q.number AND m.at_pos >= h.since GROUP BY 1, 2, 3),
y AS (SELECT label, number, arg_min(fin, n) AS fin FROM x GROUP BY 1, 2), z AS (SELECT h.label, h.number, {r"regexp_replace(substr(t, at_pos::BIGINT + 1, coalesce(fin, length(t))::BIGINT - at_pos::BIGINT), '^\s+|\s+$', '', 'g')"} AS answer FROM h JOIN t USING (label) LEFT JOIN y USING (label, number))
SELECT label, number, md5(answer) AS answer, 'line' AS found FROM b1 UNION ALL SELECT label, number, md5(answer), 'inside' FROM z WHERE length(answer) > 10""")
def answers_inside_lines(spark, sf):
    p, line = F.col("pos"), F.col("line")
    inside = F.concat(F.substring(line, 1, 25), F.lit(" "), F.floor(p % 45 / 5) + 1, F.lit(") Thus "), F.substr(line, F.lit(26)))
    decoys = F.concat(F.substring(line, 1, 9), F.lit(" 1."), p % 9, F.lit(" Km/"), p % 9, F.lit(" At ("), p % 7 + 3, F.lit(" ("), line)
    s = lines(spark, sf).select(F.col("doc_id").alias("label"), "pos", F.when(p % 5 == 0, F.concat(F.floor(p % 20 / 5) + 1, F.lit(". "), line)).when(p % 5 == 2, inside).when(p % 5 == 3, decoys).otherwise(line).alias("line"))
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("label"), F.explode(F.array(*map(F.lit, (1, 2, 4, 5, 7, 9)))).alias("number")).distinct()
    return segment.paired_answers(q, s).select("label", F.col("number").cast("int").alias("number"), _md5(F.col("answer")).alias("answer"), "found")


@register(f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id, pos, CASE WHEN pos % 4 < 2 THEN CASE WHEN pos % 8 = 0 THEN 'A' ELSE '' END || (pos % 12 // 4 + 1) || '. ' ELSE '' END || line AS line FROM lines),
n AS (SELECT doc_id, pos, regexp_extract(line, '^\\s*(?:([A-Z])\\d{{1,2}}|\\d{{1,2}})\\.', 1) AS prefix, regexp_extract(line, '^\\s*[A-Z]?(\\d{{1,2}})\\.', 1) AS n FROM l WHERE regexp_matches(line, '^\\s*[A-Z]?\\d{{1,2}}\\.')),
x AS (SELECT doc_id, pos, prefix, n::BIGINT AS n, row_number() OVER (PARTITION BY doc_id, prefix ORDER BY pos) AS k FROM n),
r AS (SELECT doc_id, prefix, 0::BIGINT AS k, 0::BIGINT AS pos, 0::BIGINT AS last, 0::BIGINT AS v, 0::BIGINT AS n, false AS ok FROM (SELECT DISTINCT doc_id, prefix FROM x)
  UNION ALL SELECT x.doc_id, x.prefix, x.k, x.pos, CASE WHEN x.n = r.last + 1 OR (x.n = 1 AND r.last >= 1) THEN x.n ELSE r.last END, r.v + (x.n = 1 AND r.last >= 1)::BIGINT, x.n, x.n = r.last + 1 OR (x.n = 1 AND r.last >= 1)
  FROM r JOIN x ON x.doc_id = r.doc_id AND x.prefix = r.prefix AND x.k = r.k + 1)
SELECT doc_id, pos, prefix || n || CASE WHEN v > 0 THEN 'v' || (v + 1) ELSE '' END AS key FROM r WHERE ok""")
def variant_starts(spark, sf):
    p = F.col("pos")
    l = lines(spark, sf).select("doc_id", "pos", F.concat(F.when(p % 4 < 2, F.concat(F.when(p % 8 == 0, "A").otherwise(""), F.floor(p % 12 / 4) + 1, F.lit(". "))).otherwise(""), "line").alias("line"))
    return segment.variant_keys(l, ["doc_id"], "pos", "line")


@register(f"""WITH RECURSIVE {_I}, b AS (SELECT doc, 'A' AS block, 1 AS s, 5 AS e, 1 AS lo, 2 AS hi FROM (SELECT DISTINCT doc FROM i) UNION ALL SELECT doc, 'B', 3, 9, 2, 3 FROM (SELECT DISTINCT doc FROM i)),
h AS (SELECT b.doc, block, lo, hi, pos, qty % 3 + 1 AS n, row_number() OVER (PARTITION BY b.doc, block ORDER BY pos) AS k FROM b JOIN i ON i.doc = b.doc AND pos >= s AND pos < e),
r AS (SELECT doc, block, lo, hi, 0::BIGINT AS k, lo::BIGINT AS x, []::BIGINT[] AS places FROM b UNION ALL SELECT h.doc, h.block, h.lo, h.hi, h.k, CASE WHEN h.n = r.x AND r.x <= h.hi THEN r.x + 1 ELSE r.x END, CASE WHEN h.n = r.x AND r.x <= h.hi THEN list_append(r.places, h.pos) ELSE r.places END
  FROM r JOIN h ON h.doc = r.doc AND h.block = r.block AND h.k = r.k + 1)
SELECT doc, block, array_to_string(arg_max(places, k), ',') AS places, len(arg_max(places, k)) = any_value(hi - lo + 1) AS ok FROM r GROUP BY 1, 2""")
def block_numbers(spark, sf):
    i = _i(spark, sf)
    d = i.select("doc").distinct()
    b = d.select("doc", F.explode(F.array(*(F.struct(F.lit(n).alias("block"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, s, e, lo, hi in (("A", 1, 5, 1, 2), ("B", 3, 9, 2, 3))))).alias("b")).select("doc", "b.*")
    w = segment.block_walk(i.select("doc", "pos", (F.col("qty") % 3 + 1).alias("n")), b, ["doc"], "pos", "n")
    return w.select("doc", "block", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"), "ok")


@register(f"""WITH RECURSIVE {_I}, h AS (SELECT doc, pos, CASE WHEN qty % 5 < 3 THEN 'practice' WHEN qty % 5 = 3 THEN 'stop' END AS kind, 'S' || (v % 2) AS name, CASE WHEN doc % 3 = 0 THEN 5 END AS back FROM i),
e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM h WHERE kind IS NOT NULL AND (back IS NULL OR pos < back)),
r AS (SELECT doc, 0::BIGINT AS k, NULL::VARCHAR AS cur, NULL::BIGINT AS since, NULL::VARCHAR AS done, NULL::BIGINT AS done_from, NULL::BIGINT AS done_to FROM (SELECT DISTINCT doc FROM e)
  UNION ALL SELECT e.doc, e.k, CASE WHEN e.kind = 'stop' THEN NULL ELSE e.name END, CASE WHEN e.kind = 'stop' THEN NULL WHEN r.cur = e.name THEN r.since ELSE e.pos END,
    CASE WHEN r.cur IS NOT NULL AND (e.kind = 'stop' OR r.cur <> e.name) THEN r.cur END, r.since, e.pos FROM r JOIN e ON e.doc = r.doc AND e.k = r.k + 1)
SELECT doc, done AS name, done_from AS start, done_to AS "end" FROM r WHERE done IS NOT NULL
UNION ALL SELECT r.doc, cur, since, CASE WHEN r.doc % 3 = 0 THEN 5 ELSE 99 END FROM r JOIN (SELECT doc, max(k) AS k FROM r GROUP BY 1) m ON m.doc = r.doc AND m.k = r.k WHERE cur IS NOT NULL""")
def book_outline(spark, sf):
    q = F.col("qty") % 5
    h = _i(spark, sf).withColumn("name", F.concat(F.lit("S"), F.col("v") % 2))
    return segment.sections(h, ["doc"], "pos", F.when(q < 3, "practice").when(q == 3, "stop"), "name", F.lit(99).cast("long"), F.when(F.col("doc") % 3 == 0, 5).cast("long"))


# Fixed value: how a stem opens.
_STEM = r"(?i)^(A(?=\s|[a-z])|An\s|The\s|Two\s|Three\s|Four\s|Five\s|Six\s|Seven\s|Eight\s|Nine\s|Ten\s)"


@register(f"""WITH {LINES}, l AS (SELECT doc_id, pos, trim(CASE pos % 5 WHEN 0 THEN 'The thing' WHEN 4 THEN line ELSE 'opt ' || pos || CASE WHEN pos % 7 = 0 THEN '?' ELSE '' END END) AS t FROM lines),
m AS (SELECT *, regexp_matches(t, '(?i)^(A(\\s|[a-z])|An\\s|The\\s|Two\\s|Three\\s|Four\\s|Five\\s|Six\\s|Seven\\s|Eight\\s|Nine\\s|Ten\\s)') AS s FROM l WHERE t <> '' AND NOT regexp_matches(t, '(?i)^(Turn\\s*over|Please do not write|EPO\\d)')),
q AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS q FROM m), o AS (SELECT *, NOT s AND length(t) < 60 AND NOT ends_with(t, '?') AS opt FROM q WHERE q > 0),
g AS (SELECT doc_id, q, string_agg(t, ' ' ORDER BY pos) FILTER (NOT opt) AS stem, list(t ORDER BY pos) FILTER (opt) AS options FROM o GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY q) AS number, md5(stem) AS stem, array_to_string(options, '|') AS options FROM g WHERE len(options) >= 2""")
def mcq_pages(spark, sf):
    p = F.col("pos")
    l = lines(spark, sf).select("doc_id", "pos", F.when(p % 5 == 0, "The thing").when(p % 5 == 4, F.col("line")).otherwise(F.concat(F.lit("opt "), p, F.when(p % 7 == 0, "?").otherwise(""))).alias("t"))
    q = segment.mcq_questions(l, ["doc_id"], "pos", F.col("t"), _STEM, r"(?i)^(Turn\s*over|Please do not write|EPO\d)")
    return q.select("doc_id", "number", _md5(F.col("stem")).alias("stem"), F.array_join("options", "|").alias("options"))


@register(f"""WITH RECURSIVE {_I}, f AS (SELECT doc, pos, CASE qty % 4 WHEN 0 THEN 'A. a' || chr(10) || 'B. b' || chr(10) || 'C. c' WHEN 1 THEN 'stem ' || v ELSE 'x' || v || chr(10) || 'D. d' END AS t, CASE WHEN qty % 7 > 0 THEN pos * 10 END AS a, pos * 10 + qty % 30 AS u FROM i),
k AS (SELECT *, len(regexp_extract_all(t, '(?m)^\\s*[A-D]\\.\\s')) AS n, regexp_matches(t, '^\\s*[A-D]\\.\\s') AS opens, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM f),
r AS (SELECT doc, 0::BIGINT AS k, 0::BIGINT AS q, 3::BIGINT AS n, NULL::BIGINT AS a, NULL::BIGINT AS u, NULL::BIGINT AS pos, '' AS t FROM (SELECT DISTINCT doc FROM k)
  UNION ALL SELECT k.doc, k.k, r.q + (NOT j)::BIGINT, CASE WHEN j THEN r.n + k.n ELSE k.n END, CASE WHEN j THEN r.a ELSE k.a END, CASE WHEN j THEN r.u ELSE k.u END, k.pos, k.t
  FROM (SELECT r.*, r.n < 3 AND (k.opens OR coalesce(r.a <= k.a AND k.a < r.u, false)) AS j FROM r JOIN k ON k.doc = r.doc AND k.k = r.k + 1) r JOIN k ON k.doc = r.doc AND k.k = r.k + 1)
SELECT doc, q AS question, count(*) AS n_fragments, md5(string_agg(t, chr(10) ORDER BY pos)) AS content FROM r WHERE k > 0 GROUP BY 1, 2""")
def break_merge(spark, sf):
    q, v = F.col("qty"), F.col("v")
    t = F.when(q % 4 == 0, "A. a\nB. b\nC. c").when(q % 4 == 1, F.concat(F.lit("stem "), v)).otherwise(F.concat(F.lit("x"), v, F.lit("\nD. d")))
    f = _i(spark, sf).select("doc", "pos", t.alias("t"), F.when(q % 7 > 0, F.col("pos") * 10).alias("a"), (F.col("pos") * 10 + q % 30).alias("u"))
    return segment.merged_fragments(f, ["doc"], "pos", "t", "a", "u").select("doc", "question", "n_fragments", _md5(F.col("content")).alias("content"))


def _scheme(spark, sf):
    """Markschemes by conversation: an instruction, an anchor, and the turns as numbered answers."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x, i: F.concat(i + 1, F.lit(". "), x["t"])), "\n")
    return c.select("doc", F.size("x").alias("n"), F.concat(F.lit("Maximum mark: 9\n1. Follow the markscheme\n"), body).alias("text"))


@register("""WITH t AS (SELECT conv_id AS doc, replace(text, chr(10), ' ') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, replace(text, chr(10), ' ')) AS n FROM conversations), l AS (SELECT doc, n, n || '. ' || t AS line FROM t)
SELECT doc, n, (41 + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM l""")
def scheme_walk(spark, sf):
    s = _scheme(spark, sf)
    return s.select("doc", F.explode(segment.anchored_walk(F.col("text"), F.col("n"))).alias("x")).select("doc", "x.n", F.col("x.at").alias("place"))


@register()
def prompt_answers(spark, sf):
    c = table(spark, sf, "conversations").withColumn("x", F.struct("turn", "role", "text"))
    of = lambda role: F.transform(F.filter(F.sort_array(F.collect_list("x")), lambda y: y["role"] == role), lambda y: y["text"])
    g = c.groupBy(F.col("conv_id").alias("doc")).agg(of("user").alias("q"), of("assistant").alias("a"))
    g = g.withColumn("text", F.array_join(F.zip_with("q", "a", lambda q, a: F.concat_ws("\nMarkscheme: ", q, a)), "\n"))
    g = g.withColumn("places", segment.located_prompts(F.col("text"), F.col("q")))
    return g.select("doc", F.explode(segment.bounded_answers(F.col("text"), F.col("places"))).alias("r")).select("doc", "r.n", _md5(F.col("r.answer")).alias("answer"))


@register(r"""WITH RECURSIVE c AS (SELECT conv_id AS doc, turn, role, text, regexp_replace(text, '[,.;:-]', '', 'g') AS lost FROM conversations WHERE text IS NOT NULL), u AS (SELECT doc, text AS p, row_number() OVER (PARTITION BY doc ORDER BY turn, text) AS n FROM c WHERE role = 'user'),
d AS (SELECT doc, string_agg(CASE WHEN role = 'user' THEN lost ELSE text END, chr(10) ORDER BY turn, role, text) AS t FROM c GROUP BY 1), h AS (SELECT doc, t, ltrim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS hay FROM d),
k AS (SELECT doc, list(i ORDER BY i) AS at_pos FROM (SELECT doc, i, k, lag(k) OVER (PARTITION BY doc ORDER BY i) AS b FROM (SELECT doc, i - 1 AS i, CASE WHEN regexp_matches(substr(t, i, 1), '^\s$') THEN 1 WHEN regexp_matches(substr(t, i, 1), '^[\p{L}\p{N}]$') THEN 2 ELSE 0 END AS k FROM (SELECT doc, t, unnest(range(1, length(t) + 1)) AS i FROM d)) WHERE k > 0) WHERE k = 2 OR b = 2 GROUP BY 1),
w AS (SELECT doc, n, trim(left(x, 60)) AS a, trim(left(x, 40)) AS b, trim(left(y, 80)) AS f FROM (SELECT doc, n, trim(regexp_replace(regexp_replace(lower(p), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS x, trim(regexp_replace(regexp_replace(lower(regexp_extract(p, '(?is)(?:^|\s)(?:\((?:a|b|c|i|ii)\)|(?:a|b|c|i|ii|iii|iv|v)\.)\s.*')), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS y FROM u)),
r AS (SELECT doc, 0::BIGINT AS n, 0::BIGINT AS since, NULL::BIGINT AS at_pos FROM h UNION ALL
  SELECT doc, n, coalesce(at_pos + 1, since), at_pos FROM (SELECT w.doc, w.n, r.since, coalesce(CASE WHEN length(f) >= 8 AND contains(substr(hay, r.since + 1), f) THEN r.since + instr(substr(hay, r.since + 1), f) - 1 END, CASE WHEN length(a) >= 8 AND contains(substr(hay, r.since + 1), a) THEN r.since + instr(substr(hay, r.since + 1), a) - 1 END, CASE WHEN length(b) >= 8 AND contains(substr(hay, r.since + 1), b) THEN r.since + instr(substr(hay, r.since + 1), b) - 1 END) AS at_pos FROM r JOIN w ON w.doc = r.doc AND w.n = r.n + 1 JOIN h ON h.doc = r.doc) z)
SELECT r.doc, n, k.at_pos[r.at_pos + 1]::BIGINT AS place FROM r JOIN k USING (doc) WHERE r.at_pos IS NOT NULL""")
def prompt_places(spark, sf):
    """Users' turns sought in texts that have lost their marks."""
    c = table(spark, sf, "conversations").where("text is not null")
    t = F.when(F.col("role") == "user", F.regexp_replace("text", "[,.;:-]", "")).otherwise(F.col("text"))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda y: y["t"])
    g = c.groupBy(F.col("conv_id").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", t.alias("t")))), lambda y: y["t"]).alias("all"), in_order(F.when(F.col("role") == "user", F.struct("turn", F.col("text").alias("t")))).alias("p"))
    return g.select("doc", F.explode(segment.projected_prompts(F.array_join("all", "\n"), F.col("p"))).alias("x")).select("doc", "x.n", F.col("x.at").alias("place"))


@register()
def paper_parts(spark, sf):
    p = lines(spark, sf)
    k = F.col("pos")
    t = F.concat(F.when(k % 6 == 0, F.concat(F.floor(k / 6) + 1, F.lit(". "))).when(k % 6 == 2, "(a) ").when(k % 6 == 4, F.concat(F.lit("It ends. "), F.floor(k / 6) + 2, F.lit(". [2 marks] "))).otherwise(""), "line")
    d = p.groupBy(F.col("doc_id").alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", t.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return segment.paper_parts(d).select("doc", "question", "part", _md5(F.col("content")).alias("content"))


@register("""WITH x AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'old Examiners report ' || text WHEN 1 THEN text END AS cur, text || CASE turn % 4 WHEN 3 THEN ' Examiners report more' ELSE '' END AS found, (conv_id % 10) / 10.0 AS score FROM conversations),
y AS (SELECT *, regexp_replace(CASE WHEN contains(found, 'Examiners report') THEN string_split(found, 'Examiners report')[1] ELSE found END, '^\\s+|\\s+$', '', 'g') AS c, contains(coalesce(cur, ''), 'Examiners report') AS b FROM x),
z AS (SELECT *, CASE WHEN length(c) >= 40 AND score >= 0.6 AND b THEN 'replace' WHEN length(c) >= 40 AND score >= 0.6 THEN 'risk' ELSE 'keep' END AS action FROM y)
SELECT conv_id, turn, role, action, md5(CASE action WHEN 'replace' THEN c ELSE cur END) AS answer FROM z""")
def answer_repair(spark, sf):
    t = F.col("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(t % 3 == 0, F.concat(F.lit("old Examiners report "), "text")).when(t % 3 == 1, F.col("text")).alias("current"),
                                                 F.concat("text", F.when(t % 4 == 3, " Examiners report more").otherwise("")).alias("found"), ((F.col("conv_id") % 10) / 10).alias("score"))
    return segment.repaired_answers(c).select("conv_id", "turn", "role", "action", _md5(F.col("answer")).alias("answer"))


@register(f"""WITH {_I}, n AS (SELECT doc, count(*) FILTER (qty % 3 > 0) AS q, count(*) AS m FROM i GROUP BY 1)
SELECT doc, m AS n, CASE WHEN m < 3 THEN 'too few' WHEN m > 6 THEN 'too many' WHEN q <> m THEN 'counts differ' END AS skip FROM n""")
def paper_gate(spark, sf):
    p = _i(spark, sf).groupBy("doc").agg(F.collect_list(F.when(F.col("qty") % 3 > 0, F.col("pos"))).alias("q"), F.collect_list("pos").alias("m"))
    return segment.segmented_papers(p, "doc", F.col("q"), F.col("m"), 3, 6).select("doc", "n", "skip")


_OPTION_TEXT = ("Option A — Relativity 11 – 14\nOption B – Engineering physics 15 – 19", "option c - Imaging 3-9 \nOption D — x", "none", "Option D — Astrophysics 24 – 31 ")


@register(r"""WITH x AS (SELECT doc_id, ['Option A — Relativity 11 – 14' || chr(10) || 'Option B – Engineering physics 15 – 19', 'option c - Imaging 3-9 ' || chr(10) || 'Option D — x', 'none', 'Option D — Astrophysics 24 – 31 '][doc_id % 4 + 1] || chr(10) || replace(text, 'ption', '') AS s FROM documents),
m AS (SELECT doc_id, regexp_extract_all(s, '(?i)Option\s+([A-D])\s+[—–-]\s*[^\r\n]+?(\d+)\s*[–-]\s*(\d+)', 1) AS a, regexp_extract_all(s, '(?i)Option\s+([A-D])\s+[—–-]\s*[^\r\n]+?(\d+)\s*[–-]\s*(\d+)', 2) AS b, regexp_extract_all(s, '(?i)Option\s+([A-D])\s+[—–-]\s*[^\r\n]+?(\d+)\s*[–-]\s*(\d+)', 3) AS c FROM x)
SELECT doc_id, a[i] AS letter, b[i]::BIGINT AS lo, c[i]::BIGINT AS hi FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)""")
def option_ranges(spark, sf):
    s = F.concat(F.element_at(F.array(*map(F.lit, _OPTION_TEXT)), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("\n"), F.replace("text", F.lit("ption"), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.explode(segment.declared_ranges(s)).alias("r")).select("doc_id", "r.*")


@register(r"""WITH p AS (SELECT doc_id AS source, i - 1 AS page, regexp_replace(lower(ls[i]), '[^a-z0-9]', '', 'g') AS c, length(ls[i]) % 5 AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
r AS (SELECT conv_id * 10 + turn AS id, role, conv_id * 3 AS source, turn AS number, left(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 30) AS t FROM conversations WHERE role <> 'system'),
j AS (SELECT id || role AS id, page, v, page % 4 = number AND page > 2 AS bn, length(t) >= 12 AND contains(c, t) AS bt FROM r LEFT JOIN p USING (source)),
g AS (SELECT id, arg_min((page, v), CASE WHEN bn THEN page WHEN bt THEN 1000000 + page END) FILTER (bn OR bt) AS x, bool_or(page IS NOT NULL) AS known, bool_or(coalesce(bn, false)) AS numbered FROM j GROUP BY 1),
o AS (SELECT *, CASE WHEN NOT known THEN 'no source' WHEN x IS NULL THEN 'no page' WHEN x[2] < 2 THEN 'no figure' WHEN numbered THEN 'by number' ELSE 'by text' END AS outcome FROM g)
SELECT id, outcome, CASE WHEN outcome IN ('by number', 'by text') THEN x[1] END AS page FROM o""")
def figure_links(spark, sf):
    d = lines(spark, sf).select(F.col("doc_id").alias("source"), F.col("pos").cast("long").alias("page"), F.when(F.col("pos") > 2, F.array((F.col("pos") % 4).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("numbers"), F.col("line").alias("content"), (F.length("line") % 5).alias("vectors"))
    r = table(spark, sf, "conversations").where("role <> 'system'").select(F.concat(F.col("conv_id") * 10 + F.col("turn"), "role").alias("id"), (F.col("conv_id") * 3).alias("source"), F.col("turn").cast("long").alias("number"), "text")
    return segment.linked_figures(r, d, 2)


@register("""WITH r AS (SELECT DISTINCT trim(f) AS figure FROM (SELECT unnest(string_split('fig' || (doc_id % 90) || '.png, fig' || (doc_id % 170) || '.png', ',')) AS f FROM documents)) SELECT figure FROM r WHERE figure NOT IN (SELECT 'fig' || s_suppkey || '.png' FROM supplier)""")
def missing_figures(spark, sf):
    d = F.col("doc_id")
    r = table(spark, sf, "documents").select(F.explode(text.split_images(F.concat(F.lit("fig"), d % 90, F.lit(".png, fig"), d % 170, F.lit(".png")))).alias("figure")).distinct()
    return r.join(table(spark, sf, "supplier").select(F.concat(F.lit("fig"), "s_suppkey", F.lit(".png")).alias("figure")), "figure", "left_anti")


@register("""SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN starts_with(f, 'Topic') THEN 0 ELSE 1 END, CASE WHEN starts_with(f, 'Topic') THEN nullif(regexp_replace(f, '\\D', '', 'g'), '')::INT END NULLS FIRST, f, p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'Topic ' || (p_partkey % 37) ELSE p_brand END AS f FROM part)""")
def folder_order(spark, sf):
    from pyspark.sql.window import Window

    k = F.col("p_partkey")
    f = table(spark, sf, "part").select("p_partkey", F.when(k % 5 < 3, F.concat(F.lit("Topic "), k % 37)).otherwise(F.col("p_brand")).alias("f"))
    topic = F.startswith("f", F.lit("Topic"))
    number = F.when(topic, F.regexp_replace("f", r"\D", "").try_cast("int"))
    # ranks of folders, of which there are few, not of the rows in them
    names = f.groupBy("f").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy((~topic).cast("int"), number.asc_nulls_first(), "f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return f.join(names, "f").select("p_partkey", (F.col("before") + F.row_number().over(Window.partitionBy("f").orderBy("p_partkey"))).cast("long").alias("place"))


@register("SELECT n_nationkey, row_number() OVER (ORDER BY lower(n)) AS place FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE upper(n_name) END AS n FROM nation)")
def locale_order(spark, sf):
    from pyspark.sql.window import Window

    n = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.upper("n_name")).alias("n"))
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(F.collate("n", "UNICODE"))).cast("long").alias("place"))


@register(r"""WITH l AS (SELECT doc_id, i - 1 AS pos, CASE WHEN i % 5 = 1 THEN '22M.1.HL.TZ1.' || ((i // 5) % 4 + 1) || ' [' || (i % 7) || ' marks] ' ELSE '' END || CASE WHEN i = 21 THEN 'Markschemes ' ELSE '' END || ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT *, nullif(regexp_extract(line, '(\d{2}(?:M|N|SP)\.\d\.(?:HL|SL|AHL|ASL)\.TZ\d\.\d{1,2}[a-z]?)', 1), '') AS code FROM l), stop AS (SELECT doc_id, min(pos) FILTER (contains(line, 'Markschemes')) AS s FROM l GROUP BY 1),
s AS (SELECT doc_id, pos, code, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM c WHERE code IS NOT NULL),
b AS (SELECT s.doc_id, s.code, s.pos, string_agg(l.line, chr(10) ORDER BY l.pos) AS body FROM s JOIN stop USING (doc_id) JOIN l ON l.doc_id = s.doc_id AND l.pos >= s.pos AND (s.nxt IS NULL OR l.pos < s.nxt) AND (s.pos >= coalesce(stop.s, 1000000000) OR l.pos < coalesce(stop.s, 1000000000)) GROUP BY 1, 2, 3),
o AS (SELECT doc_id, code, arg_min(body, pos) AS question, CASE WHEN count(*) > 1 THEN arg_max(body, pos) END AS answer FROM b GROUP BY 1, 2)
SELECT doc_id, code, md5(question) AS question, md5(answer) AS answer, coalesce(list_sum(list_transform(regexp_extract_all(answer, '\[(\d+) marks?\]', 1), lambda x: x::BIGINT)), list_sum(list_transform(regexp_extract_all(question, '\[(\d+)\]', 1), lambda x: x::BIGINT)), 0)::BIGINT AS marks FROM o""")
def bank_records(spark, sf):
    from pyspark.sql.window import Window

    k = F.col("pos") + 1
    l = lines(spark, sf).withColumn("line", F.concat(F.when(k % 5 == 1, F.concat(F.lit("22M.1.HL.TZ1."), F.floor(k / 5) % 4 + 1, F.lit(" ["), k % 7, F.lit(" marks] "))).otherwise(""), F.when(k == 21, "Markschemes ").otherwise(""), "line"))
    code = F.nullif(F.regexp_extract("line", r"(\d{2}(?:M|N|SP)\.\d\.(?:HL|SL|AHL|ASL)\.TZ\d\.\d{1,2}[a-z]?)", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("pos")
    l = l.withColumn("code", code).withColumn("stop", F.min(F.when(F.contains("line", F.lit("Markschemes")), F.col("pos"))).over(Window.partitionBy("doc_id")))
    # a record runs to the next code, and a question's no further than the markschemes' heading
    l = l.withColumn("seq", F.last(F.when(F.col("code").isNotNull(), F.col("pos")), True).over(w)).withColumn("code", F.last("code", True).over(w)).where("seq is not null")
    l = l.where(F.col("stop").isNull() | (F.col("seq") >= F.col("stop")) | (F.col("pos") < F.col("stop")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    b = l.groupBy("doc_id", "code", "seq").agg(body.alias("body"))
    o = b.groupBy("doc_id", "code").agg(F.min_by("body", "seq").alias("question"), F.when(F.count(F.lit(1)) > 1, F.max_by("body", "seq")).alias("answer"))
    total = lambda c, p: F.aggregate(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    told = F.when(F.size(F.regexp_extract_all("answer", F.lit(r"\[(\d+) marks?\]"), F.lit(1))) > 0, total("answer", r"\[(\d+) marks?\]"))
    return o.select("doc_id", "code", _md5(F.col("question")).alias("question"), _md5(F.col("answer")).alias("answer"), F.coalesce(told, total("question", r"\[(\d+)\]")).alias("marks"))

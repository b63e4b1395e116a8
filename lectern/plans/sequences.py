"""Sequence operators and pairing joins as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import tables
from lectern.operators import joins, sequence
from lectern.plans.bindings import LINES, lines, table
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()
_ITEM = "i AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS pos, max(l_partkey) AS v, max(l_quantity)::BIGINT AS qty, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"


def _items(spark, sf):
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("pos"))
    return i.agg(F.max("l_partkey").alias("v"), F.max("l_quantity").cast("long").alias("qty"), F.max("l_returnflag").alias("flag"))


@register(f"WITH {_ITEM} SELECT doc, pos, coalesce(lead(pos) OVER (PARTITION BY doc ORDER BY pos), 99) AS span_end FROM i")
def span_lead(spark, sf):
    return sequence.span_ends(_items(spark, sf), ["doc"], "pos", F.lit(99)).select("doc", "pos", F.col("span_end").cast("long").alias("span_end"))


@register(f"WITH {LINES} SELECT doc_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM lines")
def prefix_offsets(spark, sf):
    return sequence.prefix_offsets(lines(spark, sf), ["doc_id"], "pos", F.length("line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "start_at")


@register("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS filled FROM conversations""")
def forward_fill(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.withColumn("o", F.struct("turn", "role", "text"))
    return sequence.forward_fill(c, ["conv_id"], "o", F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary")))).select("conv_id", "turn", "filled")


@register("""WITH g AS (SELECT l_suppkey AS page, l_extendedprice AS x, l_orderkey, l_linenumber, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER w > 60 THEN 1 ELSE 0 END AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice))
, s AS (SELECT page, x, sum(n) OVER (PARTITION BY page ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM (SELECT DISTINCT page, x, max(n) OVER (PARTITION BY page, x) AS n FROM g))
SELECT page, grp, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM s GROUP BY 1, 2""")
def gap_group(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("x")).distinct()
    g = sequence.gap_groups(p, ["page"], "x", 60)
    return g.groupBy("page", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@register("""WITH RECURSIVE p AS (SELECT page, x, row_number() OVER (PARTITION BY page ORDER BY x) AS k FROM (SELECT DISTINCT l_suppkey AS page, l_quantity AS x FROM lineitem)),
r AS (SELECT page, x, k, x AS anchor FROM p WHERE k = 1 UNION ALL SELECT p.page, p.x, p.k, CASE WHEN p.x - r.anchor <= 5 THEN r.anchor ELSE p.x END FROM r JOIN p ON p.page = r.page AND p.k = r.k + 1)
SELECT page, anchor, count(*) AS n FROM r GROUP BY 1, 2""")
def line_groups(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("page")).agg(F.collect_set("l_quantity").alias("xs"))
    return p.select("page", F.explode(sequence.anchored_groups(F.col("xs"), 5)).alias("g")).select("page", "g.anchor", "g.n")


@register(f"""WITH {LINES}, k AS (SELECT doc_id, pos, trim(line) AS line, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM lines WHERE length(line) BETWEEN 1 AND 120)
SELECT doc_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, string_agg(line, ' ' ORDER BY pos) AS joined FROM k GROUP BY doc_id, g HAVING count(*) >= 3""")
def islands_join(spark, sf):
    d = lines(spark, sf).withColumn("pos", F.col("pos").cast("long"))
    return sequence.islands(d, ["doc_id"], "pos", F.length("line").between(1, 120)).select("doc_id", "first_pos", "last_pos", "n", "joined")


@register(f"""WITH RECURSIVE {_ITEM}, h AS (SELECT doc, pos, qty % 4 + 1 AS n, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM i),
r AS (SELECT doc, 0::BIGINT AS k, 1::BIGINT AS e, 0::BIGINT AS pos, false AS ok FROM (SELECT DISTINCT doc FROM h)
  UNION ALL SELECT h.doc, h.k, CASE WHEN h.n = r.e THEN r.e + 1 ELSE r.e END, h.pos, h.n = r.e FROM r JOIN h ON h.doc = r.doc AND h.k = r.k + 1)
SELECT doc, pos, e - 1 AS n FROM r WHERE ok""")
def expected_walk(spark, sf):
    h = _items(spark, sf).groupBy("doc").agg(F.collect_list(F.struct("pos", (F.col("qty") % 4 + 1).alias("n"))).alias("hits"))
    return h.select("doc", F.explode(sequence.expected_walk(F.col("hits"))).alias("x")).select("doc", "x.pos", "x.n")


@register(ORACLES["expected_walk"])
def walk_numbers(spark, sf):
    """The same walk from SQL."""
    tables.register(spark)
    _items(spark, sf).select("doc", "pos", (F.col("qty") % 4 + 1).alias("n")).createOrReplaceTempView("lectern_hits")
    return spark.sql("SELECT * FROM walk_numbers(TABLE(lectern_hits) PARTITION BY doc ORDER BY pos)")


@register(f"""WITH RECURSIVE {_ITEM}, h AS (SELECT doc, qty % 12 AS n, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM i),
r AS (SELECT doc, 0::BIGINT AS k, NULL::BIGINT AS last, 0::BIGINT AS taken FROM (SELECT DISTINCT doc FROM h)
  UNION ALL SELECT h.doc, h.k, CASE WHEN (r.last IS NULL AND h.n <= 3) OR h.n BETWEEN r.last AND r.last + 3 THEN h.n ELSE r.last END,
    r.taken + CASE WHEN (r.last IS NULL AND h.n <= 3) OR h.n BETWEEN r.last AND r.last + 3 THEN 1 ELSE 0 END FROM r JOIN h ON h.doc = r.doc AND h.k = r.k + 1)
SELECT doc, max(taken) AS taken, arg_max(last, k) AS last_n FROM r GROUP BY doc""")
def bounded_gap_run(spark, sf):
    h = _items(spark, sf).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("qty") % 12).alias("n")))).alias("h"))
    run = sequence.bounded_gap_run(F.transform("h", lambda x: x["n"]))
    return h.select("doc", run.alias("r")).select("doc", F.size("r").cast("long").alias("taken"), F.when(F.size("r") > 0, F.element_at("r", -1)).alias("last_n"))


@register(f"""WITH {_ITEM}, b AS (SELECT doc, pos, qty % 6 AS n FROM i), c AS (SELECT doc, pos, CASE WHEN n - lag(n) OVER (PARTITION BY doc ORDER BY pos) BETWEEN 1 AND 2 THEN 0 ELSE 1 END AS s FROM b),
g AS (SELECT doc, pos, sum(s) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM c), r AS (SELECT doc, g, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc, first_pos, last_pos, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first_pos) AS k FROM r) WHERE k = 1""")
def longest_run(spark, sf):
    return sequence.longest_run(_items(spark, sf).withColumn("n", F.col("qty") % 6), ["doc"], "pos", "n", 2)


@register(f"""WITH RECURSIVE {_ITEM}, h AS (SELECT doc, pos, CASE WHEN qty % 5 = 0 THEN 'head' WHEN qty % 5 < 4 THEN 'numbered' ELSE 'other' END AS k, row_number() OVER (PARTITION BY doc ORDER BY pos) AS j FROM i),
r AS (SELECT doc, 0::BIGINT AS j, 0::BIGINT AS pos, false AS taken FROM (SELECT DISTINCT doc FROM h)
  UNION ALL SELECT h.doc, h.j, h.pos, h.k = 'head' OR (h.k = 'numbered' AND r.taken) FROM r JOIN h ON h.doc = r.doc AND h.j = r.j + 1)
SELECT doc, pos, taken FROM r WHERE j > 0""")
def page_gate(spark, sf):
    kind = F.when(F.col("qty") % 5 == 0, "head").when(F.col("qty") % 5 < 4, "numbered").otherwise("other")
    return sequence.page_gate(_items(spark, sf), ["doc"], "pos", kind).select("doc", "pos", "taken")


@register("""WITH c AS (SELECT DISTINCT l_orderkey AS page, unnest(range(floor(l_partkey % 600 / 5.0)::BIGINT, floor((l_partkey % 600 + l_quantity / 2) / 5)::BIGINT + 1)) AS c FROM lineitem),
n AS (SELECT page, c, lead(c) OVER (PARTITION BY page ORDER BY c) AS d FROM c) SELECT page, (c + 1) * 5 AS gap_start, d * 5 AS gap_end FROM n WHERE (d - c - 1) * 5 >= 25""")
def coverage_gutters(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 600).cast("double").alias("x0"), (F.col("l_partkey") % 600 + F.col("l_quantity") / 2).alias("x1"))
    return sequence.coverage_gaps(b, ["page"], "x0", "x1")


@register(f"""WITH {_ITEM}, p AS (SELECT doc, pos, qty % 5 AS a, qty % 5 + v % 4 AS b FROM i), e AS (SELECT doc, pos, a, b, unnest(range(a, b + 1)) AS page FROM p)
SELECT doc, pos, page, CASE WHEN page = a THEN 'first' WHEN page = b THEN 'last' ELSE 'middle' END AS part FROM e""")
def span_page_expand(spark, sf):
    p = _items(spark, sf).select("doc", "pos", (F.col("qty") % 5).alias("a"), (F.col("qty") % 5 + F.col("v") % 4).alias("b"))
    return sequence.span_pages(p, "a", "b").select("doc", "pos", "page", "part")


@register("SELECT l_suppkey, list_sort(list(l_quantity))[(count(*) // 2 + 1)] AS median FROM lineitem GROUP BY 1")
def median_upper(spark, sf):
    return sequence.upper_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")


@register(f"""WITH {_ITEM}, x AS (SELECT doc, pos, flag = 'R' AS f, count(*) FILTER (flag = 'R') OVER w AS n, count(*) OVER w AS rest, count(*) OVER (PARTITION BY doc) AS total FROM i WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc, min(pos) AS start_page FROM x WHERE f AND n >= 2 AND n >= 0.25 * rest AND total - rest >= 0.5 * total GROUP BY doc""")
def density_start(spark, sf):
    return sequence.density_start(_items(spark, sf).withColumn("f", F.col("flag") == "R"), ["doc"], "pos", "f", 0.25, 2, 0.5)


@register("""WITH l AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS at, l_partkey AS q FROM lineitem WHERE l_linenumber > 1), r AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS at, max(l_partkey) AS label FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT l.k, l.at, l.q, r.label FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.at >= r.at""")
def asof_page(spark, sf):
    i = table(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    l = i.where("l_linenumber > 1").select(F.col("l_suppkey").alias("k"), "at", F.col("l_partkey").alias("q"))
    r = i.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("k"), "at").agg(F.max("l_partkey").alias("label"))
    return joins.asof_backward(l, r, ["k"], "at", ["label"])


@register("""WITH e AS (SELECT user_id, event_id, ts, event_type, epoch(ts)::BIGINT AS sec FROM events), s AS (SELECT user_id, sec, max(event_id) AS banner FROM e WHERE event_type = 'view' GROUP BY 1, 2)
SELECT e.user_id, e.event_id, s.banner FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.sec >= s.sec WHERE event_type <> 'view'""")
def asof_section(spark, sf):
    # whole seconds by rounding, half to even, as a cast of SQL does
    e = table(spark, sf, "events").withColumn("at", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    s = e.where("event_type = 'view'").groupBy("user_id", "at").agg(F.max("event_id").alias("banner"))
    l = e.where("event_type <> 'view'").select("user_id", "event_id", "at")
    return joins.asof_backward(l, s, ["user_id"], "at", ["banner"]).select("user_id", "event_id", "banner")


@register(f"""WITH {LINES}, s AS (SELECT doc_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM lines),
p AS (SELECT doc_id, unnest([10, 200, 500, 100000]) AS at FROM documents) SELECT p.doc_id, p.at, max(s.pos) AS page FROM p JOIN s ON s.doc_id = p.doc_id AND s.st <= p.at GROUP BY 1, 2""")
def offset_to_page(spark, sf):
    s = sequence.prefix_offsets(lines(spark, sf), ["doc_id"], "pos", F.length("line")).select("doc_id", F.col("start_at").alias("st"), F.col("pos").cast("long").alias("page"))
    p = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (10, 200, 500, 100000)))).alias("at"))
    return joins.interval_lookup(p, s, ["doc_id"], "at", "st", "page").select("doc_id", F.col("at").cast("int").alias("at"), "page")


@register("""WITH b AS (SELECT DISTINCT l_suppkey AS page, l_orderkey AS box, l_quantity::BIGINT AS b0, l_quantity::BIGINT + l_linenumber * 3 AS b1 FROM lineitem), y AS (SELECT l_suppkey AS page, l_linenumber::BIGINT AS band, min(l_quantity)::BIGINT + any_value(l_linenumber) * 4 AS y0, min(l_quantity)::BIGINT + any_value(l_linenumber) * 4 + 9 AS y1 FROM lineitem GROUP BY 1, 2),
j AS (SELECT b.*, band, least(b1, y1) - greatest(b0, y0) AS o FROM b JOIN y USING (page) WHERE b1 >= y0 AND b0 <= y1)
SELECT page, box, b0, b1, band, o AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY page, box, b0, b1 ORDER BY o DESC, band) AS k FROM j) WHERE k = 1""")
def interval_overlap_best(spark, sf):
    i = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("long")
    b = i.select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("box"), q.alias("b0"), (q + F.col("l_linenumber") * 3).alias("b1")).distinct()
    y = i.groupBy(F.col("l_suppkey").alias("page"), F.col("l_linenumber").cast("long").alias("band")).agg(F.min(q).alias("m"))
    y = y.select("page", "band", (F.col("m") + F.col("band") * 4).alias("y0"), (F.col("m") + F.col("band") * 4 + 9).alias("y1"))
    return joins.overlap_best(b, y, ["page"])


@register("""WITH i AS (SELECT l_suppkey AS side, floor(l_extendedprice)::BIGINT AS y FROM lineitem) SELECT side, y, min(y) OVER (PARTITION BY side ORDER BY y RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y FROM (SELECT DISTINCT * FROM i)""")
def nearest_next(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("side"), F.floor("l_extendedprice").cast("long").alias("y")).distinct()
    return joins.nearest_next(i, ["side"], "y", "next_y")


@register("""WITH l AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n, l_quantity AS y, l_partkey % 50 AS x FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_orderkey AS page, l_quantity AS y, l_partkey % 90 AS x, 'm' || l_linenumber AS mark FROM lineitem WHERE l_returnflag = 'R')
SELECT page, n, y AS ly, x AS lx, mark FROM (SELECT l.*, mark, row_number() OVER (PARTITION BY l.page, l.n, l.y, l.x ORDER BY r.x, r.y, mark) AS k FROM l JOIN r ON l.page = r.page AND abs(r.y - l.y) <= 15 AND r.x - l.x > 0 AND r.x - l.x < 60) WHERE k = 1""")
def spatial_band(spark, sf):
    i = table(spark, sf, "lineitem")
    l = i.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("ly"), (F.col("l_partkey") % 50).alias("lx")).distinct()
    r = i.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("ry"), (F.col("l_partkey") % 90).alias("rx"), F.concat(F.lit("m"), F.col("l_linenumber")).alias("mark")).distinct()
    return joins.nearest_within(l, r, ["page"], 15, 60)


@register("""WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.k AS ord, md5(u.text) AS question, md5(b.text) AS answer FROM u JOIN b ON u.conv_id = b.conv_id AND u.k = b.k""")
def ordinal_zip(spark, sf):
    c = table(spark, sf, "conversations").withColumn("o", F.struct("turn", "text"))
    u = c.where("role = 'user'").select("conv_id", "o", F.md5(F.col("text").cast("binary")).alias("question"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("o").alias("p"), F.md5(F.col("text").cast("binary")).alias("answer"))
    return joins.ordinal_zip(u, b, ["conv_id"], "o", "p").select("conv_id", F.col("ord").cast("long").alias("ord"), "question", "answer")


@register(f"""WITH {_ITEM}, m AS (SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS k FROM i), b AS (SELECT doc, k // 2 AS block, min(pos) AS opens, max(pos) AS ends FROM m GROUP BY 1, 2 HAVING count(*) = 2)
SELECT doc, block, opens, ends, coalesce(lag(ends) OVER (PARTITION BY doc ORDER BY block), 0) AS region_start FROM b""")
def ordinal_blocks(spark, sf):
    return joins.ordinal_blocks(_items(spark, sf).select("doc", "pos"), ["doc"], "pos").select("doc", F.col("block").cast("long").alias("block"), "opens", "ends", F.col("region_start").cast("long").alias("region_start"))


_CODES = "q AS (SELECT l_partkey % 700 AS code, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey % 900 + 100 AS code, l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS body FROM lineitem WHERE l_returnflag = 'R')"


@register(f"""WITH {_CODES}, q1 AS (SELECT code, min(seq) AS seq FROM q GROUP BY 1), b1 AS (SELECT code, arg_min(body, seq) AS body FROM b GROUP BY 1)
SELECT coalesce(q1.code, b1.code) AS code, q1.seq, b1.body, CASE WHEN b1.code IS NULL THEN 'no answer' WHEN q1.code IS NULL THEN 'no question' ELSE 'pair' END AS state FROM q1 FULL JOIN b1 ON q1.code = b1.code""")
def pair_by_code(spark, sf):
    i = table(spark, sf, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    q = i.where("l_returnflag = 'A'").select((F.col("l_partkey") % 700).alias("code"), "seq")
    b = i.where("l_returnflag = 'R'").select((F.col("l_partkey") % 900 + 100).alias("code"), "seq", F.col("l_suppkey").alias("body"))
    pairs, no_answer, no_question = joins.exact_pairs(q, b, "code", "seq")
    tag = lambda df, s: df.withColumn("state", F.lit(s))
    return tag(pairs, "pair").unionByName(tag(no_answer, "no answer"), True).unionByName(tag(no_question.drop("seq"), "no question"), True)


@register("""WITH x AS (SELECT l_partkey AS code, l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS body FROM lineitem)
SELECT code, arg_min(body, seq) AS question, CASE WHEN count(*) > 1 THEN arg_max(body, seq) END AS markscheme, count(*) AS occurrences FROM x GROUP BY 1""")
def occurrence_join(spark, sf):
    # rows of one order and line are taken as they stand in the files
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("body"),
                                            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return joins.occurrence_pairs(x, "code", "seq", "body", "file", "row")


@register("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment IS NULL OR c_custkey % 10 = 0 OR (c_nationkey || ':' || (c_custkey % 40)) NOT IN (SELECT s_nationkey || ':' || (s_suppkey % 40) FROM supplier)""")
def anti_identity(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    mine = F.when(F.col("c_custkey") % 10 != 0, F.concat_ws(":", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string")))
    return joins.anti_identity(c, s, mine, F.concat_ws(":", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 40).cast("string"))).select(F.col("c_custkey").alias("id"))


@register("""WITH q AS (SELECT DISTINCT l_suppkey AS grp, (l_linenumber + l_quantity)::BIGINT % 60 AS n FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS grp, l_partkey % 60 AS n, l_orderkey * 10 + l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 20),
e AS (SELECT grp, n, min(pos) AS p FROM s GROUP BY 1, 2), k AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY pos) AS n, pos FROM s)
SELECT q.grp, q.n, coalesce(e.p, k.pos) AS start, CASE WHEN e.p IS NOT NULL THEN 'exact' WHEN k.pos IS NOT NULL THEN 'ordinal' END AS how FROM q LEFT JOIN e ON q.grp = e.grp AND q.n = e.n LEFT JOIN k ON q.grp = k.grp AND q.n = k.n""")
def positional_fallback(spark, sf):
    i = table(spark, sf, "lineitem")
    q = i.select(F.col("l_suppkey").alias("grp"), ((F.col("l_linenumber") + F.col("l_quantity")).cast("long") % 60).alias("n")).distinct()
    s = i.where("l_returnflag = 'R' and l_quantity < 20").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") % 60).alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).distinct()
    return joins.positional_fallback(q, s, "grp", "n", "pos")


@register("""WITH n AS (SELECT item_id AS item, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM benchmark UNION ALL SELECT -1 - item_id, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1 + item_id % 7, 22 + item_id % 9) FROM benchmark),
w AS (SELECT DISTINCT item, substr(t, i + 1, 30) AS w FROM (SELECT item, t, unnest(range(0, greatest(1, length(t) - 25), 15)) AS i FROM n) WHERE length(substr(t, i + 1, 30)) >= 24),
p AS (SELECT doc_id AS page, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents) SELECT item, min(page) AS page FROM w JOIN p ON contains(t, w) GROUP BY item""")
def window_containment(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("needle"))
    # and short stretches of the items, about as long as the shortest window
    letters = F.regexp_replace(F.lower("needle"), "[^a-z0-9]", "")
    short = b.select((-1 - F.col("item")).alias("item"), letters.substr((1 + F.col("item") % 7).cast("int"), (22 + F.col("item") % 9).cast("int")).alias("needle"))
    return joins.window_containment(table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.col("text").alias("content")), b.unionByName(short))


@register("""WITH x AS (SELECT c.conv_id, c.turn, d.text AS stem, c.text AS hay FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)
SELECT conv_id, turn, max(n)::INT AS prefix_length FROM (SELECT conv_id, turn, stem, hay, unnest(range(2, least(length(stem), length(hay)) + 1)) AS n FROM x) WHERE contains(hay, left(stem, n)) GROUP BY 1, 2""")
def longest_prefix(spark, sf):
    c, d = table(spark, sf, "conversations"), table(spark, sf, "documents")
    x = c.join(d.select("doc_id", F.col("text").alias("stem")), F.col("conv_id") == F.col("doc_id"))
    return joins.longest_prefix(x, "stem", "text", 2).where("prefix_length is not null").groupBy("conv_id", "turn").agg(F.max("prefix_length").alias("prefix_length"))


@register("""WITH i AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS pos, CASE WHEN max(l_quantity)::BIGINT % 3 = 0 THEN max(l_quantity)::BIGINT * 7 END AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i, (100 + doc % 900) // count(*) OVER (PARTITION BY doc) AS stride FROM i),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY doc ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY doc ORDER BY i DESC) AS b FROM r),
m AS (SELECT k.*, x.v AS av, y.v AS bv, greatest(0, y.v - b * k.stride) AS base FROM k LEFT JOIN r x ON x.doc = k.doc AND x.i = a LEFT JOIN r y ON y.doc = k.doc AND y.i = b)
SELECT doc, pos, (CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL AND b IS NULL THEN i * stride WHEN b IS NULL THEN av + (i - a) * stride WHEN a IS NULL THEN base + i * ((bv - base) // b) ELSE floor(av + (i - a) * ((bv - av) / (b - a)::DOUBLE)) END)::BIGINT AS filled FROM m""")
def interpolated_starts(spark, sf):
    i = _items(spark, sf).select("doc", "pos", F.when(F.col("qty") % 3 == 0, F.col("qty") * 7).alias("v"), (100 + F.col("doc") % 900).alias("length"))
    return joins.interpolate(i, ["doc"], "pos", "v", "length").select("doc", "pos", "filled")


@register("""WITH t AS (SELECT doc_id AS id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents),
r AS (SELECT min(id) AS id, lang, ts FROM t GROUP BY lang, ts), m AS (SELECT t.id, r.id AS rep FROM t JOIN r ON r.lang IS NOT DISTINCT FROM t.lang AND r.ts = t.ts),
e AS (SELECT id, lang, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM r), g AS (SELECT id, lang, x, i, min(i) OVER (PARTITION BY id, x) AS f FROM e),
h AS (SELECT DISTINCT id, lang, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, i) AS k FROM g) WHERE k <= 10), c AS (SELECT id, lang, x, count(*) AS n FROM e GROUP BY 1, 2, 3),
p AS (SELECT h.id AS a, c.id AS b FROM h JOIN c ON c.lang = h.lang AND c.x = h.x AND c.id <> h.id GROUP BY 1, 2 HAVING count(*) >= 4),
s AS (SELECT a, b, sum(least(ca.n, cb.n)) AS c FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b AND cb.x = ca.x GROUP BY 1, 2),
j AS (SELECT a, b, c::DOUBLE / (len(x.ts) + len(y.ts) - c) AS j FROM s JOIN r x ON x.id = a JOIN r y ON y.id = b), l AS (SELECT a, count(*) AS n_links, min(b) AS first_link, round(max(j), 6) AS jaccard FROM j WHERE j >= 0.45 GROUP BY a)
SELECT m.id, rep, coalesce(n_links, 0) AS n_links, first_link, jaccard FROM m LEFT JOIN l ON l.a = m.rep""")
def near_dup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    members, links = joins.near_duplicates(d, d, "lang")
    l = links.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"), F.min("b").alias("first_link"), F.round(F.max("jaccard"), 6).alias("jaccard"))
    return members.join(l, "rep", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "first_link", "jaccard")


@register("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def exact_dup(spark, sf):
    from lectern.functions.text import collapse_space

    d = table(spark, sf, "documents").select("doc_id", F.sha2(collapse_space(F.lower("text")), 256).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")

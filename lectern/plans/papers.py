"""Papers end to end as queries: a document's even lines are a paper of eight lines a page, its odd ones the markscheme, numbered by position with faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import COMMAND_TERMS
from lectern.operators import papers
from lectern.plans.bindings import LINES, lines
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()


def _papers(spark, sf):
    p, d = F.col("pos"), F.col("doc_id")
    late = d % 4 == 0
    number = F.when(p % 6 == 0, F.when((d % 9 == 0) & (p == 6), 7).otherwise(F.floor(p / 6) + 1)).when(p % 6 == 3, F.when(late & (p >= 15), F.floor((p - 9) / 6)).when(late & (p == 9), None).otherwise(F.floor(p / 6) + 1))
    opened = F.when(late & (p == 9), "Question Answers Notes Total ").when(number.isNotNull(), F.concat(number, F.lit(". "), F.when(p % 12 == 0, "[Maximum mark: 6] Find ").otherwise("Explain [2] why [3] "))).otherwise("")
    return lines(spark, sf).where((d % 7 != 0) | (p % 2 == 0)).select(F.col("doc_id").alias("doc"), F.when(p % 2 == 0, "q").otherwise("m").alias("side"), F.floor(p / 8).alias("page"), p.cast("long").alias("pos"), F.concat(opened, "line").alias("line"))


_WALKS = f"""{LINES}, l0 AS (SELECT doc_id AS doc, pos, line, CASE WHEN pos % 6 = 0 THEN CASE WHEN doc_id % 9 = 0 AND pos = 6 THEN 7 ELSE pos // 6 + 1 END WHEN pos % 6 = 3 THEN CASE WHEN doc_id % 4 = 0 AND pos >= 15 THEN (pos - 9) // 6 WHEN doc_id % 4 = 0 AND pos = 9 THEN NULL ELSE pos // 6 + 1 END END AS k FROM lines WHERE doc_id % 7 <> 0 OR pos % 2 = 0),
l AS (SELECT doc, CASE WHEN pos % 2 = 0 THEN 'q' ELSE 'm' END AS side, pos // 8 AS page, pos, CASE WHEN doc % 4 = 0 AND pos = 9 THEN 'Question Answers Notes Total ' WHEN k IS NOT NULL THEN k || '. ' || CASE WHEN pos % 12 = 0 THEN '[Maximum mark: 6] Find ' ELSE 'Explain [2] why [3] ' END ELSE '' END || line AS line FROM l0),
t AS (SELECT doc, min(pos) AS since FROM l WHERE side = 'm' AND regexp_matches(line, '^\\s*(?:Question|Q)\\s+Answers\\s+Notes\\s+Total') GROUP BY 1),
h AS (SELECT l.doc, side, pos, nullif(regexp_extract(line, '^\\s*(\\d{{1,2}})\\.(?:\\s|$)', 1), '')::BIGINT AS n FROM l LEFT JOIN t USING (doc) WHERE side = 'q' OR since IS NULL OR pos >= since),
r AS (SELECT doc, side, 0::BIGINT AS n, -1::BIGINT AS pos FROM (SELECT DISTINCT doc, side FROM h) UNION ALL SELECT r.doc, r.side, r.n + 1, min(h.pos) FROM r JOIN h ON h.doc = r.doc AND h.side = r.side AND h.n = r.n + 1 AND h.pos > r.pos WHERE r.n < 60 GROUP BY 1, 2, 3),
c AS (SELECT doc, count(*) FILTER (side = 'q' AND n > 0) AS cq, count(*) FILTER (side = 'm' AND n > 0) AS cm FROM r GROUP BY 1), e AS (SELECT doc, bool_or(side = 'm') AS there FROM l GROUP BY 1),
w AS (SELECT doc, CASE WHEN coalesce(cm, 0) > 0 THEN cm ELSE coalesce(cq, 0) END AS n, coalesce(cm, 0) AS cm, least(coalesce(cq, 0), CASE WHEN coalesce(cm, 0) > 0 THEN cm ELSE coalesce(cq, 0) END) AS cq, there FROM e LEFT JOIN c USING (doc)),
g AS (SELECT doc, n, CASE WHEN NOT there THEN 'no markscheme' WHEN n < 2 THEN 'too few' WHEN n > 25 THEN 'too many' WHEN cq <> n THEN 'questions missing' WHEN cm <> n THEN 'answers missing' END AS skip FROM w)"""
_GATE = {"least": 2, "table": papers.TABLE}


@register(f"WITH RECURSIVE {_WALKS} SELECT coalesce(skip, 'taken') AS reason, count(*) AS papers FROM g GROUP BY 1")
def paper_skips(spark, sf):
    return papers.skip_reasons(papers.paper_walks(_papers(spark, sf), ["doc"], **_GATE))


_RECORDS = f"""{_WALKS}, s AS (SELECT r.* FROM r JOIN g ON g.doc = r.doc AND g.skip IS NULL AND r.n BETWEEN 1 AND g.n),
x AS (SELECT doc, side, n, pos, lead(pos) OVER (PARTITION BY doc, side ORDER BY n) AS nxt FROM s),
b AS (SELECT x.doc, x.side, x.n, string_agg(l.line, chr(10) ORDER BY l.pos) AS body, min(l.page) AS page, max(l.page) AS fin, min(nxt) // 8 AS after FROM x JOIN l ON l.doc = x.doc AND l.side = x.side AND l.pos >= x.pos AND (nxt IS NULL OR l.pos < nxt) GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN after IS NULL THEN fin ELSE greatest(page, after - 1) END AS last_page FROM b),
j AS (SELECT q.doc, q.n AS number, q.body AS question, m.body AS answer, q.page, q.last_page, m.page AS answer_page, m.last_page AS answer_last_page, regexp_extract(regexp_replace(q.body, '^\\s*\\d{{1,2}}\\.\\s*', ''), '[A-Za-z]+') AS word FROM p q JOIN p m ON m.doc = q.doc AND m.n = q.n AND q.side = 'q' AND m.side = 'm')
SELECT doc, number, md5(question) AS question, md5(answer) AS answer, MARKS AS marks, CASE WHEN lower(word) IN ({', '.join(repr(t) for t in COMMAND_TERMS)}) THEN word END AS command_term, page, last_page, answer_page, answer_last_page FROM j"""
_FIRST = r"(CASE WHEN regexp_matches(left(question, 220), '(?i)\[Maximum mark:\s*(\d+)\]|\[(\d+)\s*marks?\]') THEN regexp_extract(regexp_extract(left(question, 220), '(?i)\[Maximum mark:\s*(\d+)\]|\[(\d+)\s*marks?\]'), '\d+')::BIGINT END)"
_EACH = r"nullif(list_sum(list_transform(regexp_extract_all(question, '\[(\d+)\]', 1), lambda z: z::BIGINT))::BIGINT, 0)"


def _digest(df):
    return df.withColumn("question", F.md5(F.col("question").cast("binary"))).withColumn("answer", F.md5(F.col("answer").cast("binary")))


@register("WITH RECURSIVE " + _RECORDS.replace("MARKS", _FIRST))
def paper_records(spark, sf):
    return _digest(papers.paper_records(_papers(spark, sf), ["doc"], **_GATE))


@register("WITH RECURSIVE " + _RECORDS.replace("MARKS", _EACH))
def structured_paper_records(spark, sf):
    return _digest(papers.paper_records(_papers(spark, sf), ["doc"], marks="each", **_GATE))

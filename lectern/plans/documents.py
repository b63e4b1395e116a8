"""Document normalisation, parsing and matching as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import similarity, text
from lectern.operators import align, locate
from lectern.plans.bindings import dealt, table
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()


def _docs(spark, sf):
    return table(spark, sf, "documents")


@register(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS a, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS b, md5(translate(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'o', '0')) AS c FROM documents")
def normal_forms(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", *(F.md5(x.cast("binary")).alias(n) for n, x in (("a", text.collapse_space(t)), ("b", text.alnum_key(t)), ("c", text.alnum_key(t, True)))))


@register(r"""WITH x AS (SELECT doc_id, 'CS HL P' || (doc_id % 4) || '  ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' ·  November 20' || (10 + doc_id % 15) ELSE '' END AS s FROM documents), y AS (SELECT doc_id, s, CASE WHEN contains(s, '·') THEN string_split(s, '·')[1] ELSE s END AS h FROM x)
SELECT doc_id, regexp_replace(CASE WHEN doc_id % 4 BETWEEN 1 AND 3 THEN replace(h, 'CS HL P', 'CS HL Paper ') ELSE h END, '\s+', ' ', 'g') || replace(substr(s, length(h) + 1), 'November', 'Nov') AS label FROM y""")
def label_normalise(spark, sf):
    s = F.concat(F.lit("CS HL P"), F.col("doc_id") % 4, F.lit("  "), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ·  November 20"), 10 + F.col("doc_id") % 15)).otherwise(""))
    return _docs(spark, sf).select("doc_id", text.normalise_label(s).alias("label"))


_WIDE = "".join(chr(0xFF01 + k) for k in range(94)) + "　"
_HALF = ("".join(chr(0x21 + k) for k in range(94)) + " ").replace("'", "''")


@register(f"SELECT doc_id, translate('Ｑ' || doc_id || '　（ａ）＋', '{_WIDE}', '{_HALF}') AS half FROM documents")
def fullwidth(spark, sf):
    return _docs(spark, sf).select("doc_id", text.half_width(F.concat(F.lit("Ｑ"), F.col("doc_id"), F.lit("　（ａ）＋"))).alias("half"))


@register("SELECT doc_id, md5(replace(translate(replace(text, 'th', '⁄'), 'éè!', 'ee'), '!', '')) AS mapped FROM documents")
def pua_map(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.map_glyphs(F.col("text"), {"th": "⁄"}, {"é": "e", "è": "e", "!": ""}).cast("binary")).alias("mapped"))


@register(r"""WITH x AS (SELECT doc_id, text || ' [' || (doc_id % 9) || '] and [' || (doc_id % 20) || ' marks] or [x]' AS s FROM documents)
SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(s, '\[(\d+)(?:\s*marks?)?\]', 1), lambda x: x::BIGINT)), 0)::BIGINT AS marks FROM x""")
def marks_sum(spark, sf):
    s = F.concat("text", F.lit(" ["), F.col("doc_id") % 9, F.lit("] and ["), F.col("doc_id") % 20, F.lit(" marks] or [x]"))
    return _docs(spark, sf).select("doc_id", text.marks_in(s).alias("marks"))


_CODE = "SELECT o_orderkey, lpad((o_orderkey % 25)::VARCHAR, 2, '0') || ['M', 'N', 'SP', 'X'][o_orderkey % 4 + 1] || '.' || (o_orderkey % 3 + 1) || '.' || ['HL', 'SL'][o_orderkey % 2 + 1] || '.TZ' || (o_orderkey % 3) || '.' || (o_orderkey % 12 + 1) AS c FROM orders"
_PATTERN = r"^(\d{2})(M|N|SP)\.(\d)\.(HL|SL|AHL|ASL)\.TZ(\d)\.(\d{1,2}[a-z]?)$"


@register(f"WITH x AS ({_CODE}), y AS (SELECT *, regexp_matches(c, '{_PATTERN}') AS ok FROM x) SELECT o_orderkey, CASE WHEN ok THEN 2000 + regexp_extract(c, '{_PATTERN}', 1)::INT END AS year, CASE WHEN ok THEN regexp_extract(c, '{_PATTERN}', 2) END AS series, CASE WHEN ok THEN regexp_extract(c, '{_PATTERN}', 4) END AS level, CASE WHEN ok THEN regexp_extract(c, '{_PATTERN}', 6) END AS question FROM y")
def code_parse(spark, sf):
    k = F.col("o_orderkey")
    code = F.concat(F.lpad((k % 25).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, ("M", "N", "SP", "X"))), (k % 4 + 1).cast("int")), F.lit("."), k % 3 + 1, F.lit("."),
                    F.element_at(F.array(F.lit("HL"), F.lit("SL")), (k % 2 + 1).cast("int")), F.lit(".TZ"), k % 3, F.lit("."), k % 12 + 1)
    return table(spark, sf, "orders").select("o_orderkey", text.parse_code(code).alias("p")).select("o_orderkey", "p.year", "p.series", "p.level", "p.question")


@register(r"""WITH x AS (SELECT doc_id, '1. ' || ['A','B','C','D'][doc_id % 4 + 1] || ' 2. B ' || (doc_id % 3 + 1) || '. ' || ['D','C'][doc_id % 2 + 1] || ' 12. E' AS s FROM documents),
m AS (SELECT doc_id, regexp_extract_all(s, '(\d{1,2})\.\s*([A-D])\b', 1) AS n, regexp_extract_all(s, '(\d{1,2})\.\s*([A-D])\b', 2) AS x FROM x),
e AS (SELECT doc_id, unnest(range(1, len(n) + 1)) AS i, n, x FROM m), f AS (SELECT doc_id, n[i]::INT AS k, arg_min(x[i], i) AS v FROM e GROUP BY 1, 2)
SELECT doc_id, string_agg(k || ':' || v, ',' ORDER BY k) AS key FROM f GROUP BY 1""")
def mcq_key(spark, sf):
    d = F.col("doc_id")
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), (d % m + 1).cast("int"))
    s = F.concat(F.lit("1. "), pick("ABCD", 4), F.lit(" 2. B "), d % 3 + 1, F.lit(". "), pick("DC", 2), F.lit(" 12. E"))
    return _docs(spark, sf).select("doc_id", text.mcq_key(s).alias("key"))


@register("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@register("""SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'AI' WHEN quality = 0 THEN 'Topic' WHEN quality IS NULL THEN 'Unlabelled' WHEN source LIKE 'src1%' THEN 'Series 1' ELSE 'Past' END AS badge FROM documents d LEFT JOIN labels l USING (doc_id)""")
def source_badge(spark, sf):
    j = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    category = F.when(F.col("toxic") == 1, "ai").when(F.col("quality") == 0, "topic").when(F.col("quality").isNotNull(), "past")
    return j.select("doc_id", text.source_badge(category, F.col("source")).alias("badge"))


@register("SELECT conv_id, turn, role, sha256(role || '|' || text) AS key, ceil(length(text) / 4.0)::BIGINT AS tokens, CASE WHEN length(text) > 90 THEN left(text, 90) || '…' ELSE text END AS preview FROM conversations")
def cache_key(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", text.cache_key(F.col("role"), F.col("text")).alias("key"), text.token_estimate(F.col("text")).alias("tokens"), text.truncate(F.col("text"), 90).alias("preview"))


_TERMS = "[" + ", ".join(f"'{t}'" for t in text.COMMAND_TERMS) + "]"


@register(f"WITH x AS (SELECT doc_id, regexp_extract(CASE WHEN doc_id % 3 = 0 THEN '12. Explain why. ' WHEN doc_id % 3 = 1 THEN '(a) State and show ' ELSE '' END || text, '[A-Za-z]+') AS w FROM documents) SELECT doc_id, CASE WHEN list_contains({_TERMS}, lower(w)) THEN w END AS term FROM x")
def command_term(spark, sf):
    d = F.col("doc_id") % 3
    s = F.concat(F.when(d == 0, "12. Explain why. ").when(d == 1, "(a) State and show ").otherwise(""), "text")
    return _docs(spark, sf).select("doc_id", text.command_term(s).alias("term"))


@register(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, len(t) >= 4 AND len(list_filter(t, lambda x: length(x) = 1)) >= 0.45 * len(t) AS shattered, md5(array_to_string(list_filter(t, lambda x, i: i = 1 OR t[i - 1] <> x), ' ')) AS single FROM w""")
def token_shape(spark, sf):
    t = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return _docs(spark, sf).select("doc_id", text.shattered(F.col("text")).alias("shattered"), t.alias("t")).select("doc_id", "shattered", F.md5(F.array_join(text.drop_adjacent_repeats(F.col("t")), " ").cast("binary")).alias("single"))


@register(r"""WITH x AS (SELECT conv_id, turn, role || text AS a, text AS b, list_distinct(string_split(role || text, ' ')) AS s, list_distinct(string_split(text, ' ')) AS t FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(s, t))::DOUBLE / greatest(least(len(s), len(t)), 1), 9) AS overlap, round(len(list_intersect(s, t))::DOUBLE / greatest(len(list_distinct(list_concat(s, t))), 1), 9) AS jaccard,
 round(len(list_intersect(ga, gb))::DOUBLE / greatest(len(list_distinct(list_concat(ga, gb))), 1), 9) AS trigram FROM (SELECT *, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS ga, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS gb FROM x)""")
def token_similarity(spark, sf):
    c = table(spark, sf, "conversations")
    a, b = F.concat("role", "text"), F.col("text")
    s, t = F.split(a, " "), F.split(b, " ")
    return c.select("conv_id", "turn", F.round(similarity.overlap(s, t), 9).alias("overlap"), F.round(similarity.jaccard(s, t), 9).alias("jaccard"), F.round(similarity.jaccard(similarity.trigrams(a), similarity.trigrams(b)), 9).alias("trigram"))


@register(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/(\d+)', 1) AS number FROM pages")
def path_parse(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1).alias("lang"), F.regexp_extract("url", r"/(\d+)", 1).alias("number"))


def _passages(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("needle"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("hay"))
    # a few long pairs are dear, so they are dealt to many tasks
    return b.join(d, "key").repartition(64, "key")


@register()
def fuzzy_locate(spark, sf):
    return align.fuzzy_locate(_passages(spark, sf), window=None, step=8, refine=5)


@register()
def located_everywhere(spark, sf):
    """Every benchmark item in every document."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("needle"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("hay"))
    return locate.located_everywhere(b, d)


@register()
def paper_repair(spark, sf):
    """A conversation is a paper, the first lines of what its users say are the questions, and what stands after a question is its answer."""
    c = table(spark, sf, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    papers = c.groupBy(F.col("conv_id").alias("paper")).agg(F.array_join(turns, "\n").alias("text"))
    current = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("old Examiners report "), "text")).when(F.col("turn") % 4 == 2, F.col("text"))
    # every third question was scanned badly
    asked = F.when(F.col("turn") % 3 == 2, F.reverse("line")).otherwise(F.translate("line", "ea", "3"))
    records = c.where("role = 'user'").withColumn("line", F.substring_index("text", "\n", 1)).select(F.col("conv_id").alias("paper"), F.col("turn").alias("n"), asked.alias("question"), current.alias("current"))
    done = locate.repaired_papers(records, papers, least=0.6, step=24)
    return done.select("paper", "n", "start", "score", "action", F.md5(F.col("answer").cast("binary")).alias("answer"))


@register()
def seeded_locate(spark, sf):
    return align.seeded_places(_passages(spark, sf))


@register()
def sequence_ratio(spark, sf):
    c = dealt(table(spark, sf, "conversations"), "conv_id", "turn")
    return c.select("conv_id", "turn", F.round(similarity.sequence_ratio(F.col("text"), F.reverse("text")), 6).alias("ratio"))


def _sides(spark, sf):
    c = table(spark, sf, "conversations").withColumn("x", F.struct("turn", F.col("text").alias("t")))
    side = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("x")))), lambda x: x["t"])
    return c.groupBy(F.col("conv_id").alias("doc")).agg(side("user").alias("left"), side("assistant").alias("right"))


@register()
def dp_align(spark, sf):
    return align.aligned(_sides(spark, sf))


@register()
def greedy_align(spark, sf):
    return align.aligned(_sides(spark, sf), method="greedy")


@register()
def bbox_cluster(spark, sf):
    x, y = F.col("l_partkey") % 600, F.col("l_quantity") * 12
    box = F.struct(x.cast("double").alias("x0"), y.alias("y0"), (x + 40).cast("double").alias("x1"), (y + 30).alias("y1"))
    return align.bbox_clusters(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.sort_array(F.collect_list(box)).alias("boxes")))


@register(r"""WITH t AS (SELECT conv_id AS doc, string_agg(CASE role WHEN 'user' THEN (turn + 1) || '. ' WHEN 'assistant' THEN 'Answer: ' ELSE '' END || text, chr(10) ORDER BY turn, CASE role WHEN 'user' THEN (turn + 1) || '. ' WHEN 'assistant' THEN 'Answer: ' ELSE '' END || text) AS t FROM conversations GROUP BY 1),
l AS (SELECT doc, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM t),
q AS (SELECT *, regexp_matches(line, '^\d{1,2}[.)]') AS q, sum(regexp_matches(line, '^\d{1,2}[.)]')::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM l),
m AS (SELECT *, NOT q AND regexp_matches(line, '(?i)^ans(wer)?\b') AS a FROM q WHERE block > 0), n AS (SELECT *, max(CASE WHEN q OR a THEN pos END) OVER w AS mark, arg_max(a, CASE WHEN q OR a THEN pos END) OVER w AS told FROM m WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, min(CASE WHEN told AND trim(line) = '' THEN pos END) OVER (PARTITION BY doc, mark) AS gap FROM n), p AS (SELECT *, CASE WHEN NOT told THEN 'question' WHEN gap IS NULL OR pos < gap THEN 'answer' ELSE 'explanation' END AS part FROM f)
SELECT doc, block, part, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gap IS NULL OR pos <> gap), '')) AS content FROM p GROUP BY doc, block, mark, part""")
def line_state_machine(spark, sf):
    turns = F.struct("turn", F.concat(F.when(F.col("role") == "user", F.concat(F.col("turn") + 1, F.lit(". "))).when(F.col("role") == "assistant", "Answer: ").otherwise(""), F.col("text")).alias("t"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(turns)), lambda x: x["t"]), "\n").alias("text"))
    return align.line_blocks(c).select("doc", "block", "part", F.md5(F.col("content").cast("binary")).alias("content"))

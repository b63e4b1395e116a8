"""Sources, sinks and keyed state as queries. What is read is first written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text
from lectern.operators import search, state
from lectern.plans.bindings import QUESTIONS, questions, table
from lectern.plans.registry import registry
from lectern.sources import readers, resume, writers
from lectern.streaming.run import shared_dir

QUERIES, ORACLES, register = registry()


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def _banks(spark, sf) -> str:
    """A folder of JSON banks: objects, bare arrays, and one that doesn't parse."""
    c = table(spark, sf, "conversations").withColumn("bank", F.col("conv_id") % 6)
    item = F.struct(F.when(F.col("turn") != 3, F.concat("conv_id", F.lit("-"), "turn", F.lit("-"), "role")).alias("id"), F.col("turn").alias("marks"), F.col("text").alias("question"))
    g = c.groupBy("bank").agg(F.sort_array(F.collect_list(item)).alias("questions"))
    doc = F.when(F.col("bank") == 5, '{"questions": [').when(F.col("bank") % 2 == 0, F.to_json(F.struct("questions"))).otherwise(F.to_json("questions"))
    path = _folder(spark, "banks")
    g.select("bank", doc.alias("value")).repartition("bank").write.partitionBy("bank").text(path)
    return path


_ITEM = "id string, marks int, question string"


@register("""SELECT conv_id % 6 AS bank, conv_id || '-' || turn || '-' || role AS id, turn::INT AS marks, md5(text) AS question FROM conversations WHERE conv_id % 6 < 5 AND turn <> 3""")
def json_banks(spark, sf):
    items = readers.json_items(spark, _banks(spark, sf), _ITEM).where("id is not null")
    return items.select(F.regexp_extract("file", r"bank=(\d+)", 1).cast("long").alias("bank"), "id", "marks", F.md5(F.col("question").cast("binary")).alias("question"))


@register("""SELECT conv_id % 6 AS bank, CASE WHEN conv_id % 6 = 5 THEN 'not parsed' ELSE count(*) FILTER (turn = 3) || ' without id' END AS warning FROM conversations GROUP BY 1 HAVING conv_id % 6 = 5 OR count(*) FILTER (turn = 3) > 0""")
def json_bank_warnings(spark, sf):
    w = readers.json_warnings(spark, _banks(spark, sf), _ITEM)
    return w.select(F.regexp_extract("file", r"bank=(\d+)", 1).cast("long").alias("bank"), "warning")


@register("""SELECT l_suppkey AS book, l_partkey AS part, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem WHERE l_linenumber < 6""")
def chunk_lines(spark, sf):
    path = _folder(spark, "chunks")
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    # a chunk also holds lines that are no JSON
    l.select(F.when(F.col("n") < 6, F.to_json(F.struct("book", "part", "o", "n"))).otherwise("{broken").alias("value")).write.text(path)
    return readers.merged_chunks(spark, path, "book long, part long, o long, n int", "book", ["o", "n", "part"]).select("book", "part", F.col("in_book_order").cast("long").alias("place"))


@register("""WITH p AS (SELECT 2010 + s_suppkey % 10 AS year, 'p' || s_suppkey % 3 AS stem FROM supplier GROUP BY ALL), m AS (SELECT year, stem, CASE WHEN year % 2 = 0 THEN stem ELSE 'x' || stem END AS scheme FROM p WHERE stem <> 'p1')
SELECT p.year::INT AS year, p.stem, min(m.scheme) AS scheme FROM p LEFT JOIN m ON m.year = p.year AND contains(m.scheme, p.stem) WHERE p.year >= 2015 GROUP BY 1, 2""")
def corpus_plan(spark, sf):
    base = _folder(spark, "corpus")
    p = table(spark, sf, "supplier").select((2010 + F.col("s_suppkey") % 10).alias("year"), F.concat(F.lit("p"), F.col("s_suppkey") % 3).alias("stem")).distinct()
    m = p.where("stem <> 'p1'").select("year", F.when(F.col("year") % 2 == 0, F.col("stem")).otherwise(F.concat(F.lit("x"), "stem")).alias("stem"))
    for kind, files in (("paper", p), ("markscheme", m)):
        files.withColumn("value", F.lit("x")).repartition("year", "stem").write.partitionBy("year", "stem").text(f"{base}/{kind}")
    tree = readers.file_tree(spark, base, r"/(paper|markscheme)/year=(\d{4})/stem=(\w+)/part-", ["kind", "year", "stem"], 2015)
    of = lambda kind: tree.where(F.col("kind") == kind).select(F.col("year").alias("folder"), "stem")
    pairs = readers.paired_files(of("paper"), of("markscheme").select("folder", F.col("stem").alias("scheme_stem"), F.col("stem").alias("scheme")))
    return pairs.select(F.col("folder").cast("int").alias("year"), "stem", "scheme")


@register("""SELECT o_orderkey AS id, o_orderstatus AS part, CASE WHEN o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS version FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0""")
def stored_partitions(spark, sf):
    path = _folder(spark, "parts")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("part"), F.lit("first").alias("version"))
    writers.write_partitions(o, path, "part")
    writers.write_partitions(o.where("part = 'F' and id % 2 = 0").withColumn("version", F.lit("second")), path, "part")
    return spark.read.schema("id long, version string, part string").parquet(path).select("id", "part", "version")


@register("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'first' WHEN c_custkey % 3 = 1 AND c_nationkey < 12 THEN 'second' ELSE 'third' END AS run, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ok' END AS status FROM customer""")
def resumed_jobs(spark, sf):
    """Three runs over growing lists of jobs into one table: each does what those before left."""
    path = _folder(spark, "jobs")
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal")
    k = F.col("id") % 3
    for name, wanted in (("first", k == 0), ("second", (k < 2) & ((k == 0) | (F.col("c_nationkey") < 12))), ("third", F.lit(True))):
        resume.run_pending(jobs.where(wanted), path, "id", lambda j, name=name: j.select("id", F.lit(name).alias("run"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("ok").alias("status")))
    return spark.read.schema("id long, run string, status string").parquet(path)


@register("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def snapshot_versions(spark, sf):
    base = _folder(spark, "snapshots")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    first = writers.snapshot(c, base)
    writers.snapshot(c.limit(1), base)
    # a reader of the first version does not see the second
    writers.write_json(spark.read.parquet(first), f"{base}/json")
    return spark.read.schema("id long, segment string, balance double").json(f"{base}/json")


@register("""WITH q AS (SELECT c_nationkey AS book, c_custkey AS k, '<b>' || c_name || '</b>' AS question, CASE WHEN c_custkey % 3 = 0 THEN 'a&' || c_custkey ELSE '' END AS image, c_mktsegment AS answer FROM customer),
e AS (SELECT book, k, CASE WHEN image <> '' THEN '<img src="' || replace(image, '&', '&amp;') || '">' ELSE replace(replace(question, '<', '&lt;'), '>', '&gt;') END AS q, answer FROM q)
SELECT book, md5('<section><ol>' || string_agg('<li>' || q || '</li>', '' ORDER BY k) || '</ol></section><section><h2>Answers</h2><ol>' || string_agg('<li>' || answer || '</li>', '' ORDER BY k) || '</ol></section>') AS html FROM e GROUP BY 1""")
def worksheets(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("book"), k.alias("k"), F.concat(F.lit("<b>"), "c_name", F.lit("</b>")).alias("question"), F.when(k % 3 == 0, F.concat(F.lit("a&"), k)).otherwise("").alias("question_image"),
                                            F.col("c_mktsegment").alias("answer"), F.lit(None).cast("string").alias("answer_image"))
    return writers.worksheets(c, "book", "k").select("book", F.md5(F.col("html").cast("binary")).alias("html"))


@register(f"""WITH {QUESTIONS} SELECT id::VARCHAR AS id, subject, try_cast(CASE WHEN id % 4 = 0 THEN 'many' ELSE marks::VARCHAR END AS INT) AS marks, coalesce(category, 'past') AS category, 'new' AS review_status, 0 AS well_down FROM q""")
def seed_conform(spark, sf):
    q = questions(spark, sf).select("id", "subject", "topic", "category", F.when(F.col("id") % 4 == 0, "many").otherwise(F.col("marks").cast("string")).alias("marks"))
    return schema.conform(q, "questions").select("id", "subject", "marks", "category", "review_status", "well_down")


@register("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND (o_totalprice >= 50000 OR o_totalprice IS NULL)""")
def delete_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    gone = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return state.delete_where(state.delete_keys(o, gone, ["id"]), F.col("o_totalprice") < 50000).select("id")


@register(f"""WITH {QUESTIONS} SELECT id, category, 'old' AS origin FROM q WHERE NOT coalesce(category = 'past' OR topic = 'src3', false) UNION ALL SELECT id, 'past', 'new' FROM q WHERE id % 7 = 0""")
def replace_category(spark, sf):
    q = questions(spark, sf).select("id", "category", "topic")
    new = q.where("id % 7 = 0").select("id", F.lit("past").alias("category"), "topic", F.lit("new").alias("origin"))
    return state.replace_partition(q.withColumn("origin", F.lit("old")), new, "category", (F.col("category") == "past") | (F.col("topic") == "src3")).select("id", "category", "origin")


@register("""SELECT count(*) FILTER (c_custkey % 2 = 0) AS copied, count(*) FILTER (c_custkey % 2 = 0) AS expected, true AS ok FROM customer""")
def replicate_verify(spark, sf):
    c = table(spark, sf, "customer")
    source = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("extra"))
    return state.verified_copy(source, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), ["id"])


@register("""WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) SELECT p_partkey AS id, p_partkey IN (SELECT k FROM l) OR p_size % 5 = 1 AS stays FROM part""")
def safe_orphans(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 == 1).alias("well_down"))
    stay, go = state.orphans(p, table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id")), ["id"], F.col("well_down"))
    return stay.select("id", F.lit(True).alias("stays")).unionByName(go.select("id", F.lit(False).alias("stays")))


@register("""WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents) SELECT DISTINCT d.keep AS doc_id, quality, toxic FROM labels l JOIN d ON d.doc_id = l.doc_id""")
def collapse_cascade(spark, sf):
    from pyspark.sql.window import Window

    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("k")).withColumn("new", F.min("doc_id").over(Window.partitionBy("k")))
    return state.cascade_repoint(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", d.where("doc_id <> new").select(F.col("doc_id").alias("old"), "new"))


@register("""WITH o AS (SELECT c_custkey AS id, c_name AS note FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'changed' ELSE note END AS note, id % 10 = 1 AS mastered FROM (SELECT * FROM o UNION ALL SELECT c_custkey, 'added' FROM customer WHERE c_custkey % 6 = 0)) SELECT * FROM s WHERE id % 11 <> 5""")
def notebook_edits(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("note"), F.lit(False).alias("mastered"))
    added = state.insert_ignore(old, c.where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("id"), F.lit("added").alias("note"), F.lit(False).alias("mastered"), F.col("c_custkey").alias("seq")), ["id"], "seq")
    k = F.col("c_custkey")
    edits = c.select(k.alias("id"), F.struct((k % 4 == 0).alias("set"), F.lit("changed").alias("val")).alias("note"), F.struct((k % 10 == 1).alias("set"), F.lit(True).alias("val")).alias("mastered"))
    return state.delete_where(state.patch(added, edits, ["id"], ["note", "mastered"]), F.col("id") % 11 == 5)


@register("""SELECT event_id, ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' AS day FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01-0%'""")
def day_prefix(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.where(F.startswith("at", F.lit("2024-01-0"))).select("event_id", F.startswith("at", F.lit("2024-01-05")).alias("day"))


@register(f"""WITH {QUESTIONS} SELECT id, marks FROM q WHERE subject = 'en' AND (question ILIKE '%the%' OR topic ILIKE '%the%' OR command_term ILIKE '%the%' OR paper_type ILIKE '%the%')""")
def search_columns(spark, sf):
    return search.search(questions(spark, sf), subject="en", q="the", text_columns=("question", "topic", "command_term", "paper_type")).select("id", "marks")


@register("""WITH s AS (SELECT l_suppkey AS book, coalesce(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END, 'General') AS section, l_orderkey * 10 + l_linenumber AS o, l_partkey FROM lineitem)
SELECT book, section, count(*) AS n, md5(string_agg(l_partkey::VARCHAR, ',' ORDER BY o, l_partkey)) AS items FROM s GROUP BY 1, 2""")
def book_detail(spark, sf):
    i = table(spark, sf, "lineitem")
    s = F.coalesce(F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")), F.lit("General"))
    g = i.groupBy(F.col("l_suppkey").alias("book"), s.alias("section")).agg(F.sort_array(F.collect_list(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_partkey").alias("p")))).alias("x"))
    return g.select("book", "section", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.transform("x", lambda y: y["p"].cast("string")), ",").cast("binary")).alias("items"))


@register("""WITH p AS (SELECT l_orderkey AS paper, l_linenumber AS q, CASE WHEN l_partkey % 5 > 0 THEN l_quantity::BIGINT END AS marks FROM lineitem)
SELECT paper, count(*) AS n, sum(marks)::BIGINT AS total, min(marks) AS least, max(marks) AS most, coalesce(string_agg('no marks for ' || q, '; ' ORDER BY q) FILTER (marks IS NULL), '') AS warnings FROM p GROUP BY 1""")
def paper_report(spark, sf):
    m = F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity").cast("long"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("total"), F.min(m).alias("least"), F.max(m).alias("most"), F.sort_array(F.collect_list(F.when(m.isNull(), F.col("l_linenumber")))).alias("w"))
    return g.withColumn("warnings", F.array_join(F.transform("w", lambda q: F.concat(F.lit("no marks for "), q)), "; ")).drop("w")


@register("""SELECT c_custkey AS id, 'Customer#' || lpad(c_custkey::VARCHAR, 3, '0') AS code, md5(regexp_replace(regexp_replace(c_name || chr(10) || chr(10) || chr(10) || chr(10) || 'x ', '\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM customer""")
def built_codes(spark, sf):
    c = table(spark, sf, "customer")
    # a code longer than the padding is cut by the padding, in both engines
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 3, "0")).alias("code"), F.md5(text.collapse_newlines(F.concat("c_name", F.lit("\n\n\n\nx "))).cast("binary")).alias("cleaned"))

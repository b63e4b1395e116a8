"""Papers from lines to records on papers worked out by hand."""

from pyspark.sql import functions as F

from lectern.operators import papers


def paper(spark, docs):
    """doc -> (paper's pages, markscheme's pages), pages as lists of lines."""
    rows = []
    for doc, sides in docs.items():
        for side, pages in zip("qm", sides):
            pos = 0
            for page, ls in enumerate(pages):
                for x in ls:
                    rows.append((doc, side, page, pos, x, "clash"))
                    pos += 1
    return spark.createDataFrame(rows, "doc string, side string, page long, pos long, line string, text string")


Q = [["Instructions", "1. [Maximum mark: 5] Find x", "more", "2. State y [2]"], ["(a) part [3]", "1. not again"], ["3. Why? [1 mark]", None]]
M = [["1. decoy", "Question Answers Notes Total", "1. x = 5", "2. y"], ["3. because", "4. extra 1.5"]]


def test_walks_and_reasons(spark):
    m3 = [M[0], M[1][:1]]
    docs = {"good": (Q, m3), "none": (Q,), "less": ([Q[0]], m3), "few": (Q, [["1. a"]]), "other": (Q, [["nothing"]])}
    w = papers.paper_walks(paper(spark, docs), ["doc"], least=2, table=papers.TABLE)
    got = {r["doc"]: (r["n"], [(x["n"], x["pos"]) for x in r["questions"]], [(x["n"], x["pos"]) for x in r["answers"]], r["skip"]) for r in w.collect()}
    three = [(1, 1), (2, 3), (3, 6)]
    assert got == {"good": (3, three, [(1, 2), (2, 3), (3, 4)], None), "none": (3, three, [], "no markscheme"), "less": (3, three[:2], [(1, 2), (2, 3), (3, 4)], "questions missing"),
                   "few": (1, three[:1], [(1, 0)], "too few"), "other": (3, three, [], "answers missing")}
    assert {r["reason"]: r["papers"] for r in papers.skip_reasons(w).collect()} == {"taken": 1, "no markscheme": 1, "questions missing": 1, "too few": 1, "answers missing": 1}
    assert papers.paper_walks(paper(spark, docs), ["doc"], least=2, most=2).where("skip = 'too many'").count() == 3


def test_records_of_a_paper(spark):
    l = paper(spark, {"p": (Q, [M[0], M[1][:1]]), "bad": (Q,)})
    got = papers.paper_records(l, ["doc"], least=2, table=papers.TABLE).orderBy("number").collect()
    assert [(r["doc"], r["number"], r["marks"], r["command_term"], r["page"], r["last_page"], r["answer_page"], r["answer_last_page"]) for r in got] == [
        ("p", 1, 5, None, 0, 0, 0, 0), ("p", 2, None, "State", 0, 1, 0, 0), ("p", 3, 1, None, 2, 2, 1, 1)]
    assert [(r["question"], r["answer"]) for r in got] == [("1. [Maximum mark: 5] Find x\nmore", "1. x = 5"), ("2. State y [2]\n(a) part [3]\n1. not again", "2. y"), ("3. Why? [1 mark]\n", "3. because")]
    each = papers.paper_records(l, ["doc"], marks="each", least=2, table=papers.TABLE).orderBy("number")
    assert [r["marks"] for r in each.collect()] == [None, 5, None]
    assert papers.paper_records(l.limit(0), ["doc"]).count() == 0 and papers.paper_walks(l.limit(0), ["doc"]).count() == 0
    assert papers.paper_records(l.withColumn("number", F.lit(9)).withColumn("marks", F.lit(9)), ["doc"], least=2, table=papers.TABLE).count() == 3

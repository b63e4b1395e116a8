"""Periodic runs against a plain search of every period, and the query against a plain version of its contract."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import queries, runs
from lectern.llm.common import table


def plain(w, min_length=runs.MIN_LENGTH, exponent=runs.EXPONENT):
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(min_length, exponent * q):
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def found(texts, *limits):
    of, *rest = runs.maximal_runs([np.array(t, np.int64) for t in texts], *limits)
    return [[tuple(int(r[i]) for r in rest) for i in np.flatnonzero(of == k)] for k in range(len(texts))]


words = st.lists(st.integers(0, 3), max_size=70)
echo = st.builds(lambda head, body, times, tail: head + body * times + tail, st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=8))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(words, echo), min_size=1, max_size=5), st.sampled_from([(6, 4), (2, 2), (9, 3), (6, 5)]))
def test_runs_equal_a_search_of_every_period(texts, limits):
    assert found(texts, *limits) == [plain(t, *limits) for t in texts]


def test_long_periods_and_blocks_of_leaves(monkeypatch):
    rng = np.random.default_rng(5)
    text = [*rng.integers(0, 40, 3000).tolist(), *rng.integers(0, 40, 700).tolist() * 5, *[7] * 900, *[1, 2, 1, 3] * 300]
    want = plain(text)
    assert found([text])[0] == want and (3000, 3500, 700) in want
    monkeypatch.setattr(runs, "BLOCK", 64)
    assert found([text])[0] == want


def test_find_on_edge_rows(spark):
    long = "a b " * 100_000 + "c"
    data = [(1, "x y " * 4 + "z"), (1, "x y " * 4 + "z"), (2, None), (3, ""), (None, "n " * 6), (4, long), (5, "\t\n "), (6, "é é é é é é é é é é é é")]
    df = spark.createDataFrame(data, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("runs", "collapsed", "name", "best", "start")))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find(df).collect()]
    assert got[0] == got[1] == (1, [(0, 8, 2)], "x y z") and got[2] == (2, [], "") and got[3] == (3, [], "")
    assert got[4] == (None, [(0, 6, 1)], "n") and got[5] == (4, [(0, 200_000, 2)], "a b c") and got[6] == (5, [], "")
    assert got[7] == (6, [(0, 6, 1)], "é é")
    assert runs.report(df.limit(0)).count() == 0 and runs.report(df).count() == len(data)
    named = spark.createDataFrame([("k", "q q q q q q")], "key string, body string")
    assert runs.find(named, "key", "body").first()["runs"][0]["length"] == 6


def test_the_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in table(spark, sf, "documents").collect():
        w = (r["text"] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        every = plain(w)
        best = min(every, key=lambda r: (-r[1], r[0], r[2])) if every else (None,) * 3
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in every)]
        want[r["doc_id"]] = (len(every), *best, 1000 * best[1] // best[2] if every else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in every).encode()).hexdigest(),
                             hashlib.sha256(b" ".join(kept)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got == want and any(v[0] for v in want.values())

"""Near-duplicate links that only members of a bucket make, none of them its leader."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import minhash, vector


def _changed(words, at, tag):
    out = list(words)
    for k in at:
        out[k] = f"{tag}x{k}"
    return out


def _classes(texts):
    sets = minhash._sets(texts)
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if top(i) != top(j) and minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8 - 1e-9:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_a_text_tied_to_one_member_of_a_large_group_joins_it(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [_changed(base, [rng.randrange(5, 195)], f"c{k}") for k in range(240)]
    for k in range(20):
        a = _changed(base, [8 + k], f"a{k}")
        texts += [a, _changed(a, [40 + k, 85 + k, 130 + k, 170 + k], f"b{k}")]
    # like none, though they share most buckets with the group
    texts += [_changed(base, range(7, 195, 22 - k), f"d{k}") for k in range(6)]
    texts = [" ".join(t) for t in texts]
    want = _classes(texts)
    assert [want[k] for k in range(280)] == [0] * 280 and want[280:] == list(range(280, 286))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80), st.lists(st.integers(0, 60), min_size=1, max_size=80), st.integers(0, 3))
def test_the_bound_is_never_below_the_similarity(a, b, repeat):
    """p, q as in ``ceiling``, in plain Python, against the exact value."""
    b = b + a * repeat
    x, p = np.unique(vector.mix(np.array(a, np.uint64)), return_counts=True)
    y, q = np.unique(vector.mix(np.array(b, np.uint64)), return_counts=True)
    bits = minhash.sketches(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), 2).view(np.uint64)
    m = min((len(x) + len(y) - int(np.bitwise_count(bits[0] ^ bits[1]).sum())) // 2, len(x), len(y))
    assert m >= len(np.intersect1d(x, y))
    u, v = min(1, (m + p.sum() - len(x)) / p.sum()), min(1, (m + q.sum() - len(y)) / q.sum())
    assert minhash.probability_jaccard(x, p, y, q) <= (u * v / (u + v - u * v) if u + v else 0) + 1e-12


def test_the_bound_in_sql_equals_the_plain_one(spark):
    rng = np.random.default_rng(1)
    sizes, extra = rng.integers(512, 900, (60, 2)), rng.integers(0, 40, (60, 2))
    bits = rng.integers(-(2**63), 2**63 - 1, (60, 2, minhash.BITS // 64)) & rng.integers(-(2**63), 2**63 - 1, (60, 1, 1))
    t = "struct<size:long,extra:long,sketch:array<long>>"
    df = spark.createDataFrame([(k, *((int(sizes[k, i]), int(extra[k, i]), bits[k, i].tolist()) for i in (0, 1))) for k in range(60)], f"k long, a {t}, b {t}")
    for r in df.select("k", minhash.ceiling("a", "b").alias("j")).collect():
        (d1, d2), (e1, e2) = sizes[r["k"]].tolist(), extra[r["k"]].tolist()
        m = min((d1 + d2 - int(np.bitwise_count((bits[r["k"], 0] ^ bits[r["k"], 1]).view(np.uint64)).sum())) // 2, d1, d2)
        p, q = min(1, (m + e1) / (d1 + e1)), min(1, (m + e2) / (d2 + e2))
        assert (r["j"] or 0) == pytest.approx(p * q / (p + q - p * q) if p + q - p * q else 0)


def test_rows_are_told_apart_whatever_their_ids(spark):
    a, b, c = (" ".join(f"{t}{k}" for k in range(30)) for t in "abc")
    data = [("7", a), ("7", b), ("3", a), (None, a), (None, c), (None, c), ("1", ""), ("1", None), ("2", b + " more")]
    got = minhash.judge(spark.createDataFrame(data, "doc_id string, text string"))
    kept = sorted((r["doc_id"] or "", r["class_id"] or "") for r in got.where("kept").collect())
    assert kept == [("", ""), ("1", "1"), ("1", "1"), ("2", "2"), ("3", "3")]
    assert got.count() == 9 and got.where("class_id = '3'").count() == 3 and got.where("class_id = '2'").count() == 2


def test_classes_of_the_test_documents_equal_brute_force(spark):
    """Every pair of 1,000 documents; no link may be missing or made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = sorted(map(tuple, docs.collect()))
    first: dict[str, int] = {}
    for i, t in data:
        first.setdefault(t, i)
    want = dict(zip(first.values(), (list(first.values())[k] for k in _classes(list(first))), strict=True))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert got == {i: want[first[t]] for i, t in data}

"""The pipeline's stages on nulls, empty tables, repeated ids, ties, very long texts and clashing columns, and its run against a plain version."""

import hashlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import bpe, minhash, toxicity
from lectern.llm.common import table

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)
A, B, C = (" ".join(f"{t}{k}" for k in range(40)) for t in "abc")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, pairs):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in ("_row", "spans", "_text", "_may", "rejected", "kept", "row", "severity", "contaminated", "n_words", "_hits", "n_tokens")))


def kept(spark, stage, pairs):
    return sorted(((r["doc_id"], r["text"]) for r in STAGES[stage](spark, frame(spark, pairs), SF).collect()), key=repr)


def test_near_dedup_keeps_one_row_of_each_class_and_no_fewer(spark):
    near = "minhash near-dedup"
    assert kept(spark, near, [(7, A), (7, B), (3, A)]) == [(3, A), (7, B)]
    assert kept(spark, near, [(1, A), (1, A), (1, B), (2, C), (2, B + " more")]) == [(1, A), (1, B), (2, C)]
    assert kept(spark, near, [(3, A), (None, A), (None, B), (None, C), (None, C)]) == [(3, A), (None, B), (None, C)]
    assert kept(spark, near, [(1, None), (1, ""), (2, None), (None, "")]) == [(1, ""), (1, None), (2, None), (None, "")]
    long = A + " " + "and so on " * 60_000
    assert kept(spark, near, [(9, long), (4, long + "x"), (5, A)]) == sorted([(4, long + "x"), (5, A)], key=repr)


@pytest.mark.parametrize("stage", [n for n, _ in pipeline.STAGES])
def test_every_stage_takes_an_empty_table_and_returns_its_columns(spark, stage):
    out = STAGES[stage](spark, frame(spark, []), SF)
    assert out.count() == 0
    if stage != pipeline.STAGES[-1][0]:
        assert out.columns == pipeline.COLUMNS


def test_filters_keep_nulls_and_repeats(spark):
    rows = [(1, A), (1, A), (None, A), (2, None), (3, ""), (None, None)]
    want = sorted(rows, key=repr)
    for stage in ("toxicity", "benchmark decontamination", "secret scan"):
        assert kept(spark, stage, rows) == want


def test_decontamination_and_secrets_take_effect(spark):
    item = next(r["text"] for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) > 20)
    assert kept(spark, "benchmark decontamination", [(1, item), (1, A), (None, item), (None, B)]) == sorted([(1, A), (None, B)], key=repr)
    hidden = "x token: abcdef123 y"
    got = STAGES["secret scan"](spark, frame(spark, [(1, hidden), (None, hidden), (1, A)]), SF).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == sorted([("x [SECRET] y", 12)] * 2 + [(A, len(A))])


def test_byte_pairs_of_nulls_and_long_texts(spark):
    got = {r["doc_id"]: r for r in STAGES["byte-level bpe"](spark, frame(spark, [(1, None), (2, ""), (3, "ab " * 400_000)]), SF).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["decoded_sha256"] == hashlib.sha256(b"ab " * 400_000).hexdigest()


def test_the_run_equals_a_plain_one(spark):
    """Each stage anew in plain Python; only the toxicity model is taken as fitted."""
    import re

    docs = [r.asDict() for r in table(spark, SF, "documents").select(*pipeline.COLUMNS).collect()]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({k: k + 32 for k in range(65, 91)})) if w]
    from lectern.llm import vector

    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))

    def clean(t):
        if not len(model.thetas):
            return True
        h, n = np.unique(vector.words(pa.array([t])).hashes, return_counts=True)
        score = sum(weight.get(x, 0) * np.log1p(c) for x, c in zip(h.tolist(), n.tolist(), strict=True))
        return 1 / (1 + np.exp(model.thetas[0] - score)) < toxicity.REJECT_AT

    docs = [d for d in docs if clean(d["text"])]
    sets = minhash._sets([d["text"] for d in docs])
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if words(docs[i]["text"]) and words(docs[j]["text"]) and find(i) != find(j) and minhash.probability_jaccard(*sets[i], *sets[j]) >= minhash.AT_LEAST:
                root[find(i)] = find(j)
    least: dict = {}
    for k, d in enumerate(docs):
        least.setdefault(find(k), []).append(d["doc_id"])
    docs = [d for k, d in enumerate(docs) if d["doc_id"] == min(least[find(k)])]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    sizes = {len(w) for w in windows}

    def dirty(t):
        w = words(t)
        hit = {p for m in sizes for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows for p in range(k, k + m)}
        return hit and 20 * len(hit) >= len(w)

    docs = [d for d in docs if not dirty(d["text"])]
    from lectern.llm import secret_scan

    def redacted(t):
        spans = sorted((m.start(), m.end()) for r in secret_scan.RULES for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.min_chars)
        out, at = [], 0
        for a, b in spans:
            if a >= at and (a > at or not out):
                out += [t[at:a], secret_scan.MARK]
            at = max(at, b)
        return "".join(out) + t[at:]

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    want = set()
    for d in docs:
        t = redacted(d["text"])
        ids = coder.encode_ordinary(t)
        want.add((d["doc_id"], len(t) if t != d["text"] else d["n_chars"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want

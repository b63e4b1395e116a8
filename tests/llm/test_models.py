"""Quality resampling and toxicity against plain versions of their formulas."""

import math
import random

import numpy as np
import pyarrow as pa

from lectern.llm import quality_classifier, toxicity, vector


def test_weights_keys_and_draw_equal_plain_counts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words[: 20 + k], k=rng.randint(0, 30)))) for k in range(40)] + [(50, None), (51, ""), (3, "w1 w2 w1")]
    labels = [(k, 1) for k in range(0, 40, 3)] + [(1, 0), (None, 1), (3, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = quality_classifier.resample(d, spark.createDataFrame(labels, "doc_id long, quality int"), fraction=0.6).collect()
    good = {i for i, q in labels if q == 1}
    grams = [(i, quality_classifier.buckets(pa.array([t or ""]))[0].tolist()) for i, t in docs]
    raw, target = [1] * quality_classifier.BUCKETS, [1] * quality_classifier.BUCKETS
    for i, g in grams:
        for b in g:
            raw[b] += 1
            target[b] += i in good
    ratio = [math.log(t / sum(target)) - math.log(r / sum(raw)) for r, t in zip(raw, target, strict=True)]
    want = sorted((i, len(g), round(sum(ratio[b] for b in g), 6)) for i, g in grams)
    assert sorted((r["doc_id"], r["n_grams"], round(r["log_weight"], 6)) for r in out) == want
    ranked = sorted((r["key"] for r in out), reverse=True)
    cut = ranked[math.ceil(0.6 * len(out)) - 1]
    assert all(r["kept"] == (r["key"] >= cut) for r in out) and sum(r["kept"] for r in out) >= math.ceil(0.6 * len(out))


def test_ties_with_the_last_key_are_drawn_together(spark):
    docs = spark.createDataFrame([(5, "same words here")] * 6 + [(9, "other")] * 2, "doc_id long, text string")
    out = quality_classifier.resample(docs, spark.createDataFrame([(5, 1)], "doc_id long, quality int"), fraction=0.3).collect()
    assert sum(r["kept"] for r in out) in (2, 6, 8) and len({r["kept"] for r in out if r["doc_id"] == 5}) == 1


def penalised(x, y, w, theta):
    """The negative log likelihood and its penalty, a document at a time."""
    edge = [-math.inf, *theta, math.inf]
    sigmoid = lambda z: 1.0 if z == math.inf else 0.0 if z == -math.inf else 1 / (1 + math.exp(-z))
    total = toxicity.L2 * float(w @ w)
    for row, grade in zip(x, y, strict=True):
        s = float(row @ w)
        total -= math.log(sigmoid(edge[grade + 1] - s) - sigmoid(edge[grade] - s))
    return total


def test_the_fit_is_the_optimum_of_the_plain_likelihood():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = np.digitize(x @ [1.5, -1.0, 0.4, 0.0] + rng.logistic(size=300), [0.0, 1.0, 2.0])
    w, theta = toxicity.fit_ordinal(x, y)
    at = penalised(x, y, w, theta)
    for k in range(7):
        for step in (1e-4, -1e-4):
            v = np.concatenate((w, theta))
            v[k] += step
            assert penalised(x, y, v[:4], v[4:]) >= at - 1e-7
    gradient = []
    for k in range(7):
        up, down = (np.concatenate((w, theta)) for _ in "ab")
        up[k] += 1e-5
        down[k] -= 1e-5
        gradient.append((penalised(x, y, up[:4], up[4:]) - penalised(x, y, down[:4], down[4:])) / 2e-5)
    assert np.abs(gradient).max() < 0.05


def test_severity_is_the_sum_of_the_grades_chances(spark):
    texts = ["vile vile day", "day and night", "", None, "Vile! nasty NASTY nasty", "long " * 5000 + "nasty"]
    hashes = vector.words(pa.array(["vile nasty day"])).hashes
    order = np.argsort(hashes)
    model = toxicity.Model(hashes[order], np.array([1.2, 0.7, -0.4])[order], np.array([0.5, 1.5, 2.5]))
    got = {r["doc_id"]: r for r in toxicity.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        words = (t or "").lower().replace("!", "").split()
        score = sum(w * math.log1p(words.count(x)) for x, w in (("vile", 1.2), ("nasty", 0.7), ("day", -0.4)))
        chance = [1 / (1 + math.exp(c - score)) for c in (0.5, 1.5, 2.5)]
        assert math.isclose(got[k]["severity"], sum(chance)) and math.isclose(got[k]["p_toxic"], chance[0]) and got[k]["rejected"] == (chance[0] >= toxicity.REJECT_AT)


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELS", 50)
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(400)] + [(2, "other")], "doc_id long, text string")
    assert toxicity.sample(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() == 50

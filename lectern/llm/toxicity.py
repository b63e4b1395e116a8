"""Toxicity by cumulative-link ordinal regression.

Labels say only toxic or not, so severity grades are made from the text: toxic
documents are graded 1 to 3 by tertiles of how much they say in words that point
to toxicity in the labelled sample, sum of log(1 + count); others have grade 0. The model is

    P(grade <= k) = sigmoid(theta_k - w.x),  theta_1 < theta_2 < theta_3,

with one weight vector for all thresholds and x = log(1 + count) of the chosen
words. Output is the expected severity, sum over k >= 1 of P(grade >= k).

The model is fitted on :data:`MAX_LABELS` rows of labelled documents at most
(those whose hashed id is smallest, however many rows bear an id); words are chosen by the G squared of their counts. It is
a few kilobytes, which is all that is broadcast. Scoring is one pass.

Defined results: null or empty text has no words and the severity of a text
without a chosen word; repeated rows are scored one by one; labels that repeat
an id count as toxic if one does; null labels are left out; without labels of
both kinds the severity is 0 everywhere; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import vector
from lectern.llm.common import durable, rows

MAX_LABELS, MAX_WORDS, MIN_DOCS, MIN_G2, MIN_SHARE, MIN_PURITY = 8000, 512, 5, 25.0, 0.01, 0.75
GRADES = 3
L2 = 0.01
#: Documents at or above this probability of any severity are rejected.
REJECT_AT = 0.5


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thetas: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """(texts, grades): P(grade >= k) for k = 1..; zeros without a fit."""
        if not len(self.thetas):
            return np.zeros((len(score), GRADES))
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -60, 60)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in vector.slices(batches, 0):
        w = vector.words(batch.column(0))
        hashes, counts = [], []
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            h, c = np.unique(w.hashes[a:b].view(np.int64), return_counts=True)
            hashes.append(h)
            counts.append(c)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
            ["toxic", "words", "counts"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(toxic, words, counts) of a bounded number of labelled documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # MAX_LABELS rows at most: bounded by the limit
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS).withColumnRenamed("doc_id", "_id")
    t = rows(docs, id_col, text_col)
    t = t.join(F.broadcast(few), t["doc_id"] == few["_id"])
    # ids that several rows bear may make more of them, so the rows are bounded as well
    t = t.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(MAX_LABELS).select("text", "toxic")
    return durable(t.mapInArrow(_counted, "toxic int, words array<long>, counts array<long>"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    s = sample(docs, labels, id_col, text_col)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    n1, n = (lambda r: (r[0] or 0, r[1]))(s.agg(F.sum("toxic"), F.count(F.lit(1))).first())
    if not 0 < n1 < n:
        return none
    each = s.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("d"))
    # G squared of the word's two-by-two table; the sign says which side it points to
    a, b = F.col("p").cast("double"), (F.col("d") - F.col("p")).cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    d, share = F.col("d").cast("double"), n1 / n
    g2 = 2 * (part(a, d * share) + part(b, d * (1 - share)) + part(n1 - a, (n - d) * share) + part(n - n1 - b, (n - d) * (1 - share)))
    scored = each.where(F.col("d") >= MIN_DOCS).select("w", "p", "d", g2.alias("g2"), (a > d * share).alias("ill"))
    # words of a few copied documents, or of clean documents as well, point to nothing
    wide = ~F.col("ill") | ((F.col("p") >= MIN_SHARE * n1) & (F.col("p") >= MIN_PURITY * F.col("d")))
    top = scored.where((F.col("g2") >= MIN_G2) & wide).orderBy(F.desc("g2"), "w").limit(MAX_WORDS).collect()
    if not top:
        return none
    order = np.argsort(np.array([r["w"] for r in top], np.int64).view(np.uint64))
    chosen = np.array([r["w"] for r in top], np.int64)[order]
    ill = np.array([r["ill"] for r in top])[order]
    kept = F.filter(F.arrays_zip("words", "counts"), lambda x: x["words"].isin(chosen.tolist()))
    data = s.select("toxic", kept.alias("x")).collect()
    place = {w: k for k, w in enumerate(chosen.tolist())}
    x, y, told = np.zeros((len(data), len(chosen))), np.zeros(len(data), int), np.zeros(len(data))
    for i, r in enumerate(data):
        for f in r["x"]:
            x[i, place[f["words"]]] = np.log1p(f["counts"])
            told[i] += np.log1p(f["counts"]) * ill[place[f["words"]]]
        y[i] = r["toxic"]
    shown = told[(y == 1) & (told > 0)]
    cuts = np.quantile(shown, [k / GRADES for k in range(1, GRADES)]) if len(shown) else np.zeros(GRADES - 1)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, told, "left"), 0)
    w, thetas = fit_ordinal(x, grade)
    return Model(chosen.view(np.uint64), w, thetas)


def fit_ordinal(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by BFGS. Gaps between thresholds are kept as logarithms."""
    m = x.shape[1]
    v = np.concatenate((np.zeros(m), [1.0], np.full(GRADES - 1, -1.0)))

    def loss(v):
        w, gaps = v[:m], np.exp(np.clip(v[m + 1 :], -20, 20))
        theta = v[m] + np.concatenate(([0], np.cumsum(gaps)))
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        s = x @ w
        up, down = (1 / (1 + np.exp(-np.clip(edge[y + k] - s, -60, 60))) for k in (1, 0))
        prob = np.maximum(up - down, 1e-12)
        g_up, g_down = up * (1 - up) / prob, down * (1 - down) / prob
        by_theta = np.zeros(GRADES + 2)
        np.add.at(by_theta, y + 1, -g_up)
        np.add.at(by_theta, y, g_down)
        t = by_theta[1:-1]
        grad = np.concatenate((x.T @ (g_up - g_down) + 2 * L2 * w, [t.sum()], [t[k + 1 :].sum() * gaps[k] for k in range(GRADES - 1)]))
        return -np.log(prob).sum() + L2 * (w @ w), grad

    h = np.eye(len(v)) * 0.01
    f, g = loss(v)
    for _ in range(steps):
        d = -h @ g
        if d @ g > -1e-12:
            break
        t = 1.0
        while t > 1e-10:
            f2, g2 = loss(v + t * d)
            if f2 <= f + 1e-4 * t * (d @ g):
                break
            t /= 2
        else:
            break
        s, yk = t * d, g2 - g
        v, drop, f, g = v + s, f - f2, f2, g2
        r = s @ yk
        if r > 1e-12:
            hy = h @ yk
            h += np.outer(s, s) * ((r + yk @ hy) / r**2) - (np.outer(hy, s) + np.outer(s, hy)) / r
        if drop < 1e-9 * max(1.0, abs(f)):
            break
    return v[:m], v[m] + np.concatenate(([0], np.cumsum(np.exp(np.clip(v[m + 1 :], -20, 20)))))


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` and, per row, severity (expected), p_toxic and rejected; columns of these names are replaced."""
    added = {"severity": "double", "p_toxic": "double", "rejected": "boolean"}
    keep = [c for c in docs.columns if c not in added]
    schema = docs.select(*(docs[c] for c in keep), *(F.lit(None).cast(t).alias(n) for n, t in added.items())).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = np.zeros(1 << 16, bool)
        slots[m.words & np.uint64(0xFFFF)] = True
        for batch in vector.slices(batches, at):
            w = vector.words(batch.column(at))
            score = np.zeros(batch.num_rows)
            near = np.flatnonzero(slots[w.hashes & np.uint64(0xFFFF)])
            if len(near):
                k = np.searchsorted(m.words, w.hashes[near])
                k[k == len(m.words)] = 0
                real = m.words[k] == w.hashes[near]
                text = np.searchsorted(w.bounds, near[real], "right") - 1
                pair, n = np.unique(text * len(m.words) + k[real], return_counts=True)
                np.add.at(score, pair // len(m.words), m.weights[pair % len(m.words)] * np.log1p(n))
            p = m.at_least(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= REJECT_AT)], [*keep, *added])

    return docs.select(*(docs[c] for c in keep)).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Severity of every document under the model fitted on ``labels``."""
    return annotate(rows(docs), fit(docs, labels)).drop("text")

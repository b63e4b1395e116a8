"""Order-dependent text matching that no expression can state: one Arrow batch or one document at a time."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import matching


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def best_window(needle: str, hay: str, start: int = 0, window: int | None = 14_000, step: int = 8, refine: int = 0) -> tuple[int, float]:
    """Start and ratio of the stretch of ``hay`` most like ``needle`` (window None: to its end); with ``refine``, finer steps around the best one."""
    end = len(hay) if window is None else min(len(hay), start + window)
    match = difflib.SequenceMatcher(None, autojunk=False)
    match.set_seq2(needle)

    def score(i: int) -> float:
        match.set_seq1(hay[i : i + len(needle)])
        return match.ratio()

    places = range(start, max(start, end - len(needle)) + 1, step)
    best = max(((score(i), -i) for i in places), default=(0.0, 0))
    if refine:
        at = -best[1]
        best = max([best, *((score(i), -i) for i in range(max(start, at - step), min(at + step, end) + 1, refine))])
    return -best[1], best[0]


def fuzzy_locate(pairs: DataFrame, least: float = 0.3, window: int | None = 14_000, step: int = 8, refine: int = 0) -> DataFrame:
    """``pairs`` (key, needle, hay) -> (key, found_at, score); found_at is null below ``least``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [best_window(n or "", h or "", 0, window, step, refine) for n, h in zip(pdf["needle"], pdf["hay"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "found_at": pd.array([g[0] if g[1] >= least else None for g in got], "Int64"), "score": [round(g[1], 6) for g in got]})

    return pairs.select("key", "needle", "hay").mapInPandas(run, "key long, found_at long, score double")


def similarities(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The ratio of each element of ``a`` with each of ``b``."""
    return matching.ratios([x for x in a for _ in b], [*b] * len(a)).reshape(len(a), len(b))


def align(a: Sequence[str], b: Sequence[str], gap: float) -> list[tuple[int, int]]:
    """Monotone alignment of greatest total similarity less ``gap`` for every element left out."""
    return best_path(similarities(a, b), gap)


def greedy(a: Sequence[str], b: Sequence[str], least: float) -> list[tuple[int, int]]:
    """Each element of ``a`` in turn takes the most similar later unused one of ``b``, if similar enough."""
    return taken_in_turn(similarities(a, b), least)


def best_path(score: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """:func:`align` by the similarities there are."""
    n, m = score.shape
    s = score.tolist()
    best = [[-gap * j if j else 0.0 for j in range(m + 1)]]
    for i in range(1, n + 1):
        above, row = best[-1], [-gap * i]
        for j in range(1, m + 1):
            row.append(max(above[j - 1] + s[i - 1][j - 1], above[j] - gap, row[j - 1] - gap))
        best.append(row)
    out, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j - 1] + s[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i - 1][j] - gap:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def taken_in_turn(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """:func:`greedy` by the similarities there are."""
    out, after = [], 0
    for i, row in enumerate(score):
        if after == len(row):
            break
        j = after + int(row[after:].argmax())
        if row[j] >= least:
            out.append((i, j))
            after = j + 1
    return out


#: Pairs that one row of work holds, about.
PAIRS = 512


def aligned(docs: DataFrame, gap: float = 0.3, method: str = "global", least: float = 0.3, tasks: int = 64) -> DataFrame:
    """``docs`` (doc, left array, right array) -> (doc, left_pos, right_pos, score).

    A document's pairs are compared by blocks of its left elements, dealt to ``tasks`` tasks, so a long one is many rows; only numbers
    come together again.
    """
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                left, right = ([y or "" for y in x] for x in (left, right))
                out.append(similarities(left, right).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["doc", "block", "scores"])

    def pairs(table: pa.Table) -> pa.Table:
        score = np.array([row for some in table.sort_by("block")["scores"].to_pylist() for row in some])
        got = best_path(score, gap) if method == "global" else taken_in_turn(score, least)
        i, j = ([p[k] for p in got] for k in range(2))
        return pa.table({"doc": pa.array([table["doc"][0].as_py()] * len(got), pa.int64()), "left_pos": pa.array(i, pa.int64()), "right_pos": pa.array(j, pa.int64()),
                         "score": pa.array([round(float(score[p]), 6) for p in got], pa.float64())})

    step = F.greatest(F.lit(1), F.floor(F.lit(PAIRS) / F.size("right"))).cast("int")
    some = docs.where("size(left) > 0 and size(right) > 0").select("doc", "left", "right", step.alias("step"))
    blocks = some.select("doc", F.explode(F.sequence(F.lit(0), F.floor((F.size("left") - 1) / F.col("step")).cast("int"))).alias("block"), "left", "right", "step")
    blocks = blocks.select("doc", "block", F.slice("left", F.col("block") * F.col("step") + 1, F.col("step")).alias("left"), "right").repartition(tasks, "doc", "block")
    told = blocks.mapInArrow(scores, "doc long, block int, scores array<array<double>>")
    return told.groupBy("doc").applyInArrow(pairs, "doc long, left_pos long, right_pos long, score double")


def clusters(boxes: Sequence[tuple[float, float, float, float]], pad: float) -> list[int]:
    """Single linkage of padded boxes that touch, grown boxes included: the number of its first box per box.

    A box is added to clusters that don't touch each other and takes in those it touches, until it touches none; the
    outcome is the same in any order, and each box is compared with each cluster there is.
    """
    apart: list[tuple[list[float], list[int]]] = []
    for k, box in enumerate(boxes):
        area, mine = list(box), [k]
        while True:
            near = [p[0] - pad <= area[2] and area[0] - pad <= p[2] and p[1] - pad <= area[3] and area[1] - pad <= p[3] for p, _ in apart]
            if not any(near):
                break
            for (p, ids), touches in zip(apart, near, strict=True):
                if touches:
                    area = [min(area[0], p[0]), min(area[1], p[1]), max(area[2], p[2]), max(area[3], p[3])]
                    mine += ids
            apart = [c for c, touches in zip(apart, near, strict=True) if not touches]
        apart.append((area, mine))
    label = [0] * len(boxes)
    for _, mine in apart:
        for k in mine:
            label[k] = min(mine)
    return label


def bbox_clusters(pages: DataFrame, pad: float = 4.0) -> DataFrame:
    """``pages`` (page, boxes array<struct<x0,y0,x1,y1>>) -> (page, n, x0, y0, x1, y1) per cluster."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, boxes in zip(pdf["page"], pdf["boxes"], strict=True):
                b = [(x["x0"], x["y0"], x["x1"], x["y1"]) for x in boxes]
                label = clusters(b, pad)
                for k in sorted(set(label)):
                    mine = [x for x, j in zip(b, label, strict=True) if j == k]
                    out.append((page, len(mine), min(x[0] for x in mine), min(x[1] for x in mine), max(x[2] for x in mine), max(x[3] for x in mine)))
            yield pd.DataFrame(out, columns=["page", "n", "x0", "y0", "x1", "y1"])

    return pages.select("page", "boxes").mapInPandas(run, "page long, n long, x0 double, y0 double, x1 double, y1 double")


def parse_blocks(lines: Sequence[str], question: str = r"^\d{1,2}[.)]", answer: str = r"(?i)^ans(wer)?\b") -> list[tuple[int, str, str]]:
    """State machine over lines: (number of block, part, text). Text before the first question is dropped."""
    import re

    q, a = re.compile(question), re.compile(answer)
    out: list[tuple[int, str, list[str]]] = []
    block, part = 0, ""
    for line in lines:
        if q.match(line):
            block, part = block + 1, "question"
            out.append((block, part, [line]))
        elif block and a.match(line):
            part = "answer"
            out.append((block, part, [line]))
        elif block and not line.strip() and part == "answer":
            part = "explanation"
            out.append((block, part, []))
        elif block:
            out[-1][2].append(line)
    return [(b, p, "\n".join(t)) for b, p, t in out]


def line_blocks(docs: DataFrame, question: str = r"^\d{1,2}[.)]", answer: str = r"(?i)^ans(wer)?\b") -> DataFrame:
    """``docs`` (doc, text) -> (doc, block, part, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, *x) for d, t in zip(pdf["doc"], pdf["text"], strict=True) for x in parse_blocks((t or "").split("\n"), question, answer)]
            yield pd.DataFrame(out, columns=["doc", "block", "part", "content"])

    return docs.select("doc", "text").mapInPandas(run, "doc long, block long, part string, content string")


def seeded_locate(needle: str, hay: str, start: int = 0, seed: int = 20, least: float = 0.5) -> int | None:
    """Exact seeds from the needle's head, tail and middle propose places; the most similar one counts if alike enough."""
    n = len(needle)
    places = set()
    for off in {0, max(0, n - seed), max(0, (n - seed) // 2)}:
        at = hay.find(needle[off : off + seed], start)
        while at >= 0:
            places.add(max(start, at - off))
            at = hay.find(needle[off : off + seed], at + 1)
    best = max(((ratio(needle, hay[p : p + n]), -p) for p in places), default=(0.0, 0))
    return -best[1] if best[0] > least else None


def seeded_places(pairs: DataFrame, seed: int = 20, least: float = 0.5) -> DataFrame:
    """``pairs`` (key, needle, hay) -> (key, found_at) by :func:`seeded_locate`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [seeded_locate(n or "", h or "", 0, seed, least) for n, h in zip(pdf["needle"], pdf["hay"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "found_at": pd.array(got, "Int64")})

    return pairs.select("key", "needle", "hay").mapInPandas(run, "key long, found_at long")

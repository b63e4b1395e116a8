"""Periodic runs of words: what a text says over and over, found in its suffix tree.

A run is a stretch of words with smallest period q (words q apart are equal) and
at least ``exponent`` periods and ``min_length`` words, that no neighbouring word
extends. The method is Stoye and Gusfield's:

1. Suffixes of a text's words are sorted by prefix doubling; the ranks of every
   doubling are kept and tell whether any two stretches are equal. Neighbours'
   common prefixes give the nodes of the suffix tree (nearest smaller values).
2. At a node of depth D the leaves of the smaller half are gone through: a leaf i
   whose partner i + D or i - D lies in the other half starts (or is the second
   half of) a branching tandem repeat of half length D, one that the next word
   doesn't carry on. Every leaf is looked at O(log n) times in all.
3. Repeats with enough copies to their left are rotated to the left as far as
   words stay equal, by doubling steps. That gives the maximal stretch of period
   D; those of one stretch are merged, and the smallest D is its period.

A word of a run stands in the text at least ``exponent`` times, so rarer words
get codes of their own beforehand: no run is lost, and the tree is smaller. Words
are coded by equality of their bytes, never by hash. All steps are array
operations over many texts at once; a worker holds the texts of one part (2 MB,
or one longer text) and O(n log n) ranks of it.

Defined results: words are runs of bytes other than space and \\t to \\r; a null
or empty text has no words, no run and an empty collapsed text; repeated rows
and null ids are worked on one by one; a very long text is one row, worked on
whole; of runs that tie nothing is dropped, they come by (start, period); an
empty table gives an empty table; columns other than id and text are not read,
so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import vector
from lectern.llm.common import rows

MIN_LENGTH, EXPONENT = 6, 4
#: Leaves gone through at once.
BLOCK = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _first(new: np.ndarray) -> np.ndarray:
    """Of each place the last one at or before it that is marked."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def doubled_ranks(code: np.ndarray, end: np.ndarray, reach: int) -> list[np.ndarray]:
    """ranks[k][i] == ranks[k][j] if and only if the 2 ** k words from i and from j are equal; up to 2 ** k > reach.

    ``code`` tells words (and texts) apart, ``end`` is where each word's text ends. Rows are padded by one place.
    """
    n = len(code)
    sizes = np.bincount(code)
    rank = np.append((np.cumsum(sizes) - sizes)[code], n)
    ranks = [rank.astype(np.int32)]
    live, step = np.flatnonzero(sizes[code] > 1), 1
    while step <= reach:
        if len(live):
            after = live + step
            key = rank[live] * (n + 2) + np.where(after < end[live], rank[np.minimum(after, n)] + 1, 0)
            by = np.argsort(key)
            live, key = live[by], key[by]
            old = rank[live]
            new = np.append(True, key[1:] != key[:-1])
            start = _first(new)
            rank[live] = old + start - _first(np.append(True, old[1:] != old[:-1]))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(live)))
            live = live[np.repeat(count, count) > 1]
            ranks.append(rank.astype(np.int32))
        else:
            ranks.append(ranks[-1])
        step *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, exact below 2 ** len(ranks)."""
    a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
        size += same
        a += same
        b += same
        # what runs past the last text meets nothing there
        np.minimum(a, len(ranks[k]) - 1, out=a)
        np.minimum(b, len(ranks[k]) - 1, out=b)
    return size


def _smaller(depth: np.ndarray, over: Callable) -> np.ndarray:
    """For each place the nearest one before it whose depth isn't ``over`` its own, by pointer jumping; place 0 has depth -1."""
    to = np.arange(-1, len(depth) - 1)
    live = np.arange(1, len(depth))
    while len(live):
        live = live[over(depth[to[live]], depth[live])]
        to[live] = to[to[live]]
    return to


def tree_nodes(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary nodes of the suffix tree: node t parts the sorted suffixes lo[t] to t - 1 from t to hi[t] - 1.

    ``depth[t]`` is the common prefix of suffixes t - 1 and t, at least 0. A node of many children is a chain of such nodes.
    """
    padded = np.concatenate(([-1], depth))
    lo = np.maximum(_smaller(padded, np.greater_equal)[1:] - 1, 0)
    back = _smaller(np.concatenate(([-1], depth[::-1])), np.greater)[1:]
    hi = len(depth) - back[::-1]
    return lo, hi


def branching_repeats(order: np.ndarray, depth: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(end, half length) of the branching tandem repeats at the given nodes, in blocks.

    ``order`` has the sorted suffixes; nodes come as (t, lo, hi) with their depth.
    """
    at = np.full(n + 1, -1)
    at[order] = np.arange(len(order))
    nodes = np.flatnonzero(depth > 0)
    left = nodes - lo[nodes] <= hi[nodes] - nodes
    begin = np.where(left, lo[nodes], nodes)
    size = np.where(left, nodes - lo[nodes], hi[nodes] - nodes)
    other, until = np.where(left, nodes, lo[nodes]), np.where(left, hi[nodes], nodes)
    ends = np.cumsum(size)
    cut = 0
    while cut < len(nodes):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + BLOCK, "right")))
        some = slice(cut, stop)
        of = np.repeat(np.arange(cut, stop), size[some])
        leaf = order[np.repeat(begin[some] - np.append(0, np.cumsum(size[some])[:-1]), size[some]) + np.arange(len(of))]
        half = depth[nodes[of]]
        for partner, end in ((leaf + half, leaf + 2 * half), (leaf - half, leaf + half)):
            inside = (partner >= 0) & (partner <= n)
            place = at[np.where(inside, partner, n)]
            found = (place >= other[of]) & (place < until[of])
            yield end[found], half[found]
        cut = stop


def maximal_runs(codes: list[np.ndarray], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of the texts, whose words come as codes from 0; by text, start, period."""
    sizes = np.array([len(c) for c in codes], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    none = (np.zeros(0, np.int64),) * 4
    n = int(bounds[-1])
    shortest = max(min_length, exponent)
    if not n or sizes.max() < shortest:
        return none
    kinds = np.array([int(c.max()) + 1 if len(c) else 0 for c in codes], np.int64)
    code = np.concatenate(codes).astype(np.int64) + np.repeat(np.cumsum(kinds) - kinds, sizes)
    often = np.bincount(code)[code] >= exponent
    code[~often] = int(kinds.sum()) + np.arange(n - int(often.sum()))
    code = np.unique(code, return_inverse=True)[1]
    text = np.repeat(np.arange(len(codes)), sizes)
    begin, end = bounds[:-1][text], bounds[1:][text]
    ranks = doubled_ranks(code, end, int(sizes.max()) // exponent)
    live = np.flatnonzero(often)
    if not len(live):
        return none
    order = live[np.argsort(ranks[-1][live], kind="stable")]
    depth = np.zeros(len(order), np.int64)
    near = 1 + np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    depth[near] = common_prefixes(ranks, order[near - 1], order[near])
    lo, hi = tree_nodes(depth)
    wanted = np.where(depth * exponent <= sizes[text[order]], depth, 0)
    found: list[list[np.ndarray]] = [[], []]
    for stop, half in branching_repeats(order, wanted, lo, hi, n):
        # enough words before the end, and each copy equal to the next one: two overlapping blocks tell
        inside = stop - exponent * half >= begin[stop - 1]
        stop, half = stop[inside], half[inside]
        k = np.frexp(half.astype(np.float64))[1] - 1
        for copy in range(exponent, 2, -1):
            if not len(stop):
                break
            a = stop - copy * half
            over = half - (1 << k)
            same = np.zeros(len(stop), bool)
            for level in np.unique(k):
                on = np.flatnonzero(k == level)
                r, x, d = ranks[level], a[on], half[on]
                same[on] = (r[x] == r[x + d]) & (r[x + over[on]] == r[x + over[on] + d])
            stop, half, k = stop[same], half[same], k[same]
        found[0].append(stop)
        found[1].append(half)
    stop, half = np.concatenate(found[0] or [none[0]]), np.concatenate(found[1] or [none[0]])
    start = _rotated(ranks, stop - exponent * half, half, begin[stop - 1] if len(stop) else stop)
    long = stop - start >= min_length
    start, stop, half = start[long], stop[long], half[long]
    by = np.lexsort((half, stop, start))
    start, stop, half = start[by], stop[by], half[by]
    first = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(start)]
    start, stop, half = start[first], stop[first], half[first]
    by = np.lexsort((half, start))
    start, stop, half = start[by], stop[by], half[by]
    of = text[start]
    return of, start - bounds[of], stop - start, half


def _rotated(ranks: list[np.ndarray], start: np.ndarray, half: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The furthest place to the left from which on words ``half`` apart are still equal."""
    start = start.copy()
    for k in range(len(ranks) - 1, -1, -1):
        live = np.arange(len(start))
        while len(live):  # more than one step on the topmost level only
            to = start[live] - (1 << k)
            ok = to >= begin[live]
            live, to = live[ok], to[ok]
            ok = ranks[k][to] == ranks[k][to + half[live]]
            live = live[ok]
            start[live] = to[ok]
    return start


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] > 0


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT,
         rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, runs (by start, period) and collapsed, the words that no run repeats, joined by one space.

    ``rewrite`` may change the words of a text before, by (id as a string, words).
    """
    if exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    src = rows(df, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    src = src.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vector.slices(batches, 2):
            words = [t.as_buffer().to_pybytes().split() for t in part.column(2).cast(pa.large_binary())]
            if rewrite is not None:
                words = [rewrite(name, w) for name, w in zip(part.column(1).to_pylist(), words, strict=True)]
            codes = []
            for w in words:
                index = {x: k for k, x in enumerate(dict.fromkeys(w))}
                codes.append(np.fromiter(map(index.__getitem__, w), np.int64, len(w)))
            text, *runs = maximal_runs(codes, min_length, exponent)
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            out = []
            for k, w in enumerate(words):
                a, b = bounds[k], bounds[k + 1]
                if a < b:
                    w = [w[i] for i in np.flatnonzero(~dropped(len(w), *(r[a:b] for r in runs)))]
                out.append(b" ".join(w))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(r) for r in runs], fields=list(_RUN.value_type)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(out, pa.binary())], ["doc_id", "runs", "collapsed"])

    found = src.mapInArrow(run, f"doc_id {id_type}, runs {RUNS}, collapsed binary")
    return found.select("doc_id", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """:func:`find` as n_runs, the longest run (ties: smallest start, then period; null where there is none) and digests."""
    found = find(df, id_col, text_col, **options)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

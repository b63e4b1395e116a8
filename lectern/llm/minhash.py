"""Near-duplicate classes by ProbMinHash.

Shingles are runs of five words weighted by how often a text holds them; the
similarity is the probability Jaccard of the two weight distributions,

    J(P, Q) = sum over x in both of 1 / sum_z max(P(z) / P(x), Q(z) / Q(x)),

which is the set Jaccard where no shingle repeats.

1. Texts of equal words collapse to one representative. A group of copies,
   however large, is one row from here on.
2. A signature has :data:`BANDS` x :data:`ROWS` registers. Every shingle sends
   arrivals of a Poisson process with rate its weight; each arrival picks a
   register, a register keeps its earliest. A shingle stops as soon as its next
   arrival is later than all of the text's registers (early termination).
   Registers agree with probability J.
3. Representatives that agree in a band meet in a bucket. Each bucket's leader,
   the member that meets most others, is verified against all its members by
   exact J, so a bucket of n like texts costs n checks, not n squared.
4. What the leaders leave in different classes meets in pairs inside the join of
   each bucket that still holds several classes, under an exact bound. A text
   carries a sketch of :data:`BITS` bits, each the parity of the number of its
   distinct shingles in that slot, so two sketches differ in no more bits than
   the texts have shingles apart. That bounds the number of shared shingles from
   above, and with it J (:func:`ceiling`). It is a few bit counts a pair; only
   pairs that pass it, each in the first band it shares, meet as texts. So each
   pair of a bucket has been verified, ruled out by the bound, or is in one class.
5. Classes are the components of the verified links, by label propagation with
   pointer jumping over tables in the shared folder. Links never reach the driver.

Rows are told apart by a row number that is written once with the texts, so an
id may be null, repeated or of any type. Defined results: a text of one to four
words has one shingle of all its words; texts without words (null, empty) are
classes of their own; the class id is the smallest id of its rows, null where
all are null; the row kept of a class is the first of those that bear that id;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import vector
from lectern.llm.common import Scratch, durable, rows

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 24 < 1e-4.
BANDS, ROWS = 24, 5
#: Bits of a sketch.
BITS = 1024
#: Equal sums in another order of adding may differ by a part in 10 ** 9.
AT_LEAST = THRESHOLD * (1 - 1e-9)
_M = BANDS * ROWS
_GOLD = 0x9E3779B97F4A7C15


def weighted(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and the text of each."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.lexsort((grams, text))
    g, t = grams[by], text[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return g[at], np.diff(np.append(at, len(g))), t[at]


def signatures(shingles: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, registers): the shingle that arrives first at each register; 0 for a text without shingles."""
    first = np.full(n * _M, np.inf)
    who = np.zeros(n * _M, np.uint64)
    live, clock = np.arange(len(shingles)), np.zeros(len(shingles))
    rate = weights.astype(np.float64)
    turn = 0
    while len(live):
        turn += 1
        h = vector.mix(shingles[live] + np.uint64(_GOLD * turn & (1 << 64) - 1))
        # 53 bits make the waiting time, a second mix makes the register
        clock[live] -= np.log1p((h >> np.uint64(11)).astype(np.float64) * -(2.0**-53)) / rate[live]
        slot = text[live] * _M + (vector.mix(h) % np.uint64(_M)).astype(np.int64)
        np.minimum.at(first, slot, clock[live])
        won = first[slot] == clock[live]
        who[slot[won]] = shingles[live][won]
        latest = first.reshape(n, _M).max(axis=1)
        live = live[clock[live] < latest[text[live]]]
    return who.reshape(n, _M)


def sketches(shingles: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS / 64) words of the parities of the texts' distinct shingles by hashed slot."""
    slot = (vector.mix(shingles ^ np.uint64(_GOLD)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(text * BITS + slot, minlength=n * BITS) & 1
    return np.packbits(odd.reshape(n, BITS).astype(np.uint8), axis=1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in vector.slices(batches, 2):
        n, w = part.num_rows, vector.words(part.column(2))
        grams, bounds = vector.grams(w, SHINGLE)
        shingles, counts, text = weighted(grams, bounds)
        sig = signatures(shingles, counts, text, n)
        keys = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            keys = vector.mix(keys ^ sig[:, r::ROWS][:, :BANDS])
        # the words in order: equal for texts of equal words only
        digest = [w.counts.astype(np.uint64)]
        filled = np.flatnonzero(w.counts)
        place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], w.counts)
        for salt in (1, 2):
            digest.append(digest[-1].copy())
            if len(filled):
                mixed = vector.mix(w.hashes ^ vector.mix(place.astype(np.uint64) + np.uint64(salt << 40)))
                digest[-1][filled] = vector.mix(digest[-1][filled] ^ np.add.reduceat(mixed, w.bounds[:-1][filled]))
        distinct, total = np.bincount(text, minlength=n), np.bincount(text, counts, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(1), pa.array(w.counts > 0), *(pa.array(d.view(np.int64)) for d in digest[1:]),
            pa.array(distinct), pa.array(total - distinct), _lists(sketches(shingles, text, n)), _lists(keys.view(np.int64)),
        ], ["row", "doc_id", "filled", "key1", "key2", "size", "extra", "sketch", "bands"])


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel()))


def probability_jaccard(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> float:
    """Exact J of two sorted shingle arrays with counts p and q."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if p.max() == 1 and q.max() == 1:
        return len(both) / (len(a) + len(b) - len(both))
    x, y = p[i] / p.sum(), q[j] / q.sum()
    by = np.argsort(x / y, kind="stable")
    x, y = x[by], y[by]
    # z with a ratio of at least x's counts by P, others by Q; shingles of one text alone by their own
    alone_p, alone_q = 1 - x.sum(), 1 - y.sum()
    above = np.cumsum(x[::-1])[::-1] + alone_p
    below = np.concatenate(([0], np.cumsum(y)[:-1])) + alone_q
    return float((1 / (above / x + below / y)).sum())


def _sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    shingles, counts, text = weighted(*vector.grams(vector.words(pa.array(texts, pa.large_string())), SHINGLE))
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(shingles[a:b], counts[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 256):
            part = pdf.iloc[k : k + 256]
            seen: dict[str, tuple] = {}  # one leader stands in many rows
            for t in (t for c in ("ta", "tb") for t in part[c]):
                seen.setdefault(t, ())
            seen = dict(zip(seen, _sets(list(seen)), strict=True))
            ok = [probability_jaccard(*seen[x], *seen[y]) >= AT_LEAST for x, y in zip(part["ta"], part["tb"], strict=True)]
            yield part.loc[ok, ["a", "b"]]


def ceiling(a: str, b: str) -> Column:
    """The most that J of two texts can be, by (size, extra, sketch) of the structs ``a`` and ``b``.

    With D distinct shingles (``size``) and D + e in all (``extra``), at most m = (D1 + D2 - differing bits) / 2
    are shared, so at most p = (m + e1) / (D1 + e1) of the first text's weight and q of the second's. Each term of
    J with weights x, y is at most xy / (y + (1 - q) x); that is concave, so J is at most pq / (p + q - pq).
    """
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(BITS // 64)), F.lit(0))
    both = F.least(F.floor((F.col(f"{a}.size") + F.col(f"{b}.size") - apart) / 2), f"{a}.size", f"{b}.size")
    p, q = (F.least(F.lit(1.0), (both + F.col(f"{t}.extra")) / (F.col(f"{t}.size") + F.col(f"{t}.extra"))) for t in (a, b))
    return p * q / (p + q - p * q)


def links(texts: DataFrame, reps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b): verified links that span every bucket's like texts, and (node, label): their components.

    ``texts`` has (row, text), ``reps`` a row a representative: rep, size, extra, sketch, bands.
    """
    band = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = scratch(band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    # how many others a text meets, over all bands: most in the middle of its group
    crowd = -F.sum("n").over(Window.partitionBy("rep"))
    met = scratch(band.join(shared.hint("merge"), ["band", "key"]).select("band", "key", "rep", crowd.alias("crowd")), "near-met")
    lead = met.groupBy("band", "key").agg(F.min(F.struct("crowd", "rep")).alias("l")).select("band", "key", F.col("l.rep").alias("leader"))
    lead = scratch(lead, "near-leaders")
    # written first, so that Spark knows its size: while it is small, no text is shuffled
    wanted = scratch(met.select("rep").distinct(), "near-wanted")
    sets = scratch(texts.join(wanted, F.col("row") == F.col("rep")).select("rep", "text"), "near-sets")
    first = met.join(lead.hint("merge"), ["band", "key"]).where("rep <> leader")
    # a pair that several bands hold is verified once
    first = first.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    good = scratch(_verified(first, sets), "near-links")
    label = components(good, scratch)
    left = met.join(lead.select("band", "key", F.col("leader").alias("rep")), ["band", "key", "rep"], "left_anti").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    left = scratch(left.select("band", "key", "rep", F.coalesce("label", "rep").alias("label")), "near-left")
    # a bucket whose members are all in one class has nothing left to link
    several = scratch(left.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key"), "near-open")
    still = scratch(left.join(several, ["band", "key"], "left_semi").join(reps, "rep"), "near-still")
    x, y = still.alias("x"), still.alias("y")
    apart = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & (ceiling("x", "y") >= AT_LEAST)
    shared_before = F.exists(F.sequence(F.lit(0), F.col("x.band")), lambda k: (k < F.col("x.band")) & (F.col("x.bands")[k] == F.col("y.bands")[k]))
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & apart & ~shared_before)
    more = scratch(_verified(rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")), sets), "near-links")
    if more.isEmpty():
        return good, label
    every = good.unionByName(more)
    return every, components(every, scratch)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""
    one, two = (sets.select(F.col("rep").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").mapInPandas(_linked, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each component of ``edges`` (a, b)."""
    sym = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    label = scratch(sym.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-roots")
    while True:
        # take the smallest label next to each node, then jump to that label's own label
        ext = sym.join(label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        near = label.join(ext, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = scratch(near.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "near-roots")
        label = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return label


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: row, doc_id, class_id, n_copies (rows of equal words), n_links (of its representative) and kept (one row of each class).

    ``row_col`` names a column of distinct longs in a written table; without it the texts are written with one.
    """
    with Scratch() as scratch:
        if row_col is None:
            texts = scratch(rows(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "near-texts")
        else:
            texts = rows(df, id_col, text_col, row=df[row_col])
        id_type = texts.schema["doc_id"].dataType.simpleString()
        signed = texts.select("row", "doc_id", "text").mapInArrow(_signed, (
            f"row long, doc_id {id_type}, filled boolean, key1 long, key2 long, size long, extra long, sketch array<long>, bands array<long>"))
        signed = scratch(signed, "near-signed")
        group = signed.where("filled").groupBy("key1", "key2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_copies"))
        group = scratch(group, "near-groups")
        reps = signed.join(group.select(F.col("rep").alias("row")).hint("merge"), "row").select(F.col("row").alias("rep"), "size", "extra", "sketch", "bands")
        edges, label = links(texts, scratch(reps, "near-reps"), scratch)
        degree = edges.select(F.col("a").alias("rep")).unionByName(edges.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        known = group.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        known = known.select(*group.columns, F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        known = scratch(known, "near-classes")
        least = scratch(known.groupBy("label").agg(F.min("low").alias("class_id")), "near-least")
        known = scratch(known.join(least, "label").select("key1", "key2", "label", "class_id", "n_copies", "n_links"), "near-known")
        full = scratch(signed.where("filled").select("row", "doc_id", "key1", "key2").join(known.hint("merge"), ["key1", "key2"]).drop("key1", "key2"), "near-full")
        first = full.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("row").alias("row"))
        out = full.join(first.select("row", F.lit(True).alias("kept")), "row", "left")
        out = out.select("row", "doc_id", "class_id", "n_copies", "n_links", F.coalesce("kept", F.lit(False)).alias("kept"))
        none = signed.where("not filled").select(
            "row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
        return durable(out.unionByName(none), "near-judged")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`judge` without what differs between equal rows: doc_id, class_id, n_copies and n_links."""
    return judge(df, id_col, text_col).select("doc_id", "class_id", "n_copies", "n_links")

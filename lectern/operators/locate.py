"""Fuzzy location over a whole corpus, and the repair of a paper's answers by a chain of places."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import matching
from lectern.operators.joins import interpolate
from lectern.operators.segment import repaired_answers

#: Characters of needles that one pass over the texts looks for; its index is broadcast.
NEEDLES = 1 << 20
#: Places of a text that one row stands for.
CHUNK = 1 << 16
_LONGEST_GRAM = 12
#: Bits of the hashes by which runs are looked up, at most.
_SLOT_BITS = 22
#: Characters of short texts that are looked through together: few, so that their votes stay in a core's cache.
_TOGETHER = 1 << 14
#: Classes of letters that are counted, votes held at once and windows compared at once.
_CLASSES, _VOTES, _WINDOWS = 128, 1 << 20, 1 << 12


def seeds(size: int, least: float) -> tuple[int, int, int]:
    """(q, hits, shift) for a needle of ``size`` characters and a window of as many with a ratio of ``least`` at least.

    The window leaves u characters of each side unmatched at most, so there are 2 u + 1 matching blocks at most, since between two
    of them something is unmatched. They hold size - u characters, hence size - u - (2 u + 1)(q - 1) runs of q characters
    at the least, and none is shifted by more than u against the window. q is the longest that leaves three such runs, else one.
    """
    shift = size - math.ceil(least * size - 1e-9)
    for few in (3, 1):
        for q in range(_LONGEST_GRAM, 1, -1):
            hits = size - shift - (2 * shift + 1) * (q - 1)
            if hits >= few:
                return q, hits, shift
    return 1, 0, shift


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q characters; equal runs have equal hashes."""
    m = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for k in range(q):
        h = h * m + codes[k : k + len(h)]
    return (h ^ (h >> np.uint64(32))) * m


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, lo[k], lo[k] + 1, ...) for n[k] numbers from each."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(lo - np.cumsum(n) + n, n)


class Index:
    """Where runs of needles stand, by length of the run, and how many of which letters they have: what is broadcast."""

    def __init__(self, needles: list[tuple[int, str]], least: float):
        self.needles, self.least = needles, least
        codes = [_codes(t) for _, t in needles]
        self.size = np.array([len(c) for c in codes])
        self.q, self.hits, self.shift = np.array([seeds(len(t), least) for _, t in needles]).T
        # letters of one class are taken for equal, so none in common are missed
        self.bags = np.stack([np.bincount(c.astype(np.int64) % _CLASSES, minlength=_CLASSES) for c in codes])
        self.by_q: dict[int, tuple] = {}
        for q in set(self.q.tolist()) - {1}:
            mine = np.flatnonzero(self.q == q)
            grams = [_grams(codes[k], q) for k in mine]
            of, at = _spread(np.zeros(len(mine), np.int64), np.array([len(g) for g in grams]))
            bits = min(_SLOT_BITS, (8 * len(of)).bit_length())
            slot = np.concatenate(grams) >> np.uint64(64 - bits)
            by = np.argsort(slot, kind="stable")
            begin = np.searchsorted(slot[by], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            self.by_q[q] = bits, begin, mine[of[by]], at[by]

    def places(self, codes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(needle, place): the multiples of ``step`` whose window may be like the needle.

        A run votes for its diagonal. The votes for a window lie within 2 shift of each other, so in two bins side by side;
        where two such bins hold too few, nothing is sorted.
        """
        needles, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(self.q == 1):  # no run is sure to be shared: every place is looked at
            at = np.arange(0, len(codes) - self.size[k] + 1, step)
            needles.append(np.full(len(at), k))
            places.append(at)
        for q, (bits, begin, of, at) in self.by_q.items():
            slot = (_grams(codes, q) >> np.uint64(64 - bits)).astype(np.int64)
            lo = begin[slot].astype(np.int64)
            n = begin[slot + 1] - lo
            j = np.flatnonzero(n)
            lo, n = lo[j], n[j]
            same = self.q == q
            width, ahead = 2 * int(self.shift[same].max()) + 1, int(self.size[same].max())
            # a needle's bins: diagonals from -ahead on, and empty ones at both ends
            bins = (len(codes) + ahead) // width + 3
            span, zero = bins * width, ahead + width
            base = of * span + zero - at
            cuts = np.searchsorted(np.cumsum(n), np.arange(_VOTES, n.sum(), _VOTES)).tolist()
            parts = list(itertools.pairwise([0, *cuts, len(n)]))

            def diagonals(part: tuple[int, int], lo=lo, n=n, j=j, base=base) -> np.ndarray:
                k, p = _spread(lo[slice(*part)], n[slice(*part)])
                return base[p] + j[slice(*part)][k]

            held = np.zeros(len(same) * bins, np.int64)
            for part in parts:
                votes = diagonals(part)
                held += np.bincount(votes // width, minlength=len(held))
            held = held.reshape(-1, bins)
            both = held[:, :-1] + held[:, 1:] >= self.hits[:, None]
            enough = np.zeros(held.shape, bool)
            enough[:, :-1] = both
            enough[:, 1:] |= both
            if not enough.any():
                continue
            enough, told = enough.ravel(), []
            for part in parts:
                votes = votes if len(parts) == 1 else diagonals(part)
                told.append(np.unique(votes[enough[votes // width]], return_counts=True))
            votes, which = np.unique(np.concatenate([d for d, _ in told]), return_inverse=True)
            total = np.append(0, np.cumsum(np.bincount(which, np.concatenate([c for _, c in told]), len(votes)))).astype(np.int64)
            k = votes // span
            first = np.flatnonzero(total[np.searchsorted(votes, votes + 2 * self.shift[k], "right")] - total[:-1] >= self.hits[k])
            k = k[first]
            last = np.searchsorted(total, total[first] + self.hits[k]) - 1
            # enough votes within a band of diagonals: the places they can belong to
            zeros = k * span + zero
            x = -(-np.maximum(votes[last] - zeros - self.shift[k], 0) // step)
            y = np.minimum(votes[first] - zeros + self.shift[k], len(codes) - self.size[k]) // step
            # both ends rise within a needle: a place is taken once
            x[1:] = np.where(k[1:] == k[:-1], np.maximum(x[1:], y[:-1] + 1), x[1:])
            which, p = _spread(x, np.maximum(y - x + 1, 0))
            needles.append(k[which])
            places.append(p * step)
        return np.concatenate(needles), np.concatenate(places)

    def alike(self, codes: np.ndarray, needle: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the windows have letters enough in common with their needles."""
        which, at = _spread(place, self.size[needle])
        bags = np.bincount(which * _CLASSES + (codes[at] % np.uint64(_CLASSES)).astype(np.int64), minlength=len(needle) * _CLASSES)
        return np.minimum(bags.reshape(-1, _CLASSES), self.bags[needle]).sum(axis=1) >= self.least * self.size[needle] - 1e-9

    def found(self, parts: list[str], most: int, step: int) -> Iterator[tuple[int, int, int, float]]:
        """(needle, part, place, ratio) of the windows as good as ``least`` at multiples of ``step`` below ``most`` of each part.

        Parts are looked through one behind the other, each from a multiple of ``step`` on.
        """
        codes = [_codes(t) for t in parts]
        size = np.array([len(c) for c in codes])
        begin = np.append(0, np.cumsum(-(-size // step) * step))
        line = np.zeros(begin[-1], np.uint64)
        for b, c in zip(begin, codes, strict=False):
            line[b : b + len(c)] = c
        needle, at = self.places(line, step)
        part = np.searchsorted(begin, at, "right") - 1
        own = (at - begin[part] < most) & (at - begin[part] + self.size[needle] <= size[part])
        needle, at, part = needle[own], at[own], part[own]
        for a in range(0, len(at), _WINDOWS):
            some = np.arange(a, min(a + _WINDOWS, len(at)))
            some = some[self.alike(line, needle[some], at[some])]
            rows = list(zip(needle[some].tolist(), part[some].tolist(), (at[some] - begin[part[some]]).tolist(), strict=True))
            score = matching.ratios([parts[t][p : p + self.size[k]] for k, t, p in rows], [self.needles[k][1] for k, _, _ in rows])
            yield from ((self.needles[k][0], t, p, s) for (k, t, p), s in zip(rows, score.tolist(), strict=True) if s >= self.least)


def located_everywhere(needles: DataFrame, texts: DataFrame, least: float = 0.9, step: int = 8) -> DataFrame:
    """(needle, doc, found_at, score) for each needle (key, needle) and text (key, hay) with a window, at a multiple of ``step``, of that ratio.

    It is the best window's first place, as a scan of all windows would give it. Runs of characters that a window as good as
    ``least`` must share with the needle vote for diagonals; only places with enough votes, and enough letters in common, are compared.
    Texts are cut into overlapping chunks, so a long one is many rows, and short ones are looked through together; needles are
    taken by blocks of :data:`NEEDLES` characters.
    """
    asked = needles.select("key", "needle").where("length(needle) >= 12")
    longest = asked.agg(F.max(F.length("needle"))).first()[0]
    if longest is None:
        return texts.select(F.lit(None).cast("long").alias("needle"), F.col("key").cast("long").alias("doc"), F.lit(None).cast("long").alias("found_at"), F.lit(None).cast("double").alias("score")).limit(0)
    chunk = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("hay"), F.lit(1)) - 1) / CHUNK).cast("int")), lambda k: F.substring(F.col("hay"), k * CHUNK + 1, F.lit(CHUNK + longest))))
    rows = texts.where("hay is not null").select(F.col("key").cast("long").alias("doc"), chunk.alias("k", "part"))

    def look(shared) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, names = shared.value, ["needle", "doc", "found_at", "score"]

            def told(held: list[tuple[int, int, str]]) -> pa.RecordBatch:
                out = [(key, held[t][0], held[t][1] * CHUNK + p, s) for key, t, p, s in index.found([part for _, _, part in held], CHUNK, step)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names)

            held, size = [], 0
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    held.append(row)
                    size += len(row[2])
                    if size >= _TOGETHER:
                        yield told(held)
                        held, size = [], 0
            if held:
                yield told(held)

        return run

    found, block, size = None, [], 0
    context = texts.sparkSession.sparkContext

    def taken(block: list) -> DataFrame:
        return rows.mapInArrow(look(context.broadcast(Index(block, least))), "needle long, doc long, found_at long, score double")

    for r in asked.orderBy("key").toLocalIterator():
        block.append((r["key"], r["needle"]))
        size += len(r["needle"])
        if size >= NEEDLES:
            found, block, size = taken(block) if found is None else found.unionByName(taken(block)), [], 0
    if block:
        found = taken(block) if found is None else found.unionByName(taken(block))
    best = F.max(F.struct("score", (-F.col("found_at")).alias("back"))).alias("b")
    return found.groupBy("needle", "doc").agg(best).select("needle", "doc", (-F.col("b.back")).alias("found_at"), F.round("b.score", 6).alias("score"))


def projected(text: str) -> tuple[str, np.ndarray]:
    """Letters and digits of a text in lower case, and where each stands in it."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = np.array([ord(c.lower()) if (c := chr(k)).isalnum() else 0 for k in range(128)], np.uint8)
    kept = np.where(codes < 128, letters[np.minimum(codes, 127)], 0).astype(np.uint8)
    # beyond ASCII, two letters have one of it in lower case
    kept[codes == ord("\u0130")], kept[codes == ord("\u212a")] = ord("i"), ord("k")
    at = np.flatnonzero(kept)
    return kept[at].tobytes().decode("ascii"), at


def window_scores(needle: str, hay: str, least: float, step: int) -> list[tuple[int, float]]:
    """(place, ratio) of the windows at multiples of ``step`` that reach ``least``.

    What needle and window have in common as bags of characters, and then as sequences, bounds the ratio; windows below are not compared.
    """
    n = len(needle)
    if n < 12 or len(hay) < n:
        return []
    places = np.arange(0, len(hay) - n + 1, step)
    codes, common = _codes(hay), np.zeros(len(places), np.int64)
    for c, k in Counter(needle).items():
        seen = np.append(0, np.cumsum(codes == ord(c)))
        common += np.minimum(seen[places + n] - seen[places], k)
    some = places[common >= least * n - 1e-9]
    some = some[longest_common(needle, codes, some) >= least * n - 1e-9].tolist()
    score = matching.ratios([hay[p : p + n] for p in some], [needle] * len(some)).tolist()
    return [(p, s) for p, s in zip(some, score, strict=True) if s >= least]


#: Bits of a word that hold places of the needle; the one above them takes the carry.
_BITS = 62


def longest_common(needle: str, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the needle and of the window at each place: no ratio's blocks hold more.

    A bit for each place of the needle, a row of words for each window: the windows' k-th characters are taken together.
    """
    n, one, full = len(needle), np.uint64(1), np.uint64((1 << _BITS) - 1)
    letters, at = np.unique(_codes(needle), return_inverse=True)
    words = -(-n // _BITS)
    mask = np.zeros((len(letters) + 1, words), np.uint64)
    for k, c in enumerate(at.tolist()):
        mask[c, k // _BITS] |= one << np.uint64(k % _BITS)
    found = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    which = np.where(letters[found] == codes, found, len(letters))
    v = np.full((words, len(places)), full)
    for k in range(n):
        c = which[places + k]
        carry = np.zeros(len(places), np.uint64)
        for w in range(words):
            u = v[w] & mask[c, w]
            total = v[w] + u + carry
            carry = total >> np.uint64(_BITS)
            v[w] = (total & full) | (v[w] - u)
    used = [full if w < words - 1 else np.uint64((1 << (n - w * _BITS)) - 1) for w in range(words)]
    return sum((np.bitwise_count(~v[w] & used[w]).astype(np.int64) for w in range(words)), np.zeros(len(places), np.int64))


def heaviest_chain(places: list[list[tuple[int, float]]]) -> list[tuple[int, float] | None]:
    """One place (position, weight) or none for each item in order, positions rising, of the greatest total weight.

    A binary indexed tree over the positions holds the best chain that ends at or before each.
    """
    order = {p: i + 1 for i, p in enumerate(sorted({p for some in places for p, _ in some}))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(order) + 1)
    links: list[tuple[int, int, float, int]] = []  # item, position, weight, link before
    for item, some in enumerate(places):
        ends = []
        for p, weight in some:
            i, best = order[p] - 1, (0.0, -1)
            while i > 0:
                best = max(best, tree[i], key=lambda t: t[0])
                i &= i - 1
            ends.append((order[p], best[0] + weight, len(links)))
            links.append((item, p, weight, best[1]))
        for i, total, link in ends:  # an item is taken once
            while i < len(tree):
                if total > tree[i][0]:
                    tree[i] = (total, link)
                i += i & -i
    out: list[tuple[int, float] | None] = [None] * len(places)
    link = max(tree, key=lambda t: t[0])[1]
    while link >= 0:
        item, p, weight, link = links[link]
        out[item] = (p, weight)
    return out


def repaired_papers(records: DataFrame, papers: DataFrame, least: float = 0.30, step: int = 8, tail: int = 90, sign: str = "Examiners report", tasks: int = 64) -> DataFrame:
    """``records`` (paper, n, question, current) and ``papers`` (paper, text) -> paper, n, start, score, action, answer.

    A record's places are those of its question, or of its last ``tail`` characters, in the paper, compared on letters and digits; a record is a
    row, so a paper's are searched side by side, in ``tasks`` tasks. The heaviest chain of places that rise with the records gives the sure starts, the
    average stride and the line between neighbours the others (:func:`interpolate`). An answer reaches to the next start and is cut
    at ``sign``; it replaces the current one by the rule of :func:`repaired_answers`.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, np.ndarray]] = {}
        for batch in batches:
            out = []
            for question, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text not in known:
                    known.clear()
                    known[text] = projected(text or "")
                hay, at = known[text]
                needle, best = projected(question or "")[0], {}
                for some in dict.fromkeys((needle, needle[-tail:])):
                    for p, score in window_scores(some, hay, least, step):
                        best[p] = max(best.get(p, 0.0), score)
                out.append([{"at": int(at[p]), "score": s} for p, s in sorted(best.items())])
            kind = pa.list_(pa.struct([("at", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["paper", "n", "places"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        got = heaviest_chain([[(p["at"], p["score"]) for p in some] for some in table["places"].to_pylist()])
        return pa.table({"paper": table["paper"], "n": table["n"], "known": pa.array([g and g[0] for g in got], pa.int64()), "score": pa.array([g[1] if g else 0.0 for g in got], pa.float64())})

    text = papers.select("paper", F.coalesce("text", F.lit("")).alias("text"))
    both = records.select("paper", "n", "question").join(text, "paper").repartition(tasks, "paper", "n")
    placed = both.mapInArrow(search, "paper long, n long, places array<struct<at:bigint,score:double>>")
    starts = placed.groupBy("paper").applyInArrow(chain, "paper long, n long, known long, score double")
    starts = starts.join(text.select("paper", F.length("text").alias("length")), "paper")
    filled = interpolate(starts, ["paper"], "n", "known", "length").withColumnRenamed("filled", "start")
    w = Window.partitionBy("paper")
    stride = F.floor(F.col("length") / F.count(F.lit(1)).over(w))
    end = F.coalesce(F.lead("start").over(w.orderBy("n")), F.col("length"))
    end = F.when(end > F.col("start"), end).otherwise(F.col("start") + F.greatest(F.lit(200), F.floor(stride / 2)))
    found = filled.select("paper", "n", "start", "score", end.alias("end")).join(text, "paper").join(records.select("paper", "n", "current"), ["paper", "n"])
    region = F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    done = repaired_answers(found.select("paper", "n", "start", "score", "current", region.alias("found")), sign)
    return done.select("paper", "n", "start", F.round("score", 6).alias("score"), "action", "answer")

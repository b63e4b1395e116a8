"""difflib's ratio of many pairs of strings at once, to the last bit.

The longest common block of two stretches, the first of equals, splits both; what lies before and after it is treated alike. Here all
stretches of all pairs are split level by level with arrays: first by blocks of :data:`STAGES`\\ [0] characters or more, which
are few; stretches that share none go on with shorter ones.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np

#: Least lengths of blocks, in turn.
STAGES = (4, 2, 1)
#: Characters of the pairs taken together, and places where blocks may begin that are held at once.
CHARACTERS, PLACES = 1 << 18, 1 << 21


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, lo[k], lo[k] + 1, ...) for n[k] numbers from each."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(lo - np.cumsum(n) + n, n)


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate([*raw, np.zeros(0, np.uint32)]), np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64))


def _grams(codes: np.ndarray, split: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the runs of k characters of both sides, and how many numbers there are."""
    base = int(codes.max(initial=0)) + 1
    out, numbers = codes, base
    for d in range(1, k):
        if numbers * base >= 1 << 40:
            out = np.unique(out, return_inverse=True)[1]
            numbers = len(out) + 1
        out, numbers = out * base + np.append(codes[d:], np.zeros(min(d, len(codes)), np.int64)), numbers * base
    return out[:split], out[split:], numbers


class _TooMany(Exception):
    pass


def _common(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Characters in matching blocks, per pair."""
    (ca, at), (cb, bt) = _codes(a), _codes(b)
    codes = np.unique(np.concatenate([ca, cb]), return_inverse=True)[1].astype(np.int64)
    total = np.zeros(len(a), np.int64)
    pair = np.arange(len(a))
    box = np.stack([at[:-1], at[1:], bt[:-1], bt[1:]])  # alo, ahi, blo, bhi of each stretch
    for k in STAGES:
        ga, gb, numbers = _grams(codes, len(ca), k)
        keep = (box[1] - box[0] >= k) & (box[3] - box[2] >= k)
        # too short for this stage, not for the next ones
        rest_pair, rest_box = [pair[~keep]], [box[:, ~keep]]
        pair, box = pair[keep], box[:, keep]
        if len(pair):
            if numbers * (len(pair) + 1) >= 1 << 62:
                both = np.unique(np.concatenate([ga, gb]), return_inverse=True)[1]
                ga, gb, numbers = both[: len(ca)], both[len(ca) :], len(both) + 1
            of_a, i = _spread(box[0], box[1] - box[0] - k + 1)
            of_b, j = _spread(box[2], box[3] - box[2] - k + 1)
            key_a, key_b = of_a * numbers + ga[i], of_b * numbers + gb[j]
            by = np.argsort(key_b)
            key_b, j = key_b[by], j[by]
            lo = np.searchsorted(key_b, key_a, "left")
            n = np.searchsorted(key_b, key_a, "right") - lo
            if n.sum() > PLACES:
                raise _TooMany
            which, p = _spread(lo, n)
            node, i, j = of_a[which], i[which], j[p]
            # places on one diagonal in a row are one block
            width = len(ca) + len(cb) + 1
            order = np.argsort((node * width + (i - j + len(cb))) * (len(ca) + 1) + i) if len(pair) * width * (len(ca) + 1) < 1 << 62 else np.lexsort((i, i - j, node))
            node, i, j = node[order], i[order], j[order]
            new = np.ones(len(i), bool)
            new[1:] = (node[1:] != node[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(i))) + k - 1
            node, i, j = node[first], i[first], j[first]
            while True:
                # the longest block of each stretch, of equals the first in a, then in b
                has = np.zeros(len(pair), bool)
                has[node] = True
                rest_pair.append(pair[~has])
                rest_box.append(box[:, ~has])
                if not len(node):
                    break
                pair, box, node = pair[has], box[:, has], (np.cumsum(has) - 1)[node]
                start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                top = np.maximum.reduceat(size, start)
                best = np.flatnonzero(size == top[node])
                best = best[np.lexsort((j[best], i[best], node[best]))]
                best = best[np.append(True, node[best][1:] != node[best][:-1])]
                bi, bj, bk = i[best], j[best], size[best]
                np.add.at(total, pair, bk)
                # what each block has before and after it
                before = np.minimum(size, np.minimum(bi[node] - i, bj[node] - j))
                skip = np.maximum(0, np.maximum((bi + bk)[node] - i, (bj + bk)[node] - j))
                x, y = before >= k, size - skip >= k
                left, right = (node * 2)[x], (node * 2 + 1)[y]
                i, j, size = np.append(i[x], (i + skip)[y]), np.append(j[x], (j + skip)[y]), np.append(before[x], (size - skip)[y])
                node = np.append(left, right)
                order = np.argsort(node, kind="stable")
                node, i, j, size = node[order], i[order], j[order], size[order]
                split = np.empty((4, 2 * len(pair)), np.int64)
                split[:, 0::2] = box[0], bi, box[2], bj
                split[:, 1::2] = bi + bk, box[1], bj + bk, box[3]
                pair, box = np.repeat(pair, 2), split
        pair, box = np.concatenate(rest_pair), np.concatenate(rest_box, axis=1)
        some = (box[1] > box[0]) & (box[3] > box[2])
        pair, box = pair[some], box[:, some]
    return total


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``SequenceMatcher(None, x, y, autojunk=False).ratio()`` of each x of ``a`` with the y of ``b`` at its place."""
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.ones(len(size))
    work = []
    begin, held = 0, 0
    for end, n in enumerate(size.tolist(), 1):
        held += n
        if held >= CHARACTERS or end == len(size):
            work.append((begin, end))
            begin, held = end, 0
    while work:
        lo, hi = work.pop()
        try:
            common = _common(a[lo:hi], b[lo:hi])
        except _TooMany:
            if hi - lo > 1:
                work += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
                continue
            common = np.array([sum(m.size for m in difflib.SequenceMatcher(None, a[lo], b[lo], autojunk=False).get_matching_blocks())])
        some = size[lo:hi] > 0
        out[lo:hi][some] = 2.0 * common[some] / size[lo:hi][some]
    return out

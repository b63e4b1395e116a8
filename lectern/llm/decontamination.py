"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of :data:`WINDOW` consecutive words, or one of
all its words if it has fewer. A document is hit where it holds a window.

1. The tokens of a window are ordered by rarity: by their count over all
   documents. Exact containment needs all tokens, so the prefix that a match
   must share is the rarest token alone.
2. The join meets document words with prefix tokens. A match at word p with the
   token's offset o gives the start p - o; starts whose window leaves the text
   are dropped (positional and length bounds).
3. A candidate is verified over its whole window, rarest tokens first.

The benchmark is the stated query set: its windows are written once and read in
blocks of :data:`BLOCK_WINDOWS` at most, however they spread over items, so one
long item or many rows of one are split like the rest. A block is some 30 MB,
broadcast while its pass runs; documents never move. Passes write narrow hits
(row, start, end, item) alone; with one block, hits stay in their document's row
and nothing is written.

Defined results: null or empty text has no words and no hits; repeated rows are
judged one by one; repeated items count once by id; empty tables give no rows
or no hits; columns of the input that bear an added name are replaced.
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

WINDOW = 13
BLOCK_WINDOWS = 200_000
#: A document is contaminated if at least one in this many of its words is hit.
SHARE = 20
_SLOTS = 1 << 20


@dataclass
class Block:
    """The windows of one block, prefix tokens sorted, with their postings."""

    tokens: np.ndarray  # (windows, WINDOW) word hashes
    sizes: np.ndarray
    order: np.ndarray  # (windows, WINDOW) offsets, rarest first
    items: list  # item ids of each window, as strings
    prefix: np.ndarray  # sorted distinct rarest tokens
    first: np.ndarray  # prefix k has the windows posting[first[k] : first[k + 1]]
    posting: np.ndarray
    slots: np.ndarray  # a bit a hashed prefix token


def item_windows(ids, texts) -> dict[tuple[int, ...], set]:
    """Distinct windows with the items that hold them."""
    w = vector.words(pa.array(texts, pa.large_string()))
    out: dict[tuple[int, ...], set] = {}
    for i, item in enumerate(ids):
        h = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
        for k in range(max(1, len(h) - WINDOW + 1) if h else 0):
            out.setdefault(tuple(h[k : k + WINDOW]), set()).add(item)
    return out


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(tokens: the words' hashes, items as strings) of every distinct window of ``benchmark`` (doc_id, text)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vector.slices(batches, 1, rows=64):
            found = item_windows(part.column(0).cast(pa.string()).to_pylist(), part.column(1))
            rows_ = [(list(w), i) for w, items in found.items() for i in items]
            for k in range(0, len(rows_), 4096):
                tokens, items = zip(*rows_[k : k + 4096], strict=True)
                tokens = pa.array([np.array(t, np.uint64).view(np.int64) for t in tokens], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([tokens, pa.array(items, pa.string())], ["tokens", "item"])

    cut_up = benchmark.select("doc_id", "text").mapInArrow(cut, "tokens array<long>, item string")
    return cut_up.groupBy("tokens").agg(F.collect_set("item").alias("items"))


def build(windows: dict[tuple[int, ...], set], counts: dict[int, int]) -> Block:
    n = len(windows)
    tokens, sizes = np.zeros((n, WINDOW), np.uint64), np.zeros(n, np.int64)
    order, items = np.zeros((n, WINDOW), np.int64), []
    for k, (win, ids) in enumerate(windows.items()):
        m = len(win)
        tokens[k, :m], sizes[k] = win, m
        order[k, :m] = sorted(range(m), key=lambda j: (counts.get(win[j], 0), j))
        items.append(sorted(ids))
    rare = tokens[np.arange(n), order[:, 0]] if n else np.zeros(0, np.uint64)
    by = np.argsort(rare, kind="stable")
    prefix, first = np.unique(rare[by], return_index=True)
    slots = np.zeros(_SLOTS, bool)
    slots[prefix & np.uint64(_SLOTS - 1)] = True
    return Block(tokens, sizes, order, items, prefix, np.append(first, n), by, slots)


def matches(b: Block, w: vector.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, window) of every place where a window of the block stands."""
    none = np.zeros(0, np.int64)
    if not len(b.prefix) or not len(w.hashes):
        return none, none, none
    at = np.flatnonzero(b.slots[w.hashes & np.uint64(_SLOTS - 1)])
    k = np.searchsorted(b.prefix, w.hashes[at])
    k[k == len(b.prefix)] = 0
    real = b.prefix[k] == w.hashes[at]
    at, k = at[real], k[real]
    # each word meets the windows whose rarest token it is
    many = b.first[k + 1] - b.first[k]
    run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    win = b.posting[np.repeat(b.first[k], many) + run]
    start = np.repeat(at, many) - b.order[win, 0]
    text = np.repeat(np.searchsorted(w.bounds, at, "right") - 1, many)
    ok = (start >= w.bounds[text]) & (start + b.sizes[win] <= w.bounds[text + 1])
    text, start, win = text[ok], start[ok], win[ok]
    for j in range(1, WINDOW):
        more = b.sizes[win] > j
        off = b.order[win, j]
        ok = ~more | (w.hashes[np.where(more, start + off, 0)] == b.tokens[win, off])
        text, start, win = text[ok], start[ok], win[ok]
    return text, start, win


def token_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Occurrences of the block's tokens over all documents; a row per token at most reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        slots = np.zeros(_SLOTS, bool)
        slots[v & np.uint64(_SLOTS - 1)] = True
        total = np.zeros(len(v) + 1, np.int64)
        for batch in vector.slices(batches, 0):
            h = vector.words(batch.column(0)).hashes
            h = h[slots[h & np.uint64(_SLOTS - 1)]]
            k = np.searchsorted(v, h)
            k[k == len(v)] = 0
            total += np.bincount(k[v[k] == h], minlength=len(total)) if len(v) else 0
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(total[at])], ["token", "n"])

    summed = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"] & (1 << 64) - 1: r["n"] for r in summed.collect()}


def _block(docs: DataFrame, windows: DataFrame) -> Block:
    found = {tuple(t & (1 << 64) - 1 for t in r["tokens"]): set(r["items"]) for r in windows.collect()}
    return build(found, token_counts(docs, np.unique(np.array([t for w in found for t in w], np.uint64))))


_HITS = "array<struct<start:bigint,end:bigint>>"
_ADDED = ("n_words", "n_hit", "items", "contaminated")


def find(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` (with a column ``text``) and, per row, n_words, n_hit, items (array<string>) and contaminated.

    The other columns of ``docs`` are returned as they are.
    """
    keep = [c for c in docs.columns if c not in _ADDED]
    docs = docs.select(*keep)
    context = docs.sparkSession.sparkContext
    windows = durable(windows_of(rows(benchmark, item_col, item_text)), "decontam-windows")
    n = windows.count()
    if n <= BLOCK_WINDOWS:
        found = docs.mapInArrow(_pass(context.broadcast(_block(docs, windows)), keep), _hit_schema(docs))
    else:
        # rows are numbered with their texts, and each block's pass writes what it hits
        blocks = -(-n // BLOCK_WINDOWS)
        windows = windows.withColumn("_b", F.pmod(F.xxhash64("tokens"), F.lit(2 * blocks)))
        numbered = durable(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-rows")
        hits = None
        for b in range(2 * blocks):
            text = numbered.select("_row", "text")
            part = text.mapInArrow(_pass(context.broadcast(_block(docs, windows.where(F.col("_b") == b).drop("_b"))), text.columns), _hit_schema(text))
            part = durable(part.where(F.size("_h") > 0).select("_row", "_h", "items"), "decontam-hits")
            hits = part if hits is None else hits.unionByName(part)
        met = hits.groupBy("_row").agg(F.flatten(F.collect_list("_h")).alias("_h"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        counted = numbered.mapInArrow(_pass(context.broadcast(build({}, {})), numbered.columns), _hit_schema(numbered))
        found = counted.drop("_h", "items").join(durable(met, "decontam-met"), "_row", "left")
        found = found.withColumn("_h", F.coalesce("_h", F.array().cast(_HITS))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = _covered(F.col("_h"))
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def _hit_schema(docs: DataFrame):
    return docs.select("*", F.lit(None).cast(_HITS).alias("_h"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words")).schema


def _covered(hits):
    """Words inside any of the spans."""
    def add(a, x):
        return F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")), add, lambda a: a["n"])


def _pass(shared, keep: list[str]):
    """The batch's columns with the block's merged hits, their items and the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, at = shared.value, keep.index("text")
        for batch in vector.slices(batches, at):
            w = vector.words(batch.column(at))
            hits, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            text, start, win = matches(b, w)
            for i in np.unique(text).tolist():
                mine = slice(*np.searchsorted(text, [i, i + 1]))  # texts come in order
                s = start[mine] - w.bounds[i]
                hits[i] = [{"start": x, "end": y} for x, y in _merged(np.stack([s, s + b.sizes[win[mine]]], 1).tolist())]
                found[i] = sorted({it for v in np.unique(win[mine]).tolist() for it in b.items[v]})
            spans = pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans, pa.array(found, pa.list_(pa.string())), pa.array(w.counts, pa.int64())], [*keep, "_h", "items", "n_words"])

    return run


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_hit, n_items, a digest of the items and the verdict, per document."""
    found = find(rows(docs, id_col, text_col), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

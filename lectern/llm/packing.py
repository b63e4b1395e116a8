"""Token sequences of bounded size by bounded-space online packing.

1. A partition's documents come in their order, as token ids with a separator
   after each. Whole windows are cut off the front of a document; what remains is
   placed in the open window that it fits best. At most :data:`OPEN` windows are
   open. Where none fits and no more may be opened, the fullest is filled up with
   a part of the document and emitted, and the rest takes its place.
2. At a partition's end the open windows are merged into full ones, and fewer
   tokens than a window are left over, at most one window a partition.
3. Leftovers of :data:`FAN` partitions at a time are merged in one task each, in
   rounds, until one is left. It is cut into sequences whose lengths are powers
   of two, which need no padding.

So no token is dropped and none is padded. A worker holds one part of the texts
and OPEN windows; only leftovers travel. Sequence ids tell round, task and
number, so a task that runs again makes the same ids.

Ids come from the byte-level vocabulary of a tokenizer file (JSON) whose merges
are in the order of its ids, and are run by a library that takes ranks; they
equal that tokenizer's own ids without special tokens (tested). Defined results:
a null or empty text has the separator alone; null and repeated ids are packed
row by row, and their pieces can't be told apart by id; a very long text is cut
into many windows; texts that tie go by their order in the partition; an empty
table gives an empty table; other columns are not read, so clashing names do no
harm.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import vector
from lectern.llm.common import Scratch, durable, rows

WINDOW, OPEN, SEPARATOR = 1024, 64, 0
#: Leftovers of so many partitions meet in one task: FAN x WINDOW ids at most.
FAN = 256
_ROUND, _TASK = 56, 32
_PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "part"]


def read_vocabulary(path: str) -> dict[bytes, int]:
    """bytes -> id of a byte-level tokenizer file; its merges must be in the order of the ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # how such files write bytes: printable ones as themselves, the others in order from U+0100
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    made = [model["vocab"][t] for t in joined]
    if made != sorted(made):
        raise ValueError("merges are not in the order of the ids")
    known = set(joined)
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if len(t) == 1 or t in known}


class Packer:
    """Pieces (document, start, ids) into windows; ``emit`` is called with each window's pieces."""

    def __init__(self, size: int, n_open: int, emit: Callable[[list], None]):
        self.size, self.n_open, self.emit = size, n_open, emit
        #: (room, number) ascending, and the pieces of each open window by number
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, doc: object, ids: np.ndarray) -> None:
        at, end = 0, len(ids)
        while end - at >= self.size:
            self.emit([(doc, at, ids[at : at + self.size])])
            at += self.size
        while at < end:
            n = end - at
            k = bisect_left(self.rooms, (n, -1))
            if k == len(self.rooms):
                if len(self.rooms) < self.n_open:
                    self.made += 1
                    insort(self.rooms, (self.size, self.made))
                    self.held[self.made] = []
                    continue
                k, n = 0, self.rooms[0][0]  # the fullest takes a part
            room, number = self.rooms.pop(k)
            self.held[number].append((doc, at, ids[at : at + n]))
            at += n
            if room > n:
                insort(self.rooms, (room - n, number))
            else:
                self.emit(self.held.pop(number))

    def finish(self) -> list:
        """Merges the open windows, fullest first; returns what is left over."""
        left = filled([p for _, number in self.rooms for p in self.held[number]], self.size, self.emit)
        self.rooms, self.held = [], {}
        return left


def filled(pieces: list, size: int, emit: Callable[[list], None]) -> list:
    """Fills windows with the pieces in turn, cutting where one is full; returns those of the last, unfilled one."""
    window, room = [], size
    for doc, start, ids in pieces:
        at = 0
        while at < len(ids):
            n = min(room, len(ids) - at)
            window.append((doc, start + at, ids[at : at + n]))
            at, room = at + n, room - n
            if not room:
                emit(window)
                window, room = [], size
    return window


class _Rows:
    """Collects the rows of windows; a document is (id, number of its tokens)."""

    def __init__(self, base: int, part: int, with_ids: bool):
        self.base, self.part, self.with_ids, self.n = base, part, with_ids, 0
        self.clear()

    def clear(self) -> None:
        self.doc, self.ids = [], []
        self.cols: list[list] = [[] for _ in _PIECE]

    def emit(self, pieces: list, left: bool = False) -> None:
        total, at = sum(len(ids) for _, _, ids in pieces), 0
        for (doc, tokens), start, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            self.doc.append(doc)
            self.ids.append(raw if left or self.with_ids else None)
            for col, x in zip(self.cols, (start, len(ids), zlib.crc32(raw), tokens, None if left else self.base + self.n, at, total, self.part), strict=True):
                col.append(x)
            at += len(ids)
        self.n += not left


_coders: dict[tuple[str, str], object] = {}


def coder(path: str, pattern: str):
    """Made once a Python worker, which drops it when it turns to another operator."""
    if (path, pattern) not in _coders:
        import tiktoken

        if not _coders:
            vector.kept.append(_coders.clear)
        _coders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_vocabulary(path), special_tokens={})
    return _coders[path, pattern]


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, n_open: int = OPEN,
         separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, and ids (binary, little-endian uint32) if asked for.

    ``path`` is the tokenizer file, on every machine.
    """
    if window < 1 or window & (window - 1) or n_open < 1:
        raise ValueError("a window's size is a power of two, and one window is open at least")
    src = rows(df, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {', '.join(f'{c} long' for c in _PIECE)}, ids binary"

    def batch(out: _Rows, kind: pa.DataType) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out.doc, kind), *(pa.array(c, pa.int64()) for c in out.cols), pa.array(out.ids, pa.binary())], ["doc_id", *_PIECE, "ids"])
        out.clear()
        return made

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, kind = _Rows(part << _TASK, part, with_ids), None
        packer = Packer(window, n_open, out.emit)
        encode = coder(path, pattern).encode_to_numpy
        end = np.array([separator], np.uint32)
        for some in vector.slices(batches, 1):
            kind = some.column(0).type
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.large_binary()), strict=True):
                ids = np.concatenate((encode(text.as_buffer().to_pybytes().decode("utf-8", "replace"), disallowed_special=()), end))
                packer.add((doc, len(ids)), ids)
            if out.doc:
                yield batch(out, kind)
        left = packer.finish()
        if left:
            out.emit(left, left=True)
        if out.doc:
            yield batch(out, kind)

    def merged(level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["part", "offset"])
            out = _Rows(level << _ROUND | int(key[0]) << _TASK, int(key[0]), with_ids)
            pieces = [((d, t), s, np.frombuffer(i, "<u4")) for d, t, s, i in zip(pdf["doc_id"], pdf["doc_tokens"], pdf["start"], pdf["ids"], strict=True)]
            left = filled(pieces, window, out.emit)
            size = window
            while last and left:  # sequences whose lengths are powers of two
                while sum(len(ids) for _, _, ids in left) < size:
                    size //= 2
                left = filled(left, size, out.emit)
            if left:
                out.emit(left, left=True)
            return pd.DataFrame({"doc_id": pd.Series(out.doc, dtype=pdf["doc_id"].dtype), **dict(zip(_PIECE, (pd.array(c, "Int64") for c in out.cols), strict=True)), "ids": pd.Series(out.ids, dtype=object)})

        return run

    with Scratch() as scratch:
        done = [scratch(src.select("doc_id", "text").mapInArrow(first, schema), "packed-first")]
        top = done[0].where(F.col("sequence_id").isNull()).agg(F.max("part")).first()[0]
        while top is not None:
            level, top = len(done), top // FAN or None
            left = done[-1].where(F.col("sequence_id").isNull())
            done.append(scratch(left.groupBy(F.floor(F.col("part") / FAN).alias("task")).applyInPandas(merged(level, top is None), schema), "packed-merged"))
        every = done[0]
        for more in done[1:]:
            every = every.unionByName(more)
        every = every.where(F.col("sequence_id").isNotNull()).drop("part")
        return durable(every if with_ids else every.drop("ids"), "packed")


def sequences(pieces: DataFrame, window: int = WINDOW, padding: int = SEPARATOR) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence of :func:`pack`'s pieces with ids, padded to ``window`` but at a power of two.

    A group is one window at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(window - F.col("n_tokens")).cast("int")
    return held.select("sequence_id", "n_tokens", F.concat(ids, F.unhex(F.repeat(F.lit(padding.to_bytes(4, "little").hex()), missing))).alias("ids"))

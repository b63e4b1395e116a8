"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed: the acceptor of a conversation's rows, a transducer
of edits (K keeps a row, R gives it the role user or assistant, D deletes it, I
inserts an empty message) and the acceptor of role initials ``(s?(ua)+)?``. A
path's weight is the pair (cost, labels), compared in that order. States are
made when first met: stepping back over a row of some class (:func:`row_class`)
from some vector of costs to go gives the vector before it and the best labels of
each grammar state, and that is kept for all rows (:class:`Composed`). Between
two rows more than two inserts never pay, so the machine has no cycle and one
walk against its topological order finds the shortest path.

Conversations of up to :data:`SEGMENT` rows are dealt out by id, sorted, and
repaired one after another. A longer one, which may hold any share of all rows,
is cut into segments. Equal rows are counted first; positions come from a range
partitioning; a segment becomes a 4 x 4 matrix over the same weights, from the
grammar state before it to the one behind it; a conversation's matrices are
folded (their number is bounded by the square root of the rows, and no text is
among them), and its segments make their parts of the text side by side. Only
the digest of the whole takes these parts in order, as few rows.

Defined results: null roles and texts are one space, null ids one conversation; a
row of an empty role can be given one but not be kept;
rows go by turn (nulls first), then role, then a hash of the text, then the text;
equal rows (ties) are interchangeable and the later ones duplicates; a row whose
``present`` is false only names its conversation; a conversation without rows has
zeros, an empty audit and the digest of the empty text; very long texts pass
through a worker one batch at a time; an empty table gives an empty table; other
columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import Scratch, durable

#: Rows up to which a conversation is one group, and the least rows of a segment of a longer one.
SEGMENT = 512
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Grammar: start, after s, after u, after a. What a row of an initial leads to, and the role that may stand next.
AFTER = {b"s": {0: 1}, b"u": {0: 2, 1: 2, 3: 2}, b"a": {2: 3}}
NEXT = (2, 2, 3, 2)
ROLE = {2: b"user", 3: b"assistant"}
LEGAL = {b"su", b"ua", b"au"}
#: What must be inserted behind the last row, and its cost: the grammar accepts at the start and after a.
TAIL = ("", "II", "I", "")
END = tuple(INSERT * len(t) for t in TAIL)
NEVER = 1 << 40
_INITIALS = (b"s", b"u", b"a", b"")


def row_class(initial: bytes, delete: bool, truncated: bool) -> int:
    """0: must go; else 1 + 2 x (s, u, a, other) + truncated."""
    return 0 if delete else 1 + 2 * (_INITIALS.index(initial) if initial in AFTER else 3) + truncated


class Composed(dict):
    """(class of a row, costs to go behind it) -> (offset, costs to go before it, (labels, grammar state behind it) by grammar state before it)."""

    def __missing__(self, key: tuple[int, tuple]) -> tuple:
        kind, behind = key
        initial, extra = _INITIALS[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
        row = []
        for g in range(4):
            ways = [(DELETE + behind[g], "D", g)]
            if kind:
                ways.append((REROLE + extra + behind[NEXT[g]], "R", NEXT[g]))
                if g in AFTER.get(initial, ()):
                    ways.append((extra + behind[AFTER[initial][g]], "K", AFTER[initial][g]))
            row.append(min(ways))
        best = row
        for _ in range(2):  # inserts before the row
            best = [min(row[g], (INSERT + best[NEXT[g]][0], "I" + best[NEXT[g]][1], best[NEXT[g]][2])) for g in range(4)]
        least = min(b[0] for b in best)
        before = tuple(min(b[0] - least, NEVER) if b[0] < NEVER else NEVER for b in best)
        out = self[key] = (least, before, tuple(b[1:] for b in best))
        return out

    def walk_back(self, kinds: list[int], end: tuple) -> tuple[tuple, list]:
        """Costs to go before the first row, by grammar state, and each row's choices."""
        cost, v, choices = 0, end, []
        for kind in reversed(kinds):
            least, v, best = self[kind, v]
            cost += least
            choices.append(best)
        choices.reverse()
        return tuple(x + cost if x < NEVER else NEVER for x in v), choices

    @staticmethod
    def labels(choices: list, g: int) -> tuple[list[str], int]:
        out = []
        for best in choices:
            label, g = best[g]
            out.append(label)
        return out, g


def faults(roles: list[bytes], texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Per row its class, and how many rows are blank, duplicate, truncated."""
    kinds, count, seen = [], [0, 0, 0], set()
    for role, text in zip(roles, texts, strict=True):
        said = text.strip()  # of bytes: space and \\t to \\r
        again = (role, text) in seen
        seen.add((role, text))
        cut = said[-1:] not in (b".", b"!", b"?")
        fault = 0 if not said else 1 if again else 2 if cut else None
        if fault is not None:
            count[fault] += 1
        kinds.append(row_class(role[:1], fault in (0, 1), fault == 2))
    return kinds, count


def illegal(roles: list[bytes]) -> int:
    initials = [r.decode("utf-8", "replace")[:1].encode() for r in roles]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def messages_of(edits: list[str], roles: list[bytes], texts: list[bytes], g: int = 0, tail: str = "") -> list[tuple[str, bytes, bytes]]:
    """(edit, role, text) of what the edits leave, from grammar state g on."""
    out = []
    for labels, role, text in zip([*edits, tail], [*roles, b""], [*texts, b""], strict=True):
        for label in labels:
            if label == "D":
                continue
            if label == "K":
                g = AFTER[role[:1]][g]
            else:
                g = NEXT[g]
                role = ROLE[g] if label == "R" else role
            out.append((label, ROLE[g], b"") if label == "I" else (label, role, text))
    return out


def gaps_of(turns: list) -> int:
    there = [t for t in turns if t is not None]
    return max(there) - min(there) + 1 - len(set(there)) if there else 0


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "place long, edit string, role string, text string"


def _whole(machine: Composed, turns: list, roles: list[bytes], texts: list[bytes]) -> tuple[tuple, list]:
    """The report of one conversation, and its repaired messages."""
    kinds, count = faults(roles, texts)
    cost, choices = machine.walk_back(kinds, END)
    edits, g = machine.labels(choices, 0)
    left = messages_of(edits, roles, texts, tail=TAIL[g])
    digest = hashlib.sha256(b"\n".join(r + b":" + t for _, r, t in left)).hexdigest()
    return (gaps_of(turns), *count, illegal(roles), cost[0], "".join(edits) + TAIL[g], digest), left


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, turns, roles, texts) of each conversation in sorted batches of (conv_id, turn, present, role, text)."""
    held = None
    for batch in batches:
        convs, turns, present = (batch.column(k).to_pylist() for k in range(3))
        roles, texts = (batch.column(k).to_pylist() for k in (3, 4))
        for conv, turn, there, role, text in zip(convs, turns, present, roles, texts, strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    yield held
                held = (conv, [], [], [])
            if there:
                held[1].append(turn)
                held[2].append(role)
                held[3].append(text)
    if held is not None:
        yield held


def _prepared(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    space = F.lit(" ")
    return df.select(df[conv_col].alias("conv_id"), df[turn_col].cast("long").alias("turn"), F.coalesce(df[role_col].cast("string"), space).alias("role"),
                     F.coalesce(df[text_col].cast("string"), space).alias("text"), F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("present"))


def _short(rows: DataFrame, as_messages: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.withColumn("by", F.xxhash64("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "by", "text")
    dealt = dealt.select("conv_id", "turn", "present", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    schema = f"conv_id {kind}, {MESSAGES if as_messages else REPORT}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out, of_id, size = Composed(), [], None, 0

        def watched():
            nonlocal of_id
            for batch in batches:
                of_id = batch.schema.field(0).type
                yield batch

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], of_id), *(pa.array(c) for c in cols[1:])], names)

        for conv, turns, roles, texts in _grouped(watched()):
            report, left = _whole(machine, turns, roles, texts)
            if as_messages:
                out += [(conv, k, e, r.decode("utf-8", "replace"), t.decode("utf-8", "replace")) for k, (e, r, t) in enumerate(left)]
                size += sum(len(t) for _, _, t in left)
            else:
                out.append((conv, *report))
            if out and (len(out) >= 4096 or size >= 1 << 22):
                yield made()
                out, size = [], 0
        if out:
            yield made()

    return dealt.mapInArrow(run, schema)


def _same(a: str, b: str, *cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's matrix: the cost and the labels from each grammar state before it to each behind it."""
    machine = Composed()
    for batch in batches:
        out = []
        for rows in batch.column(2).to_pylist():
            rows = sorted(rows, key=lambda r: r["pos"])
            kinds, roles = [], []
            for r in rows:
                initial = r["initial"].encode()
                kinds += [row_class(initial, r["blank"] or r["again"], r["truncated"])] + [0] * (r["copies"] - 1)
                roles += [initial] * min(r["copies"], 2)
            kept = [r for r in rows if not r["blank"]]
            count = [sum(r["copies"] for r in rows if r["blank"]), sum(r["copies"] - 1 + bool(r["again"]) for r in kept), sum(r["truncated"] and not r["again"] for r in kept)]
            costs, labels = [NEVER] * 16, [""] * 16
            for behind in range(4):
                before, choices = machine.walk_back(kinds, tuple(0 if g == behind else NEVER for g in range(4)))
                for g in range(4):
                    if before[g] < NEVER:
                        costs[4 * g + behind], labels[4 * g + behind] = before[g], "".join(machine.labels(choices, g)[0])
            ranks = [sorted(labels[4 * g : 4 * g + 4]).index(labels[4 * g + b]) for g in range(4) for b in range(4)]
            # a row's own copies follow each other: each but the first makes an illegal pair
            inner = illegal(roles) + sum(max(r["copies"] - 2, 0) for r in rows)
            out.append((costs, ranks, labels, roles[0].decode(), roles[-1].decode(), inner, *count))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in zip(*out, strict=True))], _MATRIX)


_MATRIX = ["conv_id", "segment", "costs", "ranks", "labels", "head", "foot", "illegal", "blank", "duplicate", "truncated"]


def _fold(table: pa.Table) -> pa.Table:
    """The shortest path through a conversation's matrices: the grammar state before and behind each segment."""
    table = table.sort_by("segment")
    v, best = list(END), []
    for c, r in zip(reversed(table["costs"].to_pylist()), reversed(table["ranks"].to_pylist()), strict=True):
        ways = [min((c[4 * g + b] + v[b], r[4 * g + b], b) for b in range(4)) for g in range(4)]
        v = [min(w[0], NEVER) for w in ways]
        best.append([w[2] for w in ways])
    states, g = [], 0
    for to in reversed(best):
        states.append((g, to[g]))
        g = to[g]
    heads, feet, n = table["head"].to_pylist(), table["foot"].to_pylist(), table.num_rows
    between = [0] + [int((a + b).encode() not in LEGAL) for a, b in zip(feet, heads[1:], strict=False)]
    new = {"before": pa.array([a for a, _ in states], pa.int32()), "behind": pa.array([b for _, b in states], pa.int32()), "tail": [""] * (n - 1) + [TAIL[g]],
           "between": pa.array(between, pa.int64()), "cost": pa.array([v[0]] + [0] * (n - 1), pa.int64())}
    return pa.table({"conv_id": table["conv_id"], "segment": table["segment"], **new})


def _long(rows: DataFrame, n_rows: int, segment: int, as_messages: bool, scratch: Scratch) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    size = max(segment, math.isqrt(n_rows))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("by", F.xxhash64("text"))
    placed = counted.repartitionByRange("conv_id", "turn", "role", "by").sortWithinPartitions("conv_id", "turn", "role", "by", "text").withColumn("pos", F.monotonically_increasing_id())
    # places count on within a partition, whose number stands in the upper bits: a segment never spans two
    within = F.col("pos").bitwiseAND((1 << 33) - 1)
    segment_id = F.shiftleft(F.shiftright("pos", 33), 33) + F.floor(within / size)
    placed = scratch(placed.withColumn("segment", segment_id).drop("by"), "talk-placed")
    said = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    small = placed.select("conv_id", "segment", "pos", "role", "copies", F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"),
                          (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    small = scratch(small, "talk-marked")
    first = small.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = small.alias("s").join(first.alias("f").hint("merge"), _same("s", "f", "conv_id", "role", "digest"), "left")
    again = F.coalesce(F.col("s.pos") > F.col("f.first"), F.lit(False))
    one = F.struct("s.pos", "s.copies", "s.initial", "s.blank", again.alias("again"), (F.col("s.cut") & ~F.col("s.blank")).alias("truncated"))
    cut = marked.groupBy("s.conv_id", "s.segment").agg(F.collect_list(one).alias("rows"))
    matrices = scratch(cut.mapInArrow(_matrices, (
        f"conv_id {kind}, segment long, costs array<long>, ranks array<long>, labels array<string>, head string, foot string, illegal long, blank long, duplicate long, truncated long")), "talk-matrices")
    path = matrices.select("conv_id", "segment", "costs", "ranks", "head", "foot").groupBy("conv_id").applyInArrow(
        _fold, f"conv_id {kind}, segment long, before int, behind int, tail string, between long, cost long")
    known = matrices.alias("m").join(path.alias("p"), _same("m", "p", "conv_id", "segment")).select(
        "m.conv_id", "m.segment", "p.before", "p.tail", F.col("m.labels")[4 * F.col("p.before") + F.col("p.behind")].alias("edits"),
        (F.col("m.illegal") + F.col("p.between")).alias("illegal"), "m.blank", "m.duplicate", "m.truncated", "p.cost")
    known = scratch(known, "talk-paths")

    def mended(rows_of: pa.Table, path_of: pa.Table) -> list:
        rows_of, way = rows_of.sort_by("pos"), path_of.slice(0, 1).to_pylist()[0]
        edits, roles, texts = [], [], []
        for role, text, copies in zip(*(rows_of[c].to_pylist() for c in ("role", "text", "copies")), strict=True):
            roles += [role.encode()] * copies
            texts += [text.encode()] * copies
        part = ""
        for label in way["edits"]:
            part += label
            if label != "I":
                edits.append(part)
                part = ""
        return messages_of(edits, roles, texts, way["before"], way["tail"])

    def with_ids(path_of: pa.Table, n: int, new: dict) -> pa.Table:
        """A table of n rows that bear the path's id and segment."""
        of = path_of.slice(0, 1).select(["conv_id", "segment"]).take(pa.array([0] * n, pa.int64()))
        return pa.table({"conv_id": of["conv_id"], "segment": of["segment"], **new})

    def as_rows(rows_of: pa.Table, path_of: pa.Table) -> pa.Table:
        left = mended(rows_of, path_of)
        text = {"edit": [e for e, _, _ in left], "role": [r.decode() for _, r, _ in left], "text": [t.decode() for _, _, t in left]}
        return with_ids(path_of, len(left), {"place": pa.array(range(len(left)), pa.int64()), **{k: pa.array(v, pa.string()) for k, v in text.items()}})

    def as_text(rows_of: pa.Table, path_of: pa.Table) -> pa.Table:
        left = mended(rows_of, path_of)
        return with_ids(path_of, 1, {"n": pa.array([len(left)], pa.int64()), "piece": pa.array([b"\n".join(r + b":" + t for _, r, t in left)], pa.binary())})

    ways = known.select("conv_id", "segment", "before", "tail", "edits")
    both = placed.select("conv_id", "segment", "pos", "role", "text", "copies").groupBy("conv_id", "segment").cogroup(ways.groupBy("conv_id", "segment"))
    if as_messages:
        out = scratch(both.applyInArrow(as_rows, f"conv_id {kind}, segment long, {MESSAGES}"), "talk-messages")
        sizes = out.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = sizes.select("conv_id", "segment", before.alias("base"))
        return out.alias("o").join(base.alias("b"), _same("o", "b", "conv_id", "segment")).select("o.conv_id", (F.col("o.place") + F.col("b.base")).alias("place"), "o.edit", "o.role", "o.text")
    pieces = both.applyInArrow(as_text, f"conv_id {kind}, segment long, n long, piece binary").where("n > 0").repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One running digest: pieces come by conversation and segment."""
        now, sha, of_id = None, None, None
        for batch in batches:
            of_id = batch.schema.field(0).type
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], of_id), pa.array([sha.hexdigest()])], ["conv_id", "sha"])
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(piece.as_buffer())
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], of_id), pa.array([sha.hexdigest()])], ["conv_id", "sha"])

    sha = pieces.mapInArrow(digests, f"conv_id {kind}, sha string")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", F.concat("edits", "tail").alias("e")))), lambda x: x["e"]), "")
    total = known.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), audit.alias("audit"))
    turns = placed.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = total.alias("t").join(turns.alias("g"), _same("t", "g", "conv_id"), "left").join(sha.alias("h"), F.col("t.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    return out.select("t.conv_id", F.coalesce("g.gaps", F.lit(0)).alias("gaps"), "t.blank", "t.duplicate", "t.truncated", "t.illegal", "t.cost", "t.audit",
                      F.coalesce("h.sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _repair(df: DataFrame, cols: tuple[str, str, str, str], present: Column | None, segment: int, as_messages: bool) -> DataFrame:
    rows = _prepared(df, *cols, present)
    with Scratch() as scratch:
        long = scratch(rows.where("present").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment), "talk-long")
        n_rows = long.agg(F.sum("n")).first()[0]
        if not n_rows:
            return _short(rows, as_messages)
        there = rows.alias("r").join(long.select("conv_id").alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")), "left_semi").where("present").drop("present")
        rest = rows.alias("r").join(long.select("conv_id").alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id")), "left_anti")
        return durable(_short(rest, as_messages).unionByName(_long(there, n_rows, segment, as_messages, scratch)), "talk-mended")


def report(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _repair(df, (conv_col, turn_col, role_col, text_col), present, segment, False)


def messages(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text of every message."""
    return _repair(df, (conv_col, turn_col, role_col, text_col), present, segment, True)

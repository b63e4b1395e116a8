"""Conversation repair against an exhaustive search, whole and in segments, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from lectern.llm import conversations, queries
from lectern.llm.common import table

GRAMMAR = re.compile("(s?(ua)+)?")
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit) over all edits of (initial, must go, truncated), by plain enumeration of what may still be said."""

    @cache
    def from_here(i, said):  # said: the role initials so far, cut to what matters
        ways = []
        if i == len(rows):
            if GRAMMAR.fullmatch(said):
                ways.append((0, ""))
        else:
            initial, go, cut = rows[i]
            ways.append(plus(4, "D", from_here(i + 1, said)))
            if not go:
                ways.append(plus(3 * cut, "K", from_here(i + 1, said + initial)) if initial and fits(said + initial) else None)
                ways += [plus(3 + 3 * cut, "R", from_here(i + 1, said + r)) for r in "ua" if fits(said + r)]
        if len(said) < len(rows) + 5:
            ways += [plus(3, "I", from_here(i, said + r)) for r in "ua" if fits(said + r)]
        return min((w for w in ways if w is not None), default=None)

    def fits(said):
        return re.fullmatch("s?(ua)*u?", said) is not None

    def plus(cost, label, rest):
        return None if rest is None else (cost + rest[0], label + rest[1])

    return from_here(0, "")


def plain(turns, roles, texts):
    """The report of one conversation whose rows are in order."""
    seen, rows, count = set(), [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            count[fault] += 1
        rows.append((role[:1], fault in (0, 1), fault == 2))
    cost, audit = cheapest(tuple(rows))
    out, k = [], 0
    n = len(re.sub("D", "", audit))
    want = ("s" if n % 2 else "") + "ua" * (n // 2)
    for label in audit:
        if label == "D":
            k += 1
            continue
        role = {"u": "user", "a": "assistant", "s": None}[want[len(out)]]
        if label == "I":
            out.append(f"{role}:")
            continue
        out.append(f"{roles[k] if label == 'K' else role}:{texts[k]}")
        k += 1
    there = [t for t in turns if t is not None]
    gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "unit"]
    return [(rng.choice([None, *range(n + 3)]), rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(["Yes.", "no", " \t", "", "Oh?", "a!\n", "b c", "é."])) for _ in range(n)]


def test_whole_conversations_equal_an_exhaustive_search():
    rng, machine = random.Random(3), conversations.Composed()
    for _ in range(1500):
        rows = random_conversation(rng, rng.choice([0, 1, 2, 3, 4, 5, 6]))
        roles, texts = [r for _, r, _ in rows], [t for _, _, t in rows]
        got, left = conversations._whole(machine, [t for t, _, _ in rows], [r.encode() for r in roles], [t.encode() for t in texts])
        assert got == plain([t for t, _, _ in rows], roles, texts), rows
        assert GRAMMAR.fullmatch("".join(r.decode()[:1] for _, r, _ in left))


@pytest.fixture(scope="module")
def talks(spark):
    rng, data = random.Random(8), []
    for conv in [*range(40), None]:
        data += [(conv, *r) for r in random_conversation(rng, rng.choice([1, 3, 9, 30]))]
    data += [(77, None, "user", "same.")] * 30 + [(77, k, "user", "same.") for k in range(20)] + [(78, 1, None, None)] * 3
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in ("pos", "segment", "copies", "present", "cost", "edit", "by")))


def test_segments_give_what_whole_conversations_give(spark, talks):
    want = sorted(map(tuple, conversations.report(talks).collect()), key=repr)
    for segment in (1, 2, 7):
        got = conversations.report(talks, segment=segment)
        assert sorted(map(tuple, got.select("conv_id", *FIELDS).collect()), key=repr) == want
    assert len(want) == 43
    as_rows = sorted(map(tuple, conversations.messages(talks).collect()), key=repr)
    assert sorted(map(tuple, conversations.messages(talks, segment=3).collect()), key=repr) == as_rows
    said = {}
    for conv, _, _, role, text in sorted(as_rows, key=lambda r: (repr(r[0]), r[1])):
        said.setdefault(conv, []).append(f"{role}:{text}")
    assert {r[0]: r[-1] for r in want} == {r[0]: hashlib.sha256("\n".join(said.get(r[0], [])).encode()).hexdigest() for r in want}


def test_edge_rows(spark):
    schema = "conv_id string, turn int, role string, text string, there boolean"
    long = "word " * 200_000 + "end."
    data = [("a", 0, "user", "Hi.", True), ("a", 2, "assistant", long, True), ("b", 0, "user", "x", False), ("c", None, None, None, True), (None, 0, "assistant", "Yo.", True)]
    df = spark.createDataFrame(data, schema)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(df, present=df["there"]).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got["a"] == (1, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:Hi.\nassistant:{long}".encode()).hexdigest())
    assert got["b"] == (0, 0, 0, 0, 0, 0, "", empty) and got["c"] == (0, 1, 0, 0, 0, 4, "D", empty)
    assert got[None] == (0, 0, 0, 0, 0, 3, "IK", hashlib.sha256(b"user:\nassistant:Yo.").hexdigest())
    assert conversations.report(df.limit(0)).count() == 0 and conversations.messages(df.limit(0)).count() == 0


def test_the_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    talk = {}
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        rows = talk.setdefault(r["conv_id"], [])
        fault, role, text = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20, r["role"], r["text"]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(r["turn"], "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    want = {c: plain(*([r[k] for r in rows] for k in range(3))) for c, rows in talk.items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf).collect()} == want

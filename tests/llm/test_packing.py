"""Packing: every token in one piece, gapless full windows, and ids equal to the tokenizer's own."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import packing, queries
from lectern.llm.common import table

JSON = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 6))
def test_packer_keeps_every_token_once_in_full_windows(lengths, n_open):
    windows = []
    packer = packing.Packer(16, n_open, windows.append)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n))
        assert len(packer.held) <= n_open and all(sum(len(p[2]) for p in w) == 16 for w in windows)
    left = packer.finish()
    assert sum(len(p[2]) for p in left) < 16
    seen = sorted((d, s + i, x) for w in [*windows, left] for d, s, ids in w for i, x in enumerate(ids.tolist()))
    assert seen == [(k, i, i) for k, n in enumerate(lengths) for i in range(n)]


def test_placement_is_best_fit_and_the_fullest_is_filled():
    windows = []
    packer = packing.Packer(16, 2, windows.append)
    for doc, n in (("a", 10), ("b", 13), ("c", 3)):
        packer.add(doc, np.arange(n))
    assert [[p[0] for p in w] for w in windows] == [["b", "c"]]
    packer.add("d", np.arange(9))
    packer.add("e", np.arange(8))  # neither room 6 nor room 7 takes it: the fullest, of room 6, takes a part
    assert [(p[0], p[1], len(p[2])) for p in windows[-1]] == [("a", 0, 10), ("e", 0, 6)]
    assert [(p[0], p[1], len(p[2])) for p in packer.finish()] == [("d", 0, 9), ("e", 6, 2)]


def whole(got, docs, tokenizer, window=1024):
    """Checks pieces against the tokenizer's ids of (doc_id, text) with distinct ids."""
    pieces, filling = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        filling[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    short = 0
    for parts in filling.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and at & (at - 1) == 0 and all(p[2] == at for p in parts)
        short += at < window
    assert short <= window.bit_length()


def test_the_query_packs_every_document(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    whole(queries.op12_packing(spark, sf).collect(), docs, tokenizer)


def test_leftovers_merge_in_rounds(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    docs = [(k, "lorem ipsum " * (k % 37)) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7, "doc_id")
    got = packing.pack(df, JSON, public.PATTERN, n_open=3, window=64)
    whole(got.collect(), docs, tokenizer, 64)


def test_edge_rows_and_ids_of_sequences(spark, tokenizer):
    docs = [("a", None), ("b", ""), ("c", "x " * 40_000), (None, "one two"), ("d", "<|endoftext|> é\u0085  ｆ 👍🏽"), ("e", "one two")]
    df = spark.createDataFrame(docs, "key string, body string").select("*", *(F.lit(1).alias(c) for c in ("ids", "part", "length", "sequence_id", "doc_id")))
    got = packing.pack(df, JSON, public.PATTERN, "key", "body", with_ids=True)
    whole(got.collect(), docs, tokenizer)
    made = packing.sequences(got, padding=7).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in made)
    assert sum(r["n_tokens"] for r in made) == got.agg(F.sum("length")).first()[0]
    part = got.where("doc_id is null").first()
    assert np.frombuffer(part["ids"], "<u4").tolist() == [*tokenizer.encode("one two").ids, 0]
    three = got.where("sequence_tokens < 1024").limit(1).select("sequence_id", F.lit(3).cast("long").alias("length"), F.lit(0).cast("long").alias("offset"), F.lit(b"\1\0\0\0" * 3).alias("ids"))
    assert np.frombuffer(packing.sequences(three, padding=7).first()["ids"], "<u4").tolist() == [1] * 3 + [7] * 1021
    assert packing.pack(df.limit(0), JSON, public.PATTERN, "key", "body").count() == 0
    twins = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert packing.pack(twins, JSON, public.PATTERN).agg(F.sum("length")).first()[0] == 2 * len([*tokenizer.encode("same").ids, 0])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizers(text):
    got = packing.coder(JSON, public.PATTERN).encode_to_numpy(text.encode("utf-8", "replace").decode(), disallowed_special=())
    t = _own()
    assert got.tolist() == t.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def _own(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(JSON))
        kept[0].encode_special_tokens = True
    return kept[0]

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, license_scan, minhash, pii, quality_classifier, quality_rules, secret_scan, toxicity, warc

LONG = "word and the other " * 20_000 + "all rights reserved token = \"abcdef123456\" a@b.example.org"
TEXTS = [(1, "All rights reserved."), (1, "All rights reserved."), (2, None), (3, ""), (None, "cc by token: abcdefgh"), (4, LONG), (5, "a b c"), (6, "\n\n \t")]
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, data):
    extra = [F.lit("x").alias(c) for c in ("n_words", "spans", "_words", "kept", "rid", "key", "bands", "token", "severity", "n_tokens", "band", "rep", "base", "_id")]
    return spark.createDataFrame(data, "doc_id long, text string").select("*", *extra)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (8, None), (9, "")], "item_id long, text string")
    return {
        "op1": license_scan.report, "op2": secret_scan.report, "op4": lambda d: quality_classifier.resample(d, labels), "op5": lambda d: toxicity.report(d, labels),
        "op6": quality_rules.judge, "op7": lambda d: bpe.annotate(d, RANKS, tokenizers.PATTERN), "op8": minhash.classes, "op9": pii.report,
        "op10": lambda d: decontamination.report(d, bench),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_edge_rows_and_empty_table(spark, name):
    op = operators(spark)[name]
    got = op(frame(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    twins = [r for r in got if r["doc_id"] == 1]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert op(frame(spark, [])).count() == 0


def test_values_on_edge_rows(spark):
    d = frame(spark, TEXTS)
    lic = {r["doc_id"]: r for r in license_scan.report(d).collect()}
    assert lic[1]["base_labels"] == "reserved" and (lic[1]["first_word"], lic[1]["n_base"]) == (0, 1)
    assert lic[2]["n_words"] == 0 and lic[2]["first_word"] is None and lic[None]["base_labels"] == "cc-by"
    assert lic[4]["n_base"] == 1 and lic[4]["first_word"] == 80_000
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.report(d).collect()} == {1: 0, 2: 0, 3: 0, None: 1, 4: 1, 5: 0, 6: 0}
    assert {r["doc_id"]: r["n_email"] for r in pii.report(d).collect()}[4] == 1
    cls = {r["doc_id"]: r for r in minhash.classes(d).collect()}
    assert cls[1]["n_copies"] == 2 and cls[2]["class_id"] == 2 and cls[3]["class_id"] == 3
    con = {r["doc_id"]: r for r in decontamination.report(d, spark.createDataFrame([(7, "a B c")], "item_id long, text string")).collect()}
    assert con[5]["contaminated"] and con[5]["n_hit"] == 3 and not con[4]["contaminated"]


def test_warc_edges(spark):
    big = "x" * 120
    torn = "head\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + big
    rows = [(3, "u", big), (1, None, big), (2, "u v\r\nX: y", torn), (4, "u", None), (5, "u", ""), (1, "u", big), (None, "u", big), (6, "é", "WARC/1.1\r\n"), (7, "u", "tiny"), (8, "u", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("payload", F.lit("y"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.report(pages).collect()), key=repr)
    want = [(3, 120, "revisit", 1), (1, 120, "response", None), (1, 120, "response", None), (2, len(torn), "response", None), (4, 0, "response", None),
            (5, 0, "response", None), (None, 120, "revisit", 1), (6, 10, "response", None), (7, 4, "response", None), (8, 4, "response", None)]
    assert got == sorted(want, key=repr)
    import hashlib

    digest = {r["page_id"]: r["payload_digest"] for r in warc.report(pages).collect()}
    assert digest[2] == hashlib.sha256(torn.encode()).hexdigest() and digest[3] == hashlib.sha256(big.encode()).hexdigest()
    assert warc.report(pages.limit(0)).count() == 0

"""Passages are found wherever they stand in a text."""

import random

from pyspark.sql import functions as F

from lectern.operators import align
from lectern.plans import documents


def _tables(spark, monkeypatch, needle, hay):
    b = spark.createDataFrame([(1, needle)], "item_id long, text string")
    d = spark.createDataFrame([(1, hay)], "doc_id long, text string")
    monkeypatch.setattr(documents, "table", lambda spark, sf, name: {"benchmark": b, "documents": d}[name])


def test_a_late_passage_of_a_long_needle_is_found(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    needle = "common head " * 8 + " ".join(word() for _ in range(12))
    hay = " ".join(word() for _ in range(2200))
    at = 14_600
    hay = "common head " * 8 + hay[: at - 96] + needle + hay[at:]
    _tables(spark, monkeypatch, needle, hay)
    got = documents.QUERIES["fuzzy_locate"](spark, "").first()
    brute = max((align.ratio(hay[i : i + len(needle)], needle), -i) for i in range(at - 20, at + 20))
    assert -brute[1] == at and abs(got["found_at"] - at) <= 4 and got["score"] > 0.9
    assert documents.QUERIES["seeded_locate"](spark, "").select(F.col("found_at")).first()[0] == at


def test_a_place_after_sixty_four_others_counts():
    needle = "the same opening words and then its own end"
    hay = "the same opening words zzzzz qqqqq xxxxx kkkkk. " * 90 + needle
    assert align.seeded_locate(needle, hay) == hay.rindex("the same")

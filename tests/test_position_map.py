"""Letters and digits with their places against a plain walk."""

from pyspark.sql import functions as F

from lectern.functions import cleaning


def test_places_are_those_of_a_plain_walk_without_a_match_for_each_letter(spark, capsys):
    texts = ["", None, "  a", "Éa \n\t b-C", "x\u0001 y", "\U0001f600 Q\U0001d7d8 z", "a - b", "  k l ", "1.2  "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", cleaning.position_map(F.col("t")).alias("m"))
    for r in df.collect():
        t, want, before = texts[r["k"]], [], 1
        for at, ch in enumerate(t or ""):
            kind = 1 if ch in " \t\n\x0b\x0c\r" else 2 if ch.isalpha() or ch.isnumeric() else 0
            if kind == 2 or kind == 1 and before == 2:
                want.append((" " if kind == 1 else ch.lower(), at))
            before = kind or before
        assert (r["m"] if t is None else [(x["ch"], x["at"]) for x in r["m"]]) == (None if t is None else want), t
    df.explain()
    assert "rlike" not in capsys.readouterr().out.lower()

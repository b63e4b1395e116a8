"""Bands that are split: what stands twice, and what a task has to hold for it."""

from lectern.operators import extraction


def test_bands_and_cuts_that_stand_twice_count_once_without_a_table_of_rows(spark, capsys):
    bands = spark.createDataFrame([("a", 0, 90), ("a", 0, 90), ("a", 50, 140), ("b", 10, 20), ("c", None, 5), ("c", None, 5), (None, 1, 9)], "doc string, y0 long, y1 long")
    cuts = spark.createDataFrame([("a", 60), ("a", 60), ("a", 0), ("a", 90), ("b", 10), ("b", 20), ("c", 3), (None, 4), ("a", None)], "doc string, y long")
    done = extraction.split_bands(bands, cuts, ["doc"])
    got = sorted((tuple(r) for r in done.select("doc", "number", "start", "end").collect()), key=repr)
    want = [("a", 1, 0, 60), ("a", 2, 50, 60), ("a", 3, 60, 90), ("a", 4, 60, 90), ("a", 5, 90, 140), ("b", 1, 10, 20), ("c", 1, None, 5), (None, 1, 1, 9)]
    assert got == sorted(want, key=repr)
    done.explain()
    assert "Aggregate" not in capsys.readouterr().out

from datetime import datetime

import __spark_entry__ as entry
from lectern.operators import joins


def test_seconds_of_the_as_of_join_are_rounded_and_nulls_meet_nothing(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 0, 10, 600000), 1, "view"), (2, datetime(2024, 1, 1, 0, 0, 10, 900000), 1, "click"), (3, datetime(2024, 1, 1, 0, 0, 11, 500000), 1, "view"),
            (4, datetime(2024, 1, 1, 0, 0, 10, 400000), 1, "click"), (5, None, 1, "view"), (6, None, 1, "click"), (7, datetime(2024, 1, 1), None, "view"), (8, datetime(2024, 1, 1), None, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["banner"] for r in entry.queries()["asof_section"](spark, str(tmp_path)).collect()}
    assert got == {2: 1, 4: None, 6: None, 8: None}


def test_occurrences_of_one_place_are_taken_as_they_stand(spark, tmp_path):
    rows = [(1, 7, 1, 10), (1, 7, 1, 20), (1, 7, 1, 30)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in entry.queries()["occurrence_join"](spark, str(tmp_path)).collect()] == [(7, 10, 10, 3)]
    some = spark.createDataFrame([(1, 5, None), (1, 6, "a"), (1, None, "b"), (1, 9, "c")], "code long, seq long, body string")
    assert [tuple(r) for r in joins.occurrence_pairs(some, "code", "seq", "body").collect()] == [(1, "a", "c", 4)]

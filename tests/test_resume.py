"""Taking up work again, and the checks of declared sums and shared images."""

import pytest

from lectern.operators import quality
from lectern.sources import resume


def test_a_run_that_dies_is_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "done")
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (3, "c"), (None, "d")], "id int, name string")
    ran = lambda: sorted((r["id"] or 0, r["name"]) for r in spark.read.parquet(path).collect())
    resume.run_pending(jobs.where("id = 1"), path, "id", lambda j: j)
    with pytest.raises(Exception):
        resume.run_pending(jobs, path, "id", lambda j: j.selectExpr("id", "if(id = 3, raise_error('lost'), name) as name"))
    assert ran() == [(1, "a")]
    resume.run_pending(jobs.where("id is not null"), path, "id", lambda j: j)
    assert ran() == [(1, "a"), (2, "b"), (2, "b2"), (3, "c")]
    assert [r["name"] for r in resume.pending(jobs, path, "id").collect()] == ["d"]
    resume.run_pending(jobs.where("id is not null"), path, "id", lambda j: j)
    assert len(ran()) == 4
    with pytest.raises(ValueError):
        resume.run_pending(jobs, path, "id", lambda j: j.select("name"))


def test_sums_totals_and_images(spark):
    q = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (2, "x"), (None, None)], "book int, image string")
    b = spark.createDataFrame([(1, 3), (2, 3), (3, 0), (4, None), (5, 1)], "book int, n int")
    one = lambda df: tuple(df.first())
    assert one(quality.same_total(q, b, "n")) == (False, 1) and one(quality.same_total(q.limit(0), b.limit(0), "n")) == (True, 0)
    assert one(quality.totals_agree(b, q, "book", "n")) == (False, 2)
    assert one(quality.unshared(q, "image")) == (False, 2) and one(quality.unshared(q.limit(0), "image")) == (True, 0)

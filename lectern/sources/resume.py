"""Work that is taken up where it stopped: jobs by key, and a written table whose rows say which keys are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def done_keys(jobs: DataFrame, path: str, key: str) -> DataFrame:
    """(key): the keys that the table at ``path`` has; none where there is no table yet."""
    try:
        done = jobs.sparkSession.read.parquet(path)
    except AnalysisException:
        return jobs.select(key).limit(0)
    return done.select(F.col(key).cast(jobs.schema[key].dataType).alias(key)).distinct()


def pending(jobs: DataFrame, path: str, key: str) -> DataFrame:
    """The jobs whose key is not done. A null key is never done; a key that several rows have is one job."""
    return jobs.join(done_keys(jobs, path, key), key, "left_anti")


def run_pending(jobs: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Append ``work(pending jobs)`` to ``path``.

    The append is committed as one, so a run that dies leaves no key done and the next one takes its jobs up again; results and done keys cannot
    part, since they are the same rows. ``work`` has to return its key, and at least a row (an error is one) for each job that shall not come again.
    """
    out = work(pending(jobs, path, key))
    if key not in out.columns:
        raise ValueError(f"the work's result has no {key}")
    out.write.mode("append").parquet(path)

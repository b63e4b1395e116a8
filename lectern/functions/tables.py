"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class WalkNumbers:
    """``walk_numbers(TABLE(t) PARTITION BY ... ORDER BY ... [, first [, cap]])``: the rows whose ``n`` is the expected number.

    The rule is that of :func:`lectern.operators.sequence.expected_walk`: the first row accepted bears ``first`` (1), each further one the
    number after the last, and none one above ``cap``. Rows of a partition come in the order asked for and one at a time, so the state is one
    number. What comes out has the columns that went in; rows of a null number are passed over.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, first: AnalyzeArgument | None = None, cap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or "n" not in rows.dataType.fieldNames():
            raise ValueError("walk_numbers takes TABLE(...) with a column n")
        for a in (first, cap):
            if a is not None and (a.isTable or not a.isConstantExpression):
                raise ValueError("first and cap are constant numbers")
        return AnalyzeResult(schema=StructType([StructField(f.name, LongType() if f.name == "n" else f.dataType) for f in rows.dataType.fields]))

    def __init__(self) -> None:
        self.expected: int | None = None

    def eval(self, rows, first: int = 1, cap: int | None = None):
        if self.expected is None:
            self.expected = first
        if rows["n"] == self.expected and (cap is None or self.expected <= cap):
            self.expected += 1
            yield tuple(rows)


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("walk_numbers", WalkNumbers)

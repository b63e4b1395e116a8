"""Similarity measures. All but :func:`sequence_ratio` are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import matching


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def trigrams(c: Column) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    return F.when(F.length(c) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, which is neither an edit distance nor a Jaccard."""
    return pd.Series(matching.ratios([x or "" for x in a], [y or "" for y in b]), dtype="float64")

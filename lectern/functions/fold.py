"""A fold over an array that returns a longer array, in time linear in the items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items folded before what they gave is set aside: appending copies no more than that.
BLOCK = 128


def gathered(items: Column, state: Column, state_type: str, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays that ``step(state, item)`` returns beside the next state, joined in order; ``out_type`` is the type of one element."""
    def begin(s: Column) -> Column:
        return F.struct(s.cast(state_type).alias("s"), F.array().cast(f"array<{out_type}>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        following, new = step(acc["s"], x)
        return F.struct(following.cast(state_type).alias("s"), F.concat(acc["out"], new.cast(f"array<{out_type}>")).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        done = F.aggregate(b, begin(acc["s"]), one)
        # a lambda's own variable is evaluated once
        return F.transform(F.array(done), lambda d: F.struct(d["s"].alias("s"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")))[0]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(state.cast(state_type).alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("parts"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, start, block)["parts"])).otherwise(F.array().cast(f"array<{out_type}>"))

"""Stateful operators whose next state depends on what they accepted before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lectern.operators.progress import SRS_DAYS
from lectern.sources.scratch import Scratch, durable
from lectern.streaming.limits import DAY, Ledger


def srs_stream(events: DataFrame) -> DataFrame:
    """Spaced repetition as keyed stream state: (question_id, srs_level, times_wrong, next_us).

    ``events`` has question_id, kind, us (microseconds), event_id. Within a
    micro-batch a question's events are put in order; across batches they must arrive in order.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, wrong, due, present = state.get if state.exists else (0, 0, 0, False)
        for row in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples():
            if row.kind == "incorrect":
                level, wrong, due, present = 0, wrong + 1, row.us, True
            elif row.kind == "add" and not present:
                due, present = row.us, True
            elif row.kind == "correct" and present:
                level = min(level + 1, len(SRS_DAYS))
                due = row.us + SRS_DAYS[level - 1] * DAY
        state.update((int(level), int(wrong), int(due), bool(present)))
        if present:
            yield pd.DataFrame({"question_id": [key[0]], "srs_level": [level], "times_wrong": [wrong], "next_us": [due]})

    return events.groupBy("question_id").applyInPandasWithState(
        step, "question_id long, srs_level long, times_wrong long, next_us long", "level long, wrong long, due long, present boolean", "update", GroupStateTimeout.NoTimeout)


def ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key together and in order, for a fold that holds one key's state at a time."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def rate_limited(calls: DataFrame, per_minute: int = 15, per_day: int = 300, all_per_day: int | None = None) -> DataFrame:
    """``calls`` (caller, us, call_id) with ``verdict``: ok, minute, day or global. Rejected calls are not counted.

    The sliding minute is checked before the UTC day, and both begin anew at midnight. The state is one caller's
    accepted calls of the last minute, so memory does not grow with a caller's calls. Until all callers together have
    ``all_per_day`` accepted calls of a day, none depends on another's; after that call, in order, all of the day are
    rejected. So that call is found once the callers have been judged apart.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, ledger = object(), Ledger()
        for pdf in batches:
            verdicts = []
            for who, us in zip(pdf["caller"], pdf["us"], strict=True):
                if who != caller:
                    caller, ledger = who, Ledger()
                verdicts.append(ledger.call(us, per_minute, per_day))
            yield pdf[["caller", "us", "call_id"]].assign(verdict=verdicts)

    judged = ordered(calls.select("caller", "us", "call_id"), "caller", "us", "call_id").mapInPandas(run, "caller long, us long, call_id long, verdict string")
    if all_per_day is None:
        return judged
    day = F.floor(F.col("us") / DAY)
    nth = F.row_number().over(Window.partitionBy("_day").orderBy("us", "call_id"))
    # at most all_per_day rows of a day and task are ranked
    last = judged.where("verdict = 'ok'").select(day.alias("_day"), "us", "call_id").withColumn("_n", nth).where(F.col("_n") <= all_per_day).where(F.col("_n") == all_per_day)
    last = last.select("_day", F.struct("us", "call_id").alias("_last"))
    late = F.coalesce(F.struct("us", "call_id") > F.col("_last"), F.lit(False))
    return judged.withColumn("_day", day).join(last, "_day", "left").select("caller", "us", "call_id", F.when(late, "global").otherwise(F.col("verdict")).alias("verdict"))


def quota_ledger(calls: DataFrame, per_minute: int, per_day: int, tokens_per_day: int) -> DataFrame:
    """``calls`` (model, us, call_id, tokens, retry_s) with ``verdict``: the first check that fails, or ok.

    The checks in order: cooldown, server (the day is used up by the server's word), requests, tokens, minute. An accepted call counts its
    tokens, unless ``retry_s`` is set: then the server refused it, the model cools down for 1 to 3600 seconds, and beyond 300 it is out for
    the day. A day begins at UTC midnight. The state is one model's.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, ledger = object(), Ledger()
        for pdf in batches:
            verdicts = []
            for who, us, n, retry in zip(pdf["model"], pdf["us"], pdf["tokens"], pdf["retry_s"], strict=True):
                if who != model:
                    model, ledger = who, Ledger()
                verdicts.append(ledger.model(us, n, retry, per_minute, per_day, tokens_per_day))
            yield pdf[["model", "us", "call_id"]].assign(verdict=verdicts)

    rows = calls.select("model", "us", "call_id", "tokens", "retry_s")
    return ordered(rows, "model", "us", "call_id").mapInPandas(run, "model long, us long, call_id long, verdict string")


def cached(requests: DataFrame, ttl_us: int = 6 * 3_600_000_000) -> DataFrame:
    """``requests`` (key, us, request_id) with ``hit``: an entry stored less than the TTL ago answers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stored = object(), None
        for pdf in batches:
            hits = []
            for k, us in zip(pdf["key"], pdf["us"], strict=True):
                if k != key:
                    key, stored = k, None
                hit = stored is not None and us - stored < ttl_us
                stored = stored if hit else us
                hits.append(hit)
            yield pdf[["key", "us", "request_id"]].assign(hit=hits)

    return ordered(requests.select("key", "us", "request_id"), "key", "us", "request_id").mapInPandas(run, "key long, us long, request_id long, hit boolean")


#: Requests of one range, which is one task's.
RANGE = 1 << 18


def capped_cache(requests: DataFrame, ttl_us: int = 6 * 3_600_000_000, cap: int = 500, size: int = RANGE) -> DataFrame:
    """``requests`` (key, us, request_id) with ``hit`` for a cache over all keys: an entry answers while it is younger than the TTL, and where
    ``cap`` entries are held the one stored first goes before another is stored.

    The requests of all keys are one sequence, so they are dealt out by ranges of it (of about ``size`` each), and every range is run through from
    the entries that the range before it left in the last round; the first starts empty. A round runs those whose entries to start with have
    changed, side by side; when none has, all are right: the first range is after one round, and each round makes one more right at least. What
    was held before a range soon leaves the cache, so a few rounds do. A range's state, and what is passed on, is ``cap`` entries; keys don't
    matter to the dealing, so a hot one does no harm.
    """
    key_type = requests.schema["key"].dataType.simpleString()
    held = f"array<struct<key:{key_type},us:bigint>>"
    schema = f"block long, key {key_type}, us long, request_id long, hit boolean, held {held}"

    def through(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        cache = {e["key"]: e["us"] for e in (start["held"][0].as_py() if start.num_rows else [])}
        hits = []
        for key, us in zip(rows["key"].to_pylist(), rows["us"].to_pylist(), strict=True):
            since = cache.get(key)
            hit = since is not None and us - since < ttl_us
            if not hit:
                if since is not None:
                    del cache[key]
                elif len(cache) >= cap:
                    del cache[next(iter(cache))]
                cache[key] = us
            hits.append(hit)
        n, kinds = rows.num_rows, pa.list_(pa.struct([("key", rows.schema.field("key").type), ("us", pa.int64())]))
        left = pa.array([None] * n + [[{"key": k, "us": u} for k, u in cache.items()]], kinds)
        block = rows["block"].to_pylist()
        pad = lambda c, t: pa.array([*rows[c].to_pylist(), None], t)
        return pa.table({"block": pa.array([*block, block[0]], pa.int64()), "key": pad("key", rows.schema.field("key").type), "us": pad("us", pa.int64()),
                         "request_id": pad("request_id", pa.int64()), "hit": pa.array([*hits, None], pa.bool_()), "held": left})

    with Scratch() as scratch:
        rows = requests.select("key", F.col("us").cast("long").alias("us"), F.col("request_id").cast("long").alias("request_id"))
        n = max(1, -(-rows.count() // size))
        placed = rows.repartitionByRange(n, "us", "request_id").sortWithinPartitions("us", "request_id").withColumn("pos", F.monotonically_increasing_id())
        placed = scratch(placed.withColumn("block", F.shiftright("pos", 33)), "cache-placed")
        # ranges that hold no request are not there: each follows the one before it that is
        follows = placed.select("block").distinct().withColumn("next", F.lead("block").over(Window.orderBy("block")))
        follows = scratch(follows, "cache-follows")
        starts = placed.select("block").limit(0).withColumn("held", F.lit(None).cast(held))
        todo, rounds = follows.select("block"), []
        while not rounds or not todo.isEmpty():
            rows_of, starts_of = (placed.join(todo, "block", "left_semi"), starts.join(todo, "block", "left_semi")) if rounds else (placed, starts)
            run = rows_of.groupBy("block").cogroup(starts_of.groupBy("block")).applyInArrow(through, schema)
            rounds.append(scratch(run, "cache-round"))
            left = rounds[-1].where("held is not null").join(follows.where("next is not null"), "block").select(F.col("next").alias("block"), "held")
            new = scratch(starts.join(left.select("block"), "block", "left_anti").unionByName(left), "cache-starts")
            same = new.alias("a").join(starts.alias("b"), (F.col("a.block") == F.col("b.block")) & F.col("a.held").eqNullSafe(F.col("b.held")), "left_anti")
            todo, starts = scratch(same.select("a.block"), "cache-todo"), new
        last = rounds[0].select("block", F.lit(0).alias("round")).where(F.lit(False))
        for k, done in enumerate(rounds):
            last = last.unionByName(done.where("held is not null").select("block", F.lit(k).alias("round")))
        last = last.groupBy("block").agg(F.max("round").alias("round"))
        every = rounds[0].withColumn("round", F.lit(0))
        for k, done in enumerate(rounds[1:], 1):
            every = every.unionByName(done.withColumn("round", F.lit(k)))
        out = every.where("held is null").join(last, ["block", "round"], "left_semi")
        return durable(out.select("key", "us", "request_id", "hit"), "cache")


def failover(requests: DataFrame, pool: list[tuple[str, str]], wanted: str = "wanted", down: str = "down") -> DataFrame:
    """The model that answers: the wanted one, else the pool in order, leaving out those that are down; null if none is up."""
    names = F.array(*(F.lit(n) for n, _ in pool))
    order = F.array_distinct(F.filter(F.concat(F.array(F.col(wanted)), names), lambda x: x.isNotNull()))
    return requests.withColumn("model", F.get(F.filter(order, lambda x: ~F.array_contains(F.col(down), x)), F.lit(0)))


def intent(requests: DataFrame, matrix: dict[str, dict[str, str]], pool: list[str], hardness: str = "complexity", length: str = "length", usual: tuple[str, str] = ("standard", "medium")) -> DataFrame:
    """``requests`` with ``wanted``: the matrix's model for how hard and how long; unknown values count as ``usual``, a model outside the pool as its first."""
    row, cell = (F.when(F.col(c).isin(list(known)), F.col(c)).otherwise(u) for c, known, u in ((hardness, matrix, usual[0]), (length, matrix[usual[0]], usual[1])))
    pick = F.coalesce(*(F.when((row == r) & (cell == c), F.lit(m if m in pool else pool[0])) for r, cells in matrix.items() for c, m in cells.items()))
    return requests.withColumn("wanted", pick)

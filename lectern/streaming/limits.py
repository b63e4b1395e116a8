"""Rate limits as keyed streams: one caller's or one model's ledger as state, with timers that let it go.

A ledger is the accepted calls of the last minute and the day's counts. The same
rules judge batches (:mod:`lectern.streaming.state`), so a stream gives what a
batch over its rows gives, however its micro-batches are cut; calls of a key have
to arrive in order from one micro-batch to the next. Two event-time timers stand
for a key at most: when its last minute is over the list goes, and at UTC midnight
the counts do, so a caller who stays away costs no state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE, DAY = 60_000_000, 86_400_000_000


class Ledger:
    """Accepted calls of the last minute and what the day has used up; both begin anew at UTC midnight."""

    def __init__(self, recent=(), day: int = -1, requests: int = 0, tokens: int = 0, until: int = 0, out: bool = False):
        self.recent, self.day, self.requests, self.tokens, self.until, self.out = deque(recent), day, requests, tokens, until, out

    def at(self, us: int) -> None:
        if us // DAY != self.day:
            self.__init__(day=us // DAY)
        while self.recent and self.recent[0] <= us - MINUTE:
            self.recent.popleft()

    def call(self, us: int, per_minute: int, per_day: int) -> str:
        """A caller's call: the minute is checked before the day, and only accepted calls count."""
        self.at(us)
        verdict = "minute" if len(self.recent) >= per_minute else "day" if self.requests >= per_day else "ok"
        if verdict == "ok":
            self.recent.append(us)
            self.requests += 1
        return verdict

    def model(self, us: int, tokens, retry, per_minute: int, per_day: int, tokens_per_day: int) -> str:
        """A model's call: cooldown, server, requests, tokens, minute in this order. ``retry`` (seconds) means that the server refused an accepted call."""
        self.at(us)
        verdict = ("cooldown" if us < self.until else "server" if self.out else "requests" if self.requests >= per_day else "tokens" if self.tokens >= tokens_per_day
                   else "minute" if len(self.recent) >= per_minute else "ok")
        if verdict == "ok" and not pd.isna(retry):
            wait = int(max(1, min(retry or 20, 3600)))
            self.until, self.out = us + wait * 1_000_000, self.out or wait > 300
        elif verdict == "ok":
            self.requests, self.tokens, self.until = self.requests + 1, self.tokens + (0 if pd.isna(tokens) else int(tokens)), 0
            self.recent.append(us)
        return verdict


class _Limited(StatefulProcessor):
    def __init__(self, key: str, more: tuple[str, ...], limits: tuple[int, ...]):
        self.key, self.more, self.limits = key, more, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "us long")
        self.counts = handle.getValueState("counts", "day long, requests long, tokens long, until long, out boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["us", "call_id"])
        counts = self.counts.get() if self.counts.exists() else None
        ledger = Ledger([r[0] for r in self.recent.get()] if self.recent.exists() else (), *(counts or ()))
        judge = ledger.model if self.more else ledger.call
        verdicts = [judge(int(us), *more, *self.limits) for us, *more in zip(calls["us"], *(calls[c] for c in self.more), strict=True)]
        self.counts.update((int(ledger.day), int(ledger.requests), int(ledger.tokens), int(ledger.until), bool(ledger.out)))
        if ledger.recent:
            self.recent.put([(int(us),) for us in ledger.recent])
            self.handle.registerTimer((ledger.recent[-1] + MINUTE) // 1000 + 1)
        elif self.recent.exists():
            self.recent.clear()
        self.handle.registerTimer((ledger.day + 1) * DAY // 1000)
        yield pd.DataFrame({self.key: [key[0]] * len(calls), "us": calls["us"].to_numpy(), "call_id": calls["call_id"].to_numpy(), "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.recent.exists() and all(r[0] <= now - MINUTE for r in self.recent.get()):
            self.recent.clear()
        if self.counts.exists() and self.counts.get()[0] < now // DAY:
            self.counts.clear()
            if self.recent.exists():
                self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def _stream(calls: DataFrame, key: str, more: tuple[str, ...], limits: tuple[int, ...], late: str) -> DataFrame:
    timed = calls.select(key, "us", "call_id", *more, F.timestamp_micros("us").alias("_at")).withWatermark("_at", late)
    kind = calls.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(_Limited(key, more, limits), f"{key} {kind}, us long, call_id long, verdict string", "Append", "EventTime")


def rate_limited_stream(calls: DataFrame, per_minute: int = 15, per_day: int = 300, late: str = "1 minute") -> DataFrame:
    """A stream of ``calls`` (caller, us, call_id) with ``verdict``: ok, minute or day. What comes ``late`` behind the newest call is dropped."""
    return _stream(calls, "caller", (), (per_minute, per_day), late)


def quota_stream(calls: DataFrame, per_minute: int, per_day: int, tokens_per_day: int, late: str = "1 minute") -> DataFrame:
    """A stream of ``calls`` (model, us, call_id, tokens, retry_s) with ``verdict``: the first check that fails, or ok."""
    return _stream(calls, "model", ("tokens", "retry_s"), (per_minute, per_day, tokens_per_day), late)

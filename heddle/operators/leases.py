"""Leases with fencing tokens: who may work on an item, until when, and whose result still counts.

Events of an item, in order of time and then of seq:

* `claim`: granted if the item is pending, its next time has come and its attempts aren't used up. Each grant has the
  next token, and a lease of `lease` microseconds.
* `renew`, `complete`, `fail` with a token: taken only with the token of the running attempt, before its lease ends; any
  other is `stale`. A renewed lease counts from then. A failed attempt leaves the item pending again after a delay that doubles
  from `initial` up to `most`, or failed for good when no attempt is left.
* a lease that ends without these is `expired`, and its attempt has failed.

The fold is the same on a table (`folded`) and on a stream with timers (`heddle.streaming.online.leases`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "item string, at long, seq long, outcome string, token long, state string"


@dataclass
class Policy:
    lease: int
    attempts: int
    initial: int
    most: int


@dataclass
class Item:
    """state: pending, running, completed or failed; until: the end of the lease; due: when a pending item may be claimed."""

    state: str = "pending"
    token: int = 0
    until: int = 0
    due: int = 0

    def values(self) -> tuple:
        return astuple(self)

    def _failed(self, at: int, p: Policy) -> None:
        more = self.token < p.attempts
        self.state = "pending" if more else "failed"
        if more:
            self.due = at + min(p.most, p.initial << (self.token - 1))

    def expire(self, now: int, p: Policy) -> tuple | None:
        """Ends a lease whose time is over: (at, outcome, token, state)."""
        if self.state != "running" or self.until > now:
            return None
        self._failed(self.until, p)
        return self.until, "expired", self.token, self.state

    def apply(self, at: int, kind: str, token: int | None, p: Policy) -> str:
        """The outcome of an event; leases that are over by then have been ended."""
        if kind == "claim":
            if self.state != "pending":
                return f"refused_{self.state}"
            if self.due > at:
                return "refused_not_due"
            self.state, self.token, self.until = "running", self.token + 1, at + p.lease
            return "granted"
        if self.state != "running" or token != self.token:
            return "stale"
        if kind == "renew":
            self.until = at + p.lease
            return "renewed"
        if kind == "complete":
            self.state = "completed"
            return "completed"
        self._failed(at, p)
        return "failed"


def rows_of(item: Item, name: str, events: Iterator[tuple], policy: Policy) -> Iterator[tuple]:
    """Rows of OUT for an item's events (at, seq, kind, token) in order; the item is left as it is after them."""
    for at, seq, kind, token in events:
        if ended := item.expire(at, policy):
            yield name, ended[0], None, *ended[1:]
        outcome = item.apply(at, kind, None if pd.isna(token) else int(token), policy)
        yield name, at, seq, outcome, item.token, item.state


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["item", "at", "seq", "outcome", "token", "state"])
    return out.astype({"at": "int64", "seq": "Int64", "token": "int64"})


def folded(events: DataFrame, policy: Policy, until: int | None = None) -> DataFrame:
    """(item, at, seq, outcome, token, state): a row for each event (item, at in microseconds, seq, kind, token) and for each lease that expired; until: the time up to which leases expire after an item's last event.

    Items are sorted within partitions and folded row by row, so no task holds an item's events; an item's events are one task's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, item = None, Item()

        def last() -> list[tuple]:
            ended = item.expire(until, policy) if until is not None and name is not None else None
            return [(name, ended[0], None, *ended[1:])] if ended else []

        for b in batches:
            out: list[tuple] = []
            for key, at, seq, kind, token in b[["item", "at", "seq", "kind", "token"]].itertuples(index=False):
                if key != name:
                    out += last()
                    name, item = key, Item()
                out += rows_of(item, name, iter([(at, seq, kind, token)]), policy)
            yield frame(out)
        if rest := last():
            yield frame(rest)

    rows = events.select("item", "at", "seq", "kind", F.col("token").cast("long").alias("token"))
    return rows.repartition("item").sortWithinPartitions("item", "at", "seq").mapInPandas(run, OUT)

"""Online forms of stateful operators: job states, sequential acceptance, deduplication and dead letters.

Each keeps one small state for each key. Results don't depend on how rows fall into batches, as long as
the rows of a key come in order of their sequence; within a batch they are sorted by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heddle.operators.leases import OUT, Item, Policy, frame, rows_of
from heddle.operators.ledger import TERMINAL
from heddle.operators.stats import ALPHA, CAP, KAPPA, PI_ZERO


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")


def job_states(reports: DataFrame) -> DataFrame:
    """(job, seq, outcome, state) of each report (job string, seq long, status string)."""

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        out = []
        for seq, status in _rows(batches)[["seq", "status"]].itertuples(index=False):
            if now is None or (now != status and now not in TERMINAL):
                outcome, now = "applied", status
            else:
                outcome = "duplicate" if now == status else "conflict"
            out.append((key[0], seq, outcome, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["job", "seq", "outcome", "state"])

    return reports.groupBy("job").applyInPandasWithState(step, "job string, seq long, outcome string, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def e_processes(outcomes: DataFrame, pi_zero: float = PI_ZERO, alpha: float = ALPHA) -> DataFrame:
    """(spec_id, seq, n, log_wealth, accepted) after each outcome (spec_id string, seq long, outcome double in [0, 1]); accepted stays true."""
    level = math.log(1 / alpha)

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        wealth, n, total, accepted = state.get if state.exists else (0.0, 0, 0.0, False)
        out = []
        for seq, x in _rows(batches)[["seq", "outcome"]].itertuples(index=False):
            bet = max(0.0, min(CAP / pi_zero, KAPPA * ((total / n if n else 0.0) - pi_zero)))
            wealth += math.log1p(bet * (x - pi_zero))
            n, total = n + 1, total + x
            accepted = accepted or wealth >= level
            out.append((key[0], seq, n, wealth, accepted))
        state.update((wealth, n, total, accepted))
        yield pd.DataFrame(out, columns=["spec_id", "seq", "n", "log_wealth", "accepted"])

    return outcomes.groupBy("spec_id").applyInPandasWithState(step, "spec_id string, seq long, n long, log_wealth double, accepted boolean", "wealth double, n long, total double, accepted boolean", "append", GroupStateTimeout.NoTimeout)


def consumed_once(messages: DataFrame, within: str | None = None) -> DataFrame:
    """The first handled message of each dedup_key (dedup_key, handled, and ts if `within` bounds how long keys are kept). Messages whose handling failed don't count."""
    done = messages.where("handled")
    if within:
        return done.withWatermark("ts", within).dropDuplicatesWithinWatermark(["dedup_key"])
    return done.dropDuplicates(["dedup_key"])


def dead_letters(deliveries: DataFrame, most: int = 3) -> DataFrame:
    """(message_id, receives): messages at the delivery (message_id string, seq long, handled boolean) that makes `most` without success."""

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        n, done = state.get if state.exists else (0, False)
        out = []
        for handled in _rows(batches)["handled"]:
            if done or n >= most:
                break
            n, done = n + 1, bool(handled)
            if n == most and not done:
                out.append((key[0], n))
        state.update((n, done))
        yield pd.DataFrame(out, columns=["message_id", "receives"])

    return deliveries.groupBy("message_id").applyInPandasWithState(step, "message_id string, receives long", "n long, done boolean", "append", GroupStateTimeout.NoTimeout)


def stage_counts(items: DataFrame, by: str = "request") -> DataFrame:
    """Running counts of states for each request, as a streaming aggregate in update mode."""
    return items.groupBy(by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("failed", "cancelled", "running", "pending", "completed")))


def leases(events: DataFrame, policy: Policy, delay: str = "0 seconds") -> DataFrame:
    """(item, at, seq, outcome, token, state) as `heddle.operators.leases.folded` gives, of events (item string, ts timestamp, seq long, kind string, token long).

    The end of a running lease is the item's timer: when the watermark, `delay` behind the latest event, passes it, the attempt
    expires, also if no event of the item comes any more.
    """

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        item = Item(*state.get) if state.exists else Item()
        if state.hasTimedOut:
            ended = item.expire(item.until, policy)
            out = [(key[0], ended[0], None, *ended[1:])] if ended else []
        else:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "seq"], kind="stable")
            out = list(rows_of(item, key[0], rows[["at", "seq", "kind", "token"]].itertuples(index=False), policy))
        state.update(item.values())
        if item.state == "running":
            # timers count milliseconds, and one has to lie after the watermark: a lease that is over by now ends with the next batch
            state.setTimeoutTimestamp(max(-(-item.until // 1000), state.getCurrentWatermarkMs() + 1))
        yield frame(out)

    rows = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return rows.groupBy("item").applyInPandasWithState(step, OUT, "state string, token long, until long, due long", "append", GroupStateTimeout.EventTimeTimeout)

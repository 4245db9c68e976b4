"""The execution ledger as folds over event tables: stages, claims, retries, supersession, job states, replay.

Decisions are recomputed from ordered events; locks and transactions are not part of that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.framing import retry_delay
from heddle.operators.graphs import closure

# States in order of precedence, and those that end a job.
PRECEDENCE = ("failed", "cancelled", "running", "pending")
TERMINAL = ("done", "failed")


def stage_state(items: DataFrame, by: Sequence[str], detection_completed: Column | None = None) -> DataFrame:
    """State of each request's work items: the first of PRECEDENCE that any has, else completed; without items completed only if detection is."""
    counts = items.groupBy(*by).agg(F.count("state").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in PRECEDENCE))
    first = F.coalesce(*(F.when(F.col(s) > 0, F.lit(s)) for s in PRECEDENCE))
    rest = F.when((F.col("total") > 0) | (detection_completed if detection_completed is not None else F.lit(False)), "completed").otherwise("pending")
    return counts.withColumn("stage", F.coalesce(first, rest))


def claim_next(items: DataFrame, by: Sequence[str], now: Column) -> DataFrame:
    """The oldest pending item of each queue whose time has come. items: id, state, created_at, next_attempt_at."""
    due = items.where((F.col("state") == "pending") & (F.coalesce("next_attempt_at", "created_at") <= now))
    least = due.groupBy(*by).agg(F.min(F.struct("created_at", "id")).alias("_first"))
    return least.select(*by, F.col("_first.id").alias("id"), F.col("_first.created_at").alias("created_at"))


def after_failure(items: DataFrame) -> DataFrame:
    """items with the state and delay that a failed attempt leads to: pending again until max_attempts, then failed. items: attempts, max_attempts, initial_seconds, max_seconds."""
    more = F.col("attempts") < F.col("max_attempts")
    delay = F.least(F.col("max_seconds").cast("double"), F.col("initial_seconds") * F.pow(F.lit(2.0), F.col("attempts") - 1))
    return items.withColumns({"state": F.when(more, "pending").otherwise("failed"), "delay_seconds": F.when(more, delay)})


def uncovered_failures(runs: DataFrame) -> DataFrame:
    """Failed or interrupted runs that no chain of replacements by a completed run covers; the runs replaced must have had no results. runs: id, supersedes, state, result_count."""
    step = runs.where("supersedes IS NOT NULL").select(F.col("id").alias("src"), F.col("supersedes").alias("dst"))
    empty = runs.where("result_count = 0").select(F.col("id").alias("dst"))
    covered = closure(step.join(empty, "dst", "left_semi"), runs.where("state = 'completed'").select(F.col("id").alias("node")))
    return runs.where("state IN ('failed', 'interrupted')").join(covered.select(F.col("node").alias("id")), "id", "left_anti")


def fold_jobs(events: DataFrame, by: Sequence[str], order: Sequence[str], status: str = "status") -> DataFrame:
    """events with outcome and the state after each, by a job's state machine.

    A first report is applied; one of the state that stands is a duplicate (whatever it carries); running
    may become done or failed; anything after those is a conflict and changes nothing. So the state is
    that of the first end, or before it of the last report: done by two windows, without a loop.
    """
    ordered = W.partitionBy(*by).orderBy(*order)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    s = F.col(status)
    ended = F.first(F.when(s.isin(*TERMINAL), s), ignorenulls=True).over(before)
    stands = F.coalesce(ended, F.last(s).over(before))
    rows = events.withColumn("_stands", stands)
    outcome = F.when(F.col("_stands").isNull(), "applied").when(F.col("_stands") == s, "duplicate").when(F.col("_stands").isin(*TERMINAL), "conflict").otherwise("applied")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("state", F.when(F.col("outcome") == "applied", s).otherwise(F.col("_stands"))).drop("_stands")


def consumed_once(messages: DataFrame, key: Sequence[str], order: Sequence[str], handled: Column) -> DataFrame:
    """The first message of each key whose handling succeeds; failed ones don't count as done."""
    w = W.partitionBy(*key).orderBy(*order)
    return messages.where(handled).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dead_letters(deliveries: DataFrame, key: Sequence[str], most: int = 3) -> DataFrame:
    """Messages that were received `most` times without being handled. deliveries: handled."""
    return deliveries.groupBy(*key).agg(F.count("*").alias("receives"), F.bool_or("handled").alias("done")).where((F.col("receives") >= most) & ~F.col("done")).drop("done")


def replay_conflicts(operations: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """Operation keys that were used with different bytes."""
    return operations.groupBy(*key).agg(F.count_distinct(F.sha2(content, 256)).alias("contents")).where("contents > 1")


def latest(rows: DataFrame, by: Sequence[str], at: Sequence[str], value: str) -> DataFrame:
    """Each group's value of the latest row, by time and not by version."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*at)).alias(value))


def next_versions(versions: DataFrame, by: Sequence[str], version: str = "version") -> DataFrame:
    """The largest x.y.z in each group, as numbers, with its last part one higher."""
    parts = F.transform(F.split(version, "\\."), lambda p: p.cast("int"))
    top = versions.groupBy(*by).agg(F.max(parts).alias("_v"))
    return top.select(*by, F.concat_ws(".", F.col("_v")[0], F.col("_v")[1], F.col("_v")[2] + 1).alias("next_version"))


def denial(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules))


def tiered(repos: DataFrame, tiers: Sequence[int]) -> DataFrame:
    """Each repository once (owner, name), in the highest tier of stars that a listing gave it; tiers from the highest."""
    tier = F.coalesce(*(F.when(F.col("stars") >= t, F.lit(i)) for i, t in enumerate(tiers)), F.lit(len(tiers)))
    return repos.groupBy("owner", "name").agg(F.min(tier).alias("tier"), F.max("stars").alias("stars"))


__all__ = ["after_failure", "claim_next", "consumed_once", "dead_letters", "denial", "fold_jobs", "latest", "next_versions", "replay_conflicts", "retry_delay", "stage_state", "tiered", "uncovered_failures"]

"""Policies of trust, snapshots and oracle runs: what may follow, what holds at a time, and what is shown of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.tables import union_all
from heddle.operators.findings import CORE, CORE_ENGINES, ORACLE

# Formats of identifiers, and the order of a grant's states.
SHA = "^[0-9a-f]{40}$"
ENVIRONMENT = "^sha256:[0-9a-f]{64}$"
STATES = ("active", "retired", "revoked")


def is_sha(value: Column) -> Column:
    return F.coalesce(value.rlike(SHA) & ~value.contains("\n"), F.lit(False))


def is_environment(value: Column) -> Column:
    return F.coalesce(value.rlike(ENVIRONMENT) & ~value.contains("\n"), F.lit(False))


def strong(class_: Column, namespace: Column, accepted: str) -> Column:
    """Whether an identity may keep a decision: a strong one of the accepted namespace; never a weak or a former one."""
    return F.coalesce((class_ == "strong") & (namespace == accepted), F.lit(False))


def both_strong(graph: Column, sliced: Column, graph_namespace: str, slice_namespace: str) -> Column:
    """Whether both identities of a finding (structs status, class, namespace) are completed and strong, each of its own namespace."""
    one = lambda i, n: F.coalesce(i["status"] == "completed", F.lit(False)) & strong(i["class"], i["namespace"], n)
    return one(graph, graph_namespace) & one(sliced, slice_namespace)


def at_risk(record_type: Column, origin: Column, engine: Column) -> Column:
    """Whether a record is a finding of the core that a disagreeing oracle moves."""
    return F.coalesce((record_type == "chain") & (origin == CORE) & engine.isin(*CORE_ENGINES), F.lit(False))


def policy_time(policies: DataFrame, moment: Column) -> DataFrame:
    """policies (valid_from, expires_at, action, issued_at, checkpoint_expires_at) with `denial`: null where both the policy and its checkpoint hold at the moment."""
    within = lambda a, b: F.coalesce((F.col(a) <= moment) & (moment < F.col(b)), F.lit(False))
    admitted = F.coalesce(F.col("action") == "admit", F.lit(False)) & within("issued_at", "checkpoint_expires_at")
    return policies.withColumn("denial", F.when(~within("valid_from", "expires_at"), "policy-expired").when(~admitted, "checkpoint-denied"))


def evolution_violations(old: DataFrame, new: DataFrame, windows: DataFrame) -> DataFrame:
    """(policy_id, grant_id, violation) of new policies against the old.

    old, new: policy_id, grant_id, content (all that a state's change leaves alone), status, changed_at, not_before, not_after;
    windows: policy_id, valid_from, expires_at of the new policy. No grant goes or changes its content; states only go on from active
    to retired to revoked; a change of state has a time that isn't before the last, and no change leaves the time alone; a new grant lies
    within the policy's window.
    """
    key = ["policy_id", "grant_id"]
    order = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c)
    before = old.select(*key, F.col("content").alias("was"), F.col("status").alias("old_status"), F.col("changed_at").alias("old_changed_at"))
    both = new.join(before, key)
    same = F.col("status") == F.col("old_status")
    said = lambda df, v: df.select(*key, F.lit(v).alias("violation"))
    fresh = new.join(before.select(*key), key, "left_anti").join(windows, "policy_id")
    inside = (F.col("valid_from") <= F.col("not_before")) & (F.col("not_after") <= F.col("expires_at"))
    return union_all(
        [
            said(before.join(new.select(*key), key, "left_anti"), "removed"),
            said(both.where(~F.col("content").eqNullSafe(F.col("was"))), "content"),
            said(both.where(order(F.col("status")) < order(F.col("old_status"))), "state"),
            said(both.where(same & ~F.col("changed_at").eqNullSafe(F.col("old_changed_at"))), "time_without_change"),
            said(both.where(~same & F.col("old_changed_at").isNotNull() & ~F.coalesce(F.col("changed_at") >= F.col("old_changed_at"), F.lit(False))), "time_goes_back"),
            said(fresh.where(~F.coalesce(inside, F.lit(False))), "outside_window"),
        ]
    )


def oracle_runs(runs: DataFrame) -> DataFrame:
    """runs (verdict, sites: array, ...) with `agreed` and `refused`: a closed world agrees and may name no site."""
    agreed = F.col("verdict") == "closed-world"
    return runs.withColumns({"agreed": agreed, "refused": agreed & (F.size(F.coalesce("sites", F.array())) > 0)})


def flipped(records: DataFrame, runs: DataFrame) -> DataFrame:
    """(record_id, run_id): findings of the core in snapshots of which an oracle's run disagrees, moved by the first such run and only once.

    records: record_id, snapshot_id, record_type, origin, engine, parent_id; runs: run_id, snapshot_id, agreed, completed_at.
    """
    first = runs.where("NOT agreed").groupBy("snapshot_id").agg(F.min(F.struct("completed_at", "run_id"))["run_id"].alias("run_id"))
    done = records.where("record_type = 'repartition'").select(F.col("parent_id").alias("record_id"))
    core = records.where(at_risk(F.col("record_type"), F.col("origin"), F.col("engine")))
    return core.join(done, "record_id", "left_anti").join(first, "snapshot_id").select("record_id", "run_id")


def auditor_records(records: DataFrame) -> DataFrame:
    """record_id, its columns, effective_origin, and repartition_history: the ids of the records that moved it, by time.

    records: record_id, parent_id, record_type, origin, created_at, and more.
    """
    moves = records.where("record_type = 'repartition'").groupBy(F.col("parent_id").alias("record_id")).agg(F.sort_array(F.collect_list(F.struct("created_at", F.col("record_id").alias("id")))).alias("moves"))
    rows = records.join(moves, "record_id", "left")
    origin = F.when(F.col("moves").isNotNull() | F.col("origin").isNull(), ORACLE).otherwise(F.col("origin"))
    history = F.transform(F.coalesce("moves", F.array().cast(moves.schema["moves"].dataType)), lambda m: m["id"])
    return rows.select(*records.columns, origin.alias("effective_origin"), history.alias("repartition_history"))


def resolved(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests (org_id, codebase_id, commit_sha, env_digest, ...) with snapshot_id: the latest of just these, or null, which means that one has to be made; also where the environment isn't known."""
    key = ["org_id", "codebase_id", "commit_sha", "env_digest"]
    latest = snapshots.groupBy(*key).agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))
    return requests.join(latest, key, "left")

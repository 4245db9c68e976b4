"""Continuity: matching the findings of one scan with those of the scan before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What can block a whole plan, in order, and a row's dispositions.
BLOCKS = ("unsealed_detection_inventory", "detection_incomplete", "matching_policy_inactive_or_unaccepted", "ambiguous_predecessor_entity", "multiple_occurrences_at_one_sink", "ineligible_or_unsupported_potential_competitor")
AMBIGUOUS, NEW, NO_ENTITY, LINKED = "ambiguous_equal_slice", "no_equal_eligible_predecessor", "predecessor_entity_unavailable", "unique_eligible_identity"


def plan(before: DataFrame, after: DataFrame, entities: DataFrame, sealed: bool = True, completed: bool = True, policy_active: bool = True) -> DataFrame:
    """(occurrence_id, disposition, reason, predecessor_id, entity_id) for each occurrence of the later scan.

    before, after: occurrence_id, profile, slice_digest, sink, eligible; entities: occurrence_id (of
    before), entity_id. One ineligible occurrence, or one sink with two, blocks all. A key of profile and
    slice links only where each scan has it once.
    """
    repeated = lambda df: df.groupBy("sink").count().where("count > 1").select(F.lit(1).alias("x"))
    ineligible = before.unionByName(after).where("NOT eligible").select(F.lit(1).alias("x"))
    twice = entities.groupBy("entity_id").count().where("count > 1").select(F.lit(1).alias("x"))
    any_ = lambda df, name: df.agg((F.count("*") > 0).alias(name))  # noqa: E731  one row
    flags = any_(twice, "e").crossJoin(any_(repeated(before).unionByName(repeated(after)), "s")).crossJoin(any_(ineligible, "i"))
    tests = (F.lit(not sealed), F.lit(not completed), F.lit(not policy_active), F.col("e"), F.col("s"), F.col("i"))
    block = F.coalesce(*(F.when(t, F.lit(b)) for t, b in zip(tests, BLOCKS, strict=True)))
    key = ["profile", "slice_digest"]
    counted = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n), F.min("occurrence_id").alias(f"{n}_id"))
    rows = after.join(counted(before, "old"), key, "left").join(counted(after, "new").drop("new_id"), key)
    rows = rows.join(entities.withColumnRenamed("occurrence_id", "old_id"), "old_id", "left").crossJoin(F.broadcast(flags.select(block.alias("block"))))
    reason = F.when(F.col("block").isNotNull(), F.col("block")).when((F.col("old") > 1) | (F.col("new") > 1), AMBIGUOUS).when(F.col("old").isNull(), NEW).when(F.col("entity_id").isNull(), NO_ENTITY).otherwise(LINKED)
    rows = rows.withColumn("reason", reason)
    linked = F.col("reason") == LINKED
    disposition = F.when(linked, "linked").when(F.col("reason") == NEW, "new_identity").otherwise("blocked")
    return rows.select("occurrence_id", disposition.alias("disposition"), "reason", F.when(linked, F.col("old_id")).alias("predecessor_id"), F.when(linked, F.col("entity_id")).alias("entity_id"))


def unmatched(before: DataFrame, planned: DataFrame) -> DataFrame:
    """Earlier occurrences that no row of a plan took up; they are not resolved by that."""
    return before.join(planned.select(F.col("predecessor_id").alias("occurrence_id")), "occurrence_id", "left_anti").select("occurrence_id")


def effective_decisions(occurrences: DataFrame, direct: DataFrame, linked: DataFrame, default: str = "unreviewed") -> DataFrame:
    """(occurrence_id, verdict, source): the occurrence's own decision, else that of its entity if it is open and of the same generation, else the default.

    direct: occurrence_id, verdict (null: none); linked: occurrence_id, verdict, lifecycle, generation,
    authorized_generation.
    """
    own = direct.select("occurrence_id", F.col("verdict").alias("own"))
    inherited = F.when((F.col("lifecycle") == "open") & (F.col("generation") == F.col("authorized_generation")), F.col("verdict"))
    rows = occurrences.join(own, "occurrence_id", "left").join(linked.select("occurrence_id", inherited.alias("inherited")), "occurrence_id", "left")
    source = F.when(F.col("own").isNotNull(), "occurrence").when(F.col("inherited").isNotNull(), "entity").otherwise("default")
    return rows.select("occurrence_id", F.coalesce("own", "inherited", F.lit(default)).alias("verdict"), source.alias("source"))


def transition_violations(versions: DataFrame) -> DataFrame:
    """Entity versions that don't follow: revisions go up by one, generations only when a resolved entity reappears, and then by one.

    versions: entity_id, revision, generation, lifecycle.
    """
    w = W.partitionBy("entity_id").orderBy("revision")
    rows = versions.withColumns({c: F.lag(f).over(w) for c, f in (("r0", "revision"), ("g0", "generation"), ("l0", "lifecycle"))})
    reappears = (F.col("lifecycle") == "reappeared") & (F.col("l0") == "resolved")
    wrong = (F.col("revision") != F.col("r0") + 1) | (F.col("generation") != F.col("g0") + reappears.cast("int"))
    return rows.where(F.col("r0").isNotNull() & wrong).select(versions.columns)

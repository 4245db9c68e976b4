"""Sealed inventories of a scan's occurrences, their digests, and the registry of matching policies.

occurrences: occurrence_id, scan_id, capture_id, source_tree_digest, cohort (struct), and whatever else a
view of an occurrence holds; inventories: scan_id, capture_id, source_tree_digest, cohort, detection_state,
sealed, sealed_occurrence_ids, evidence_refs, content_digest. Digests are bound to a namespace that the caller
names, so that a digest of one kind of record is never one of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.canonical import canonical, canonical_row, namespaced_digest, quoted
from heddle.functions.tables import union_all

# The states of a detection.
STATES = ("pending", "running", "completed", "failed")
SCOPE = ["scan_id", "capture_id", "source_tree_digest", "cohort"]


def occurrence_digests(occurrences: DataFrame, namespace: str) -> DataFrame:
    """occurrence_id and the digest of the whole row as canonical JSON."""
    return occurrences.select("occurrence_id", namespaced_digest(namespace, canonical_row(occurrences.schema)).alias("digest"))


def _object(fields: dict[str, Column]) -> Column:
    pairs = [F.concat(quoted(F.lit(n)), F.lit(":"), fields[n]) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def inventory_digests(inventories: DataFrame, occurrences: DataFrame, namespace: str) -> DataFrame:
    """scan_id and the digest that binds the inventory and all occurrences of the scan, whatever their order.

    The digest is over one text, so an inventory is gathered in one row; scans are many and spread.
    """
    rows = occurrences.select("scan_id", F.struct("occurrence_id", canonical_row(occurrences.schema).alias("json")).alias("o"))
    lists = rows.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["json"]), ",").alias("listed"))
    kinds = {f.name: f.dataType for f in inventories.schema.fields}
    fields = {n: canonical(F.col(n), kinds[n]) for n in ("scan_id", "capture_id", "source_tree_digest", "cohort", "detection_state", "sealed")}
    fields |= {n: canonical(F.array_sort(n), T.ArrayType(T.StringType())) for n in ("sealed_occurrence_ids", "evidence_refs")}
    fields["occurrences"] = F.concat(F.lit("["), F.coalesce("listed", F.lit("")), F.lit("]"))
    return inventories.join(lists, "scan_id", "left").select("scan_id", namespaced_digest(namespace, _object(fields)).alias("digest"))


def inventory_violations(inventories: DataFrame, occurrences: DataFrame, namespace: str) -> DataFrame:
    """(scan_id, violation, subject): everything that keeps an inventory from being what it says.

    State unknown, evidence missing from a sealed one or repeated, ids repeated, sealed without an occurrence or the other way
    round, occurrences of another capture, tree or cohort, and a content digest that isn't the content's.
    """
    none = F.lit(None).cast("string")

    def said(df: DataFrame, violation: str, subject: Column = none) -> DataFrame:
        return df.select("scan_id", F.lit(violation).alias("violation"), subject.alias("subject"))

    sealed = inventories.select("scan_id", F.explode("sealed_occurrence_ids").alias("occurrence_id"))
    listed = occurrences.select("scan_id", "occurrence_id")
    twice = lambda df: df.groupBy("scan_id", "occurrence_id").count().where("count > 1")
    kinds = {f.name: f.dataType for f in inventories.schema.fields}
    own = inventories.select("scan_id", *(canonical(F.col(c), kinds[c]).alias(f"own_{c}") for c in SCOPE[1:]))
    theirs = {f.name: f.dataType for f in occurrences.schema.fields}
    other = [canonical(F.col(c), theirs[c]) != F.col(f"own_{c}") for c in SCOPE[1:]]
    outside = occurrences.join(own, "scan_id").where(other[0] | other[1] | other[2])
    refs = inventories.where(F.size(F.array_distinct("evidence_refs")) < F.size("evidence_refs"))
    digests = inventories.join(inventory_digests(inventories, occurrences, namespace), "scan_id").where("NOT (content_digest <=> digest)")
    id_ = F.col("occurrence_id")
    return union_all(
        [
            said(inventories.where(~F.col("detection_state").isin(*STATES) | F.col("detection_state").isNull()), "unknown_state", F.col("detection_state")),
            said(inventories.where("sealed AND size(evidence_refs) = 0"), "sealed_without_evidence"),
            said(refs, "repeated_evidence"),
            said(twice(sealed), "repeated_sealed_id", id_),
            said(twice(listed), "repeated_occurrence", id_),
            said(sealed.distinct().join(listed, ["scan_id", "occurrence_id"], "left_anti"), "sealed_but_absent", id_),
            said(listed.distinct().join(sealed, ["scan_id", "occurrence_id"], "left_anti"), "present_but_unsealed", id_),
            said(outside, "outside_scope", id_),
            said(digests, "digest_mismatch"),
        ]
    )


def registry_violations(registries: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """(registry_id, violation, subject) of transitions from a registry's previous to its current snapshot.

    registries: registry_id, previous_revision, current_revision; entries: registry_id, snapshot (`previous`
    or `current`), digest, state (`active`, `revoked`), activation_event_id; events: registry_id, snapshot, event_id: the activations used so far.

    The revision goes up by one; no policy is removed; no used event is forgotten; a new policy, and one
    that is active again, takes an event never used before, any other keeps its event; and the events added are just those.
    """
    at = lambda df, s: df.where(F.col("snapshot") == s).drop("snapshot")
    key = ["registry_id", "digest"]
    was = at(entries, "previous").select(*key, F.col("state").alias("was"), F.col("activation_event_id").alias("old_event"))
    now = at(entries, "current").select(*key, F.col("state").alias("now"), F.col("activation_event_id").alias("event_id"))
    used, after = at(events, "previous").select("registry_id", "event_id").distinct(), at(events, "current").select("registry_id", "event_id").distinct()
    both = now.join(was, key, "left").join(used.withColumn("used", F.lit(True)), ["registry_id", "event_id"], "left")
    is_new, again = F.col("was").isNull(), (F.col("was") == "revoked") & (F.col("now") == "active")
    introduced = both.where(is_new | again).where("used is null").select("registry_id", "event_id").distinct()
    added = after.join(used, ["registry_id", "event_id"], "left_anti")
    said = lambda df, v, s: df.select("registry_id", F.lit(v).alias("violation"), F.col(s).cast("string").alias("subject"))
    return union_all(
        [
            said(registries.where("current_revision <> previous_revision + 1"), "revision", "current_revision"),
            said(was.join(now, key, "left_anti"), "removed_policy", "digest"),
            said(used.join(after, ["registry_id", "event_id"], "left_anti"), "forgotten_event", "event_id"),
            said(both.where(is_new & F.col("used").isNotNull()), "new_policy_needs_fresh_event", "digest"),
            said(both.where(again & F.col("used").isNotNull()), "reactivation_needs_fresh_event", "digest"),
            said(both.where(~is_new & ~again & (F.col("event_id") != F.col("old_event"))), "event_changed", "digest"),
            said(added.join(introduced, ["registry_id", "event_id"], "left_anti"), "event_without_activation", "event_id"),
            said(introduced.join(added, ["registry_id", "event_id"], "left_anti"), "activation_without_event", "event_id"),
        ]
    )

"""Canonical JSON, sealed inventories and policy registries: customers are scans, their orders are occurrences; nations are registries, their suppliers are policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.canonical import canonical_row, namespaced_digest
from heddle.functions.tables import parts, read, union_all
from heddle.operators import inventory

DOCUMENT, OCCURRENCE, INVENTORY = "document/1", "occurrence/1", "inventory/1"


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and bytes of each document's row as canonical JSON, its source and language as a nested object with its words' number."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.struct("source", "lang").alias("origin"), F.array("lang", F.lit(None).cast("string"), "source").alias("tags"), (F.col("n_chars") > 1000).alias("long"))
    json = canonical_row(rows.schema)
    return rows.select("doc_id", F.octet_length(json).cast("long").alias("n_bytes"), namespaced_digest(DOCUMENT, json).alias("digest"))


def _q(x: str) -> str:
    """SQL of a JSON string."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    out = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    for k in range(1, 32):
        out = f"replace({out}, chr({k}), '{short.get(k, f'\\u{k:04x}')}')"
    return f"coalesce('\"' || {out} || '\"', 'null')"


CANONICAL_DOCUMENTS = f"""
WITH j AS (SELECT doc_id, '{{"doc_id":' || doc_id || ',"long":' || coalesce(CAST(n_chars > 1000 AS VARCHAR), 'null') || ',"origin":{{"lang":' || {_q("lang")} || ',"source":' || {_q("source")} || '}},"tags":[' || {_q("lang")} || ',null,' || {_q("source")} || '],"text":' || {_q("text")} || '}}' AS json FROM documents)
SELECT doc_id, CAST(strlen(json) AS BIGINT) AS n_bytes, 'sha256:' || sha256('{DOCUMENT}' || chr(10) || json) AS digest FROM j
"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(inventories without a digest, occurrences)."""
    c = read(spark, sf_dir, "customer")
    n = parts(spark, 10 * read(spark, sf_dir, "orders").count())  # an order's row is wide, and both lists of its scan name it
    scope = [
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("scan_id"),
        F.concat(F.lit("cap-"), F.col("c_nationkey").cast("string")).alias("capture_id"),
        F.concat(F.lit("sha256:"), F.sha2("c_name", 256)).alias("source_tree_digest"),
        F.struct(F.col("c_nationkey").cast("string").alias("org_id"), F.lit("ifds").alias("engine"), F.col("c_mktsegment").alias("detector_id")).alias("cohort"),
    ]
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    id_ = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    occurrences = o.select(*scope, id_.alias("occurrence_id"), (F.col("o_orderstatus") == "P").alias("duplicate_ambiguity"), F.array("o_orderpriority", "o_orderstatus").alias("evidence_refs"), F.when(F.col("o_orderstatus") != "F", F.struct(F.col("o_orderpriority").alias("profile"))).alias("binding"))
    sealed = o.groupBy("c_custkey").agg(F.collect_list(id_).alias("ids"))
    empty = F.array().cast("array<string>")
    state = F.when(F.col("c_mktsegment") == "MACHINERY", "done").otherwise("completed")
    refs = F.when(F.col("c_mktsegment") == "BUILDING", empty).otherwise(F.array("c_mktsegment", "c_name"))
    inventories = c.join(sealed, "c_custkey", "left").select(*scope, state.alias("detection_state"), (state == "completed").alias("sealed"), F.coalesce("ids", empty).alias("sealed_occurrence_ids"), refs.alias("evidence_refs"), "c_nationkey", "c_acctbal")
    return inventories.repartition(n, "scan_id"), occurrences.repartition(n, "scan_id")


def inventory_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that binds each customer's inventory and all its orders."""
    inventories, occurrences = _scans(spark, sf_dir)
    return inventory.inventory_digests(inventories, occurrences, INVENTORY)


def occurrence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.occurrence_digests(_scans(spark, sf_dir)[1], OCCURRENCE)


def inventory_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with inventories of which some digests are forged, some orders are of another capture, and some ids are unsealed or of no order."""
    inventories, occurrences = _scans(spark, sf_dir)
    moved = occurrences.withColumn("capture_id", F.when(F.col("evidence_refs")[1] == "P", "cap-x").otherwise(F.col("capture_id")))
    low = occurrences.where(F.col("evidence_refs")[0] == "5-LOW").groupBy("scan_id").agg(F.collect_list("occurrence_id").alias("low"))
    ids = F.array_except("sealed_occurrence_ids", F.coalesce("low", F.array().cast("array<string>")))
    ids = F.when(F.col("c_acctbal") < 0, F.concat(ids, F.array(F.concat(F.lit("none-"), "scan_id")))).otherwise(ids)
    changed = inventories.join(low, "scan_id", "left").withColumn("sealed_occurrence_ids", ids).drop("low")
    digests = inventory.inventory_digests(changed, moved, INVENTORY)
    forged = F.when(F.col("c_nationkey") < 12, F.col("digest")).otherwise(F.lit("sha256:" + "0" * 64))
    return inventory.inventory_violations(changed.join(digests, "scan_id").withColumn("content_digest", forged).drop("digest"), moved, INVENTORY)


_SCOPE = f"""',"cohort":{{"detector_id":' || {_q("c_mktsegment")} || ',"engine":"ifds","org_id":"' || c_nationkey || '"}}'"""
_TREE = """'"sha256:' || sha256(c_name) || '"'"""
_OCCURRENCES = f"""
o AS (
  SELECT c_custkey, 'o' || o_orderkey AS id,
    '{{"binding":' || CASE WHEN o_orderstatus <> 'F' THEN '{{"profile":' || {_q("o_orderpriority")} || '}}' ELSE 'null' END || ',"capture_id":"cap-' || c_nationkey || '"' || {_SCOPE}
    || ',"duplicate_ambiguity":' || CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END || ',"evidence_refs":[' || {_q("o_orderpriority")} || ',' || {_q("o_orderstatus")}
    || '],"occurrence_id":"o' || o_orderkey || '","scan_id":"c' || c_custkey || '","source_tree_digest":' || {_TREE} || '}}' AS json
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
OCCURRENCE_DIGESTS = f"WITH {_OCCURRENCES} SELECT id AS occurrence_id, 'sha256:' || sha256('{OCCURRENCE}' || chr(10) || json) AS digest FROM o"
INVENTORY_DIGESTS = f"""
WITH {_OCCURRENCES},
l AS (SELECT c_custkey, string_agg(json, ',' ORDER BY id) AS listed, string_agg('"' || id || '"', ',' ORDER BY id) AS ids FROM o GROUP BY c_custkey),
i AS (
  SELECT c_custkey, '{{"capture_id":"cap-' || c_nationkey || '"' || {_SCOPE} || ',"detection_state":"' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'done' ELSE 'completed' END
    || '","evidence_refs":[' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE {_q("least(c_mktsegment, c_name)")} || ',' || {_q("greatest(c_mktsegment, c_name)")} END
    || '],"occurrences":[' || coalesce(listed, '') || '],"scan_id":"c' || c_custkey || '","sealed":' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'false' ELSE 'true' END
    || ',"sealed_occurrence_ids":[' || coalesce(ids, '') || '],"source_tree_digest":' || {_TREE} || '}}' AS json
  FROM customer LEFT JOIN l USING (c_custkey))
SELECT 'c' || c_custkey AS scan_id, 'sha256:' || sha256('{INVENTORY}' || chr(10) || json) AS digest FROM i
"""
INVENTORY_VIOLATIONS = """
WITH o AS (SELECT 'c' || o_custkey AS scan_id, 'o' || o_orderkey AS id, o_orderstatus, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'c' || c_custkey AS scan_id, 'unknown_state' AS violation, 'done' AS subject FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'c' || c_custkey, 'sealed_without_evidence', NULL FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'c' || c_custkey, 'sealed_but_absent', 'none-c' || c_custkey FROM customer WHERE c_acctbal < 0
UNION ALL SELECT scan_id, 'present_but_unsealed', id FROM o WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT scan_id, 'outside_scope', id FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT 'c' || c_custkey, 'digest_mismatch', NULL FROM customer WHERE c_nationkey >= 12
"""


def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are policies that are removed, revoked, reactivated and renamed by their balance; rich customers are new ones."""
    n, s, c = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    registries = n.select(F.col("n_nationkey").alias("registry_id"), F.col("n_nationkey").cast("long").alias("previous_revision"), (F.col("n_nationkey") + F.when(F.col("n_regionkey") == 2, 2).otherwise(1)).cast("long").alias("current_revision"))
    b, key, event = F.col("s_acctbal"), F.col("s_nationkey").alias("registry_id"), name("e", "s_suppkey")

    def rows(df: DataFrame, snapshot: str, *columns: Column) -> DataFrame:
        return df.select(columns[0], F.lit(snapshot).alias("snapshot"), *columns[1:])

    was = F.when(b > 0, "active").otherwise("revoked").alias("state")
    now = F.when(b > -500, "active").otherwise("revoked").alias("state")
    new_event = F.when((b > -250) & (b <= 0), name("f", "s_suppkey")).when((b > 4000) & (b < 5000), name("x", "s_suppkey")).otherwise(event)
    nation = F.col("c_nationkey").alias("registry_id")
    rich = c.where("c_acctbal > 9500")
    entries = union_all(
        [
            rows(s, "previous", key, F.col("s_name").alias("digest"), was, event.alias("activation_event_id")),
            rows(s.where(b <= 9000), "current", key, F.col("s_name").alias("digest"), now, new_event.alias("activation_event_id")),
            rows(rich, "current", nation, F.col("c_name").alias("digest"), F.lit("active").alias("state"), F.when(F.col("c_acctbal") > 9900, name("h", "c_nationkey")).otherwise(name("n", "c_custkey")).alias("activation_event_id")),
        ]
    )
    here = F.col("n_nationkey").alias("registry_id")
    events = union_all(
        [
            rows(s, "previous", key, event.alias("event_id")),
            rows(n, "previous", here, name("h", "n_nationkey").alias("event_id")),
            rows(s.where(~b.between(7000, 7500)), "current", key, event.alias("event_id")),
            rows(n, "current", here, name("h", "n_nationkey").alias("event_id")),
            rows(s.where((b > -200) & (b <= 0)), "current", key, name("f", "s_suppkey").alias("event_id")),
            rows(rich.where("c_acctbal <= 9900"), "current", nation, name("n", "c_custkey").alias("event_id")),
            rows(n.where("n_nationkey < 5"), "current", here, name("z", "n_nationkey").alias("event_id")),
        ]
    )
    return inventory.registry_violations(registries, entries, events)


REGISTRY_VIOLATIONS = """
SELECT n_nationkey AS registry_id, 'revision' AS violation, CAST(n_nationkey + 2 AS VARCHAR) AS subject FROM nation WHERE n_regionkey = 2
UNION ALL SELECT s_nationkey, 'removed_policy', s_name FROM supplier WHERE s_acctbal > 9000
UNION ALL SELECT s_nationkey, 'forgotten_event', 'e' || s_suppkey FROM supplier WHERE s_acctbal BETWEEN 7000 AND 7500
UNION ALL SELECT c_nationkey, 'new_policy_needs_fresh_event', c_name FROM customer WHERE c_acctbal > 9900
UNION ALL SELECT s_nationkey, 'reactivation_needs_fresh_event', s_name FROM supplier WHERE s_acctbal > -500 AND s_acctbal <= -250
UNION ALL SELECT s_nationkey, 'event_changed', s_name FROM supplier WHERE s_acctbal > 4000 AND s_acctbal < 5000
UNION ALL SELECT n_nationkey, 'event_without_activation', 'z' || n_nationkey FROM nation WHERE n_nationkey < 5
UNION ALL SELECT s_nationkey, 'activation_without_event', 'f' || s_suppkey FROM supplier WHERE s_acctbal > -250 AND s_acctbal <= -200
"""

_ALL = (canonical_documents, occurrence_digests, inventory_digests, inventory_violations, registry_violations)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

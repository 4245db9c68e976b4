"""Tenancy, rights, shapes of typed graphs, and chains of signed records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.tables import materialized, union_all
from heddle.operators.graphs import closure, nearest_ancestor

# What each role may do.
RIGHTS = {
    "org-admin": {"scans": ["submit", "read"], "snapshots": ["submit", "read"], "codebases": ["create", "read", "update_creds"], "findings": ["read", "patch_status"], "attestations": ["read"]},
    "org-viewer": {"scans": ["read"], "snapshots": ["read"], "codebases": ["read"], "findings": ["read"], "attestations": ["read"]},
    "scanner": {"scans": ["submit", "read"], "snapshots": ["submit", "read"], "codebases": [], "findings": ["read"], "attestations": ["read"]},
}
#: Kinds that typed edges may join; None: any.
EXPRESSION = "EXPRESSION"
ENDS = {
    "CALL": (["CALL"], ["METHOD"]),
    "PARAMETER_LINK": (["METHOD_PARAMETER_IN"], ["METHOD_PARAMETER_OUT"]),
    "RECEIVER": (["CALL"], EXPRESSION),
    "ARGUMENT": (["CALL", "RETURN"], EXPRESSION),
}
REFERENCES = ["LOCAL", "METHOD_PARAMETER_IN", "MEMBER", "TYPE_DECL", "METHOD"]
VERIFIED, TAMPERED, KEY_NOT_FOUND, MISSING = "VERIFIED", "TAMPERED", "KEY_NOT_FOUND", "ARTIFACT_MISSING"


def tenant_rows(rows: DataFrame, org: str | None) -> DataFrame:
    """The rows of one organisation; without one, no rows can be asked for."""
    if not org:
        raise PermissionError("no organisation is bound to the session")
    return rows.where(F.col("org_id") == org)


def rights(spark: SparkSession) -> DataFrame:
    rows = [(r, what, a) for r, per in RIGHTS.items() for what, actions in per.items() for a in actions]
    return spark.createDataFrame(rows, "role string, resource string, action string")


def allowed(requests: DataFrame) -> DataFrame:
    """requests (role, resource, action, ...) with `allowed`."""
    table = F.broadcast(rights(requests.sparkSession).withColumn("_ok", F.lit(True)))  # a few dozen rows
    return requests.join(table, ["role", "resource", "action"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def all_distinct(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def unexpected_keys(json: Column, expected: Sequence[str]) -> Column:
    """Keys of a JSON object that its closed shape doesn't have."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, expected)))


def wrong_ends(of: Callable[[str], Column] = F.col) -> Column:
    """The rule that an edge (kind, with src_kind, src_expr, dst_kind, dst_expr of its ends) breaks, or null; `of` gives these."""
    fits = lambda e, kinds: of(f"{e}_expr") if kinds == EXPRESSION else of(f"{e}_kind").isin(kinds)
    bad = F.when(of("src_kind").isNull() | of("dst_kind").isNull(), "dangling")
    for kind, (a, b) in ENDS.items():
        bad = bad.when((of("kind") == kind) & ~(fits("src", a) & fits("dst", b)), kind)
    return bad.when((of("kind") == "REF") & (of("src_kind") == "IDENTIFIER") & ~of("dst_kind").isin(REFERENCES), "REF")


def typed_edge_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a typed graph that join what they may not, and nodes with two owners, with the rule's name.

    nodes: graph_id, id, kind, is_expression; edges: graph_id, src, dst, kind.
    """
    end = lambda e: nodes.select("graph_id", F.col("id").alias(e), F.col("kind").alias(f"{e}_kind"), F.col("is_expression").alias(f"{e}_expr"))
    rows = edges.join(end("src"), ["graph_id", "src"], "left").join(end("dst"), ["graph_id", "dst"], "left")
    wrong = rows.withColumn("rule", wrong_ends()).where("rule IS NOT NULL").select("graph_id", "src", "dst", "kind", "rule")
    owners = edges.where("kind = 'AST'").groupBy("graph_id", "dst").agg(F.count_distinct("src").alias("n"), F.min("src").alias("src")).where("n > 1")
    return wrong.unionByName(owners.select("graph_id", "src", "dst", F.lit("AST").alias("kind"), F.lit("owners").alias("rule")))


def owner_methods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, owner): the nearest METHOD at or above each node of the syntax tree."""
    parents = nodes.select("graph_id", F.col("id").alias("node")).join(edges.where("kind = 'AST'").select("graph_id", F.col("dst").alias("node"), F.col("src").alias("parent")), ["graph_id", "node"], "left")
    return nearest_ancestor(parents, nodes.where("kind = 'METHOD'").select("graph_id", F.col("id").alias("node")), ["graph_id"])


def related(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(graph_id, node, kind, targets): for each node and kind its targets in order of the edges' ordinals."""
    e = edges.where(F.col("kind").isin(*kinds)).groupBy("graph_id", F.col("src").alias("node"), "kind").agg(F.sort_array(F.collect_list(F.struct("ordinal", "dst"))).alias("x"))
    return e.select("graph_id", "node", "kind", F.transform("x", lambda x: x["dst"]).alias("targets"))


def verified_chains(records: DataFrame, artifacts: DataFrame, verify: Callable[[pd.Series, pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """(record_id, verdict) of signed records; a repartition's verdict is its own, else that of the nearest record above that isn't VERIFIED.

    records: record_id, parent_id, record_type, canonical, stored_sha256, key_id (null: no key), signature,
    artifact_id, artifact_sha256; artifacts: artifact_id, sha256. verify(canonical, signature, key_id) says
    for a batch which signatures hold; the digest is recomputed from the canonical text.
    """
    holds = F.pandas_udf(verify, "boolean")
    rows = records.join(artifacts.select("artifact_id", F.col("sha256").alias("_there")), "artifact_id", "left")
    own = (
        F.when(F.col("key_id").isNull(), KEY_NOT_FOUND)
        .when((F.sha2("canonical", 256) != F.col("stored_sha256")) | ~holds("canonical", "signature", "key_id"), TAMPERED)
        .when(F.col("artifact_id").isNotNull() & F.col("_there").isNull(), MISSING)
        .when(F.col("artifact_id").isNotNull() & (F.col("_there") != F.col("artifact_sha256")), TAMPERED)
        .when((F.col("record_type") == "repartition") & F.col("parent_id").isNull(), TAMPERED)
        .otherwise(VERIFIED)
    )
    rows = rows.select("record_id", "record_type", "parent_id", own.alias("own"))
    known = rows.select(F.col("record_id").alias("parent_id"), F.lit(True).alias("_known"))
    rows = rows.join(known, "parent_id", "left")
    rows = rows.withColumn("own", F.when((F.col("own") == VERIFIED) & (F.col("record_type") == "repartition") & F.col("_known").isNull(), MISSING).otherwise(F.col("own")))
    up = F.when((F.col("own") == VERIFIED) & (F.col("record_type") == "repartition"), F.col("parent_id"))
    marked = rows.where(up.isNull() | (F.col("own") != VERIFIED)).select(F.col("record_id").alias("node"))
    ends = nearest_ancestor(rows.select(F.col("record_id").alias("node"), up.alias("parent")), marked)
    return ends.join(rows.select(F.col("record_id").alias("owner"), "own"), "owner").select(F.col("node").alias("record_id"), F.col("own").alias("verdict"))


def tree_paths(entries: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, unreached) of object trees: every file's path under each root tree, and objects that no root leads to.

    entries: tree, name, object, kind (tree or blob); roots: root, tree. Levels are joined one by one.
    """
    level = materialized(roots.select("root", "tree", F.lit("").alias("prefix")))
    files = []
    while not level.isEmpty():
        inside = level.join(entries, "tree").withColumn("path", F.concat("prefix", "name"))
        files.append(inside.where("kind = 'blob'").select("root", "path", "object"))
        level = materialized(inside.where("kind = 'tree'").select("root", F.col("object").alias("tree"), F.concat("path", F.lit("/")).alias("prefix")))
    links = entries.select(F.col("tree").alias("src"), F.col("object").alias("dst"))
    reached = closure(links, roots.select(F.col("tree").alias("node")))
    unreached = entries.select(F.col("tree").alias("node")).unionByName(entries.select(F.col("object").alias("node"))).distinct().join(reached, "node", "left_anti")
    return (union_all(files) if files else level.select("root", F.col("prefix").alias("path"), F.col("tree").alias("object"))), unreached


def live_heads(expected: DataFrame, heads: DataFrame, key: Sequence[str]) -> DataFrame:
    """expected with `live`: whether the current head of each key is what was expected, null-safe."""
    current = heads.withColumnRenamed("head", "_now")
    return expected.join(current, list(key), "left").withColumn("live", F.col("head").eqNullSafe(F.col("_now"))).drop("_now")


def triage_columns(rows: DataFrame, writable: Sequence[str], key: str) -> DataFrame:
    """Only what a triage run may write, with scores in [0, 1] to four places; another score raises."""
    score = F.when(F.col("score").between(0, 1), F.bround(F.col("score").cast("decimal(20,10)"), 4).cast("decimal(5,4)")).otherwise(F.raise_error(F.lit("score outside [0, 1]")).cast("decimal(5,4)"))
    return rows.withColumn("score", score).select(key, *writable)

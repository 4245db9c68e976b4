"""Incremental graphs: what a change affects, which route a rebuild takes, and the difference of two graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.graphs import closure, direct_callers

# Above these shares a degraded snapshot is parsed anew.
THETA_FILES = 0.4
THETA_CONE = 0.25


def affected(changed: DataFrame, changed_types: DataFrame, symbol_users: DataFrame, calls: DataFrame, subtypes: DataFrame, type_of: DataFrame) -> DataFrame:
    """Declarations (node) that a change invalidates: the changed ones, all users of their symbols, their direct callers, and declarations of all subtypes of changed types.

    changed, changed_types: node; symbol_users, calls, subtypes: src, dst (symbol to user, caller to
    callee, type to subtype); type_of: node, type.
    """
    users = closure(symbol_users, changed)
    callers = direct_callers(calls, changed)
    cone = closure(subtypes, changed_types).select(F.col("node").alias("type"))
    typed = type_of.join(cone, "type", "left_semi").select("node")
    return users.unionByName(callers).unionByName(typed).distinct()


def route(verdict: Column, file_ratio: Column, cone_ratio: Column, theta_files: float = THETA_FILES, theta_cone: float = THETA_CONE) -> Column:
    """closed-world, degraded or full-reparse. Only a degraded verdict looks at the shares, files first; a share must exceed its limit."""
    return F.when(verdict != "degraded", verdict).when((file_ratio > theta_files) | (cone_ratio > theta_cone), F.lit("full-reparse")).otherwise(F.lit("degraded"))


def shown_cone_ratio(verdict: Column, file_ratio: Column, cone_ratio: Column, theta_files: float = THETA_FILES) -> Column:
    """The cone's share, null where the route was decided without it."""
    return F.when((verdict == "degraded") & ~(file_ratio > theta_files), cone_ratio)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one graph has, with `change` added or removed; as sets."""
    added = new.subtract(old).withColumn("change", F.lit("added"))
    removed = old.subtract(new).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def rebuild(nodes: DataFrame, edges: DataFrame, touched: DataFrame, parsed_nodes: DataFrame, parsed_edges: DataFrame) -> dict[str, DataFrame]:
    """A new graph that keeps the ids of declarations that aren't touched.

    nodes: node_id, enclosing_decl_fqn, ...; edges: src, dst, kind; touched: enclosing_decl_fqn;
    parsed_nodes and parsed_edges: the touched declarations' new nodes with ids from 0. Fresh ids begin
    above the largest kept one, so they can equal an id that was removed, which then isn't listed as
    removed.
    """
    kept = nodes.join(touched, "enclosing_decl_fqn", "left_anti").select(nodes.columns)
    kept_edges = edges
    for end in ("src", "dst"):
        kept_edges = kept_edges.join(kept.select(F.col("node_id").alias(end)), end, "left_semi")
    base = kept.agg((F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("base"))  # one row
    fresh = parsed_nodes.crossJoin(F.broadcast(base)).withColumn("node_id", F.col("node_id") + F.col("base")).select(nodes.columns)
    fresh_edges = parsed_edges.crossJoin(F.broadcast(base)).select((F.col("src") + F.col("base")).alias("src"), (F.col("dst") + F.col("base")).alias("dst"), "kind")
    new, new_edges = kept.unionByName(fresh), kept_edges.select("src", "dst", "kind").unionByName(fresh_edges)
    return {
        "nodes": new,
        "edges": new_edges,
        "added_nodes": fresh.select("node_id"),
        "removed_nodes": nodes.join(new, "node_id", "left_anti").select("node_id"),
        "added_edges": fresh_edges,
        "removed_edges": edges.select("src", "dst", "kind").join(new_edges, ["src", "dst", "kind"], "left_anti"),
    }

"""Many facts spread over one graph: the graph is condensed first, so that facts visit few places.

Where the edges are known, what holds at a node follows from the nodes before it, whatever the facts are. A node
with one predecessor and no fact of its own holds what that one holds, and two nodes with edges to each other hold
the same. Both are merged. A node with one predecessor or none is released: it leaves the graph, what is its own goes on to its successors, and
once all is known it holds that and what its predecessor holds; short chains of such nodes go at once. Nodes are released and merged until
few edges are left, and only those are visited, several steps a round: on most graphs a round costs more by being one than by its rows.
Facts are numbered by the node that they begin at (their origin); rows are written out for the nodes that are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.tables import Found, counted, forget, materialized, together, union_all, written

# The releasing ends when a round leaves more than SHRINK of its edges, or all rounds have left no more than ENOUGH.
SHRINK, ENOUGH = 0.5, 0.03
# Steps that a round takes; nodes of a chain that are released at once.
HOPS, CHAIN = 3, 4


@dataclass
class Condensed:
    nodes: DataFrame  # *keys, rep: all nodes that any fact reaches
    edges: DataFrame  # rep, dst
    origins: DataFrame  # *keys, origin: nodes with facts of their own
    own: DataFrame  # rep, origin: what the reps that are left have of their own
    released: list[tuple[DataFrame, DataFrame]]  # of each round (rep, up) and (rep, origin): a rep holds its own origins and what up holds


@dataclass
class Solution:
    nodes: DataFrame  # *keys, rep
    facts: DataFrame  # *by, rep, fact; by: the first of the keys, which name a graph

    def at(self, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
        """nodes (*keys, ...) with each fact that holds there."""
        by = [c for c in self.facts.columns if c not in ("rep", "fact")]
        return nodes.join(self.nodes, list(keys)).join(self.facts.drop(*by), "rep").drop("rep")


def _followed(pointers: DataFrame) -> tuple[DataFrame, int]:
    """(node, owner): what each node's pointer (node, parent) leads to, followed up to HOPS times, and their number. All on a pointer's way hold the
    same, so one that leads on may be followed later or never."""
    to = pointers
    for _ in range(HOPS - 1):
        above = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        to = to.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
    return written(to.withColumnRenamed("parent", "owner"))


def _renamed(df: DataFrame, to: DataFrame, *columns: str) -> DataFrame:
    """df after each node became its owner."""
    for c in columns:
        df = df.join(to.select(F.col("node").alias(c), "owner"), c, "left").withColumn(c, F.coalesce("owner", c)).drop("owner")
    return df


def condensed(nodes: DataFrame, edges: DataFrame, own: DataFrame, keys: Sequence[str]) -> Condensed:
    """nodes (*keys): all that facts reach; edges (*keys and the same with dst_ before them); own (*keys): nodes with facts of their own."""
    keys = list(keys)
    numbers = materialized(nodes.select(*keys).withColumn("rep", F.monotonically_increasing_id()))
    dst = numbers.select(*(F.col(k).alias(f"dst_{k}") for k in keys), F.col("rep").alias("dst"))
    (e, n), origins = together(
        nodes.sparkSession,
        lambda: written(edges.join(numbers, keys).join(dst, [f"dst_{k}" for k in keys]).select("rep", "dst").where("rep <> dst").distinct()),
        lambda: materialized(own.select(*keys).distinct().join(numbers, keys).withColumnRenamed("rep", "origin")),
    )
    own = origins.select(F.col("origin").alias("rep"), "origin")
    merged: list[DataFrame] = []
    released: list[tuple[DataFrame, DataFrame, int]] = []
    to, moved = _followed(materialized(_single(e, own))) if n else (None, 0)
    if moved:
        merged.append(to)
        old, (e, n) = e, written(_renamed(e, to, "rep", "dst").where("rep <> dst").distinct())
        forget(old)
    first = n
    while n > ENOUGH * first:
        before = n
        gone, moved = written(_released(e, own))
        out = gone.select("rep", F.explode("via").alias("at")).join(own.withColumnRenamed("rep", "at"), "at").select("rep", "origin")
        kept = _without(e, gone)
        to, same = _followed(_mutual(kept))
        if not moved and not same:
            break
        passed = out.join(e, "rep").select(F.col("dst").alias("rep"), "origin").unionByName(own).join(gone.select("rep"), "rep", "left_anti")
        if moved:
            released.append((gone.select("rep", "up"), out, len(merged)))
        if same:
            merged.append(to)
            kept, passed = _renamed(kept, to, "rep", "dst").where("rep <> dst"), _renamed(passed, to, "rep")
        old, (own, (e, n)) = e, together(nodes.sparkSession, lambda: materialized(passed.distinct()), lambda: written(kept.distinct()))  # noqa: B023
        forget(old)
        if n > SHRINK * before:
            break
    owner = numbers
    for to in merged:
        owner = _renamed(owner, to, "rep")
    layers = []
    for gone, out, at in released:
        for to in merged[at:]:
            gone = _renamed(gone, to, "up")
        layers.append((gone, out))
    return Condensed(materialized(owner.select(*keys, "rep")), e, origins, own, layers)


def _single(edges: DataFrame, own: DataFrame) -> DataFrame:
    one = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("rep").alias("parent")).where("n = 1")
    return one.select(F.col("dst").alias("node"), "parent").join(own.select(F.col("rep").alias("node")).distinct(), "node", "left_anti")


def _released(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(rep, up, via): nodes without predecessor (up: null) and those with one, in chains of up to CHAIN; up: what the chain hangs from, via: the node and those above it in its chain.

    Longer chains lose their beginning; a cycle, which has none, stays.
    """
    one = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("rep").alias("up")).where("n = 1").select(F.col("dst").alias("rep"), "up")
    first = own.select("rep").distinct().join(edges.select(F.col("dst").alias("rep")).distinct(), "rep", "left_anti").join(edges.select("rep").distinct(), "rep", "left_semi")
    pointers = one.unionByName(first.withColumn("up", F.lit(None).cast("long")))
    above = pointers.select(F.col("rep").alias("up"), F.col("up").alias("next"), F.lit(True).alias("more"))
    chains = pointers.withColumn("via", F.array("rep")).withColumn("more", F.lit(True))
    for _ in range(CHAIN):
        longer = chains.drop("more").join(above, "up", "left")
        chains = longer.select("rep", F.when(F.col("more"), F.col("next")).otherwise(F.col("up")).alias("up"), F.when(F.col("more"), F.concat("via", F.array("up"))).otherwise(F.col("via")).alias("via"), "more")
    return chains.where("more is null").drop("more")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges (rep, dst) that are left when nodes are released: those from a released node come from what its chain hangs from."""
    inner = edges.join(gone.select(F.col("rep").alias("dst")), "dst", "left_anti").join(gone.select("rep", "up", F.lit(True).alias("is_gone")), "rep", "left")
    return inner.select(F.when(F.col("is_gone"), F.col("up")).otherwise(F.col("rep")).alias("rep"), "dst").where("rep <> dst")


def _mutual(edges: DataFrame) -> DataFrame:
    """Pointers to the least of the nodes with edges both ways, if that is smaller: they run downwards, so they meet no cycle."""
    back = edges.select(F.col("dst").alias("rep"), F.col("rep").alias("dst"))
    return edges.join(back, ["rep", "dst"], "left_semi").where("dst < rep").groupBy(F.col("rep").alias("node")).agg(F.min("dst").alias("parent"))


def reach(start: DataFrame, edges: DataFrame, on: Sequence[str]) -> DataFrame:
    """start and all rows it leads to over edges (*on, dst), where the last of `on` becomes dst. A round takes HOPS steps, and the next one goes on from what the last step found."""
    on, columns = list(on), start.columns
    table, (n, open_) = counted(start.distinct().withColumn("hop", F.lit(HOPS)), F.lit(True), F.col("hop") == HOPS)
    found = Found()
    found.add(table, n)
    while open_:
        at, steps = table.where(F.col("hop") == HOPS).drop("hop"), []
        for hop in range(1, HOPS + 1):
            at = at.join(edges, on).withColumn(on[-1], F.col("dst")).select(*columns).distinct()
            steps.append(at.withColumn("hop", F.lit(hop)))
        new = union_all(steps).groupBy(*columns).agg(F.min("hop").alias("hop")).join(found.all().drop("hop"), columns, "left_anti")
        table, (n, open_) = counted(new, F.lit(True), F.col("hop") == HOPS)
        if n:
            found.add(table, n)
    return found.all().drop("hop")


def spread(c: Condensed, facts: DataFrame, keys: Sequence[str], by: Sequence[str]) -> Solution:
    """Where facts (*keys, fact) hold in the end, all of which begin at origins; by: the keys that name a graph, in which facts have their names."""
    names = materialized(facts.join(c.origins, list(keys)).select("origin", *by, "fact").distinct())
    wanted = names.select("origin").distinct()
    held = [reach(c.own.join(wanted, "origin", "left_semi").select("rep", "origin"), c.edges, ["rep"])]
    for left, (gone, out) in zip(reversed(range(len(c.released))), reversed(c.released), strict=True):
        above = union_all(held).withColumnRenamed("rep", "up").join(gone, "up").select("rep", "origin")
        layer = above.unionByName(out.join(wanted, "origin", "left_semi").select("rep", "origin")).distinct()
        # nothing but the rows themselves reads the last layer
        held.append(materialized(layer) if left else layer)
    return Solution(c.nodes, union_all(held).join(names, "origin").select(*by, "rep", "fact"))

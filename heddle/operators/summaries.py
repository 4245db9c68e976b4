"""Procedure summaries: what a call gives back, and a cache of it that outlives a run.

Tables as in `heddle.operators.taint`. A procedure's summary maps each fact at its entry to the facts that hold
anywhere in its body, the entry included. At a call whose fact isn't stopped, the callee's summary is
spliced: its facts hold at the call's return sites, the control-flow successors of the call.

A fact that isn't stopped at a call holds at the callee's entry, too, so as soon as one fact leaves a call
all facts of the callee's body hold at its return sites. Which calls are left follows from the nodes alone, so it is found
first; then bodies are nodes with edges to the sites that they return to, and the facts spread over a condensed graph
(`operators.condensed`). Nothing makes the product of entry and body facts; `summary_rows` writes it out for those who ask.

Facts are named `node:ordinal` by their source and clause, so a name means the same after a change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.tables import materialized, together, union_all
from heddle.operators.condensed import Condensed, Solution, condensed, reach, spread
from heddle.operators.taint import _matches, procedures, steps

PLACE = ["spec_id", "graph_id", "node_id", "fact"]


@dataclass
class Program:
    """A graph and its specification, made ready for the fixpoint."""

    proc: DataFrame  # graph_id, node_id, proc
    moves: DataFrame  # graph_id, node_id, dst
    returns: DataFrame  # graph_id, call, proc, dst
    blocked: DataFrame  # spec_id, graph_id, node_id; maybe repeated
    seeds: DataFrame  # spec_id, graph_id, node_id, fact
    sinks: DataFrame  # spec_id, graph_id, node_id


def program(nodes: DataFrame, edges: DataFrame, clauses: DataFrame) -> Program:
    """Joined once, and written: each round reads them."""
    places = ["spec_id", "graph_id", "node_id"]
    proc, both, blocked = together(
        nodes.sparkSession,
        lambda: materialized(procedures(nodes)),
        lambda: materialized(steps(nodes, edges)),
        lambda: materialized(_matches(nodes, clauses, "sanitize").select(*places)),
    )
    calls = both.where("call").select("graph_id", F.col("src").alias("call"), F.col("dst").alias("proc"))
    after = both.where("not call").select("graph_id", F.col("src").alias("call"), "dst")
    fact = F.concat_ws(":", "node_id", "ordinal").alias("fact")
    returns, seeds = together(
        nodes.sparkSession,
        lambda: materialized(calls.join(after, ["graph_id", "call"])),
        lambda: materialized(_matches(nodes, clauses, "source").join(proc, ["graph_id", "node_id"], "left_semi").select(*places, fact)),
    )
    moves = both.select("graph_id", F.col("src").alias("node_id"), "dst").distinct()
    return Program(proc, moves, returns, blocked, seeds, _matches(nodes, clauses, "sink").select(*places).distinct())


NODE = ["spec_id", "graph_id", "node_id"]
GRAPH = ["spec_id", "graph_id"]
_KEYS = [*NODE, "body", "plain"]


def _bodies(p: Program, places: DataFrame) -> DataFrame:
    return places.join(p.proc, ["graph_id", "node_id"]).select("spec_id", "graph_id", "proc", "fact").distinct()


def _passed(p: Program) -> DataFrame:
    """(spec_id, graph_id, node_id, dst): the moves that no sanitizer stops."""
    return materialized(p.seeds.select(*GRAPH).distinct().join(p.moves, "graph_id").join(p.blocked, NODE, "left_anti"))


def _live(p: Program, passed: DataFrame) -> DataFrame:
    """(spec_id, graph_id, node_id): where any fact holds. What a call gives back comes to nodes that the call leads to anyway."""
    return reach(p.seeds.select(*NODE), passed, NODE)


def _left(p: Program, live: DataFrame) -> DataFrame:
    """(spec_id, graph_id, call): the calls that some fact leaves."""
    calls = p.returns.select("graph_id", F.col("call").alias("node_id")).distinct()
    return live.join(calls, ["graph_id", "node_id"], "left_semi").join(p.blocked, NODE, "left_anti").withColumnRenamed("node_id", "call")


@dataclass
class Graph:
    """A program's graph with an edge from each body to the sites that it returns to, condensed."""

    condensed: Condensed
    left: DataFrame  # spec_id, graph_id, call
    plain: bool  # whether it has a second copy of all nodes, in which facts return from no call


def graph(p: Program, plain: bool = False) -> Graph:
    """Nodes, and bodies as nodes of their own (node_id: their procedure) that hold all that holds in them. plain: also the graph without bodies, beside it."""
    passed = _passed(p)
    live = _live(p, passed)
    left, inside = together(
        live.sparkSession,
        lambda: materialized(_left(p, live)),
        lambda: materialized(live.join(p.proc, ["graph_id", "node_id"]).select(*NODE, "proc")),
    )
    kind = lambda body, copy: (F.lit(body).alias("body"), F.lit(copy).alias("plain"))
    nodes, moves = live.select(*NODE, *kind(False, False)), passed.join(live, NODE, "left_semi")

    def ends(df: DataFrame, src: str, a: bool, dst: str, b: bool, copy: bool = False) -> DataFrame:
        to = [*(F.col(c) for c in GRAPH), F.col(dst).alias("node_id"), *kind(b, copy)]
        return df.select(*GRAPH, F.col(src).alias("node_id"), *kind(a, copy), *(c.alias(f"dst_{k}") for k, c in zip(_KEYS, to, strict=True)))

    # what goes from a call to where it returns comes back from the callee as well
    twice = p.returns.select("graph_id", F.col("call").alias("node_id"), "dst").distinct()
    entered = p.returns.select("graph_id", F.col("call").alias("node_id"), F.col("proc").alias("dst")).distinct()
    once = moves.join(twice.join(entered, ["graph_id", "node_id", "dst"], "left_anti"), ["graph_id", "node_id", "dst"], "left_anti")
    back = left.join(p.returns, ["graph_id", "call"])
    edges = [ends(once, "node_id", False, "dst", False), ends(inside, "node_id", False, "proc", True), ends(back, "proc", True, "dst", False)]
    nodes = nodes.unionByName(inside.select(*GRAPH, F.col("proc").alias("node_id")).distinct().select("*", *kind(True, False)))
    if plain:
        edges.append(ends(moves, "node_id", False, "dst", False, True))
        nodes = nodes.unionByName(live.select(*NODE, *kind(False, True)))
    return Graph(condensed(nodes, union_all(edges), _copies(p.seeds, plain), _KEYS), left, plain)


def _copies(df: DataFrame, plain: bool) -> DataFrame:
    """Nodes as the graph has them: once, or also in its plain copy."""
    return df.select("*", F.lit(False).alias("body"), F.explode(F.array(*map(F.lit, [False, True][: 1 + plain]))).alias("plain"))


def tabulate(g: Graph, start: DataFrame) -> Solution:
    """Where the facts of `start` hold in the end; each goes its own way, since the edges don't depend on it."""
    return spread(g.condensed, _copies(start, g.plain), _KEYS, GRAPH)


def places(s: Solution) -> DataFrame:
    """(spec_id, graph_id, node_id, fact): all places of facts."""
    return s.at(s.nodes.where("not body and not plain").select(*_KEYS), _KEYS).select(*PLACE)


def findings(p: Program, places: DataFrame | Solution) -> DataFrame:
    """(spec_id, graph_id, sink, fact): facts that hold at sinks."""
    if isinstance(places, Solution):
        return places.at(_copies(p.sinks, False), _KEYS).select(*GRAPH, F.col("node_id").alias("sink"), "fact")
    return places.join(p.sinks, ["spec_id", "graph_id", "node_id"]).select("spec_id", "graph_id", F.col("node_id").alias("sink"), "fact")


def only_by_summaries(p: Program, s: Solution) -> DataFrame:
    """(spec_id, graph_id, sink, fact, by_summary): facts that hold at sinks, and whether each gets there only by a summary. s: of a graph with its plain copy, where facts hold that also hold beside it."""
    return s.at(_copies(p.sinks, True), _KEYS).groupBy(*GRAPH, F.col("node_id").alias("sink"), "fact").agg((~F.bool_or("plain")).alias("by_summary"))


def solve(nodes: DataFrame, edges: DataFrame, clauses: DataFrame) -> tuple[Program, DataFrame]:
    """The program, and all places of facts with summaries spliced."""
    p = program(nodes, edges, clauses)
    return p, places(tabulate(graph(p), p.seeds))


def summary_totals(p: Program, s: Solution) -> tuple[DataFrame, DataFrame]:
    """(spec_id, graph_id, proc, entry_fact), and (spec_id, graph_id, proc, rep): where the facts of each body are in the solution. Bodies that hold the same share a rep."""
    entries = p.seeds.select("spec_id").distinct().crossJoin(p.proc.where("node_id = proc")).select(*NODE, F.lit(False).alias("body"), F.lit(False).alias("plain"), "proc")
    return s.at(entries, _KEYS).select(*GRAPH, "proc", F.col("fact").alias("entry_fact")), s.nodes.where("body").select(*GRAPH, F.col("node_id").alias("proc"), "rep")


def summary_rows(p: Program, places: DataFrame) -> DataFrame:
    """(spec_id, graph_id, proc, entry_fact, fact): each fact at a procedure's entry with each of its body."""
    entry = places.join(p.proc.where("node_id = proc"), ["graph_id", "node_id"]).select("spec_id", "graph_id", "proc", F.col("fact").alias("entry_fact"))
    return entry.join(_bodies(p, places), ["spec_id", "graph_id", "proc"])


# ---- the cache


class VersionMismatch(ValueError):
    """A cache was made under another version or environment."""


def write_cache(places: DataFrame | Solution, folder: str, version: str, environment: str) -> None:
    """Keeps the places of facts in a folder, under the version and the environment that made them; neither may be empty.

    A solution is kept as it is, without writing its places out. The header is written last, so a cache whose writing
    broke off has none and is refused.
    """
    if not version or not environment:
        raise ValueError("a cache needs a version and an environment")
    kept = {"nodes": places.nodes, "facts": places.facts} if isinstance(places, Solution) else {"places": places.select(*PLACE)}
    for name, table in kept.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    of = (places.nodes if isinstance(places, Solution) else places).sparkSession
    of.createDataFrame([(version, environment)], "version string, environment string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/header")


def _refuse_others(spark: SparkSession, folder: str, version: str, environment: str) -> None:
    found = [tuple(r) for r in spark.read.parquet(f"{folder}/header").limit(2).collect()]
    if found != [(version, environment)]:
        raise VersionMismatch(f"the cache is of {found}, not of {(version, environment)}")


def read_cache(spark: SparkSession, folder: str, version: str, environment: str) -> DataFrame:
    """The places of a cache; raises VersionMismatch if its header isn't this version and environment."""
    _refuse_others(spark, folder, version, environment)
    return spark.read.parquet(f"{folder}/places")


def read_solution(spark: SparkSession, folder: str, version: str, environment: str) -> Solution:
    """The same of a cache that was written from a solution."""
    _refuse_others(spark, folder, version, environment)
    return Solution(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/facts"))


def _solution(places: DataFrame) -> Solution:
    nodes = materialized(places.select(*NODE).distinct().withColumns({"body": F.lit(False), "plain": F.lit(False), "rep": F.monotonically_increasing_id()}))
    return Solution(nodes, places.join(nodes, NODE).select(*GRAPH, "rep", "fact"))


def resumed(p: Program, cached: Solution, affected: DataFrame, g: Graph | None = None) -> tuple[Solution, Solution]:
    """What stays of the solution before a change, and the solution of the facts that the change can touch: together the rows of a full run.

    p: the program after the change; cached: the solution before it; affected (graph_id, proc): all procedures
    whose nodes, edges or meaning changed, and the direct callers of those that came or went; g: the graph of p, if it is
    made already.

    Touched are facts that held in an affected procedure, whose source came or went, or that held in the body of a callee whose call
    is left now and wasn't before, or the other way round, or is left in an affected procedure. No other fact meets an edge that has changed.
    """
    keys = [*GRAPH, "fact"]
    seeds, g = p.seeds, g or graph(p)
    nodes = cached.nodes.where("not body").select(*NODE, "rep")
    inside = p.proc.join(affected, ["graph_id", "proc"], "left_semi").select("graph_id", "node_id").distinct()
    # nodes that are gone have no procedure any more
    stays = nodes.join(p.proc.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_semi")
    gone = nodes.join(stays, NODE, "left_anti")
    hit = nodes.join(inside, ["graph_id", "node_id"], "left_semi").unionByName(gone).select("rep")
    before = _left(p, nodes.select(*NODE))
    changed = union_all([before.join(g.left, [*GRAPH, "call"], "left_anti"), g.left.join(before, [*GRAPH, "call"], "left_anti"), g.left.join(inside.withColumnRenamed("node_id", "call"), ["graph_id", "call"], "left_semi").select(*GRAPH, "call")])
    callees = changed.join(p.returns, ["graph_id", "call"]).select(*GRAPH, "proc").distinct()
    bodies = nodes.join(p.proc, ["graph_id", "node_id"]).join(callees, [*GRAPH, "proc"], "left_semi").select("rep")
    # the facts are many, and what they meet is few: it is looked up in them, and they are made distinct with all others
    at = seeds.join(nodes, NODE, "left").select(*keys, "rep")
    came = at.join(cached.facts.join(at, [*keys, "rep"], "left_semi"), [*keys, "rep"], "left_anti").select(*keys)
    went = cached.facts.select(*keys).join(seeds, keys, "left_anti")
    reps, moved = together(p.proc.sparkSession, lambda: materialized(hit.unionByName(bodies).distinct()), lambda: materialized(came.unionByName(went)))
    held = cached.facts.join(reps, "rep", "left_semi").select(*keys)
    touched = materialized(held.unionByName(moved).distinct())
    kept = Solution(cached.nodes, cached.facts.join(touched, keys, "left_anti"))
    return kept, tabulate(g, seeds.join(touched, keys, "left_semi"))


def resume(p: Program, cached: DataFrame, affected: DataFrame) -> DataFrame:
    """All places of facts after a change, from those before it, as of `resumed`."""
    return union_all([places(s) for s in resumed(p, _solution(cached), affected)])

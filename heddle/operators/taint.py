"""Taint reachability over code property graphs.

nodes: graph_id, node_id, kind, operator_or_literal, resolved_fqn, enclosing_decl_fqn; edges: graph_id,
src, dst, kind; clauses: spec_id, ordinal, primitive (source, sanitize, sink, propagate), pattern.

A pattern matches a node whose operator_or_literal equals it and isn't empty. A source puts a fact on its
node, if that belongs to a procedure; the fact moves along CFG edges, and along CALL edges to METHOD
nodes. A sanitizer stops what leaves its node, not what holds there, so a node that is sanitizer and sink
reports. Propagate clauses have no effect.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.tables import Found, materialized, numbered, union_all, written


def procedures(nodes: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, proc): METHOD nodes are their own procedure, others that of their declaration's name.

    Of METHODs with one name the last in canonical order (graph_id, node_id, rank; default: node_id) has it.
    """
    methods = nodes.where("kind = 'METHOD'")
    rank = F.col("node_id") if order is None else F.col("rank")
    if order is not None:
        methods = methods.join(order, ["graph_id", "node_id"])
    name = F.when(F.col("resolved_fqn") != "", F.col("resolved_fqn")).otherwise(F.col("enclosing_decl_fqn"))
    named = methods.select("graph_id", name.alias("enclosing_decl_fqn"), F.struct(rank.alias("r"), "node_id").alias("m")).where("enclosing_decl_fqn <> ''")
    owner = named.groupBy("graph_id", "enclosing_decl_fqn").agg(F.max("m").getField("node_id").alias("owner"))
    out = nodes.join(owner, ["graph_id", "enclosing_decl_fqn"], "left")
    return out.select("graph_id", "node_id", F.when(F.col("kind") == "METHOD", F.col("node_id")).otherwise(F.col("owner")).alias("proc")).where("proc is not null")


def moves_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, call): where facts go, as often as edges say so; a CALL edge leads to its METHOD's entry."""
    methods = nodes.where("kind = 'METHOD'").select("graph_id", F.col("node_id").alias("dst"))
    flow = edges.where("kind = 'CFG'").select("graph_id", "src", "dst", F.lit(False).alias("call"))
    calls = edges.where("kind = 'CALL'").join(methods, ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst", F.lit(True).alias("call"))
    return flow.unionByName(calls)


def steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same rows, each once."""
    return moves_of(nodes, edges).distinct()


def call_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): procedures that call procedures."""
    proc = procedures(nodes)
    calls = steps(nodes, edges).where("call").join(proc.select("graph_id", F.col("node_id").alias("src"), "proc"), ["graph_id", "src"])
    return calls.select("graph_id", F.col("proc").alias("src"), "dst").distinct()


def _matches(nodes: DataFrame, clauses: DataFrame, primitive: str) -> DataFrame:
    wanted = clauses.where(F.col("primitive") == primitive).select("spec_id", "ordinal", F.col("pattern").alias("operator_or_literal"))
    # broadcast: clauses are a rule file's, and shuffling by operators would put all nodes into a few tasks
    return nodes.where("operator_or_literal <> ''").join(F.broadcast(wanted), "operator_or_literal").select("spec_id", "graph_id", "node_id", "ordinal")


def seeds(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    """(spec_id, graph_id, node_id, fact): facts numbered from 0 by (node, clause) in each graph and specification, in procedures or not.

    The rows of all graphs are numbered in ranges, so that one large graph isn't one task; a graph's first number is taken off.
    """
    keys = ["spec_id", "graph_id"]
    placed = numbered(_matches(nodes, clauses, "source"), [*keys, "node_id", "ordinal"], "place")
    first = placed.groupBy(*keys).agg(F.min("place").alias("first"))
    return placed.join(first, keys).select(*keys, "node_id", (F.col("place") - F.col("first")).alias("fact"))


def tabulate(seeded: DataFrame, moves: DataFrame, blocked: DataFrame) -> DataFrame:
    """(spec_id, graph_id, fact, node_id, depth): all places where facts hold, and the least number of steps to each.

    seeded: spec_id, graph_id, node_id, fact; moves: graph_id, src, dst; blocked: spec_id, graph_id, node_id.
    """
    keys = ["spec_id", "graph_id", "node_id"]
    frontier, n = written(seeded.select(*keys, "fact", F.lit(0).alias("depth")).distinct())
    specs = frontier.select("spec_id", "graph_id").distinct()
    moves = specs.join(moves.select("graph_id", F.col("src").alias("node_id"), "dst"), "graph_id")
    # written: each round reads them, and they are made from whole tables
    passed = materialized(moves.join(blocked.select(*keys), keys, "left_anti").distinct())
    found, depth = Found(), 0
    found.add(frontier, n)
    while True:
        depth += 1
        new = frontier.join(passed, keys).select("spec_id", "graph_id", F.col("dst").alias("node_id"), "fact").distinct()
        new = new.join(found.all().drop("depth"), [*keys, "fact"], "left_anti")
        frontier, n = written(new.withColumn("depth", F.lit(depth)))
        if not n:
            return found.all()
        found.add(frontier, n)


def solve(nodes: DataFrame, edges: DataFrame, clauses: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(spec_id, graph_id, sink, fact, depth): facts that hold at sinks. within (graph_id, proc): only these procedures are entered."""
    proc = procedures(nodes)
    if within is not None:
        proc = proc.join(within, ["graph_id", "proc"], "left_semi")
    moves = steps(nodes, edges)
    if within is not None:
        inside = within.select("graph_id", F.col("proc").alias("dst"))
        moves = moves.where("not call").unionByName(moves.where("call").join(inside, ["graph_id", "dst"], "left_semi"))
    seeded = seeds(nodes, clauses).join(proc, ["graph_id", "node_id"], "left_semi")
    facts = tabulate(seeded, moves, _matches(nodes, clauses, "sanitize"))
    sinks = _matches(nodes, clauses, "sink").select("spec_id", "graph_id", "node_id").distinct()
    return facts.join(sinks, ["spec_id", "graph_id", "node_id"]).select("spec_id", "graph_id", F.col("node_id").alias("sink"), "fact", "depth")


def incremental_solve(nodes: DataFrame, edges: DataFrame, clauses: DataFrame, prior: DataFrame, affected: DataFrame) -> DataFrame:
    """Findings after a change: affected procedures and all their callers are solved again, prior findings elsewhere stay.

    prior: findings as of `solve`; affected: graph_id, proc. Facts are numbered over the whole graph, so
    preserved findings keep their old numbers.
    """
    from heddle.operators.graphs import transitive_callers

    touched = affected.select("graph_id", F.col("proc").alias("node"))
    callers = transitive_callers(call_graph(nodes, edges), touched, ["graph_id"])
    again = materialized(touched.unionByName(callers).distinct().select("graph_id", F.col("node").alias("proc")))
    proc = procedures(nodes).select("graph_id", F.col("node_id").alias("sink"), "proc")
    kept = prior.join(proc, ["graph_id", "sink"], "left").join(again, ["graph_id", "proc"], "left_anti").select(prior.columns)
    return kept.unionByName(solve(nodes, edges, clauses, again))


def witnesses(nodes: DataFrame, edges: DataFrame, clauses: DataFrame, order: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(spec_id, graph_id, sink, fact, witness): the path by which each finding's fact first arrived.

    In each graph the pair of least (canonical rank, fact) moves first, and the first to bring a fact to
    a node is its predecessor; so this is a search of one graph and specification at a time. parts: how many tasks
    the graphs are dealt to, as each sorts all it gets.
    """
    rank = nodes.select("graph_id", "node_id", F.col("node_id").alias("rank")) if order is None else order
    parts = parts or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # only METHODs and sources have to meet
    sources = F.broadcast(clauses.where("primitive = 'source'").select(F.col("pattern").alias("operator_or_literal")).distinct().withColumn("is_source", F.lit(True)))
    proc = procedures(nodes.join(sources, "operator_or_literal", "left").where("kind = 'METHOD' OR is_source"), order)
    start = seeds(nodes, clauses).join(proc, ["graph_id", "node_id"], "left_semi")
    at = lambda what, primitive: _matches(nodes, clauses, primitive).select("spec_id", "graph_id", F.lit(what).alias("what"), F.col("node_id").alias("a"), F.lit(None).cast("long").alias("b"))
    marks = union_all([start.select("spec_id", "graph_id", F.lit("seed").alias("what"), F.col("node_id").alias("a"), F.col("fact").alias("b")), at("stop", "sanitize"), at("sink", "sink")])
    moves = moves_of(nodes, edges).select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("call").cast("int").alias("c"))
    whole = moves.unionByName(rank.select("graph_id", F.col("node_id").alias("a"), F.col("rank").cast("long").alias("b"), F.lit(None).cast("int").alias("c")))
    of = lambda what, x: F.collect_list(F.when(F.col("what") == what, x)).alias(what)
    marks = marks.repartition(parts, "graph_id").groupBy("spec_id", "graph_id").agg(of("seed", F.struct("a", "b")), of("stop", F.col("a")), of("sink", F.col("a"))).where(F.size("seed") > 0)
    whole = whole.where("a IS NOT NULL AND b IS NOT NULL").repartition(parts, "graph_id").groupBy("graph_id").agg(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("a", "b", "c"))).alias("move"), F.collect_list(F.when(F.col("c").isNull(), F.struct("a", "b"))).alias("rank"))
    columns = ["spec_id", "graph_id", "seed", "stop", "sink", "move", "rank"]
    none = [F.coalesce(c, F.array().cast(whole.schema[c].dataType)).alias(c) for c in ("move", "rank")]
    return marks.join(whole.hint("merge"), "graph_id", "left").withColumns(dict(zip(("move", "rank"), none, strict=True))).select(*columns).mapInArrow(_searched, "spec_id string, graph_id string, sink long, fact long, witness array<long>")


# Graphs of a batch whose rows are Python's at a time.
GRAPHS = 200


def _rows(lists: pa.ListArray) -> list[list[tuple]]:
    """The items of each list as tuples of numbers; none is null."""
    ends = lists.offsets.to_numpy().tolist()
    values = lists.values.slice(ends[0], ends[-1] - ends[0])
    columns = values.flatten() if pa.types.is_struct(values.type) else [values]
    flat = list(zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True))
    return [flat[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, GRAPHS):
            b = batch.slice(k, GRAPHS)
            lists = zip(*(_rows(b[c]) for c in ("seed", "stop", "sink", "move", "rank")), strict=True)
            out = [(spec, graph, *found) for spec, graph, x in zip(b["spec_id"].to_pylist(), b["graph_id"].to_pylist(), lists, strict=True) for found in _search(*x)]
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["spec_id", "graph_id", "sink", "fact", "witness"])


def _search(seed: list[tuple], stop: list[tuple], sink: list[tuple], move: list[tuple], ranked: list[tuple]) -> Iterator[tuple[int, int, list[int]]]:
    """(sink, fact, witness) of one graph: facts (node, fact), nodes (node,), moves (from, to, whether it's a call) and ranks (node, rank)."""
    last = 1 << 62
    rank, stops = dict(ranked), {n for (n,) in stop}
    moves: dict = {}
    for _, _, a, b in sorted((c, rank.get(b, last), a, b) for a, b, c in move):
        moves.setdefault(a, []).append(b)
    came: dict = {}
    queue: list = []

    def arrive(node: int, fact: int, source: tuple | None) -> None:
        if (node, fact) not in came:
            came[node, fact] = source
            heapq.heappush(queue, (rank.get(node, last), fact, node))

    for fact, node in sorted((fact, node) for node, fact in seed):
        arrive(node, fact, None)
    while queue:
        _, fact, node = heapq.heappop(queue)
        if node not in stops:
            for nxt in moves.get(node, ()):
                arrive(nxt, fact, (node, fact))
    facts: dict = {n: [] for (n,) in sink}
    for node, fact in came:
        if node in facts:
            facts[node].append(fact)
    for node in sorted(facts, key=lambda n: (rank.get(n, last), n)):
        for fact in sorted(facts[node]):
            path, at = [], (node, fact)
            while at is not None:
                path.append(at[0])
                at = came[at]
            yield node, fact, path[::-1]

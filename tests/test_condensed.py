"""Facts that spread over a condensed graph: few places are visited, and the rows stay the same."""

import random

from pyspark.sql import functions as F

from heddle.functions import tables
from heddle.operators import condensed, summaries, taint
from heddle.plans import summary_queries
from tests.test_summaries import CLAUSE, CLAUSES, EDGES, NODES, _changed, _places, _program, _tables

TINY = "/root/testdata/sf0.001"


def test_what_a_callee_gives_back_is_visited_once(spark):
    """30 sources in a body that is called 40 times by each of two procedures."""
    nodes, edges = [("g", 0, "METHOD", "", "m", "")], []
    nodes += [("g", k, "CALL", "src", "", "m") for k in range(1, 31)]
    edges += [("g", k, k + 1, "CFG") for k in range(30)]
    for p in (1000, 2000):
        nodes += [("g", p, "METHOD", "", f"m{p}", "")] + [("g", p + k, "CALL", "src" if k == 1 else "x", "", f"m{p}") for k in range(1, 42)]
        edges += [("g", p + k, p + k + 1, "CFG") for k in range(41)] + [("g", p + k, 0, "CALL") for k in range(1, 41)]
    p = summaries.program(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(CLAUSES, CLAUSE))
    s = summaries.tabulate(summaries.graph(p), p.seeds)
    n = summaries.places(s).count()
    assert n > 2 * 40 * 30 and s.facts.count() < n / 2


def test_condensed_graphs_against_a_plain_search(spark):
    rng = random.Random(5)
    edges, own, want = [], [], set()
    for g in range(60):
        n = rng.randrange(2, 12)
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))}
        seeds = {rng.randrange(n) for _ in range(rng.randrange(1, 4))}
        for s in seeds:
            at, todo = {s}, [s]
            while todo:
                a = todo.pop()
                for x, y in pairs:
                    if x == a and y not in at:
                        at.add(y)
                        todo.append(y)
            want |= {(g, v, str(s)) for v in at}
        reached = {v for h, v, _ in want if h == g}
        edges += [(g, a, g, b) for a, b in pairs if a in reached]
        own += [(g, s, str(s)) for s in seeds]
    keys = ["g", "v"]
    nodes = spark.createDataFrame(sorted({(g, v) for g, v, _ in want}), "g long, v long")
    facts = spark.createDataFrame(own, "g long, v long, fact string")
    c = condensed.condensed(nodes, spark.createDataFrame(edges, "g long, v long, dst_g long, dst_v long"), facts, keys)
    assert c.nodes.select("rep").distinct().count() < nodes.count()
    got = condensed.spread(c, facts, keys, ["g"]).at(nodes, keys)
    assert {(r.g, r.v, r.fact) for r in got.collect()} == want


def test_a_solution_is_resumed_as_a_full_run(spark, tmp_path):
    rng = random.Random(11)
    before = [_program(rng, f"g{g}") for g in range(60)]
    after = [_changed(rng, *x, f"g{g}") for g, x in enumerate(before)]
    p = summaries.program(*_tables(spark, before))
    summaries.write_cache(summaries.tabulate(summaries.graph(p), p.seeds), str(tmp_path), "1", "env")
    p, full = summaries.solve(*_tables(spark, after))
    affected = spark.createDataFrame([(f"g{g}", a) for g, x in enumerate(after) for a in x[2]], "graph_id string, proc long")
    parts = summaries.resumed(p, summaries.read_solution(spark, str(tmp_path), "1", "env"), affected)
    assert set().union(*(_places(summaries.places(s)) for s in parts)) == _places(full)


def test_summaries_make_no_product_of_entries_and_bodies(spark, monkeypatch):
    monkeypatch.setattr(summaries, "summary_rows", None)
    assert summary_queries.procedure_summaries(spark, TINY).agg(F.count("*")).first()[0] > 0


def test_sources_that_hang_from_a_cycle_are_released(spark):
    """A cycle of three nodes, 20 sources that it leads to, each with a source behind it: nothing but the cycle is left to visit."""
    edges = [("g", a, "g", b) for a, b in [(0, 1), (1, 2), (2, 0), *((0, 10 + k) for k in range(20)), *((10 + k, 50 + k) for k in range(20))]]
    own = [("g", v, str(v)) for v in (0, *range(10, 30), *range(50, 70))]
    nodes = spark.createDataFrame([("g", v) for v in (0, 1, 2, *range(10, 30), *range(50, 70))], "g string, v long")
    facts = spark.createDataFrame(own, "g string, v long, fact string")
    c = condensed.condensed(nodes, spark.createDataFrame(edges, "g string, v long, dst_g string, dst_v long"), facts, ["g", "v"])
    assert c.edges.count() <= 3
    got = condensed.spread(c, facts, ["g", "v"], ["g"]).at(nodes, ["g", "v"])
    want = {(v, "0") for v in (0, 1, 2, *range(10, 30), *range(50, 70))} | {(v, str(v)) for v in (*range(10, 30), *range(50, 70))} | {(50 + k, str(10 + k)) for k in range(20)}
    assert {(r.v, r.fact) for r in got.collect()} == want


def test_chains_of_sources_are_released_at_once(spark):
    """A cycle of three nodes that two chains of three sources hang from, which meet in one node."""
    pairs = [(0, 1), (1, 2), (2, 0), (0, 10), (10, 11), (11, 12), (2, 20), (20, 21), (21, 22), (12, 30), (22, 30)]
    own = [0, 10, 11, 12, 20, 21, 22]
    nodes = spark.createDataFrame([("g", v) for v in (1, 2, *own, 30)], "g string, v long")
    edges = spark.createDataFrame([("g", a, "g", b) for a, b in pairs], "g string, v long, dst_g string, dst_v long")
    facts = spark.createDataFrame([("g", v, str(v)) for v in own], "g string, v long, fact string")
    c = condensed.condensed(nodes, edges, facts, ["g", "v"])
    first, _ = c.released[0]
    assert first.count() >= 6
    got = {(r.v, r.fact) for r in condensed.spread(c, facts, ["g", "v"], ["g"]).at(nodes, ["g", "v"]).collect()}
    assert got == {(v, "0") for v in (1, 2, *own, 30)} | {(b + k, str(b + j)) for b in (10, 20) for k in range(3) for j in range(k + 1)} | {(30, str(f)) for f in own}


def test_a_round_takes_several_steps(spark, monkeypatch):
    """40 nodes, each with edges to the next two: the last is 20 steps from the first."""
    nodes = spark.createDataFrame([("g", v) for v in range(40)], "g string, v long")
    edges = spark.createDataFrame([("g", v, "g", v + k) for v in range(40) for k in (1, 2) if v + k < 40], "g string, v long, dst_g string, dst_v long")
    facts = spark.createDataFrame([("g", v, str(v)) for v in range(40)], "g string, v long, fact string")
    c = condensed.condensed(nodes, edges, facts, ["g", "v"])
    made, real = [], tables.uuid.uuid4
    monkeypatch.setattr(tables.uuid, "uuid4", lambda: made.append(1) or real())
    s = condensed.spread(c, facts, ["g", "v"], ["g"])
    assert len(made) <= 12
    assert {(r.v, int(r.fact)) for r in s.at(nodes, ["g", "v"]).collect()} == {(v, f) for v in range(40) for f in range(v + 1)}


def test_nodes_are_not_shuffled_by_operator(spark):
    nodes, _, clauses = _tables(spark, [([("g", 1, "CALL", "src", "", "m")], [("g", 1, 1, "CFG")])])
    found = taint._matches(nodes, clauses, "source")
    assert found.count() == 1 and "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()

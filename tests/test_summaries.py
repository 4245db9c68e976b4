"""Procedure summaries against a plain fixpoint on random programs, and their cache."""

import random

import pytest

from heddle.operators import summaries

NODES = "graph_id string, node_id long, kind string, operator_or_literal string, resolved_fqn string, enclosing_decl_fqn string"
EDGES = "graph_id string, src long, dst long, kind string"
CLAUSES = [("s", 0, "source", "src"), ("s", 1, "source", "both"), ("s", 2, "sink", "sink"), ("s", 3, "sanitize", "clean"), ("s", 4, "sink", "both")]
CLAUSE = "spec_id string, ordinal int, primitive string, pattern string"


def _program(rng, graph):
    """Up to five procedures of control-flow lines with loops and calls; some calls lead nowhere."""
    nodes, edges, inside = [], [], {}
    n_procs = rng.randrange(2, 6)
    for p in range(n_procs):
        entry = 100 * p
        nodes.append((graph, entry, "METHOD", "", f"m{p}", ""))
        inside[p] = [entry]
        for k in range(1, rng.randrange(2, 8)):
            nodes.append((graph, entry + k, "CALL", rng.choice(["src", "both", "sink", "clean", "", "x"]), "", f"m{p}"))
            edges.append((graph, entry + k - 1, entry + k, "CFG"))
            inside[p].append(entry + k)
        if rng.random() < 0.4:
            edges.append((graph, rng.choice(inside[p]), rng.choice(inside[p]), "CFG"))
    for p in range(n_procs):
        for _ in range(rng.randrange(3)):
            edges.append((graph, rng.choice(inside[p]), 100 * rng.randrange(n_procs + 1), "CALL"))
    return nodes, edges


def _brute(nodes, edges):
    of = {n[1]: (n[5] or n[4]) for n in nodes}
    body, entry = {}, {n[4]: n[1] for n in nodes if n[2] == "METHOD"}
    for n, m in of.items():
        body.setdefault(m, []).append(n)
    at = {n: set() for n in of}
    for n in nodes:
        at[n[1]] |= {f"{n[1]}:{o}" for _, o, what, pattern in CLAUSES if what == "source" and pattern == n[3]}
    flow = [(a, b) for _, a, b, kind in edges if kind == "CFG"]
    calls = [(a, of[b]) for _, a, b, kind in edges if kind == "CALL" and b in of]
    clean = {n[1] for n in nodes if n[3] == "clean"}
    while True:
        before = {n: set(f) for n, f in at.items()}
        for a, b in flow:
            if a not in clean:
                at[b] |= at[a]
        summary = {m: {f: set().union(*(at[n] for n in body[m])) for f in at[e]} for m, e in entry.items()}
        for a, m in calls:
            if a not in clean:
                at[entry[m]] |= at[a]
                for b in (y for x, y in flow if x == a):
                    at[b] |= set().union(*(summary[m].get(f, set()) for f in at[a]))
        if at == before:
            return {(n, f) for n, fs in at.items() for f in fs}, {(entry[m], f, g) for m, s in summary.items() for f, gs in s.items() for g in gs}


def _changed(rng, nodes, edges, graph):
    """Other operators, edges and procedures, and the procedures that this affects."""
    affected = {rng.choice([n[1] for n in nodes if n[2] == "METHOD"])}
    home = lambda n: n // 100 * 100
    if rng.random() < 0.3:  # a procedure goes
        gone = rng.choice([n[1] for n in nodes if n[2] == "METHOD"])
        affected |= {home(a) for _, a, b, kind in edges if kind == "CALL" and b == gone} | {gone}
        nodes = [n for n in nodes if home(n[1]) != gone]
        edges = [e for e in edges if home(e[1]) != gone and not (e[3] == "CFG" and home(e[2]) == gone)]
    new = [n if home(n[1]) not in affected or n[2] == "METHOD" else (*n[:3], rng.choice(["src", "both", "sink", "clean", "", "x"]), *n[4:]) for n in nodes]
    kept = [e for e in edges if home(e[1]) not in affected or e[3] == "CFG" or rng.random() < 0.5]
    for a in sorted(affected & {n[1] for n in new}):
        if rng.random() < 0.5:
            kept.append((graph, rng.choice([n[1] for n in new if home(n[1]) == a]), rng.choice([n[1] for n in new if n[2] == "METHOD"]), "CALL"))
    return new, kept, sorted(affected & {n[1] for n in new})


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(2)
    before, after = [], []
    for g in range(120):
        nodes, edges = _program(rng, f"g{g}")
        before.append((nodes, edges))
        after.append(_changed(rng, nodes, edges, f"g{g}"))
    return before, after


def _tables(spark, programs):
    flat = lambda i: [row for p in programs for row in p[i]]
    return spark.createDataFrame(flat(0), NODES), spark.createDataFrame(flat(1), EDGES), spark.createDataFrame(CLAUSES, CLAUSE)


def _places(df):
    return {(r.graph_id, r.node_id, r.fact) for r in df.collect()}


def test_summaries_and_resumed_runs(spark, many, tmp_path):
    before, after = many
    p, places = summaries.solve(*_tables(spark, before))
    want = [_brute(n, e) for n, e in before]
    assert _places(places) == {(f"g{g}", *x) for g, w in enumerate(want) for x in w[0]}
    rows = {(r.graph_id, r.proc, r.entry_fact, r.fact) for r in summaries.summary_rows(p, places).collect()}
    assert rows == {(f"g{g}", *x) for g, w in enumerate(want) for x in w[1]} and len(rows) > 500
    summaries.write_cache(places, str(tmp_path), "1", "env")
    p = summaries.program(*_tables(spark, after))
    affected = spark.createDataFrame([(f"g{g}", a) for g, x in enumerate(after) for a in x[2]], "graph_id string, proc long")
    got = _places(summaries.resume(p, summaries.read_cache(spark, str(tmp_path), "1", "env"), affected))
    assert got == {(f"g{g}", *x) for g, (n, e, _) in enumerate(after) for x in _brute(n, e)[0]}


def test_a_cache_of_another_version_is_refused(spark, tmp_path):
    places = spark.createDataFrame([("s", "g", 1, "1:0")], "spec_id string, graph_id string, node_id long, fact string")
    summaries.write_cache(places, str(tmp_path), "1", "env")
    assert summaries.read_cache(spark, str(tmp_path), "1", "env").count() == 1
    for other in (("2", "env"), ("1", "other"), ("", "env")):
        with pytest.raises(summaries.VersionMismatch):
            summaries.read_cache(spark, str(tmp_path), *other)
    with pytest.raises(ValueError):
        summaries.write_cache(places, str(tmp_path), "", "env")


def test_no_sources_no_places(spark):
    nodes, edges, clauses = _tables(spark, [([("g", 0, "METHOD", "", "m", ""), ("g", 1, "CALL", "x", "", "m")], [("g", 0, 1, "CFG")])])
    _, places = summaries.solve(nodes, edges, clauses)
    assert places.count() == 0

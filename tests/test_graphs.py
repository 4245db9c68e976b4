import itertools
import random

from heddle.operators import graphs, identity, taint

NODE = "graph_id string, node_id long, kind string, operator_or_literal string, resolved_fqn string, enclosing_decl_fqn string, structural_path string"
EDGE = "graph_id string, src long, dst long, kind string"
CLAUSE = "spec_id string, ordinal int, primitive string, pattern string"


def graph(spark, nodes, edges):
    """nodes: (id, kind, text, own name, declaration)."""
    n = spark.createDataFrame([("g", i, k, o, f, d, "") for i, k, o, f, d in nodes], NODE)
    return n, spark.createDataFrame([("g", a, b, k) for a, b, k in edges], EDGE)


def rules(spark):
    return spark.createDataFrame([("s", 0, "source", "in"), ("s", 1, "sanitize", "clean"), ("s", 2, "sink", "out"), ("s", 3, "sink", "clean")], CLAUSE)


def body(*texts):
    return [(0, "METHOD", "", "f", ""), *((i + 1, "CALL", t, "", "f") for i, t in enumerate(texts))]


def line(n):
    return [(i, i + 1, "CFG") for i in range(n)]


def found(df):
    return sorted((r.sink, r.fact) for r in df.collect())


def test_chain_and_witness(spark):
    n, e = graph(spark, body("in", "x", "out"), line(3))
    assert found(taint.solve(n, e, rules(spark))) == [(3, 0)]
    assert [r.witness for r in taint.witnesses(n, e, rules(spark)).collect()] == [[1, 2, 3]]


def test_sanitizer_stops_what_leaves_but_reports_itself(spark):
    n, e = graph(spark, body("in", "clean", "out"), line(3))
    assert found(taint.solve(n, e, rules(spark))) == [(2, 0)]


def test_source_without_procedure_is_not_seeded(spark):
    n, e = graph(spark, [(0, "METHOD", "", "f", ""), (1, "CALL", "in", "", "nowhere"), (2, "CALL", "out", "", "f")], [(1, 2, "CFG")])
    assert found(taint.solve(n, e, rules(spark))) == []


def test_calls_cycles_and_empty_text(spark):
    nodes = [(0, "METHOD", "", "f", ""), (1, "CALL", "in", "", "f"), (2, "METHOD", "", "g", ""), (3, "CALL", "out", "", "g"), (4, "CALL", "", "", "g")]
    n, e = graph(spark, nodes, [(1, 2, "CALL"), (2, 3, "CFG"), (3, 4, "CFG"), (4, 0, "CALL"), (0, 1, "CFG"), (1, 4, "CALL")])
    assert found(taint.solve(n, e, rules(spark))) == [(3, 0)]
    callers = graphs.transitive_callers(taint.call_graph(n, e), spark.createDataFrame([("g", 2)], "graph_id string, node long"), ["graph_id"])
    assert sorted(r.node for r in callers.collect()) == [0, 2]  # on a cycle, so a seed is its own caller


def test_incremental_keeps_what_lies_outside(spark):
    nodes = [(0, "METHOD", "", "f", ""), (1, "CALL", "in", "", "f"), (2, "CALL", "out", "", "f"), (3, "METHOD", "", "g", ""), (4, "CALL", "in", "", "g"), (5, "CALL", "out", "", "g")]
    n, e = graph(spark, nodes, [(1, 2, "CFG"), (4, 5, "CFG")])
    prior = taint.solve(n, e, rules(spark))
    touched = spark.createDataFrame([("g", 0)], "graph_id string, proc long")
    assert found(taint.incremental_solve(n, e.where("src <> 1"), rules(spark), prior, touched)) == [(5, 1)]


def test_closure_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    seeds = [1, 2]
    got = {r.node for r in graphs.closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "node long")).collect()}
    want, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in want:
                want.add(b)
                todo.append(b)
    assert got == want
    none = graphs.closure(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "node long"))
    assert none.count() == 0


def test_refine_tells_direction_and_multiplicity_apart(spark):
    nodes = spark.createDataFrame([(i, "x") for i in range(5)], "node long, label string")
    edges = spark.createDataFrame([(0, 1, "e"), (0, 1, "e"), (2, 3, "e")], "src long, dst long, kind string")
    c = {r.node: r.color for r in graphs.refine(nodes, edges).collect()}
    assert len(set(c.values())) == 5


def test_canonical_hash_is_the_same_for_isomorphic_graphs_only(spark):
    pairs = [(a, b) for a in range(3) for b in range(3) if a != b]
    rows_n, rows_e, edge_sets = [], [], []
    for k, bits in enumerate(itertools.product((0, 1), repeat=6)):
        es = [p for p, b in zip(pairs, bits, strict=True) if b]
        edge_sets.append(es)
        rows_n += [(f"{k}", i, "X", "", "", "", "") for i in range(3)]
        rows_e += [(f"{k}", a, b, "e") for a, b in es]
    got = identity.canonical_graphs(spark.createDataFrame(rows_n, NODE), spark.createDataFrame(rows_e, EDGE))
    hashes = {int(r.graph_id): r.graph_sha256 for r in got.collect()}
    least = lambda es: min(tuple(sorted((p[a], p[b]) for a, b in es)) for p in itertools.permutations(range(3)))
    for i, j in itertools.combinations(range(64), 2):
        assert (hashes[i] == hashes[j]) == (least(edge_sets[i]) == least(edge_sets[j]))


def test_search_that_gives_up_is_weak_and_stable(spark):
    n = spark.createDataFrame([("g", i, "X", "", "", "d", str(i)) for i in range(6)], NODE)
    e = spark.createDataFrame([("g", i, (i + 1) % 6, "e") for i in range(6)], EDGE)
    rows = [identity.canonical_graphs(n, e, states=1).first() for _ in range(2)]
    assert rows[0] == rows[1] and rows[0].fingerprint_class == "weak"
    assert identity.canonical_graphs(n, e).first().fingerprint_class == "strong"


def test_slices_ignore_names_of_locals_and_packages(spark):
    def sliced(name, pkg):
        nodes = [("g", 0, "METHOD", "", f"{pkg}.f", "", ""), ("g", 1, "IDENTIFIER", name, "", f"{pkg}.f", ""), ("g", 2, "LITERAL", "7", "", f"{pkg}.f", "")]
        return identity.slice_fingerprints(spark.createDataFrame(nodes, NODE), spark.createDataFrame([("g", 1, 2, "PDG")], EDGE)).first().slice_sha256

    assert sliced("a", "x.y") == sliced("bb", "z")

"""What keeps queries within their limits on larger tables."""

import hashlib
import random
import zlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from heddle.functions import tables
from heddle.operators import attest, graphs, identity, taint
from heddle.plans import file_queries, graph_queries, inventory_queries, observed_queries
from heddle.sources import cpg, objects, observed, reports, stores

TINY = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_written_once(spark, monkeypatch):
    made, real = [], observed.materialized
    monkeypatch.setattr(observed, "materialized", lambda df: made.append(df) or real(df))
    docs = spark.createDataFrame([("g", '{"nodes":[{"id":"1","kind":"A","properties":{"X":"1"},"missing_properties":[]}],"edges":[{"src":"1","dst":"1","kind":"E","properties":{}}]}'), ("h", "["), ("i", '{"nodes":[]}')], "graph_id string, json string")
    d = observed.read(docs, spark.createDataFrame([("A", "X", "str", "one")], "kind string, name string, native string, quantity string"), spark.createDataFrame([("E", None)], "kind string, name string"))
    assert len(made) == 1
    assert [(r.graph_id, r.ordinal, r.id, r.kind, r.missing) for r in d.nodes.collect()] == [("g", 0, "1", "A", [])]
    assert [(r.graph_id, r.ordinal, r.src, r.dst, r.kind) for r in d.edges.collect()] == [("g", 0, "1", "1", "E")]
    assert sorted(r.graph_id for r in d.broken.collect()) == ["h", "i"]


def test_ends_with_repeated_names(spark):
    node = lambda i, kind: '{"id":%s,"kind":"%s","properties":{},"missing_properties":[]}' % (i, kind)
    edge = lambda a, b, kind: '{"src":"%s","dst":"%s","kind":"%s","properties":{}}' % (a, b, kind)
    nodes = [node('"1"', "METHOD"), node('"2"', "METHOD_RETURN"), node('"3"', "METHOD_PARAMETER_IN"), node('"3"', "BLOCK"), node('"4"', "METHOD_PARAMETER_IN"), node("5", "BLOCK")]
    edges = [edge(1, 2, "AST"), edge(3, 4, "AST"), edge(9, 1, "AST"), edge(2, 1, "AST"), edge(4, 8, "REF")]
    docs = spark.createDataFrame([("g", '{"nodes":[%s],"edges":[%s]}' % (",".join(nodes), ",".join(edges)))], "graph_id string, json string")
    d = observed.read(docs, spark.createDataFrame([("BLOCK", "X", "str", "many")], "kind string, name string, native string, quantity string"), spark.createDataFrame([("AST", None), ("REF", None)], "kind string, name string"))
    wanted = {"repeated_id", "ends", "formal_without_method", "cyclic_ownership"}
    found = sorted((r.rule, r.subject) for r in observed.violations(d).collect() if r.rule in wanted)
    plain = [("cyclic_ownership", "1"), ("cyclic_ownership", "2"), ("ends", "dangling:4>8"), ("ends", "dangling:9>1"), ("ends", "owners:2>1")]
    # 3 is a formal without a parent, and 4's parent is a formal and a block
    assert found == [*plain, ("formal_without_method", "3"), ("formal_without_method", "4"), ("formal_without_method", "4"), ("repeated_id", "3")]


def test_cycles_take_as_many_rounds_as_one_graph_needs(spark, monkeypatch):
    rounds, real = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df: rounds.append(1) or real(df))
    rows = spark.range(2000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1))).alias("node")).withColumn("parent", 1 - F.col("node"))
    assert graphs.cycles(rows, ["g"]).count() == 4000
    assert len(rounds) <= 4


def test_views_broadcast_no_table_of_nodes(spark):
    d = observed_queries._documents(spark, TINY, False)
    assert "BroadcastHashJoin" not in _plan(observed.views(d))
    assert "BroadcastHashJoin" not in _plan(observed.ownership(d))


def _files(spark, monkeypatch, name, counted):
    """How many results the largest file has, and the query's rows."""
    sizes, real = [], getattr(reports, name)
    monkeypatch.setattr(reports, name, lambda s, path: sizes.append(max(r.n for r in s.read.text(path, wholetext=True).select((F.size(F.split("value", counted)) - 1).alias("n")).collect())) or real(s, path))
    rows = sorted(map(tuple, {"read_results": file_queries.tool_results, "read_sarif": file_queries.sarif_results}[name](spark, TINY).collect()), key=repr)
    return sizes[0], rows


def test_files_of_reports_are_bounded(spark, monkeypatch):
    for name, counted in (("read_results", '"check_id"'), ("read_sarif", '"startLine"')):
        with monkeypatch.context() as m:
            _, whole = _files(spark, m, name, counted)
        with monkeypatch.context() as m:
            m.setattr(file_queries, "FILE", 20)
            largest, parts = _files(spark, m, name, counted)
        assert parts == whole and largest < 80


def test_like_graphs_are_searched_once():
    identity._searched.cache_clear()
    node = lambda i, label: identity.Node(i, "CALL", label, "", "", "")
    found = [identity._canonical([node(0, "root"), *(node(i, x) for i, x in enumerate(leaves, 1))], [(0, i, "AST") for i in (2, 1, 3)], identity.STATES) for leaves in ("abc", "cab", "bca")]
    assert len({code for _, code, _ in found}) == 1 and identity._searched.cache_info().misses == 1
    assert [ids[:3] for ids, _, _ in found] == [[1, 2, 3], [2, 3, 1], [3, 1, 2]]


def test_digests_of_splits_gather_no_part(spark):
    ids = [f"case:{hashlib.sha256(str(i).encode()).hexdigest()[:32]}" for i in range(300)] + ["case:other", "a"]
    out, training, digest = stores.splits(spark.createDataFrame([(i,) for i in ids + ids[:9]], "row_id string"))
    assert "collect_set" not in _plan(digest)
    for part, rows in ((True, out), (False, training)):
        want = hashlib.sha256("\n".join(sorted({r.row_id for r in rows.collect()})).encode()).hexdigest()
        assert [r.ids_sha256 for r in digest.where(F.col("held_out") == part).collect()] == [want]


def test_rounds_of_taint_read_written_moves(spark, monkeypatch):
    plans, real = [], taint.written
    monkeypatch.setattr(taint, "written", lambda df: plans.append(_plan(df)) or real(df))
    assert taint.solve(*graph_queries.event_graph(spark, TINY)).count() > 0
    assert len(plans) > 2 and not any("Window" in p for p in plans[1:])


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(20).selectExpr("id % 3 a", "id % 2 b")
    got = attest.attested((rows, rows.where("a > 0")), (rows, rows.where("b = 0")), 7)
    assert _plan(got).count(", 7)") >= 3
    assert tuple(got.first())[:2] == (7, 0) and not got.first().identical
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    assert all(f", {10 * 1500 // 100})" in _plan(df) for df in inventory_queries._scans(spark, TINY))
    assert tables.parts(spark, 1) == 4


def test_imported_nodes_are_numbered_in_ranges(spark):
    nodes = spark.createDataFrame([(g, f"n{i}", "METHOD", None, f"m{i}", None, f"m{i}", "f", i, 0) for g in "ab" for i in (2, 1, 3)], "graph_id string, id string, label string, code string, name string, methodFullName string, fullName string, filename string, lineNumber int, columnNumber int")
    edges = spark.createDataFrame([("a", "n1", "n3", "AST")], "graph_id string, src string, dst string, kind string")
    out, e, _ = cpg.mapped(nodes, edges)
    assert "Window" not in _plan(out)
    assert sorted((r.graph_id, r.node_id, r.resolved_fqn) for r in out.collect()) == [(g, i - 1, f"m{i}") for g in "ab" for i in (1, 2, 3)]
    assert [tuple(r) for r in e.collect()] == [("a", 0, 2, "AST")]


def test_texts_are_deflated_in_small_batches(spark):
    rows = spark.createDataFrame([(bytearray(b"abc"),)], "payload binary").select(*objects.stored("blob", F.col("payload")))
    assert "ArrowEvalPython" not in _plan(rows)
    assert zlib.decompress(rows.first().stored) == b"blob 3\0abc"


def test_documents_that_are_read_once_are_not_written(spark, monkeypatch):
    made, real = [], tables.counted
    monkeypatch.setattr(tables, "counted", lambda df, *which: made.append(df) or real(df, *which))
    for query in (observed_queries.document_views, observed_queries.document_violations, observed_queries.observed_properties):
        df = query(spark, TINY)
        assert df.count() > 0 and not made
    # orders meet their items, and customers their orders; nothing is shuffled after the texts are made
    above, below = _plan(observed_queries.document_views(spark, TINY)).split("BatchEvalPython", 1)
    assert "Exchange" not in above and below.count("Exchange hashpartitioning") <= 3


def test_views_of_nested_nodes_and_links(spark):
    node = lambda i, kind: '{"id":"%s","kind":"%s","properties":{},"missing_properties":[]}' % (i, kind)
    edge = lambda a, b, kind: '{"src":"%s","dst":"%s","kind":"%s","properties":{}}' % (a, b, kind)
    kinds = ["META_DATA", "METHOD", "METHOD_PARAMETER_IN", "METHOD_PARAMETER_OUT", *["BLOCK"] * 9, "RETURN"]
    edges = [edge(2, 3, "PARAMETER_LINK"), edge(1, 2, "AST"), edge(1, 3, "AST"), edge(1, 4, "AST"), *(edge(i, i + 1, "AST") for i in range(4, 13)), edge(3, 2, "PARAMETER_LINK"), edge(13, 12, "ARGUMENT"), edge(12, 99, "REF")]
    docs = spark.createDataFrame([("g", '{"nodes":[%s],"edges":[%s]}' % (",".join(node(i, k) for i, k in enumerate(kinds)), ",".join(edges))), ("h", '{"nodes":[],"edges":[]}'), ("i", "x")], "graph_id string, json string")
    d = observed.parsed(docs, spark.createDataFrame([], "kind string, name string, native string, quantity string"), spark.createDataFrame([], "kind string, name string"))
    got = {(r.node, r.role): (r.ordinals, r.owner) for r in observed.owned_views(d).collect()}
    want = {("1", "AST"): [1, 2, 3], ("1", "inputs"): [1], ("1", "outputs"): [2], ("2", "links"): [0, 13], ("3", "links"): [13, 0], ("13", "arguments"): [14], **{(str(i), "AST"): [i] for i in range(4, 13)}}
    assert got == {k: (v, "1") for k, v in want.items()}
    assert {r.node: r.owner for r in observed.ownership(d).collect()} == {"0": None, **{str(i): "1" for i in range(1, 14)}}
    assert sorted(tuple(r)[1:] for r in observed.role_edges(d).where("role = 'links'").collect()) == [("2", "links", 0, 0), ("2", "links", 1, 13), ("3", "links", 0, 13), ("3", "links", 1, 0)]
    ring = spark.createDataFrame([("g", '{"nodes":[%s],"edges":[%s]}' % (",".join(node(i, "BLOCK") for i in range(3)), ",".join(edge(i, (i + 1) % 3, "AST") for i in range(3))))], "graph_id string, json string")
    with pytest.raises(Exception, match="form a cycle"):
        observed.ownership(observed.parsed(ring, d.catalogue, d.edge_catalogue)).collect()


def test_numbers_are_no_strings_without_ansi(spark):
    docs = spark.createDataFrame([("g", '{"nodes":[{"id":1,"kind":true,"properties":{},"missing_properties":[2]}],"edges":[]}')], "graph_id string, json string")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        d = observed.parsed(docs, spark.createDataFrame([], "kind string, name string, native string, quantity string"), spark.createDataFrame([], "kind string, name string"))
        assert [(r.id, r.kind, r.missing) for r in d.nodes.collect()] == [(None, None, None)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_witnesses_of_a_graph_are_searched_in_its_row(spark):
    node = "graph_id string, node_id long, kind string, operator_or_literal string, resolved_fqn string, enclosing_decl_fqn string"
    edge = "graph_id string, src long, dst long, kind string"
    rng = random.Random(5)
    nodes, edges = [], []
    for g in "abcdefgh":
        nodes += [(g, 100, "METHOD", "", "m", ""), (g, 101, "METHOD", "", "other", "")]
        nodes += [(g, i, "CALL", rng.choice(["source", "sink", "clean", "x", "x", "x", ""]), "", rng.choice(["m", "m", "m", "none"])) for i in range(20)]
        edges += [(g, rng.randrange(20), rng.randrange(22), rng.choice(["CFG", "CFG", "CFG", "AST"])) for _ in range(50)] + [(g, rng.randrange(20), rng.choice([100, 101, 3]), "CALL")] * 2 + [(g, 101, 5, "CFG"), (g, 99, 4, "CFG")]
    clauses = [("p", 0, "source", "source"), ("p", 1, "sink", "sink"), ("p", 2, "sanitize", "clean"), ("q", 0, "source", "x"), ("q", 1, "source", "source"), ("q", 2, "sink", "sink")]
    n, e, c = spark.createDataFrame(nodes, node), spark.createDataFrame(edges, edge), spark.createDataFrame(clauses, "spec_id string, ordinal int, primitive string, pattern string")
    found = taint.witnesses(n, e, c, parts=3)
    assert "MapInArrow" in _plan(found) and "FlatMapGroups" not in _plan(found)
    got = {(r.spec_id, r.graph_id, r.sink, r.fact): r.witness for r in found.collect()}
    want = {(r.spec_id, r.graph_id, r.sink, r.fact): r.depth for r in taint.solve(n, e, c).collect()}
    assert got.keys() == want.keys() and len(got) > 30
    of = {(g, i): o for g, i, _, o, _, _ in nodes}
    moves = {(g, a, b) for g, a, b, k in edges if k == "CFG" or k == "CALL" and b in (100, 101)}
    stops = {"p": "clean", "q": None}
    for (spec, g, sink, _), path in got.items():
        assert path[-1] == sink and of[g, path[0]] in ("source", "x") and len(path) - 1 >= want[spec, g, sink, _]
        assert all((g, a, b) in moves and of.get((g, a)) != stops[spec] for a, b in pairwise(path))


def test_violations_read_each_table_once_for_all_rules(spark):
    plan = _plan(observed_queries.document_violations(spark, TINY))
    assert plan.count("FileScan") == 3  # orders as such and with items
    assert "Exchange hashpartitioning" not in plan.split("BatchEvalPython", 1)[0]


def test_violations_of_ends(spark):
    node = lambda i, kind: '{"id":%s,"kind":"%s","properties":{},"missing_properties":[]}' % (i, kind)
    edge = lambda a, b, kind: '{"src":%s,"dst":%s,"kind":"%s","properties":{}}' % (a, b, kind)
    nodes = [node('"1"', "METHOD"), node('"2"', "CALL"), node('"3"', "METHOD_PARAMETER_IN"), node('"4"', "METHOD_PARAMETER_OUT"), node('"5"', "METHOD"), node("6", "CALL"), node('"7"', "BLOCK")]
    edges = [edge('"7"', '"5"', "CFG"), edge('"1"', '"3"', "AST"), edge('"5"', '"4"', "AST"), edge('"3"', '"4"', "PARAMETER_LINK"), edge('"4"', '"3"', "PARAMETER_LINK"), edge("6", '"1"', "CFG"), edge('"1"', "null", "AST"), edge('"5"', "null", "AST"), edge('"2"', '"1"', "CALL"), edge('"2"', '"1"', "ARGUMENT")]
    docs = spark.createDataFrame([("g", '{"nodes":[%s],"edges":[%s]}' % (",".join(nodes), ",".join(edges)))], "graph_id string, json string")
    d = observed.parsed(docs, spark.createDataFrame([("CALL", "ARGUMENT_INDEX", "int", "optional")], "kind string, name string, native string, quantity string"), spark.createDataFrame([], "kind string, name string"))
    found = sorted((r.rule, r.subject) for r in observed.violations(d).collect() if r.rule in {"ends", "link_across_methods", "bad_id", "formal_without_method"})
    ends = ["ARGUMENT:2>1", "PARAMETER_LINK:4>3", "dangling:1>", "dangling:5>", "dangling:>1", "owners:1>"]
    assert found == [("bad_id", "#5"), *(("ends", e) for e in ends), ("link_across_methods", "3>4"), ("link_across_methods", "4>3")]
    none = spark.createDataFrame([("g", '{"nodes":[%s,%s],"edges":[%s]}' % (node('"1"', "BLOCK"), node('"2"', "").replace('"kind":""', '"kind":null'), edge('"1"', '"2"', "CFG")))], "graph_id string, json string")
    assert [r.subject for r in observed.violations(observed.parsed(none, d.catalogue, d.edge_catalogue)).where("rule = 'ends'").collect()] == ["dangling:1>2"]

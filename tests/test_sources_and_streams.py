import json
import math

import pytest

from heddle.functions import framing
from heddle.operators import continuity, delta, ledger, stats, textscan
from heddle.sources import cpg, reports, specs
from heddle.streaming import online
from pyspark.sql import functions as F


def test_rule_lines(spark):
    lines = ["id: \"x\"", "class: \"c\"", "languages: [\"java\"]", "engine: \"semgrep\"", "# c", "source(a.b(*))", "propagate(arg[0] → ret)", "propagate(x → ret)", "source(r'x')", "if a then sink(b)", "sink(a); sink(b)", "odd(a)", "sink(cpg.call)", "sink(lambda)", "source(a.closure.b)", "sanitize(semgrep)"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "spec_id string, line int, text string")
    got = [r.rejection for r in specs.parsed(df).orderBy("line").collect()]
    assert got == [None, None, "E-DSL-008", "E-DSL-001", "E-DSL-006", "E-DSL-005", "E-DSL-008", "E-DSL-003", "E-DSL-004", "E-DSL-007", "E-DSL-002"]
    assert specs.headers(df).first().rejection == "E-DSL-009"
    assert specs.clauses(specs.parsed(df)).count() == 0
    assert [r.primitive for r in specs.clauses(specs.parsed(df.where("line < 7"))).orderBy("ordinal").collect()] == ["source", "propagate"]


EXPORT = {
    "nodes": [
        {"id": "1", "label": "METHOD", "fullName": "m.f", "filename": "a.py", "lineNumber": 1, "columnNumber": 1},
        {"id": "2", "label": "CALL", "name": "<operator>.add", "methodFullName": "op", "lineNumber": 2, "columnNumber": 3},
        {"id": "3", "label": "LITERAL", "code": "7", "lineNumber": 2, "columnNumber": 5},
        {"id": "4", "label": "UNKNOWN"},
    ],
    "edges": [{"src": "1", "dst": "2", "kind": "AST"}, {"src": "2", "dst": "3", "kind": "AST"}, {"src": "2", "dst": "3", "kind": "CDG"}],
}


def test_export_order_does_not_count(spark, tmp_path):
    out = []
    for k, turn in enumerate((False, True)):
        e = {**EXPORT, "nodes": EXPORT["nodes"][::-1]} if turn else EXPORT
        (tmp_path / f"{k}.json").write_text(json.dumps(e))
        n, edges, _ = cpg.mapped(*cpg.read_exports(spark, str(tmp_path / f"{k}.json")))
        out.append((sorted(tuple(r)[1:] for r in n.collect()), sorted(tuple(r)[1:] for r in edges.collect())))
    assert out[0] == out[1]
    assert [r[2] for r in out[0][0]] == ["", "", "<operator>.add", "7"]
    assert {r[2] for r in out[0][1]} == {"AST", "PDG"}


def test_unknown_edges_are_refused(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"nodes": [{"id": "1", "label": "X"}], "edges": [{"src": "1", "dst": "9", "kind": "ODD"}]}))
    with pytest.raises(ValueError):
        cpg.mapped(*cpg.read_exports(spark, str(tmp_path / "e.json")))


def test_sarif_statuses(spark, tmp_path):
    loc = {"physicalLocation": {"artifactLocation": {"uri": "../x.py", "index": 0}}}
    run = {"tool": {"driver": {"rules": [{"id": "A"}, {"id": "B"}, {"id": "B"}]}}, "artifacts": [{"location": {"uri": "x.py"}}], "results": [{"ruleId": "A", "ruleIndex": 0, "locations": [loc]}, {"ruleId": "B"}, {"ruleId": "Z"}, {"ruleId": "B", "ruleIndex": 0}, {}, {"ruleIndex": 9}]}
    (tmp_path / "s.sarif").write_text(json.dumps({"runs": [run]}))
    results, rules, artifacts = reports.read_sarif(spark, str(tmp_path / "s.sarif"))
    assert [r.rule_status for r in reports.rule_join(results, rules).orderBy("result").collect()] == ["matched", "ambiguous", "unindexed-id", "inconsistent", "missing", "invalid"]
    first = reports.path_join(results, artifacts, spark.createDataFrame([("x.py",)], "path string")).orderBy("result").first()
    assert first.path_status == "contradiction" and first.path is None


def test_canonical_json_keeps_or_escapes_characters():
    assert reports.canonical_json({"b": "é", "a": 1}) == '{"a":1,"b":"é"}'
    assert reports.canonical_json({"b": "é", "a": 1}, ascii_only=True) == '{"a":1,"b":"\\u00e9"}'


def test_lines_are_split_like_text_lines(spark):
    text = "a\r\nb\x0bc d\n"
    got = [r.line_text for r in textscan.lines(spark.createDataFrame([("f", text), ("g", "")], "file string, text string")).collect()]
    assert got == text.splitlines()


def test_reflection(spark):
    files = [("a.java", "java", "x = Class.forName (n)\nok()"), ("b.py", "python", "getattr(a, b); eval(c)"), ("c.js", "js", "require('x')\nrequire('a' + b)"), ("d.xyz", None, "?"), ("e.md", None, "eval(")]
    got = {(r.file, r.line, r.kind) for r in textscan.reflection_sites(spark.createDataFrame(files, "file string, language string, text string")).collect()}
    assert got == {("a.java", 1, "java-class-forname"), ("b.py", 1, "python-getattr"), ("b.py", 1, "python-eval-exec"), ("c.js", 2, "js-require-dynamic"), ("d.xyz", 0, "structural-uncertainty")}


def test_empty_inputs_have_defaults(spark):
    empty = spark.createDataFrame([], "verdict string")
    assert textscan.routing_rate(empty).first().rate == 0.0
    assert stats.combined_e_value(spark.createDataFrame([], "log_wealth double")).first().e_value == 1.0
    assert float(stats.reproduction_rate(spark.createDataFrame([], "a int"), spark.createDataFrame([(1,)], "a int")).first().rate) == 1.0


def test_continuity_blocks_all(spark):
    row = "occurrence_id string, profile string, slice_digest string, sink string, eligible boolean"
    before = spark.createDataFrame([("p", "x", "d", "s1", True)], row)
    ents = spark.createDataFrame([("p", "e1")], "occurrence_id string, entity_id string")
    after = [("a", "x", "d", "s1", True), ("b", "x", "n", "s2", True)]
    plan = lambda rows, **k: {r.occurrence_id: r.reason for r in continuity.plan(before, spark.createDataFrame(rows, row), ents, **k).collect()}
    assert plan(after) == {"a": continuity.LINKED, "b": continuity.NEW}
    assert set(plan([*after, ("c", "x", "m", "s2", True)]).values()) == {continuity.BLOCKS[4]}
    assert set(plan([*after, ("c", "x", "m", "s3", False)]).values()) == {continuity.BLOCKS[5]}
    assert set(plan(after, policy_active=False).values()) == {continuity.BLOCKS[2]}
    assert plan([("a", "x", "d", "s1", True), ("b", "x", "d", "s2", True)]) == {"a": continuity.AMBIGUOUS, "b": continuity.AMBIGUOUS}


def test_fresh_ids_may_hide_a_removal(spark):
    nodes = spark.createDataFrame([(0, "f"), (1, "g")], "node_id long, enclosing_decl_fqn string")
    edges = spark.createDataFrame([(0, 1, "CFG")], "src long, dst long, kind string")
    out = delta.rebuild(nodes, edges, spark.createDataFrame([("g",)], "enclosing_decl_fqn string"), spark.createDataFrame([(0, "g")], "node_id long, enclosing_decl_fqn string"), edges.limit(0))
    assert [r.node_id for r in out["added_nodes"].collect()] == [1] and out["removed_nodes"].count() == 0 and out["removed_edges"].count() == 1


def test_hash_mod_ten(spark):
    import hashlib

    rows = spark.range(50).select(F.col("id").cast("string").alias("s")).select("s", framing.hex_mod10(F.sha2("s", 256)).alias("m"))
    assert all(r.m == int(hashlib.sha256(r.s.encode()).hexdigest(), 16) % 10 for r in rows.collect())


def _play(spark, tmp_path, rows, schema, fn, name):
    """Feeds rows file by file."""
    source = tmp_path / name
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source / f"{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_job_states_online_as_in_batch(spark, tmp_path):
    parts = [[("j", 1, "running"), ("j", 2, "running")], [("j", 3, "done"), ("j", 4, "failed")], [("j", 5, "done"), ("k", 1, "failed")]]
    got = sorted(map(tuple, _play(spark, tmp_path, parts, "job string, seq long, status string", online.job_states, "jobs")))
    batch = ledger.fold_jobs(spark.createDataFrame([r for p in parts for r in p], "job string, seq long, status string"), ["job"], ["seq"])
    assert got == sorted((r.job, r.seq, r.outcome, r.state) for r in batch.collect())
    assert [g[2] for g in got] == ["applied", "duplicate", "applied", "conflict", "duplicate", "applied"]


def test_e_process_online_as_in_batch(spark, tmp_path):
    rows = [("s", i, float(i % 9 != 0)) for i in range(60)]
    parts = [rows[:7], rows[7:40], rows[40:]]
    got = {r.seq: r.log_wealth for r in _play(spark, tmp_path, parts, "spec_id string, seq long, outcome double", online.e_processes, "wealth")}
    batch = stats.e_process(spark.createDataFrame(rows, "spec_id string, seq long, outcome double"), ["spec_id"], ["seq"]).collect()
    assert all(math.isclose(got[r.seq], r.log_wealth, abs_tol=1e-9) for r in batch) and len(batch) == 60


def test_dead_letters_online(spark, tmp_path):
    parts = [[("a", 1, False), ("b", 1, False)], [("a", 2, False), ("b", 2, True)], [("a", 3, False), ("b", 3, False)]]
    got = _play(spark, tmp_path, parts, "message_id string, seq long, handled boolean", online.dead_letters, "letters")
    assert [tuple(r) for r in got] == [("a", 3)]

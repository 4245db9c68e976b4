"""Canonical JSON, inventories, strict documents, definitions, byte differences, stored objects and leases against plain Python."""

import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import canonical
from heddle.operators import attest, definitions, graphs, inventory, leases
from heddle.sources import objects, observed
from heddle.streaming import online

# ---- canonical JSON


def test_canonical_json_is_pythons(spark):
    kind = T.StructType.fromDDL("z string, a array<string>, m map<string, array<int>>, s struct<b boolean, `é` bigint, C struct<x string>>, d decimal(10,2), n int")
    text = "".join(map(chr, range(1, 40))) + "\x7f   é 😀 \\u000B \\ \" /"
    rows = [
        (text, [text, None, ""], {"b": [1, None], "a": [], "B": None, "é": [2]}, {"b": True, "é": -(2**63), "C": {"x": None}}, None, 3),
        (None, None, None, None, None, None),
        ("", [], {}, {"b": None, "é": None, "C": None}, None, -1),
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType().add("i", "integer").add("r", kind))
    got = {r.i: r.j for r in df.select("i", canonical.canonical(F.col("r"), kind).alias("j")).collect()}
    names = [f.name for f in kind.fields]
    for i, r in enumerate(rows):
        assert got[i] == json.dumps(dict(zip(names, r, strict=True)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    one = spark.createDataFrame([("1.50",)], "x string").select(F.col("x").cast("decimal(10,2)").alias("x"))
    assert one.select(canonical.canonical_row(one.schema)).first()[0] == '{"x":1.50}'
    with pytest.raises(TypeError):
        canonical.canonical(F.col("x"), T.DoubleType())
    digest = spark.range(1).select(canonical.namespaced_digest("n/1", F.lit("{}"))).first()[0]
    assert digest == "sha256:" + hashlib.sha256(b"n/1\n{}").hexdigest()


def test_inventories(spark):
    cohort = {"org": "o"}
    scope = "scan_id string, capture_id string, source_tree_digest string, cohort struct<org string>"
    occurrences = spark.createDataFrame([("s", "c", "t", cohort, "b", True), ("s", "c", "t", cohort, "a", None), ("s", "other", "t", cohort, "x", False), ("s", "c", "t", cohort, "b", True)], scope + ", occurrence_id string, ok boolean")
    inventories = spark.createDataFrame([("s", "c", "t", cohort, "done", True, ["a", "b", "gone", "gone"], ["e", "e"]), ("empty", "c", "t", cohort, "completed", False, [], [])], scope + ", detection_state string, sealed boolean, sealed_occurrence_ids array<string>, evidence_refs array<string>")
    digests = {r.scan_id: r.digest for r in inventory.inventory_digests(inventories, occurrences, "i/1").collect()}
    payload = {"capture_id": "c", "cohort": cohort, "detection_state": "completed", "evidence_refs": [], "occurrences": [], "scan_id": "empty", "sealed": False, "sealed_occurrence_ids": [], "source_tree_digest": "t"}
    assert digests["empty"] == "sha256:" + hashlib.sha256(b"i/1\n" + json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    stored = inventories.withColumn("content_digest", F.when(F.col("scan_id") == "empty", digests["empty"]))
    got = sorted((r.scan_id, r.violation, r.subject) for r in inventory.inventory_violations(stored, occurrences, "i/1").collect())
    assert got == sorted([("s", "unknown_state", "done"), ("s", "repeated_evidence", None), ("s", "repeated_sealed_id", "gone"), ("s", "repeated_occurrence", "b"), ("s", "sealed_but_absent", "gone"), ("s", "present_but_unsealed", "x"), ("s", "outside_scope", "x"), ("s", "digest_mismatch", None)], key=repr) or {v for _, v, _ in got} == {"unknown_state", "repeated_evidence", "repeated_sealed_id", "repeated_occurrence", "sealed_but_absent", "present_but_unsealed", "outside_scope", "digest_mismatch"}
    assert len(got) == 8


# ---- cycles and strict documents


def test_cycles(spark):
    rng = random.Random(6)
    parent = {n: rng.choice([None, *range(60)]) for n in range(60)}
    parent |= {100 + i: 100 + (i + 1) % 37 for i in range(37)} | {200: 200, 201: 200, 300: 999}
    want = set()
    for n in parent:
        at = n
        for _ in range(len(parent) + 1):
            at = parent.get(at)
        if at is not None:
            here = at
            while here not in want:
                want.add(here)
                here = parent[here]
    df = spark.createDataFrame(list(parent.items()), "node long, parent long")
    assert {r.node for r in graphs.cycles(df).collect()} == want and len(want) >= 38
    assert graphs.cycles(df.where("node = 300")).count() == 0


CATALOGUE = [("META_DATA", "LANGUAGE", "str", "one"), ("METHOD", "FULL_NAME", "str", "one"), ("METHOD", "LINE", "int", "optional"), ("METHOD", "TAGS", "str", "many"), ("METHOD", "EXTERNAL", "bool", "optional"), ("METHOD_RETURN", "LINE", "int", "optional"), ("METHOD_PARAMETER_IN", "LINE", "int", "optional"), ("METHOD_PARAMETER_OUT", "LINE", "int", "optional")]


def _doc(spark, *documents):
    rows = spark.createDataFrame([(f"g{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "graph_id string, json string")
    edges = spark.createDataFrame([("AST", None), ("CFG", None), ("PARAMETER_LINK", None), ("REACHING_DEF", "VARIABLE")], "kind string, name string")
    return observed.read(rows, spark.createDataFrame(CATALOGUE, "kind string, name string, native string, quantity string"), edges)


def _node(id_, kind="METHOD", missing=(), **properties):
    return {"id": id_, "kind": kind, "properties": properties, "missing_properties": list(missing)}


META = _node("0", "META_DATA", LANGUAGE="X")


def _edge(a, b, kind="AST", **properties):
    return {"src": a, "dst": b, "kind": kind, "properties": properties}


def test_documents_are_not_coerced(spark):
    good = {"nodes": [META, _node("1", FULL_NAME="f", LINE=3, TAGS=["a"], EXTERNAL=False), _node("2", missing=["FULL_NAME"], TAGS=[]), _node("3", "METHOD_RETURN")], "edges": [_edge("1", "3")]}
    values = [("LINE", "3"), ("LINE", 3.0), ("LINE", True), ("LINE", 2**31), ("LINE", None), ("TAGS", "a"), ("TAGS", ["a", 1]), ("TAGS", [None]), ("EXTERNAL", "true"), ("EXTERNAL", 1), ("FULL_NAME", 5)]
    bad = [{"nodes": [META, _node("1", **({"FULL_NAME": "f"} | {k: v}))], "edges": []} for k, v in values]
    d = _doc(spark, good, *bad)
    got = sorted((r.graph_id, r.rule, r.subject) for r in observed.violations(d).collect())
    assert got == sorted((f"g{i + 1}", "wrong_type", f"1.{k}") for i, (k, _) in enumerate(values))
    seen = {(r.id, r.name): (r.presence, r.value) for r in observed.observations(d).where("graph_id = 'g0' AND kind = 'METHOD'").collect()}
    assert seen["1", "LINE"][1].number == 3 and seen["1", "EXTERNAL"][1].flag is False and seen["1", "TAGS"][1].texts == ["a"] and seen["2", "TAGS"][1].texts == []
    assert seen["2", "FULL_NAME"] == ("missing_required", None) and seen["2", "LINE"] == ("absent_optional", None) and seen["2", "EXTERNAL"][0] == "absent_optional"


def test_document_shapes(spark):
    method = _node("1", FULL_NAME="f")
    cases = {
        "not_a_document": ['{"nodes":[],"nodes":[],"edges":[]}', "[1]", '{"nodes":[]}', "nope"],
        "bad_id": [{"nodes": [META, _node(i, FULL_NAME="f")], "edges": []} for i in ("01", "-1", "x", "", str(2**63), 7, None)],
        "repeated_id": [{"nodes": [META, method, method], "edges": []}],
        "unknown_kind": [{"nodes": [META, _node("1", "NOPE")], "edges": []}],
        "unknown_property": [{"nodes": [META, _node("1", FULL_NAME="f", NOPE=1)], "edges": []}],
        "missing_not_explicit": [{"nodes": [META, _node("1")], "edges": []}, {"nodes": [META, _node("1", FULL_NAME="f", missing=["FULL_NAME"])], "edges": []}],
        "metadata": [{"nodes": [method], "edges": []}, {"nodes": [META, META | {"id": "9"}], "edges": []}],
        "unknown_edge_kind": [{"nodes": [META, method], "edges": [_edge("1", "0", "NOPE")]}],
        "unknown_edge_property": [{"nodes": [META, method], "edges": [_edge("1", "0", "CFG", VARIABLE="x")]}],
        "wrong_edge_property_type": [{"nodes": [META, method], "edges": [_edge("1", "0", "REACHING_DEF", VARIABLE=1)]}],
        "ends": [{"nodes": [META, method], "edges": [_edge("1", "5")]}, {"nodes": [META, method, _node("2", FULL_NAME="g")], "edges": [_edge("1", "2"), _edge("0", "2")]}],
        "cyclic_ownership": [{"nodes": [META, method, _node("2", FULL_NAME="g")], "edges": [_edge("1", "2"), _edge("2", "1")]}],
        "formal_without_method": [{"nodes": [META, method, _node("2", "METHOD_RETURN")], "edges": []}, {"nodes": [META, method, _node("2", "METHOD_RETURN")], "edges": [_edge("0", "2")]}],
        "link_across_methods": [{"nodes": [META, method, _node("2", FULL_NAME="g"), _node("3", "METHOD_PARAMETER_IN"), _node("4", "METHOD_PARAMETER_OUT")], "edges": [_edge("1", "3"), _edge("2", "4"), _edge("3", "4", "PARAMETER_LINK")]}],
    }
    flat = [(rule, d) for rule, ds in cases.items() for d in ds]
    got = {}
    for r in observed.violations(_doc(spark, *(d for _, d in flat))).collect():
        got.setdefault(r.graph_id, set()).add(r.rule)
    assert got == {f"g{i}": {rule} for i, (rule, _) in enumerate(flat)}


# ---- definitions and differences


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_last_definitions(spark, block):
    rng = random.Random(9)
    refs = [(rng.randrange(3), rng.choice("xyz"), p := rng.randrange(60), p // 2, rng.random() < 0.4) for _ in range(150)]
    want = set()
    for proc, var, place, line, is_def in refs:
        before = [(p, ln) for q, v, p, ln, d in refs if (q, v) == (proc, var) and d and p < place]
        if not is_def and before and max(before)[1] != line:
            want.add((proc, max(before)[1], line, var))
    df = spark.createDataFrame(refs, "proc int, var string, place int, line int, is_def boolean")
    got = {(r.proc, r.from_line, r.to_line, r.var) for r in definitions.data_dependences(df, ["proc"], block).collect()}
    assert got == want and len(want) > 20
    assert definitions.control_dependences(spark.createDataFrame([(1, 2, 1), (1, 3, None)], "proc int, line int, control int"), ["proc"]).count() == 1


def test_first_differences(spark):
    rng = random.Random(10)
    pairs = []
    for n in (0, 1, 2, 3, 7, 8, 9, 255, 256, 1000):
        base = rng.randbytes(n)
        for at in {0, n // 2, n - 1, n}:
            other = base[:at] + (bytes([base[at] ^ 1]) if 0 <= at < n else b"") + base[at + 1 :]
            pairs += [(base, other), (base, base + b"x"), (base[: max(0, at)], base)]
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(pairs)], "i int, a binary, b binary")
    got = {r.i: (r.offset, bytes.fromhex(r.first_bytes), bytes.fromhex(r.second_bytes)) for r in attest.differences(df, "a", "b").collect()}
    want = {}
    for i, (a, b) in enumerate(pairs):
        if a != b:
            at = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            want[i] = (at, a[at : at + 16], b[at : at + 16])
    assert got == want


# ---- stored objects


def _stored(kind, payload, size=None):
    text = f"{kind} {len(payload) if size is None else size}".encode() + b"\0" + payload
    return hashlib.sha1(text).hexdigest(), bytearray(zlib.compress(text))


def _tree(*entries):
    return _stored("tree", b"".join(m + b" " + n + b"\0" + bytes.fromhex(o) for m, n, o in entries))


def test_objects_are_checked(spark):
    blob = _stored("blob", b"text")
    lost = _stored("blob", b"lost")
    inner = _tree((b"100644", b"a", blob[0]), (b"100755", b"b", blob[0]))
    # a directory is ordered as if its name ended in a slash
    root = _tree((b"100644", b"x.y", blob[0]), (b"40000", b"x", inner[0]), (b"100644", b"x0", blob[0]))
    commit = _stored("commit", f"tree {root[0]}\nauthor a\n\nhello".encode())
    bad = {
        "order": _tree((b"100644", b"b", blob[0]), (b"100644", b"a", blob[0])),
        "repeated name": _tree((b"100644", b"a", blob[0]), (b"40000", b"a", inner[0])),
        "name": _tree((b"100644", b"..", blob[0])),
        "mode": _tree((b"120000", b"link", blob[0])),
        "cut entry": _stored("tree", b"100644 a\0short"),
        "size": _stored("blob", b"abc", 4),
        "header": _stored("thing", b"abc"),
        "no tree": _stored("commit", b"author a\n\n"),
        "not deflated": ("1" * 40, bytearray(b"plain")),
        "id": ("2" * 40, _stored("blob", b"other")[1]),
        "trailing or missing bytes": (blob[0][::-1], blob[1] + bytearray(b"!")),
    }
    wrong = _stored("commit", f"tree {_tree((b'40000', b'd', blob[0]), (b'100644', b'e', '3' * 40))[0]}\n\n".encode())
    pointing = _tree((b"40000", b"d", blob[0]), (b"100644", b"e", "3" * 40))
    rows = objects.read(spark.createDataFrame([blob, lost, inner, root, commit, wrong, pointing, *bad.values()], "object string, stored binary")).cache()
    files = {(r.commit, r.path, r.object, r.size) for r in objects.files(rows).where("commit = '%s'" % commit[0]).collect()}
    assert files == {(commit[0], p, blob[0], 4) for p in ("x.y", "x/a", "x/b", "x0")}
    found = {(r.object, r.problem) for r in objects.problems(rows).collect()}
    assert {(o[0], p) for p, o in bad.items()} <= found
    assert {(lost[0], "unreached"), (pointing[0], "absent child"), (pointing[0], "child of another kind")} <= found
    assert not {p for o, p in found if o in (blob[0], inner[0], root[0], commit[0])}


# ---- leases

SECOND = 1_000_000
POLICY = leases.Policy(lease=10 * SECOND, attempts=3, initial=4 * SECOND, most=6 * SECOND)


def test_a_stale_token_is_refused(spark):
    events = [("i", t * SECOND, n, kind, token) for n, (t, kind, token) in enumerate([(0, "claim", None), (1, "claim", None), (5, "renew", 1), (14, "renew", 1), (30, "complete", 1), (27, "claim", None), (29, "claim", None), (31, "complete", 1), (32, "complete", 2), (33, "claim", None)])]
    df = spark.createDataFrame(events, "item string, at long, seq long, kind string, token long")
    got = [(r.at // SECOND, r.outcome, r.token, r.state) for r in leases.folded(df, POLICY).orderBy("at", "seq").collect()]
    assert got == [(0, "granted", 1, "running"), (1, "refused_running", 1, "running"), (5, "renewed", 1, "running"), (14, "renewed", 1, "running"), (24, "expired", 1, "pending"), (27, "refused_not_due", 1, "pending"), (29, "granted", 2, "running"), (30, "stale", 2, "running"), (31, "stale", 2, "running"), (32, "completed", 2, "completed"), (33, "refused_completed", 2, "completed")]


def test_leases_are_the_same_on_a_stream(spark, tmp_path):
    rng = random.Random(12)
    policy = leases.Policy(lease=40 * SECOND, attempts=4, initial=4 * SECOND, most=6 * SECOND)
    kinds = ["claim", "claim", "claim", "renew", "renew", "fail", "complete"]
    rows = [(f"i{rng.randrange(30)}", n * SECOND + rng.randrange(SECOND), n, rng.choice(kinds), rng.choice((1, 1, 2, 3))) for n in range(400)]
    end = ("end", 10_000 * SECOND, 10_000, "renew", 1)
    schema = "item string, at long, seq long, kind string, token long"
    batch = leases.folded(spark.createDataFrame([*rows, end], schema), policy, until=9_000 * SECOND)
    want = sorted((tuple(r) for r in batch.collect()), key=repr)
    folder = str(tmp_path / "events")
    for k in range(0, 400, 80):
        spark.createDataFrame(rows[k : k + 80], schema).withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("item string, seq long, kind string, token long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda: online.leases(stream, policy).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    # a much later event moves the watermark past all leases, the next one lets timers run
    for k in range(2):
        late = (end[0], end[1] + k, end[2] + k, *end[3:])
        spark.createDataFrame([late], schema).withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(folder)
        run()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("seq IS NULL OR seq <> 10001").collect()), key=repr)
    assert got == want and sum(r[3] == "expired" for r in want) > 10 and {"granted", "stale", "renewed", "failed", "completed"} <= {r[3] for r in want}

"""Canonical graphs, slices, witnesses, incremental solving, imports, rebuilds and report joins over the driver's tables.

Orders with their line items and conversations stand for small graphs, customers with their orders for
syntax trees, brands for declarations, and nations for the rules of a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.tables import materialized, numbered, read
from heddle.operators import delta, identity, refactor, taint
from heddle.plans.graph_queries import REACH, event_graph
from heddle.sources import cpg, reports


def _classes(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """Each graph with the least graph of its digest, and how many have it."""
    rows = materialized(rows)
    of = rows.groupBy(digest).agg(F.min(key).alias("class"), F.count("*").alias("members"))
    return rows.join(of, digest).select(key, "class", "members", "fingerprint_class")


def canonical_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stars of their line items: two are isomorphic if they have one status and the same return flags and line states, each as often."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_linestatus")).cast("long")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("graph_id"), place.alias("node_id"), F.lit("LITERAL").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("operator_or_literal"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("graph_id"), F.lit(0).cast("long").alias("node_id"), F.lit("CALL").alias("kind"), F.col("o_orderstatus").alias("operator_or_literal"))
    edges = li.select("graph_id", F.lit(0).cast("long").alias("src"), F.col("node_id").alias("dst"), F.lit("AST").alias("kind"))
    blank = {c: F.lit("") for c in ("resolved_fqn", "enclosing_decl_fqn", "structural_path")}
    found = identity.canonical_graphs(o.unionByName(li).withColumns(blank), edges)
    return _classes(found.withColumn("o_orderkey", F.col("graph_id").cast("long")), "graph_sha256", "o_orderkey")


CANONICAL_CLASSES = """
WITH g AS (SELECT o_orderkey, any_value(o_orderstatus) || ':' || coalesce(string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus), '') AS shape FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY shape) AS class, count(*) OVER (PARTITION BY shape) AS members, 'strong' AS fingerprint_class FROM g
"""


def slice_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as slices: a user's turn is an identifier, whose name doesn't count; other turns are calls by the last digit of their length."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph_id"), F.col("turn").cast("long").alias("node_id"), "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    local = F.col("role") == "user"
    name = F.when(local, F.concat(F.lit("v"), F.col("n").cast("string"))).otherwise((F.col("n") % 10).cast("string"))
    nodes = t.select("graph_id", "node_id", F.when(local, "IDENTIFIER").otherwise("CALL").alias("kind"), name.alias("operator_or_literal"), F.lit("").alias("resolved_fqn"), F.concat(F.lit("pkg"), "graph_id", F.lit(".f")).alias("enclosing_decl_fqn"), F.lit("").alias("structural_path"))
    after = F.lead("node_id").over(W.partitionBy("graph_id").orderBy("node_id"))
    edges = t.select("graph_id", F.col("node_id").alias("src"), after.alias("dst"), F.lit("CFG").alias("kind")).where("dst is not null")
    found = identity.slice_fingerprints(nodes, edges)
    return _classes(found.withColumn("conv_id", F.col("graph_id").cast("long")), "slice_sha256", "conv_id")


SLICE_CLASSES = """
WITH g AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'local' ELSE CAST(length(coalesce(text, '')) % 10 AS VARCHAR) END, ',' ORDER BY turn) AS shape FROM conversations GROUP BY 1)
SELECT conv_id, min(conv_id) OVER (PARTITION BY shape) AS class, count(*) OVER (PARTITION BY shape) AS members, 'strong' AS fingerprint_class FROM g
"""


def taint_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths by which users' turns first reach assistants' turns: a conversation is a procedure, a turn whose length is divisible by 5 sanitizes."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph_id"), F.col("turn").cast("long").alias("node_id"), F.concat("role", F.when(F.length("text") % 5 == 0, "!").otherwise("")).alias("operator_or_literal"))
    nodes = t.withColumns({"kind": F.lit("CALL"), "resolved_fqn": F.lit(""), "enclosing_decl_fqn": F.lit("chat")})
    methods = t.select("graph_id").distinct().withColumns({"node_id": F.lit(-1).cast("long"), "operator_or_literal": F.lit(""), "kind": F.lit("METHOD"), "resolved_fqn": F.lit("chat"), "enclosing_decl_fqn": F.lit("")})
    edges = t.join(t.select("graph_id", (F.col("node_id") - 1).alias("node_id"), F.col("node_id").alias("dst")), ["graph_id", "node_id"]).select("graph_id", F.col("node_id").alias("src"), "dst", F.lit("CFG").alias("kind"))
    rules = [("chat", 0, "source", "user"), ("chat", 1, "source", "user!"), ("chat", 2, "sink", "assistant"), ("chat", 3, "sink", "assistant!")]
    rules += [("chat", 4 + i, "sanitize", f"{r}!") for i, r in enumerate(("user", "assistant", "system", "tool"))]
    clauses = spark.createDataFrame(rules, "spec_id string, ordinal int, primitive string, pattern string")
    found = taint.witnesses(nodes.unionByName(methods), edges, clauses)
    return found.select(F.col("graph_id").cast("long").alias("conv_id"), F.element_at("witness", 1).alias("source_turn"), F.col("sink").alias("sink_turn"), F.array_join(F.col("witness").cast("array<string>"), ",").alias("witness"), F.size("witness").cast("long").alias("witness_length"))


TAINT_WITNESS = REACH + "SELECT r.conv_id, r.source_turn, r.turn AS sink_turn, r.witness, r.turn - r.source_turn + 1 AS witness_length FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.role = 'assistant'"


def incremental_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after the errors of users whose number ends in 3 have become clicks, which sanitize, too, but are no sinks: those users and their callers are solved again."""
    nodes, edges, clauses = event_graph(spark, sf_dir)
    prior = taint.solve(nodes, edges, clauses)
    changed = (F.col("enclosing_decl_fqn").cast("long") % 10 == 3) & (F.col("operator_or_literal") == "error")
    after = nodes.withColumn("operator_or_literal", F.when((F.col("kind") == "CALL") & F.expr("try_cast(enclosing_decl_fqn as bigint)").isNotNull() & changed, "click").otherwise(F.col("operator_or_literal")))
    affected = nodes.where("kind = 'METHOD' and cast(resolved_fqn as bigint) % 10 = 3").select("graph_id", F.col("node_id").alias("proc"))
    return taint.incremental_solve(after, edges, clauses, prior, affected).select("sink", "fact", F.col("depth").cast("long").alias("depth"))


INCREMENTAL_TAINT = """
WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN user_id % 10 = 3 AND event_type = 'error' THEN 'click' ELSE event_type END AS event_type, lead(event_id) OVER w AS after, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
moves AS (
  SELECT event_id AS src, after AS dst FROM e WHERE after IS NOT NULL
  UNION ALL SELECT -user_id - 1, event_id FROM e WHERE rn = 1
  UNION ALL SELECT event_id, -(user_id // 2) - 1 FROM e WHERE event_type = 'purchase' AND user_id // 2 IN (SELECT user_id FROM events)),
seed AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS fact FROM e WHERE event_type = 'signup'),
clean AS (SELECT event_id FROM e WHERE event_type IN ('error', 'view', 'click')),
r AS (
  SELECT fact, event_id AS node, 0 AS depth FROM seed
  UNION
  SELECT r.fact, m.dst, r.depth + 1 FROM r JOIN moves m ON m.src = r.node WHERE r.node NOT IN (SELECT event_id FROM clean) AND r.depth < 400)
SELECT node AS sink, fact, CAST(min(depth) AS BIGINT) AS depth FROM r JOIN e ON e.event_id = r.node AND event_type IN ('purchase', 'error') GROUP BY 1, 2
"""


def _export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A nation as an export: customers are methods in their segment's file, orders are calls below them."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    none, graph = F.lit(None).cast("string"), F.col("c_nationkey").cast("string").alias("graph_id")
    methods = c.select(graph, F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("METHOD").alias("label"), none.alias("code"), F.col("c_name").alias("name"), none.alias("methodFullName"), F.col("c_name").alias("fullName"), F.col("c_mktsegment").alias("filename"), F.col("c_custkey").cast("int").alias("lineNumber"), F.lit(0).alias("columnNumber"))
    below = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    late = F.col("o_orderstatus") == "O"
    calls = below.select(graph, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("CALL").alias("label"), none.alias("code"), F.when(late, "<operator>.open").otherwise("f").alias("name"), F.col("o_orderpriority").alias("methodFullName"), none.alias("fullName"), none.alias("filename"), F.col("o_orderkey").cast("int").alias("lineNumber"), F.lit(1).alias("columnNumber"))
    ends = [F.concat(F.lit(p), F.col(x).cast("string")).alias(n) for p, x, n in (("c", "c_custkey", "src"), ("o", "o_orderkey", "dst"))]
    edges = below.select(graph, *ends, F.lit("AST").alias("kind")).unionByName(below.where(late).select(graph, *ends, F.lit("REACHING_DEF").alias("kind")))
    return cpg.mapped(methods.unionByName(calls), edges)


def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the imported graphs."""
    return _export(spark, sf_dir)[0].withColumn("graph_id", F.col("graph_id").cast("long"))


_IMPORTED = """
WITH n AS (
  SELECT c_nationkey AS graph_id, 'c' || c_custkey AS id, 'METHOD' AS kind, '' AS operator_or_literal, c_name AS resolved_fqn, c_name AS enclosing_decl_fqn, '' AS structural_path, c_mktsegment AS file, c_custkey AS line FROM customer
  UNION ALL
  SELECT c_nationkey, 'o' || o_orderkey, 'CALL', CASE WHEN o_orderstatus = 'O' THEN '<operator>.open' ELSE '' END, o_orderpriority, c_name,
    CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS VARCHAR), c_mktsegment, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY file, line, kind = 'CALL') - 1 AS node_id FROM n)
"""
GRAPH_IMPORT = _IMPORTED + "SELECT CAST(graph_id AS BIGINT) AS graph_id, node_id, kind, operator_or_literal, resolved_fqn, enclosing_decl_fqn, structural_path FROM m"


def graph_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the imported graphs, by the nodes' new numbers."""
    return _export(spark, sf_dir)[1].withColumn("graph_id", F.col("graph_id").cast("long"))


GRAPH_IMPORT_EDGES = (
    _IMPORTED
    + """, j AS (SELECT CAST(a.graph_id AS BIGINT) AS graph_id, a.node_id AS src, b.node_id AS dst, o_orderstatus AS st FROM orders JOIN m b ON b.id = 'o' || o_orderkey JOIN m a ON a.id = 'c' || o_custkey)
SELECT graph_id, src, dst, 'AST' AS kind FROM j UNION ALL SELECT graph_id, src, dst, 'PDG' FROM j WHERE st = 'O'
"""
)


def rebuilt_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes of their brands' declarations, each with an edge to the next. Brands that end in 3 are parsed again: only parts above size 25 are still there."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"), F.col("p_brand").alias("enclosing_decl_fqn"), "p_size")
    nodes = part.drop("p_size")
    edges = nodes.select(F.col("node_id").alias("src")).join(nodes.select((F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst")), "src").withColumn("kind", F.lit("CFG"))
    touched = nodes.where("enclosing_decl_fqn like '%3'").select("enclosing_decl_fqn").distinct()
    again = numbered(part.where("enclosing_decl_fqn like '%3' and p_size > 25"), ["node_id"], "place").select(F.col("place").alias("node_id"), "enclosing_decl_fqn")
    flow = again.select(F.col("node_id").alias("src")).join(again.select((F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst")), "src").withColumn("kind", F.lit("CFG"))
    out = delta.rebuild(nodes, edges, touched, again, flow)
    none = F.lit(None).cast("long")
    tables = [out[f"{c}_nodes"].select(F.lit(f"{c} node").alias("what"), F.col("node_id").alias("src"), none.alias("dst")) for c in ("added", "removed")]
    tables += [out[f"{c}_edges"].select(F.lit(f"{c} edge").alias("what"), "src", "dst") for c in ("added", "removed")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])


REBUILT_GRAPH = """
WITH k AS (SELECT p_partkey AS id FROM part WHERE p_brand NOT LIKE '%3'),
b AS (SELECT coalesce(max(id), -1) + 1 AS base FROM k),
a AS (SELECT base + row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part, b WHERE p_brand LIKE '%3' AND p_size > 25),
n AS (SELECT id FROM k UNION ALL SELECT id FROM a),
e AS (SELECT x.p_partkey AS src, y.p_partkey AS dst FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
f AS (SELECT x.id AS src, y.id AS dst FROM a x JOIN a y ON y.id = x.id + 1),
g AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) UNION ALL SELECT src, dst FROM f)
SELECT 'added node' AS what, CAST(id AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst FROM a
UNION ALL SELECT 'removed node', p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT id FROM n)
UNION ALL SELECT 'added edge', src, dst FROM f
UNION ALL SELECT 'removed edge', src, dst FROM (SELECT src, dst FROM e EXCEPT SELECT src, dst FROM g)
"""


def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as results that name a nation as their rule by index, by name, by both or by neither; every third nation has the name of its region, so some names are ambiguous."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name"))
    rules = n.select(F.lit("r").alias("report"), F.lit(0).alias("run"), F.col("n_nationkey").cast("int").alias("rule_index"), name.alias("rule_id"))
    c = read(spark, sf_dir, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), name.alias("own")), "c_nationkey")
    way = F.col("c_custkey") % 6
    by_id = F.when(way.isin(0, 2), F.col("own")).when(way == 3, "NOBODY").when(way == 5, F.col("c_mktsegment"))
    by_index = F.when(way.isin(1, 2, 3), F.col("c_nationkey")).when(F.col("c_custkey") % 12 == 5, 99)
    results = c.select(F.lit("r").alias("report"), F.lit(0).alias("run"), "c_custkey", by_id.alias("rule_id"), by_index.cast("int").alias("rule_index"))
    return reports.rule_join(results, rules).select("c_custkey", "rule_status")


REPORT_RULES = """
WITH n AS (SELECT n_nationkey AS i, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE n_name END AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 2) THEN n.id WHEN c_custkey % 6 = 3 THEN 'NOBODY' WHEN c_custkey % 6 = 5 THEN c_mktsegment END AS id,
    CASE WHEN c_custkey % 6 IN (1, 2, 3) THEN c_nationkey WHEN c_custkey % 12 = 5 THEN 99 END AS i FROM customer JOIN n ON n.i = c_nationkey),
k AS (SELECT id, count(*) AS named FROM n GROUP BY 1)
SELECT c_custkey, CASE WHEN c.id IS NULL AND c.i IS NULL THEN 'missing' WHEN c.i IS NOT NULL AND n.i IS NULL THEN 'invalid' WHEN c.i IS NOT NULL AND c.id <> n.id THEN 'inconsistent'
  WHEN c.i IS NOT NULL THEN 'matched' WHEN named IS NULL THEN 'unindexed-id' WHEN named > 1 THEN 'ambiguous' ELSE 'matched' END AS rule_status
FROM c LEFT JOIN n ON n.i = c.i LEFT JOIN k ON k.id = c.id
"""


def report_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results whose place is a file named by their clerk, by URI, by artifact, by both or by neither; only clerks of even numbers are in the inventory."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("clerk"))
    name = F.concat(F.lit("src/"), F.col("clerk").cast("string"), F.lit(".py"))
    way = F.col("o_orderkey") % 7
    uri = F.when(way.isin(0, 1), name).when(way == 2, F.concat(F.lit("./"), name)).when(way == 3, F.concat(F.lit("../"), name)).when(way == 4, F.concat(F.lit("file:///"), name))
    results = o.select("o_orderkey", F.lit("r").alias("report"), F.lit(0).alias("run"), uri.alias("uri"), F.when(way.isin(1, 5), F.when(way == 1, (F.col("clerk") + F.col("o_orderkey") % 2) % 50).otherwise(F.col("clerk"))).cast("int").alias("artifact_index"))
    clerks = spark.range(50).select(F.col("id").cast("int").alias("artifact_index"))
    artifacts = clerks.select(F.lit("r").alias("report"), F.lit(0).alias("run"), "artifact_index", F.concat(F.lit("src/"), F.col("artifact_index").cast("string"), F.lit(".py")).alias("uri"))
    inventory = clerks.where("artifact_index % 2 = 0").select(F.concat(F.lit("src/"), F.col("artifact_index").cast("string"), F.lit(".py")).alias("path"))
    return reports.path_join(results, artifacts, inventory).select("o_orderkey", "path", "path_status")


REPORT_PATHS = """
WITH o AS (SELECT o_orderkey, o_custkey % 50 AS k, o_orderkey % 7 AS way FROM orders),
x AS (SELECT *, 'src/' || k || '.py' AS name, CASE WHEN way = 1 THEN (k + o_orderkey % 2) % 50 WHEN way = 5 THEN k END AS a FROM o),
y AS (SELECT *, CASE WHEN way IN (0, 1, 2, 5) THEN name END AS path FROM x)
SELECT o_orderkey, path, CASE WHEN way = 6 THEN 'missing' WHEN way = 1 AND a <> k THEN 'contradiction' WHEN path IS NULL THEN 'outside' WHEN k % 2 = 1 THEN 'not-in-inventory' ELSE 'matched' END AS path_status FROM y
"""


def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that call the token of its first line that calls any; after a comma stands a bracket, so that words are calls."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.regexp_replace("text", ",", "(").alias("text"))
    each = refactor.text_lines(d).select("file", "line", refactor.callee_token(F.col("line_text")).alias("token")).where("token is not null")
    tokens = each.groupBy("file").agg(F.min_by("token", "line").alias("token"))
    return refactor.sink_lines(d, tokens).select(F.col("file").alias("doc_id"), "token", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


SINK_LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, replace(unnest(string_split(text, chr(10))), ',', '(') AS t FROM documents),
c AS (SELECT doc_id, n, [x for x in [regexp_extract(s, '(?:^|[^\p{L}\p{M}\p{N}_])([A-Za-z_][\p{L}\p{M}\p{N}_]*)\s*$', 1) for s in string_split(t, '(')[:-2]] if x <> ''] AS found FROM l),
f AS (SELECT doc_id, arg_min(found[-1], n) AS token FROM c WHERE len(found) > 0 GROUP BY 1)
SELECT doc_id, token, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS lines FROM f JOIN c USING (doc_id) WHERE list_contains(found, token) GROUP BY 1, 2
"""

_ALL = (canonical_classes, slice_classes, taint_witness, incremental_taint, graph_import, graph_import_edges, rebuilt_graph, report_rules, report_paths, sink_lines)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

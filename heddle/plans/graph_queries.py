"""Graph operators over the driver's tables.

Conversations stand for control flow (a turn's successor is the next turn), parts for a tree (a part's
parent is half its number), orders, line items, suppliers and nations for dependence graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.tables import read
from heddle.operators import delta, graphs, taint


def _conversation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as nodes, one graph and one procedure for each conversation; a turn whose text length is divisible by 5 sanitizes."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph_id"), F.col("turn").alias("node_id"), "role", (F.length("text") % 5 == 0).alias("clean"))
    seeded = turns.where("role = 'user'").select(F.lit("chat").alias("spec_id"), "graph_id", "node_id", F.col("node_id").alias("fact"))
    moves = turns.join(turns.select("graph_id", (F.col("node_id") - 1).alias("node_id"), F.col("node_id").alias("dst")), ["graph_id", "node_id"]).select("graph_id", F.col("node_id").alias("src"), "dst")
    blocked = turns.where("clean").select(F.lit("chat").alias("spec_id"), "graph_id", "node_id")
    sinks = turns.where("role = 'assistant'").select("graph_id", "node_id")
    return taint.tabulate(seeded, moves, blocked), sinks, turns


def taint_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, sinks, _ = _conversation_graph(spark, sf_dir)
    at = facts.join(sinks, ["graph_id", "node_id"])
    return at.groupBy(F.col("graph_id").cast("long").alias("conv_id"), F.col("node_id").alias("sink_turn")).agg(F.count("*").alias("n_facts"))


REACH = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) % 5 = 0 AS clean FROM conversations),
r AS (
  SELECT conv_id, turn AS source_turn, turn, clean, CAST(turn AS VARCHAR) AS witness FROM t WHERE role = 'user'
  UNION ALL
  SELECT t.conv_id, r.source_turn, t.turn, t.clean, r.witness || ',' || t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1 WHERE NOT r.clean)
"""
TAINT_REACH = REACH + "SELECT r.conv_id, r.turn AS sink_turn, count(*) AS n_facts FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.role = 'assistant' GROUP BY 1, 2"


def taint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole solver on graphs made of events: a user's events in order are a procedure's control flow, and a purchase calls the procedure of the user half its number."""
    nodes, edges, clauses = event_graph(spark, sf_dir)
    return taint.solve(nodes, edges, clauses).select("sink", "fact", F.col("depth").cast("long").alias("depth"))


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    entry = -F.col("user_id") - 1
    graph = F.lit("events").alias("graph_id")
    name = F.col("user_id").cast("string")
    methods = e.select("user_id").distinct().select(graph, entry.alias("node_id"), F.lit("METHOD").alias("kind"), F.lit("").alias("operator_or_literal"), name.alias("resolved_fqn"), F.lit("").alias("enclosing_decl_fqn"), F.lit("").alias("structural_path"))
    body = e.select(graph, F.col("event_id").alias("node_id"), F.lit("CALL").alias("kind"), F.col("event_type").alias("operator_or_literal"), F.lit("").alias("resolved_fqn"), name.alias("enclosing_decl_fqn"), F.lit("").alias("structural_path"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    flow = e.select("user_id", "event_id", F.lag("event_id").over(w).alias("before"))
    flow = flow.select(graph, F.coalesce("before", entry).alias("src"), F.col("event_id").alias("dst"), F.lit("CFG").alias("kind"))
    calls = e.where("event_type = 'purchase'").select(graph, F.col("event_id").alias("src"), (-F.floor(F.col("user_id") / 2) - 1).cast("long").alias("dst"), F.lit("CALL").alias("kind"))
    clauses = spark.createDataFrame([("s", 0, "source", "signup"), ("s", 1, "sanitize", "error"), ("s", 4, "sanitize", "view"), ("s", 5, "sanitize", "click"), ("s", 2, "sink", "purchase"), ("s", 3, "sink", "error")], "spec_id string, ordinal int, primitive string, pattern string")
    return methods.unionByName(body), flow.unionByName(calls), clauses


TAINT_FINDINGS = """
WITH RECURSIVE e AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
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


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part calls the part of half its number; part 70 calls part 140 back, which makes a cycle."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src")).where("src > 1")
    up = parts.select("src", F.floor(F.col("src") / 2).cast("long").alias("dst"))
    return up.unionByName(spark.createDataFrame([(70, 140)], "src long, dst long"))


def callers_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read(spark, sf_dir, "part").where("p_partkey BETWEEN 30 AND 60 AND p_size % 2 = 0 OR p_partkey = 70").select(F.col("p_partkey").alias("node"))
    return graphs.transitive_callers(_calls(spark, sf_dir), seeds).select(F.col("node").alias("p_partkey"))


CALLERS_CLOSURE = """
WITH RECURSIVE calls AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT 70, 140),
r AS (
  SELECT src AS node FROM calls WHERE dst IN (SELECT p_partkey FROM part WHERE p_partkey BETWEEN 30 AND 60 AND p_size % 2 = 0 OR p_partkey = 70)
  UNION SELECT c.src FROM r JOIN calls c ON c.dst = r.node)
SELECT node AS p_partkey FROM r
"""


def affected_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed: parts of size 50. A part's symbol is used by the part of half its number; types by their last word, which stands under the whole type."""
    part = read(spark, sf_dir, "part")
    changed = part.where("p_size = 50").select(F.col("p_partkey").alias("node"))
    users = part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    calls = part.where("p_partkey > 1").select((F.col("p_partkey") - 1).alias("src"), F.col("p_partkey").alias("dst"))
    subtypes = part.select(F.element_at(F.split("p_type", " "), -1).alias("src"), F.col("p_type").alias("dst")).distinct()
    changed_types = part.where("p_size = 50 AND p_partkey % 7 = 0").select(F.element_at(F.split("p_type", " "), -1).alias("node"))
    out = delta.affected(changed, changed_types, users, calls, subtypes, part.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("type")))
    return out.select(F.col("node").alias("p_partkey"))


AFFECTED_SET = """
WITH RECURSIVE changed AS (SELECT p_partkey AS node FROM part WHERE p_size = 50),
users AS (SELECT node FROM changed UNION SELECT node // 2 FROM users WHERE node > 1),
cone AS (SELECT DISTINCT split_part(p_type, ' ', -1) AS t FROM part WHERE p_size = 50 AND p_partkey % 7 = 0)
SELECT node AS p_partkey FROM users
UNION SELECT node - 1 FROM changed WHERE node > 1
UNION SELECT p_partkey FROM part WHERE split_part(p_type, ' ', -1) IN (SELECT t FROM cone) OR p_type IN (SELECT t FROM cone)
"""


def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand: the share of its parts above size 30 are changed files, that of parts above 38 the cone; brands alternate in verdict."""
    b = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 30).cast("double")).alias("file_ratio"), F.avg((F.col("p_size") > 38).cast("double")).alias("cone"), F.count("*").alias("n"))
    verdict = F.when(F.col("n") % 5 == 0, "closed-world").when(F.col("n") % 5 == 1, "full-reparse").otherwise("degraded")
    return b.select("p_brand", delta.route(verdict, F.col("file_ratio"), F.col("cone")).alias("route"), F.round("file_ratio", 6).alias("file_ratio"), F.round(delta.shown_cone_ratio(verdict, F.col("file_ratio"), F.col("cone")), 6).alias("cone_ratio"))


ROUTE_DECISION = """
WITH b AS (SELECT p_brand, avg(CAST(p_size > 30 AS DOUBLE)) AS f, avg(CAST(p_size > 38 AS DOUBLE)) AS c, count(*) % 5 AS m FROM part GROUP BY 1),
v AS (SELECT *, CASE m WHEN 0 THEN 'closed-world' WHEN 1 THEN 'full-reparse' ELSE 'degraded' END AS verdict FROM b)
SELECT p_brand, CASE WHEN verdict <> 'degraded' THEN verdict WHEN f > 0.4 OR c > 0.25 THEN 'full-reparse' ELSE 'degraded' END AS route,
  round(f, 6) AS file_ratio, CASE WHEN verdict = 'degraded' AND NOT f > 0.4 THEN round(c, 6) END AS cone_ratio FROM v
"""


def graph_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-to-status edges of orders up to mid-1996 and from 1995 on, as an old and a new graph."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), "o_orderdate")
    return delta.difference(o.where("o_orderdate < timestamp '1996-07-01'").select("src", "dst"), o.where("o_orderdate >= timestamp '1995-01-01'").select("src", "dst").distinct()).distinct()


GRAPH_DELTA = """
WITH old AS (SELECT DISTINCT o_custkey AS src, o_orderstatus AS dst FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01'),
new AS (SELECT DISTINCT o_custkey AS src, o_orderstatus AS dst FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT src, dst, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old)
UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)
"""


def _part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent"), "p_size")


def ast_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest part at or above each part whose size is divisible by 5."""
    tree = _part_tree(spark, sf_dir)
    return graphs.nearest_ancestor(tree, tree.where("p_size % 5 = 0")).select(F.col("node").alias("p_partkey"), "owner")


AST_OWNER = """
WITH RECURSIVE r AS (
  SELECT p_partkey, p_partkey AS here, p_size % 5 = 0 AS hit FROM part
  UNION ALL SELECT r.p_partkey, p.p_partkey AS here, p.p_size % 5 = 0 FROM r JOIN part p ON p.p_partkey = r.here // 2 AND r.here > 1 WHERE NOT r.hit)
SELECT p_partkey, max(CASE WHEN hit THEN here END) AS owner FROM r GROUP BY 1
"""


def ast_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-order places and structural paths of parts, siblings by size and number."""
    out = graphs.preorder(_part_tree(spark, sf_dir), order=("p_size", "node"))
    return out.select(F.col("node").alias("p_partkey"), F.array_join("path", ".").alias("structural_path"), F.col("depth").cast("long").alias("depth"), "preorder")


AST_PREORDER = """
WITH RECURSIVE s AS (SELECT p_partkey, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, row_number() OVER (PARTITION BY CASE WHEN p_partkey > 1 THEN p_partkey // 2 END ORDER BY p_size, p_partkey) - 1 AS place FROM part),
r AS (
  SELECT p_partkey, [place] AS path FROM s WHERE p_partkey <= 1
  UNION ALL SELECT s.p_partkey, list_append(r.path, s.place) FROM r JOIN s ON s.parent = r.p_partkey AND s.p_partkey > 1)
SELECT p_partkey, array_to_string(path, '.') AS structural_path, CAST(len(path) - 1 AS BIGINT) AS depth, row_number() OVER (ORDER BY path) - 1 AS preorder FROM r
"""


def backward_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches supplier 1 from orders over line items (kinds by ship flag R are not walked, but show in the slice)."""
    li = read(spark, sf_dir, "lineitem")
    item = F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber")
    order, part, supplier = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("o", "l_orderkey"), ("p", "l_partkey"), ("s", "l_suppkey")))
    to_item = li.select(order.alias("src"), item.alias("dst"), F.when(F.col("l_returnflag") == "R", "AST").otherwise("CFG").alias("kind"))
    edges = to_item.unionByName(li.select(item.alias("src"), supplier.alias("dst"), F.lit("PDG").alias("kind"))).unionByName(li.select(item.alias("src"), part.alias("dst"), F.lit("CALL").alias("kind")))
    nodes, inside = graphs.backward_slice(edges, spark.createDataFrame([("s1",)], "node string"), ("CFG", "CALL", "PDG"))
    return nodes.select("node", F.lit("node").alias("what")).unionByName(inside.select(F.concat_ws(">", "src", "dst", "kind").alias("node"), F.lit("edge").alias("what")))


BACKWARD_SLICE = """
WITH RECURSIVE li AS (SELECT *, concat_ws(':', 'l', l_orderkey, l_linenumber) AS item FROM lineitem),
edges AS (
  SELECT 'o' || l_orderkey AS src, item AS dst, CASE WHEN l_returnflag = 'R' THEN 'AST' ELSE 'CFG' END AS kind FROM li
  UNION ALL SELECT item, 's' || l_suppkey, 'PDG' FROM li UNION ALL SELECT item, 'p' || l_partkey, 'CALL' FROM li),
r AS (SELECT 's1' AS node UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.node AND e.kind <> 'AST')
SELECT node, 'node' AS what FROM r
UNION ALL SELECT src || '>' || dst || '>' || kind, 'edge' FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)
"""


def wl_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement of suppliers, nations and regions until it is stable; suppliers are labelled by the sign of their balance."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = s.select(node("s", "s_suppkey").alias("node"), F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor").alias("label"))
    nodes = nodes.unionByName(n.select(node("n", "n_nationkey").alias("node"), F.lit("nation").alias("label"))).unionByName(r.select(node("r", "r_regionkey").alias("node"), F.lit("region").alias("label")))
    edges = s.select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst"), F.lit("in").alias("kind"))
    edges = edges.unionByName(n.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("of").alias("kind")))
    colors = graphs.refine(nodes, edges)
    classes = colors.groupBy("color").agg(F.min("node").alias("class"), F.count("*").alias("members"))
    return colors.join(classes, "color").select("node", "class", "members")


def _wl_round(k: int) -> str:
    item = "e.kind || ':' || lpad(CAST(c.color AS VARCHAR), 12, '0')"
    side = lambda here, there: f"coalesce((SELECT string_agg({item}, ',' ORDER BY {item}) FROM edges e JOIN c{k} c ON c.node = e.{there} WHERE e.{here} = x.node), '')"
    return f"c{k + 1} AS (SELECT node, dense_rank() OVER (ORDER BY color, ins, outs) - 1 AS color FROM (SELECT x.node, x.color, {side('dst', 'src')} AS ins, {side('src', 'dst')} AS outs FROM c{k} x))"


#: The graph is three levels high: six rounds are more than it takes to be stable, and one more changes no class.
WL_REFINE = f"""
WITH nodes AS (
  SELECT 's' || s_suppkey AS node, CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS label FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region),
edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'in' AS kind FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'of' FROM nation),
c0 AS (SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS color FROM nodes),
{', '.join(map(_wl_round, range(6)))}
SELECT node, min(node) OVER (PARTITION BY color) AS class, count(*) OVER (PARTITION BY color) AS members FROM c6
"""

QUERIES = {f.__name__: f for f in (taint_reach, taint_findings, callers_closure, affected_set, route_decision, graph_delta, ast_owner, ast_preorder, backward_slice, wl_refine)}
ORACLES = {"taint_reach": TAINT_REACH, "taint_findings": TAINT_FINDINGS, "callers_closure": CALLERS_CLOSURE, "affected_set": AFFECTED_SET, "route_decision": ROUTE_DECISION, "graph_delta": GRAPH_DELTA, "ast_owner": AST_OWNER, "ast_preorder": AST_PREORDER, "backward_slice": BACKWARD_SLICE, "wl_refine": WL_REFINE}

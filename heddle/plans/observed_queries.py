"""Strict documents made of customers: orders are methods, line items are formals and calls, and some orders break the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.tables import read
from heddle.sources import observed

CATALOGUE = [
    ("META_DATA", "LANGUAGE", "str", "one"),
    *(("METHOD", *p) for p in (("FULL_NAME", "str", "one"), ("FILENAME", "str", "optional"), ("LINE_NUMBER", "int", "optional"), ("OVERLAYS", "str", "many"))),
    ("METHOD_PARAMETER_IN", "INDEX", "int", "one"),
    ("CALL", "NAME", "str", "one"),
    ("CALL", "ARGUMENT_INDEX", "int", "one"),
    ("CALL", "IS_STATIC", "bool", "optional"),
]
EDGES = [("AST", None), ("CALL", None), ("ARGUMENT", None), ("REACHING_DEF", "VARIABLE")]


def _filled(text: str, *values: Column) -> Column:
    """text with the values for its %s; a missing one says null."""
    out = []
    for before, value in zip(text.split("%s"), [*values, None], strict=True):
        out += [F.lit(before)] * bool(before) + ([] if value is None else [F.coalesce(value.cast("string"), F.lit("null"))])
    return F.concat(*out)


def _nodes(x: dict[str, Column], broken: bool) -> Column:
    """The nodes of an order (part 0) or an item, as JSON."""
    k, n, nameless = x["key"] * 100, x["part"], x["status"] == "P"
    line = F.when(F.lit(broken) & (x["priority"] == "1-URGENT"), _filled('"%s"', x["day"])).otherwise(x["day"].cast("string"))
    named = F.when(nameless, "").otherwise(_filled('"FULL_NAME":"%s",', x["priority"]))
    missing = F.when(nameless & F.lit(not broken), '["FULL_NAME"]').otherwise("[]")
    method = _filled('{"id":"%s","kind":"METHOD","properties":{%s"FILENAME":"%s","LINE_NUMBER":%s,"OVERLAYS":["a","%s"]},"missing_properties":%s}', k, named, x["status"], line, x["status"], missing)
    formal = '{"id":"%s","kind":"METHOD_PARAMETER_IN","properties":{"INDEX":%s},"missing_properties":[]}'
    call = '{"id":"%s","kind":"CALL","properties":{"NAME":"%s","ARGUMENT_INDEX":%s,"IS_STATIC":%s},"missing_properties":[]}'
    return F.when(n == 0, method).otherwise(_filled(f"{formal},{call}", k + 1 + n, n, k + 50 + n, x["flag"], n, x["status"] == "F"))


def _edges(x: dict[str, Column], broken: bool) -> Column:
    """The edges of an item, as JSON; an order has none."""
    k, n, bad = x["key"] * 100, x["part"], F.lit(broken)
    formal, call = k + 1 + n, k + 50 + n
    edge = lambda a, b, kind, props="{}": _filled('{"src":"%s","dst":"%s","kind":"' + kind + '","properties":' + props + "}", a, b)
    nested = bad & (x["flag"] == "R") & (n > 1)
    calls = F.when(bad & x["untaxed"], formal).otherwise(k)
    edges = [
        edge(F.when(nested, k + n).otherwise(k), formal, "AST"),
        edge(k, call, "AST"),
        edge(call, calls, "CALL"),
        F.when(n > 1, edge(call, k + 49 + n, "ARGUMENT")),
        F.when(x["status"] == "F", edge(formal, call, "REACHING_DEF", '{"VARIABLE":"x"}')),
        F.when(bad & x["fifty"], edge(formal, F.lit("77"), "REACHING_DEF")),
        F.when(bad & (x["priority"] == "4-NOT SPECIFIED") & (n == 1), edge(call, k, "AST")),
    ]
    return F.when(n > 0, F.concat_ws(",", *edges))


def _documents(spark: SparkSession, sf_dir: str, broken: bool, kept: bool = False) -> observed.Documents:
    """A document for each customer with orders; kept: written, for what reads them more than once.

    Broken ones: urgent orders have their line number in quotation marks, orders of status P don't say that
    their name is missing, items with flag R stand below an item, those without tax call a formal, and the first
    item of an unspecified order owns its method. Items of 50 pieces lead to a node that isn't there.
    """
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.dayofmonth("o_orderdate").alias("day"))
    li = read(spark, sf_dir, "lineitem")
    # line numbers repeat within orders; merged, as items are in the order of orders then
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = li.select("l_orderkey", n.alias("n"), "l_returnflag", "l_linestatus", (F.col("l_tax") == 0).alias("untaxed"), (F.col("l_quantity") == 50).alias("fifty")).join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    shared = [F.col("o_custkey").cast("string").alias("graph_id"), F.col("o_orderkey").alias("key")]
    m = o.select(*shared, F.lit(0).alias("part"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "day", *(F.lit(None).cast(t).alias(c) for c, t in (("flag", "string"), ("untaxed", "boolean"), ("fifty", "boolean"))))
    items = li.select(*shared, F.col("n").alias("part"), F.col("o_orderpriority").alias("priority"), F.col("l_linestatus").alias("status"), F.lit(None).cast("int").alias("day"), F.col("l_returnflag").alias("flag"), "untaxed", "fifty")
    # only what the texts are made of is shuffled; the number of parts is fixed, since they become some forty times as large
    parts = 8 + o.count() // 20_000
    x = {c: F.col(c) for c in m.columns}
    rows = m.unionByName(items).repartition(parts, "graph_id").select("graph_id", F.struct("key", "part", _nodes(x, broken).alias("nodes"), _edges(x, broken).alias("edges")).alias("x"))
    rows = rows.groupBy("graph_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    joined = lambda name: F.array_join(f"x.{name}", ",")
    meta = '{"id":"1","kind":"META_DATA","properties":{"LANGUAGE":"SQL"},"missing_properties":[]},'
    docs = rows.select("graph_id", F.concat(F.lit('{"nodes":[' + meta), joined("nodes"), F.lit('],"edges":['), joined("edges"), F.lit("]}")).alias("json"))
    catalogue = spark.createDataFrame(CATALOGUE, "kind string, name string, native string, quantity string")
    return (observed.read if kept else observed.parsed)(docs, catalogue, spark.createDataFrame(EDGES, "kind string, name string"))


def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with the broken documents."""
    d = _documents(spark, sf_dir, True)
    return observed.violations(d).select(F.col("graph_id").cast("long").alias("c_custkey"), "rule", "subject")


_ITEMS = """
li AS (
  SELECT *, l_orderkey * 100 AS method, l_orderkey * 100 + 1 + n AS formal, l_orderkey * 100 + 50 + n AS call
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)"""
DOCUMENT_VIOLATIONS = f"""
WITH {_ITEMS}
SELECT o_custkey AS c_custkey, 'wrong_type' AS rule, (o_orderkey * 100) || '.LINE_NUMBER' AS subject FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_custkey, 'missing_not_explicit', CAST(o_orderkey * 100 AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_custkey, 'formal_without_method', CAST(formal AS VARCHAR) FROM li WHERE l_returnflag = 'R' AND n > 1
UNION ALL SELECT o_custkey, 'ends', 'CALL:' || call || '>' || formal FROM li WHERE l_tax = 0
UNION ALL SELECT o_custkey, 'ends', 'dangling:' || formal || '>77' FROM li WHERE l_quantity = 50
UNION ALL SELECT o_custkey, 'cyclic_ownership', CAST(unnest([method, call]) AS VARCHAR) FROM li WHERE o_orderpriority = '4-NOT SPECIFIED' AND n = 1
"""


def document_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by role for each node, as ordinals of the document, with the method that owns the node."""
    d = _documents(spark, sf_dir, False)
    return observed.owned_views(d).select(F.col("node").cast("long").alias("node"), "role", F.col("owner").cast("long").alias("owner"), F.size("ordinals").cast("long").alias("n"), F.array_join(F.col("ordinals").cast("array<string>"), ",").alias("ordinals"))


DOCUMENT_VIEWS = f"""
WITH {_ITEMS},
e AS (
  SELECT o_custkey, l_orderkey, n, 1 AS k, method AS src, 'AST' AS kind, 'inputs' AS role FROM li
  UNION ALL SELECT o_custkey, l_orderkey, n, 2, method, 'AST', NULL FROM li
  UNION ALL SELECT o_custkey, l_orderkey, n, 3, call, 'CALL', 'callees' FROM li
  UNION ALL SELECT o_custkey, l_orderkey, n, 4, call, 'ARGUMENT', 'arguments' FROM li WHERE n > 1
  UNION ALL SELECT o_custkey, l_orderkey, n, 5, formal, 'REACHING_DEF', NULL FROM li WHERE l_linestatus = 'F'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, n, k) - 1 AS ordinal FROM e),
roles AS (
  SELECT src AS node, role, l_orderkey, ordinal FROM numbered WHERE role IS NOT NULL
  UNION ALL SELECT src, kind, l_orderkey, ordinal FROM numbered WHERE kind IN ('AST', 'REACHING_DEF'))
SELECT node, role, l_orderkey * 100 AS owner, count(*) AS n, string_agg(ordinal, ',' ORDER BY ordinal) AS ordinals FROM roles GROUP BY node, role, l_orderkey
"""


def method_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods that each customer's names and places may mean, none chosen: by every priority as a name, and by status and each of three days as a place."""
    d = _documents(spark, sf_dir, False, kept=True)
    graphs = d.nodes.select("graph_id").distinct()
    names = graphs.join(F.broadcast(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("full_name")).distinct()))
    places = graphs.select("graph_id", F.lit("F").alias("filename"), F.explode(F.array(*map(F.lit, (1, 15, 31)))).alias("line"))
    by_name = observed.methods_by_full_name(d, names).select("graph_id", F.col("full_name").alias("asked"), "candidates")
    by_place = observed.methods_at_source(d, places).select("graph_id", F.concat_ws(":", "filename", "line").alias("asked"), "candidates")
    return by_name.unionByName(by_place).select(F.col("graph_id").cast("long").alias("c_custkey"), "asked", F.array_join("candidates", ",").alias("candidates"))


METHOD_CANDIDATES = """
WITH g AS (SELECT DISTINCT o_custkey FROM orders), p AS (SELECT DISTINCT o_orderpriority AS p FROM orders)
SELECT g.o_custkey AS c_custkey, p AS asked, coalesce(string_agg(CAST(o_orderkey * 100 AS VARCHAR), ',' ORDER BY o_orderkey), '') AS candidates
FROM g, p LEFT JOIN orders o ON o.o_custkey = g.o_custkey AND o_orderpriority = p AND o_orderstatus <> 'P' GROUP BY 1, 2
UNION ALL
SELECT g.o_custkey, 'F:' || d, coalesce(string_agg(CAST(o_orderkey * 100 AS VARCHAR), ',' ORDER BY o_orderkey), '')
FROM g, (VALUES (1), (15), (31)) t(d) LEFT JOIN orders o ON o.o_custkey = g.o_custkey AND o_orderstatus = 'F' AND day(o_orderdate) = d GROUP BY 1, 2
"""


def observed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each property is there or absent, and in which field of the union its values stand."""
    rows = observed.observations(_documents(spark, sf_dir, False))
    value = F.col("value")
    n = lambda c: F.count(c).alias
    return rows.groupBy("kind", "name", "presence").agg(n("id")("nodes"), n(value["text"])("texts"), n(value["number"])("numbers"), n(value["flag"])("flags"), n(value["texts"])("lists"), F.sum(value["number"]).alias("total"))


OBSERVED_PROPERTIES = """
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'META_DATA' AS kind, 'LANGUAGE' AS name, 'present' AS presence, count(DISTINCT o_custkey) AS nodes, count(DISTINCT o_custkey) AS texts, 0 AS numbers, 0 AS flags, 0 AS lists, NULL AS total FROM orders
UNION ALL SELECT 'METHOD', 'FULL_NAME', CASE WHEN o_orderstatus = 'P' THEN 'missing_required' ELSE 'present' END, count(*), count(*) FILTER (o_orderstatus <> 'P'), 0, 0, 0, NULL FROM orders GROUP BY 3
UNION ALL SELECT 'METHOD', 'FILENAME', 'present', count(*), count(*), 0, 0, 0, NULL FROM orders
UNION ALL SELECT 'METHOD', 'LINE_NUMBER', 'present', count(*), 0, count(*), 0, 0, CAST(sum(day(o_orderdate)) AS BIGINT) FROM orders
UNION ALL SELECT 'METHOD', 'OVERLAYS', 'present', count(*), 0, 0, 0, count(*), NULL FROM orders
UNION ALL SELECT 'METHOD_PARAMETER_IN', 'INDEX', 'present', count(*), 0, count(*), 0, 0, CAST(sum(n) AS BIGINT) FROM li
UNION ALL SELECT 'CALL', 'NAME', 'present', count(*), count(*), 0, 0, 0, NULL FROM li
UNION ALL SELECT 'CALL', 'ARGUMENT_INDEX', 'present', count(*), 0, count(*), 0, 0, CAST(sum(n) AS BIGINT) FROM li
UNION ALL SELECT 'CALL', 'IS_STATIC', 'present', count(*), 0, 0, count(*), 0, NULL FROM li
"""

_ALL = (document_violations, document_views, method_candidates, observed_properties)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

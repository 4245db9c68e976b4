"""Rights, typed graphs, chains, trees and refactor pairs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.tables import read
from heddle.operators import governance, refactor

ROLES = ["org-admin", "org-viewer", "scanner"]
RESOURCES = ["scans", "snapshots", "codebases", "findings", "attestations"]
ACTIONS = ["submit", "read", "create", "patch_status"]
_pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
_sql = lambda names, n: "['" + "', '".join(names) + f"'][{n} % {len(names)} + 1]"


def rbac_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", _pick(ROLES, F.col("user_id")).alias("role"), _pick(RESOURCES, F.col("event_id")).alias("resource"), _pick(ACTIONS, F.floor(F.col("event_id") / 5)).alias("action"))
    return governance.allowed(e).groupBy("role", "resource", "action", "allowed").agg(F.count("*").alias("n"))


RBAC_DECISIONS = (
    f"WITH e AS (SELECT {_sql(ROLES, 'user_id')} AS role, {_sql(RESOURCES, 'event_id')} AS resource, {_sql(ACTIONS, '(event_id // 5)')} AS action FROM events), r AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS role, '{w}' AS resource, '{a}' AS action" for r, per in governance.RIGHTS.items() for w, actions in per.items() for a in actions)
    + ") SELECT e.role, e.resource, e.action, r.role IS NOT NULL AS allowed, count(*) AS n FROM e LEFT JOIN r USING (role, resource, action) GROUP BY 1, 2, 3, 4"
)


def tenant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("org_id", F.concat(F.lit("org"), F.col("c_nationkey").cast("string")))
    return governance.tenant_rows(c, "org7").select("c_custkey", "org_id")


TENANT_ROWS = "SELECT c_custkey, 'org' || c_nationkey AS org_id FROM customer WHERE c_nationkey = 7"


def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("doc", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"z": 1, '), F.expr("substring(props, 2)"))).otherwise(F.col("props")))
    kinds = e.groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    bad = e.where(F.size(governance.unexpected_keys(F.col("doc"), ["k"])) > 0).groupBy("user_id").agg(F.count("*").alias("unexpected"))
    return kinds.join(bad, "user_id", "left").select("user_id", governance.all_distinct(F.col("kinds")).alias("distinct_kinds"), F.coalesce("unexpected", F.lit(0)).cast("long").alias("unexpected"))


JSON_SHAPES = "SELECT user_id, count(*) = count(DISTINCT event_type) AS distinct_kinds, count(*) FILTER (event_id % 4 = 0) AS unexpected FROM events GROUP BY 1"


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges from orders to parts; kinds by flags and status."""
    o = read(spark, sf_dir, "orders").select(F.lit("g").alias("graph_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "F", "CALL").when(F.col("o_orderstatus") == "O", "RETURN").otherwise("IDENTIFIER").alias("kind"), F.lit(True).alias("is_expression"))
    p = read(spark, sf_dir, "part").select(F.lit("g").alias("graph_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 3 == 0, "METHOD").when(F.col("p_size") % 3 == 1, "LOCAL").otherwise("LITERAL").alias("kind"), (F.col("p_size") % 3 == 2).alias("is_expression"))
    e = read(spark, sf_dir, "lineitem").select(F.lit("g").alias("graph_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("l_returnflag") == "R", "CALL").when(F.col("l_returnflag") == "A", "ARGUMENT").otherwise("REF").alias("kind"))
    return governance.typed_edge_violations(o.unionByName(p), e).groupBy("rule", "kind").agg(F.count("*").alias("n"))


TYPED_EDGES = """
WITH e AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'CALL' WHEN 'O' THEN 'RETURN' ELSE 'IDENTIFIER' END AS s, p_size % 3 AS d, CASE l_returnflag WHEN 'R' THEN 'CALL' WHEN 'A' THEN 'ARGUMENT' ELSE 'REF' END AS kind
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey),
v AS (SELECT kind, CASE WHEN s IS NULL OR d IS NULL THEN 'dangling' WHEN kind = 'CALL' AND NOT (s = 'CALL' AND d = 0) THEN 'CALL' WHEN kind = 'ARGUMENT' AND NOT (s IN ('CALL', 'RETURN') AND d = 2) THEN 'ARGUMENT' WHEN kind = 'REF' AND s = 'IDENTIFIER' AND d = 2 THEN 'REF' END AS rule FROM e)
SELECT rule, kind, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1, 2
"""


def provenance_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records in chains of halves; sizes make some keyless, tampered with, or without their artifact."""
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("record_id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent_id"), F.when((F.col("p_partkey") > 1) & (F.col("p_partkey") % 3 != 0), "repartition").otherwise("chain").alias("record_type"), F.col("p_name").alias("canonical"), F.when(F.col("p_size") == 13, "00").otherwise(F.sha2("p_name", 256)).alias("stored_sha256"), F.when(F.col("p_size") != 17, "k").alias("key_id"), F.col("p_name").alias("signature"), F.col("p_size").alias("artifact_id"), F.col("p_size").cast("string").alias("artifact_sha256"))
    artifacts = spark.range(1, 51).where("id <> 19").select(F.col("id").cast("int").alias("artifact_id"), F.col("id").cast("string").alias("sha256"))
    return governance.verified_chains(rows, artifacts, lambda text, signature, key: text == signature)


PROVENANCE_CHAINS = """
WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_size = 17 THEN 'KEY_NOT_FOUND' WHEN p_size = 13 THEN 'TAMPERED' WHEN p_size = 19 THEN 'ARTIFACT_MISSING' ELSE 'VERIFIED' END AS own, p_partkey > 1 AND p_partkey % 3 <> 0 AS up FROM part),
r AS (SELECT id AS record_id, id AS here, own, up FROM p UNION ALL SELECT r.record_id, p.id AS here, p.own, p.up FROM r JOIN p ON p.id = r.here // 2 AND r.up AND r.own = 'VERIFIED')
SELECT record_id, own AS verdict FROM r WHERE NOT up OR own <> 'VERIFIED'
"""


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tree entries under the part of half their number; parts without children are files; roots are parts 2 and 3."""
    p = read(spark, sf_dir, "part").where("p_partkey > 3")
    top = read(spark, sf_dir, "part").agg(F.max("p_partkey").alias("top"))
    e = p.crossJoin(F.broadcast(top)).select(F.floor(F.col("p_partkey") / 2).cast("long").alias("tree"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("object"), F.when(F.col("p_partkey") * 2 > F.col("top"), "blob").otherwise("tree").alias("kind"))
    files, _ = governance.tree_paths(e, spark.createDataFrame([("a", 2), ("b", 3)], "root string, tree long"))
    return files


TREE_PATHS = """
WITH RECURSIVE m AS (SELECT max(p_partkey) AS top FROM part),
r AS (SELECT 'a' AS root, CAST(2 AS BIGINT) AS object, '' AS path UNION ALL SELECT 'b', CAST(3 AS BIGINT), ''
  UNION ALL SELECT r.root, p.p_partkey, r.path || CASE WHEN r.object > 3 THEN '/' ELSE '' END || p.p_brand FROM r JOIN part p ON p.p_partkey // 2 = r.object AND p.p_partkey > 3)
SELECT root, path, object FROM r, m WHERE object * 2 > top AND object > 3
"""


def refactor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs: fingerprints are the sums of their first and second halves of line items' quantities."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber"))).alias("before"), F.sum(F.when(F.col("l_linenumber") > 3, F.col("l_linenumber") - 3)).alias("after"), F.count_if(F.col("l_linenumber") == 1).alias("candidates"))
    o = read(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = o.select(F.col("o_orderkey").alias("pair_id"), F.when(F.col("o_orderstatus") == "F", "should-flip").otherwise("should-stay").alias("truth"), "candidates", "before", F.when(F.col("o_orderkey") % 7 == 0, "weak").otherwise("strong").alias("before_class"), "after", F.lit("strong").alias("after_class"))
    return refactor.evaluated(pairs).select("pair_id", "outcome", "reason", "validity", "as_expected")


REFACTOR_PAIRS = """
WITH p AS (SELECT o_orderkey AS pair_id, any_value(o_orderstatus) AS st, sum(l_linenumber) FILTER (l_linenumber <= 3) AS b, sum(l_linenumber - 3) FILTER (l_linenumber > 3) AS a, count(*) FILTER (l_linenumber = 1) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
r AS (SELECT *, CASE WHEN c = 0 THEN 'sink-not-found' WHEN c > 1 THEN 'sink-ambiguous' WHEN b IS NULL THEN 'no-fingerprint-before' WHEN a IS NULL THEN 'no-fingerprint-after' END AS reason FROM p),
o AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unevaluated' WHEN b = a THEN 'stayed' ELSE 'flipped' END AS outcome FROM r)
SELECT pair_id, outcome, reason, CASE WHEN reason IS NULL THEN CASE WHEN pair_id % 7 = 0 THEN 'weak' ELSE 'strong' END END AS validity,
  CASE WHEN reason IS NULL THEN outcome = CASE WHEN st = 'F' THEN 'flipped' ELSE 'stayed' END END AS as_expected FROM o
"""


def callee_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with a bracket in each comma's place, so that words are calls."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", ",", "(").alias("text"))
    return refactor.text_lines(d).select("doc_id", F.col("line").cast("long").alias("line"), refactor.callee_token(F.col("line_text")).alias("token"))


#: Between brackets, what stands before each is looked at, since the expressions here have no word ends for all letters.
CALLEE_TOKENS = r"""
WITH d AS (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END AS text FROM documents WHERE text <> ''),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, replace(unnest(string_split(text, chr(10))), ',', '(') AS t FROM d)
SELECT doc_id, line, [x for x in [regexp_extract(s, '(?:^|[^\p{L}\p{M}\p{N}_])([A-Za-z_][\p{L}\p{M}\p{N}_]*)\s*$', 1) for s in string_split(t, '(')[:-2]] if x <> ''][-1] AS token FROM l
"""


def live_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers expect their nation's key mod 4 as head; the current heads are suppliers' least."""
    expected = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey") % 4).alias("head"))
    heads = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg((F.min("s_suppkey") % 4).cast("int").alias("head"))
    return governance.live_heads(expected, heads, ["key"]).select("c_custkey", "live")


LIVE_HEADS = """
WITH h AS (SELECT s_nationkey AS key, min(s_suppkey) % 4 AS head FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey % 4 END IS NOT DISTINCT FROM h.head AS live FROM customer LEFT JOIN h ON h.key = c_nationkey
"""

_ALL = (rbac_decisions, tenant_rows, json_shapes, typed_edges, provenance_chains, tree_paths, refactor_pairs, callee_tokens, live_heads)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

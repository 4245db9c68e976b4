"""Refusals, report shapes, policies and predicates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.canonical import quoted
from heddle.functions.tables import read
from heddle.operators import identity, policies
from heddle.plans.inventory_queries import _q
from heddle.sources import preflight

LIMITS = {"bytes": 2000, "depth": 2, "values": 16, "longest_string": 600}


def preflight_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON texts, of which those of more than four turns have a key twice."""
    t = read(spark, sf_dir, "conversations")
    turn = F.concat(F.lit('{"role":'), F.coalesce(quoted(F.col("role")), F.lit("null")), F.lit(',"text":'), F.coalesce(quoted(F.col("text")), F.lit("null")), F.lit("}"))
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", turn.alias("json")))).alias("x"))
    more = F.when(F.size("x") > 4, ',"conv":0').otherwise("")
    docs = rows.select("conv_id", F.concat(F.lit('{"conv":'), F.col("conv_id").cast("string"), F.lit(',"turns":['), F.array_join(F.transform("x", lambda x: x["json"]), ", "), F.lit("]"), more, F.lit("}")).alias("json"))
    return preflight.refusals(preflight.measured(docs), "conv_id", LIMITS)


PREFLIGHT_REFUSALS = f"""
WITH t AS (SELECT conv_id, turn, {_q("role")} AS r, {_q("text")} AS x FROM conversations),
d AS (
  SELECT conv_id, '{{"conv":' || conv_id || ',"turns":[' || string_agg('{{"role":' || r || ',"text":' || x || '}}', ', ' ORDER BY turn, r) || ']' || CASE WHEN count(*) > 4 THEN ',"conv":0' ELSE '' END || '}}' AS json,
    count(*) AS n, greatest(max(CASE WHEN r = 'null' THEN 5 ELSE strlen(r) - 2 END), max(CASE WHEN x = 'null' THEN 5 ELSE strlen(x) - 2 END), 5) AS longest FROM t GROUP BY conv_id)
SELECT conv_id, 'bytes' AS resource, CAST(strlen(json) AS BIGINT) AS observed, CAST({LIMITS["bytes"]} AS BIGINT) AS "limit" FROM d WHERE strlen(json) > {LIMITS["bytes"]}
UNION ALL SELECT conv_id, 'depth', 3, {LIMITS["depth"]} FROM d
UNION ALL SELECT conv_id, 'values', 3 + 3 * n + CASE WHEN n > 4 THEN 1 ELSE 0 END, {LIMITS["values"]} FROM d WHERE 3 + 3 * n + CASE WHEN n > 4 THEN 1 ELSE 0 END > {LIMITS["values"]}
UNION ALL SELECT conv_id, 'longest_string', longest, {LIMITS["longest_string"]} FROM d WHERE longest > {LIMITS["longest_string"]}
UNION ALL SELECT conv_id, 'repeated_key:conv', 2, 1 FROM d WHERE n > 4
"""

SCHEMA, TOOL = "https://example.org/sarif-2.1.0.json", "tool"


def report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each nation: suppliers are the core's results, customers the oracle's; negative balances have no level, high ones no known rule, and some nations' reports have other faults."""
    n, s, c = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))

    def results(rows: DataFrame, nation: str, name: str, balance: str, key: str) -> DataFrame:
        b = F.col(balance)
        level = F.when(b < 0, "").otherwise('"level":"warning",')
        rule = F.when(b > 9000, "other").otherwise("r1")
        text = F.when(F.col(key) % 50 == 0, "").otherwise(F.col(name))
        one = F.concat(F.lit("{"), level, F.lit('"ruleId":"'), rule, F.lit('","message":{"text":'), quoted(text), F.lit('},"properties":{"id":"'), F.col(key).cast("string"), F.lit('"}}'))
        return rows.groupBy(F.col(nation).alias("n_nationkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, one.alias("json")))), lambda x: x["json"]), ",").alias(f"{key}_results"))

    rows = n.join(results(s, "s_nationkey", "s_name", "s_acctbal", "s_suppkey"), "n_nationkey", "left").join(results(c, "c_nationkey", "c_name", "c_acctbal", "c_custkey"), "n_nationkey", "left")
    run = lambda part, found, nation: F.concat(F.lit('{"tool":{"driver":{"name":"tool","rules":[{"id":"r1"}]}},"properties":{"partition":"'), part, F.lit('","commit":"'), nation, F.lit('"},"results":['), F.coalesce(found, F.lit("")), F.lit("]}"))
    key = F.col("n_nationkey")
    name = F.when(key == 4, "").otherwise(F.col("n_name"))
    core, oracle = run(F.when(key == 5, "oracle").otherwise("core"), "s_suppkey_results", name), run(F.lit("oracle"), "c_custkey_results", name)
    runs = F.when(key == 3, core).otherwise(F.concat(core, F.lit(","), oracle))
    version = F.when(F.col("n_regionkey") == 2, "2.0").otherwise("2.1.0")
    json = F.concat(F.lit('{"$schema":"'), F.when(key == 6, "x").otherwise(SCHEMA), F.lit('","version":"'), version, F.lit('","runs":['), runs, F.lit("]"), F.when(key == 7, "").otherwise("}"))
    reports = rows.select(key.alias("report_id"), json.alias("json"))
    return preflight.report_violations(reports, SCHEMA, TOOL, {"properties.commit": "properties.commit"}, {"properties.id": "properties.id"})


REPORT_SHAPES = """
WITH x AS (
  SELECT s_nationkey AS n, 0 AS run, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, s_acctbal AS b, s_suppkey AS k FROM supplier
  UNION ALL SELECT c_nationkey, 1, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1, c_acctbal, c_custkey FROM customer),
r AS (SELECT *, 'runs[' || run || '].results[' || i || '].' AS p FROM x WHERE n NOT IN (3, 7))
SELECT n AS report_id, p || 'level' AS path, 'no level' AS problem FROM r WHERE b < 0
UNION ALL SELECT n, p || 'ruleId', 'no such rule' FROM r WHERE b > 9000
UNION ALL SELECT n, p || 'message.text', 'missing or empty' FROM r WHERE k % 50 = 0
UNION ALL SELECT n_nationkey, 'version', 'another version' FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 7
UNION ALL SELECT n_nationkey, 'runs', 'another number of runs' FROM nation WHERE n_nationkey = 3
UNION ALL SELECT n_nationkey, 'runs[' || unnest([0, 1]) || '].properties.commit', 'missing or empty' FROM nation WHERE n_nationkey = 4
UNION ALL SELECT n_nationkey, 'runs[0].properties.partition', 'another partition' FROM nation WHERE n_nationkey = 5
UNION ALL SELECT n_nationkey, '$schema', 'another schema' FROM nation WHERE n_nationkey = 6
UNION ALL SELECT n_nationkey, '', 'not JSON' FROM nation WHERE n_nationkey = 7
"""


def policy_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are policies of 90 days, of which those of status O are admitted from the tenth to the sixtieth; which hold at each customer's latest order."""
    o = read(spark, sf_dir, "orders")
    latest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("moment"))
    day = lambda n: F.col("o_orderdate") + F.expr(f"interval {n} days")
    rows = o.join(latest, "o_custkey").select("o_orderkey", "moment", F.col("o_orderdate").alias("valid_from"), day(90).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", "withdraw").otherwise("admit").alias("action"), (F.col("o_orderdate") - F.expr("interval 10 days")).alias("issued_at"), day(60).alias("checkpoint_expires_at"))
    return policies.policy_time(rows, F.col("moment")).select("o_orderkey", "denial")


POLICY_DENIALS = """
WITH m AS (SELECT o_custkey, max(o_orderdate) AS moment FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN NOT moment < o_orderdate + INTERVAL 90 DAY THEN 'policy-expired' WHEN o_orderstatus = 'F' OR NOT moment < o_orderdate + INTERVAL 60 DAY THEN 'checkpoint-denied' END AS denial FROM orders JOIN m USING (o_custkey)
"""


def grant_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are policies, their orders grants; what a new version of each may not have changed."""
    o = read(spark, sf_dir, "orders")
    key = [F.col("o_custkey").alias("policy_id"), F.col("o_orderkey").alias("grant_id")]
    status = F.when(F.col("o_orderstatus") == "F", "revoked").when(F.col("o_orderstatus") == "O", "active").otherwise("retired")
    price, date = F.col("o_totalprice"), F.col("o_orderdate")
    day = lambda n: date + F.expr(f"interval {n} days")
    old = o.where("o_orderpriority <> '5-LOW'").select(*key, "o_orderpriority", status.alias("status"), F.when(status != "active", date).alias("changed_at"), F.col("o_orderpriority").alias("content"), date.alias("not_before"), day(30).alias("not_after"))
    new = o.where(price < 450000).select(
        *key,
        F.when(price < 20000, "other").otherwise(F.col("o_orderpriority")).alias("content"),
        F.when(price.between(50000, 90000), "retired").otherwise(status).alias("status"),
        F.when(price.between(50000, 70000), day(-1)).when(price.between(70000, 90000), day(1)).when(status != "active", date).alias("changed_at"),
        date.alias("not_before"),
        day(30).alias("not_after"),
    )
    windows = o.groupBy(F.col("o_custkey").alias("policy_id")).agg(F.min("o_orderdate").alias("valid_from"), F.max("o_orderdate").alias("expires_at"))
    return policies.evolution_violations(old.drop("o_orderpriority"), new, windows)


GRANT_EVOLUTION = """
WITH o AS (SELECT *, o_totalprice AS p, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 2 END AS s, o_orderpriority = '5-LOW' AS fresh, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders),
n AS (SELECT *, CASE WHEN p BETWEEN 50000 AND 90000 THEN 2 ELSE s END AS t, CASE WHEN p BETWEEN 50000 AND 70000 THEN o_orderdate - INTERVAL 1 DAY WHEN p BETWEEN 70000 AND 90000 THEN o_orderdate + INTERVAL 1 DAY WHEN s <> 1 THEN o_orderdate END AS c, CASE WHEN s <> 1 THEN o_orderdate END AS was FROM o)
SELECT o_custkey AS policy_id, o_orderkey AS grant_id, 'removed' AS violation FROM n WHERE NOT fresh AND NOT p < 450000
UNION ALL SELECT o_custkey, o_orderkey, 'content' FROM n WHERE NOT fresh AND p < 20000
UNION ALL SELECT o_custkey, o_orderkey, 'state' FROM n WHERE NOT fresh AND p < 450000 AND t < s
UNION ALL SELECT o_custkey, o_orderkey, 'time_without_change' FROM n WHERE NOT fresh AND p < 450000 AND t = s AND c IS DISTINCT FROM was
UNION ALL SELECT o_custkey, o_orderkey, 'time_goes_back' FROM n WHERE NOT fresh AND p < 450000 AND t <> s AND was IS NOT NULL AND NOT coalesce(c >= was, false)
UNION ALL SELECT o_custkey, o_orderkey, 'outside_window' FROM n WHERE fresh AND p < 450000 AND o_orderdate + INTERVAL 30 DAY > last
"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders are findings and priorities' records that moved some of them; customers are snapshots, events oracle runs."""
    o = read(spark, sf_dir, "orders")
    chain = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("chain").alias("record_type"), F.when(F.col("o_orderstatus") == "F", "oracle").when(F.col("o_orderstatus") == "O", "deterministic-core").alias("origin"), F.when(F.col("o_totalprice") > 100000, "ifds").otherwise("regex").alias("engine"), F.col("o_custkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_tax = 0").select("l_orderkey", "l_shipdate").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    id_ = F.concat_ws("-", F.lit("m"), F.col("l_orderkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    moved = li.select(id_.alias("record_id"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("parent_id"), F.lit("repartition").alias("record_type"), F.lit("oracle").alias("origin"), F.lit("ifds").alias("engine"), F.col("o_custkey").alias("snapshot_id"), F.col("l_shipdate").alias("created_at"))
    e = read(spark, sf_dir, "events").where("event_type IN ('view', 'error')")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("snapshot_id"), F.when(F.col("event_type") == "view", "closed-world").otherwise("open-world").alias("verdict"), F.when(F.col("value") > 20, F.array("props")).alias("sites"), F.col("ts").alias("completed_at"))
    return chain.unionByName(moved), policies.oracle_runs(runs)


def oracle_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that disagreeing oracles move, and the run that does; runs that agree but name sites are refused."""
    records, runs = _records(spark, sf_dir)
    flips = policies.flipped(records, runs).select("record_id", "run_id", F.lit("moved").alias("what"))
    return flips.unionByName(runs.where("refused").select(F.lit(None).cast("string").alias("record_id"), "run_id", F.lit("refused").alias("what")))


_MOVED = "m AS (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_tax = 0)"
ORACLE_MOVES = f"""
WITH {_MOVED}, f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS run_id FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT 'c' || o_orderkey AS record_id, run_id, 'moved' AS what FROM orders JOIN f ON user_id = o_custkey WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderkey NOT IN (SELECT l_orderkey FROM m)
UNION ALL SELECT NULL, event_id, 'refused' FROM events WHERE event_type = 'view' AND value > 20
"""


def auditor_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's origin as it is now, and the records that moved it."""
    rows = policies.auditor_records(_records(spark, sf_dir)[0]).where("record_type = 'chain'")
    return rows.select("record_id", "effective_origin", F.array_join("repartition_history", ",").alias("history"))


AUDITOR_HISTORY = f"""
WITH {_MOVED}, h AS (SELECT l_orderkey, string_agg('m-' || l_orderkey || '-' || strftime(l_shipdate, '%Y%m%d'), ',' ORDER BY l_shipdate) AS history FROM m GROUP BY 1)
SELECT 'c' || o_orderkey AS record_id, CASE WHEN history IS NULL AND o_orderstatus = 'O' THEN 'deterministic-core' ELSE 'oracle' END AS effective_origin, coalesce(history, '') AS history FROM orders LEFT JOIN h ON l_orderkey = o_orderkey
"""


def snapshot_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer and priority the latest order that could serve as its snapshot in environment F."""
    o = read(spark, sf_dir, "orders")
    key = [F.lit("org").alias("org_id"), F.col("o_custkey").alias("codebase_id"), F.sha1("o_orderpriority").alias("commit_sha")]
    snapshots = o.select(*key, F.col("o_orderstatus").alias("env_digest"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    requests = o.select(*key, F.when(F.col("o_totalprice") > 1000, "F").alias("env_digest"), "o_orderkey")
    return policies.resolved(requests, snapshots).select("o_orderkey", "snapshot_id")


SNAPSHOT_RESOLUTION = """
WITH s AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN snapshot_id END AS snapshot_id FROM orders LEFT JOIN s USING (o_custkey, o_orderpriority)
"""


def identity_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with identities by status, priority and price: which may keep a decision, and which identifiers are well formed."""
    o = read(spark, sf_dir, "orders")
    class_ = F.when(F.col("o_totalprice") > 100000, "strong").otherwise("weak")
    space = F.when(F.col("o_orderpriority") == "5-LOW", "graph/1").otherwise("graph/2")
    status = F.when(F.col("o_orderstatus") == "P", "timeout").otherwise("completed")
    graph = F.struct(status.alias("status"), class_.alias("class"), space.alias("namespace"))
    sliced = F.struct(F.lit("completed").alias("status"), F.when(F.col("o_custkey") > 100, "strong").alias("class"), F.lit("slice/2").alias("namespace"))
    id_ = F.when(F.col("o_orderstatus") == "F", F.sha1("o_orderpriority")).when(F.col("o_orderstatus") == "O", F.upper(F.sha1("o_orderpriority"))).otherwise(F.concat(F.lit("sha256:"), F.sha2("o_orderpriority", 256)))
    return o.select("o_orderkey", policies.strong(class_, space, "graph/2").alias("keeps"), policies.both_strong(graph, sliced, "graph/2", "slice/2").alias("both"), policies.is_sha(id_).alias("sha"), policies.is_environment(id_).alias("environment"))


IDENTITY_PREDICATES = """
SELECT o_orderkey, o_totalprice > 100000 AND o_orderpriority <> '5-LOW' AS keeps, o_totalprice > 100000 AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_custkey > 100 AS both, o_orderstatus = 'F' AS sha, o_orderstatus = 'P' AS environment FROM orders
"""


def witness_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a path through each order's items, of the tree that its priority names: with the kinds of the steps, and the former one of ids alone. Orders with an item of flag N among the steps have no edge there."""
    li = read(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("x"))
    rows = rows.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    steps = F.transform(F.slice("x", 2, 1 << 20), lambda x: F.when(x["l_returnflag"] == "N", F.array().cast("array<string>")).when(x["l_returnflag"] == "A", F.array(F.lit("CALL"), F.lit("CFG"))).otherwise(F.array(F.lit("CFG"))))
    witness = F.transform("x", lambda x: x["l_partkey"])
    return rows.select("o_orderkey", identity.witness_digest(F.sha2("o_orderpriority", 256), witness, steps).alias("weak"), identity.path_digest(witness, "path/1\n").alias("former"))


WITNESS_DIGESTS = """
WITH i AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS rn FROM lineitem),
p AS (
  SELECT l_orderkey, string_agg(lpad(to_hex(l_partkey), 16, '0'), '' ORDER BY rn) AS ids, coalesce(string_agg(CASE l_returnflag WHEN 'A' THEN '43414C4C00434647' ELSE '434647' END, '' ORDER BY rn) FILTER (rn > 1), '') AS kinds, coalesce(bool_or(l_returnflag = 'N') FILTER (rn > 1), false) AS broken
  FROM i GROUP BY 1)
SELECT o_orderkey, CASE WHEN NOT broken THEN sha256(unhex(sha256(o_orderpriority) || ids || kinds)) END AS weak, sha256(unhex(hex(encode('path/1' || chr(10))) || ids)) AS former FROM p JOIN orders ON l_orderkey = o_orderkey
"""

_ALL = (preflight_refusals, report_shapes, policy_denials, grant_evolution, oracle_moves, auditor_history, snapshot_resolution, identity_predicates, witness_digests)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

"""Proofs of calls, verdicts of cases, graphs and searches with more than one way, and small operators that other queries don't call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.tables import materialized, parts, read, union_all
from heddle.operators import findings, governance, identity, refactor, taint, textscan
from heddle.sources import reports


def call_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are expected calls, in the file of their brand; sizes say what is wrong with source, raw calls and mapped nodes."""
    line = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    p = materialized(read(spark, sf_dir, "part").withColumns({"line": line, "callee": F.lower(F.element_at(F.split("p_type", " "), -1))}))
    size = F.col("p_size")
    call = F.concat("callee", F.lit("(a)"))
    text = F.concat(F.lit("  r = "), call, F.when(size > 45, F.concat(F.lit("; "), "callee", F.lit(" (b)"))).otherwise(""))
    source = p.select(F.col("p_brand").alias("file"), "line", text.alias("line_text"))
    expected = p.select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("file"), F.when(size.between(5, 8), -1).otherwise(F.col("line")).cast("long").alias("line"), F.when(size < 5, 8).otherwise(7).alias("column"), "callee")
    name = F.when(size.between(9, 12), "<init>").when(size == 13, "other").otherwise(F.col("callee"))
    one = lambda df, prefix: df.select(F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("raw_id"), F.when(F.col("p_size") != 20, F.col("p_brand")).alias("file"), "line", F.lit(7).alias("column"), name.alias("name"), F.concat("callee", F.lit(" ( a )")).alias("code"), F.col("p_type").alias("full_name"))
    raw = one(p, "r").unionByName(one(p.where("p_size = 14"), "q"))
    node = lambda df, more: df.select((F.col("p_partkey") + more).alias("node_id"), F.col("p_brand").alias("file"), "line", F.lit(7).alias("column"), F.col("p_type").alias("resolved_fqn"))
    mapped = node(p.where("p_size <> 16"), 0).unionByName(node(p.where("p_size = 15"), 1_000_000_000))
    return refactor.observed_calls(expected, source, raw, mapped).select("case_id", "raw_id", "node_id", "problem")


CALL_PROOFS = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line, lower(split_part(p_type, ' ', -1)) AS callee FROM part),
raw AS (
  SELECT 'r' || p_partkey AS raw_id, CASE WHEN p_size <> 20 THEN p_brand END AS file, line, CASE WHEN p_size BETWEEN 9 AND 12 THEN '<init>' WHEN p_size = 13 THEN 'other' ELSE callee END AS name, callee || '(a)' AS code, p_type FROM p
  UNION ALL SELECT 'q' || p_partkey, p_brand, line, callee, callee || '(a)', p_type FROM p WHERE p_size = 14),
node AS (SELECT p_partkey AS node_id, p_brand, line, p_type FROM p WHERE p_size <> 16 UNION ALL SELECT p_partkey + 1000000000, p_brand, line, p_type FROM p WHERE p_size = 15),
f AS (
  SELECT p.p_partkey, count(DISTINCT raw_id) AS raws, count(*) AS pairs, min(raw_id) AS raw_id, min(node_id) AS node_id
  FROM p JOIN raw r ON r.line = p.line AND (r.name = p.callee OR r.name = '<init>' AND contains(r.code, p.callee)) AND contains('r=' || p.callee || '(a)' || CASE WHEN p_size > 45 THEN ';' || p.callee || '(b)' ELSE '' END, r.code) AND (r.file IS NULL OR r.file = p.p_brand)
  JOIN node n ON n.p_brand = p.p_brand AND n.line = r.line AND n.p_type = r.p_type GROUP BY 1),
v AS (
  SELECT p.p_partkey AS case_id, f.raw_id, f.node_id, CASE WHEN p_size BETWEEN 5 AND 8 THEN 'no-line' WHEN p_size > 45 THEN 'ambiguous-token' WHEN p_size < 5 THEN 'another-column' WHEN pairs IS NULL THEN 'no-call' WHEN pairs > raws THEN 'ambiguous-node' WHEN pairs > 1 THEN 'ambiguous-call' END AS problem
  FROM p LEFT JOIN f USING (p_partkey))
SELECT case_id, CASE WHEN problem IS NULL THEN raw_id END AS raw_id, CASE WHEN problem IS NULL THEN node_id END AS node_id, problem FROM v
"""


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are cases: of structure (status O), removal (F) and failed analysis (P); prices and priorities say what was observed."""
    o = read(spark, sf_dir, "orders")
    price, priority, kind = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    none = F.array().cast("array<string>")
    strong = lambda test: F.when(test, "strong").otherwise("weak")
    space = F.when(priority == "5-LOW", "slice/1").otherwise("slice/2")
    gone = kind == "F"

    def side(**kw: Column) -> Column:
        base = dict.fromkeys(("status", "class", "namespace", "hash", "finding", "rule", "scan", "scan_id", "error_stage"), F.lit(None).cast("string"))
        base |= {"covered_files": none, "covered_rules": none, "skipped_files": none, "failed_files": none, "error_visible": F.lit(None).cast("boolean"), "located": F.lit(True), "evidence": F.array(F.lit("e"))}
        return F.struct(*(v.alias(k) for k, v in (base | kw).items()))

    rule = F.lit("r")
    before = side(status=F.lit("completed"), finding=F.lit("present"), scan=F.lit("completed"), rule=rule, covered_files=F.array(priority), covered_rules=F.array(rule), hash=F.when(price >= 5000, kind), namespace=space, **{"class": strong(price > 50000)})
    after = side(
        status=F.when(gone | (kind == "O"), "completed").otherwise("failed"),
        finding=F.lit("absent"),
        scan=F.when(gone | (kind == "O"), "completed").otherwise("failed"),
        rule=rule,
        covered_files=F.when(price > 300000, F.array(F.lit("b"))).otherwise(F.array(priority, F.lit("b"))),
        covered_rules=F.array(rule),
        skipped_files=F.when(priority == "2-HIGH", F.array(F.lit("x"))).otherwise(none),
        error_stage=F.lit("parse"),
        error_visible=price <= 300000,
        hash=F.when(price > 200000, "x").otherwise(kind),
        namespace=space,
        evidence=F.when(price > 480000, none).otherwise(F.array(F.lit("e"))),
        **{"class": strong(F.col("o_custkey") > 100)},
    )
    life = F.struct(F.lit("f").alias("before_finding"), F.lit("s").alias("after_scan"), F.when(gone, "resolved").otherwise("open").alias("state"), F.when(gone, "fixed").otherwise("analysis_failed").alias("reason"), price.between(100000, 150000).alias("inherited"))
    cases = o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(gone, "finding_removal").when(kind == "O", "structural_comparison").otherwise("analysis_failure").alias("evidence_type"),
        F.when(priority == "1-URGENT", "flip").otherwise("stay").alias("expected"),
        (priority != "4-NOT SPECIFIED").alias("run_eligible"),
        F.lit(True).alias("baseline_run"),
        F.when(price < 400000, "established").otherwise("ambiguous").alias("correspondence"),
        F.create_map(F.lit("p"), F.when(priority == "3-MEDIUM", "unmet").otherwise("met")).alias("preconditions"),
        F.create_map(F.lit("p"), F.lit("met")).alias("demanded"),
        priority.alias("before_file"),
        F.array(F.lit("b"), priority).alias("after_files"),
        F.when(price >= 10000, life).alias("lifecycle"),
        before.alias("before"),
        after.alias("after"),
    )
    return refactor.case_verdicts(cases, ["slice/2"]).select("case_id", "passed", "reason", "outcome", "baseline_eligible")


CASE_VERDICTS = """
WITH c AS (
  SELECT *, o_orderstatus AS k, o_totalprice AS p, o_orderpriority AS q, o_totalprice > 50000 AND o_custkey > 100 AND o_orderpriority <> '5-LOW' AS fits, o_totalprice >= 10000 AND o_totalprice NOT BETWEEN 100000 AND 150000 AS life FROM orders),
v AS (
  SELECT *, CASE WHEN k = 'O' AND p >= 5000 AND fits THEN CASE WHEN p > 200000 THEN 'flip' ELSE 'stay' END END AS outcome FROM c),
r AS (
  SELECT *, CASE k WHEN 'O' THEN coalesce(outcome = CASE WHEN q = '1-URGENT' THEN 'flip' ELSE 'stay' END, false) AND p < 400000 WHEN 'F' THEN life AND p <= 300000 AND q <> '2-HIGH' ELSE life AND p <= 300000 END AS good FROM v),
s AS (
  SELECT *, CASE WHEN q = '4-NOT SPECIFIED' THEN 'run-environment-or-freshness-not-eligible' WHEN q = '3-MEDIUM' THEN 'required-preconditions-not-observed' WHEN good THEN 'pass'
    WHEN k = 'O' AND p < 5000 THEN 'missing-computed-fingerprint' WHEN k = 'O' AND NOT fits THEN 'weak-or-incompatible-identity' ELSE 'incomplete-or-contrary-typed-evidence' END AS reason FROM r)
SELECT o_orderkey AS case_id, reason = 'pass' AS passed, reason, outcome, NOT p > 480000 AS baseline_eligible FROM s
"""


def canonical_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as graphs in which every node looks alike, so that a search has to branch: one cycle, or two halves each a cycle where there are six orders or more and the balance is negative.

    Nodes are named by their orders, whose numbers are in no order along the cycle. Equal graphs get one digest, others another.
    """
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    size = F.count("*").over(W.partitionBy("c_custkey"))
    rn = F.row_number().over(W.partitionBy("c_custkey").orderBy("o_totalprice", "o_orderkey")) - 1
    o = o.withColumns({"n": size, "i": rn}).where("n >= 3")
    half = F.floor(F.col("n") / 2)
    split = (F.col("c_acctbal") < 0) & (F.col("n") >= 6)
    second = split & (F.col("i") >= half)
    begin, length = F.when(second, half).otherwise(0), F.when(~split, F.col("n")).when(second, F.col("n") - half).otherwise(half)
    o = o.withColumn("next", begin + (F.col("i") - begin + 1) % length)
    o = materialized(o.select(F.col("c_custkey").cast("string").alias("graph_id"), F.col("o_orderkey").alias("node_id"), "i", F.col("next").cast("int").alias("next")))
    nodes = o.select("graph_id", "node_id", F.lit("CALL").alias("kind"), *(F.lit("").alias(c) for c in ("operator_or_literal", "resolved_fqn", "enclosing_decl_fqn", "structural_path")))
    edges = o.join(o.select("graph_id", F.col("i").alias("next"), F.col("node_id").alias("dst")), ["graph_id", "next"]).select("graph_id", F.col("node_id").alias("src"), "dst", F.lit("CFG").alias("kind"))
    found = materialized(identity.canonical_graphs(nodes, edges).withColumn("c_custkey", F.col("graph_id").cast("long")))
    of = found.groupBy("graph_sha256").agg(F.min("c_custkey").alias("class"), F.count("*").alias("members"))
    return found.join(of, "graph_sha256").select("c_custkey", "class", "members", "fingerprint_class")


CANONICAL_CYCLES = """
WITH g AS (SELECT c_custkey, count(*) AS n, count(*) >= 6 AND any_value(c_acctbal) < 0 AS split FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 3)
SELECT c_custkey, min(c_custkey) OVER (PARTITION BY n, split) AS class, count(*) OVER (PARTITION BY n, split) AS members, 'strong' AS fingerprint_class FROM g
"""


def branching_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths where many lead to the sink: each of a customer's orders is a stage, whose items stand side by side between two joins. Items of tax 0 sanitize, so the path takes the least of the others; a stage of such items only ends it."""
    lines = read(spark, sf_dir, "lineitem")
    n = parts(spark, 5 * lines.count())  # a line item is a node, a place in the order, two edges and sometimes a stop
    o = read(spark, sf_dir, "orders").repartition(n, "o_custkey").withColumn("stage", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    o = materialized(o.select(F.col("o_custkey").cast("string").alias("graph_id"), "o_orderkey", (F.col("stage") * 1000).alias("join_id")))
    li = lines.repartition(n, "l_orderkey").withColumn("n", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")).cast("long"))
    items = materialized(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("graph_id", (F.col("join_id") - 1000 + F.col("n")).alias("node_id"), "join_id", (F.col("l_tax") == 0).alias("clean")))
    blank = {"resolved_fqn": F.lit(""), "enclosing_decl_fqn": F.lit("m"), "kind": F.lit("CALL")}
    joins = o.select("graph_id", F.col("join_id").alias("node_id"), F.lit("sink").alias("operator_or_literal")).withColumns(blank)
    starts = o.select("graph_id").distinct().select("graph_id", F.lit(0).cast("long").alias("node_id"), F.lit("source").alias("operator_or_literal")).withColumns(blank)
    steps = items.select("graph_id", "node_id", F.when(F.col("clean"), "clean").otherwise("item").alias("operator_or_literal")).withColumns(blank)
    methods = starts.withColumns({"node_id": F.lit(-1).cast("long"), "kind": F.lit("METHOD"), "resolved_fqn": F.lit("m"), "enclosing_decl_fqn": F.lit(""), "operator_or_literal": F.lit("")})
    edges = items.select("graph_id", (F.col("join_id") - 1000).alias("src"), F.col("node_id").alias("dst")).unionByName(items.select("graph_id", F.col("node_id").alias("src"), F.col("join_id").alias("dst"))).withColumn("kind", F.lit("CFG"))
    clauses = spark.createDataFrame([("w", 0, "source", "source"), ("w", 1, "sink", "sink"), ("w", 2, "sanitize", "clean")], "spec_id string, ordinal int, primitive string, pattern string")
    found = taint.witnesses(union_all([joins, starts, steps, methods]), edges, clauses, parts=n)
    return found.select(F.col("graph_id").cast("long").alias("o_custkey"), F.col("sink").alias("sink"), F.array_join(F.col("witness").cast("array<string>"), ",").alias("witness"))


BRANCHING_WITNESSES = """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stage FROM orders),
i AS (SELECT l_orderkey, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
s AS (SELECT o_custkey, stage, min(n) FILTER (l_tax <> 0) AS n FROM o LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (
  SELECT o_custkey, stage, stage * 1000 AS sink, '0,' || (stage * 1000 - 1000 + n) || ',' || (stage * 1000) AS witness FROM s WHERE stage = 1 AND n IS NOT NULL
  UNION ALL SELECT s.o_custkey, s.stage, s.stage * 1000, r.witness || ',' || (s.stage * 1000 - 1000 + s.n) || ',' || (s.stage * 1000) FROM r JOIN s ON s.o_custkey = r.o_custkey AND s.stage = r.stage + 1 AND s.n IS NOT NULL)
SELECT o_custkey, sink, witness FROM r
"""


# ---- small operators


def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of orders and items in the order that is taken when a search is given up."""
    li = read(spark, sf_dir, "lineitem")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    li = materialized(li.select(F.col("l_orderkey").cast("string").alias("graph_id"), n.alias("node_id"), "l_returnflag", "l_linestatus"))
    blank = {"resolved_fqn": F.lit(""), "enclosing_decl_fqn": F.lit("d"), "kind": F.lit("CALL")}
    nodes = li.select("graph_id", "node_id", F.col("l_returnflag").alias("operator_or_literal"), F.lit("").alias("structural_path")).withColumns(blank)
    edges = li.where("l_linestatus = 'F'").select("graph_id", F.col("node_id").alias("src"), F.lit(1).cast("long").alias("dst"), F.lit("CFG").alias("kind"))
    place = F.row_number().over(W.partitionBy("graph_id").orderBy("order_key")) - 1
    return identity.fallback_order_key(nodes, edges).select(F.col("graph_id").cast("long").alias("l_orderkey"), "node_id", place.cast("long").alias("place"))


FALLBACK_ORDER = """
WITH n AS (SELECT l_orderkey, l_returnflag AS f, l_linestatus = 'F' AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS node_id, count(*) FILTER (l_linestatus = 'F') OVER (PARTITION BY l_orderkey) AS hits FROM lineitem),
k AS (SELECT *, array_to_string(list_resize(['CFG'], 0) || list_transform(range(CASE WHEN hit THEN 1 ELSE 0 END + CASE WHEN node_id = 1 THEN hits ELSE 0 END), lambda x: 'CFG'), ',') AS kinds FROM n)
SELECT l_orderkey, node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY kinds, f, node_id) - 1 AS place FROM k
"""


def solution_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each customer's orders as findings, their parts as witnesses."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("witness"))
    o = read(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = o.select("o_custkey", F.floor(F.col("o_totalprice")).cast("long").alias("rank"), F.col("o_orderkey").alias("sink"), F.col("o_orderkey").alias("fact"), "witness")
    return identity.solution_hash(rows, ["o_custkey"])


SOLUTION_DIGESTS = """
WITH l AS (SELECT l_orderkey, string_agg(lpad(to_hex(l_partkey), 16, '0'), '' ORDER BY l_partkey) AS w FROM lineitem GROUP BY 1)
SELECT o_custkey, sha256(unhex(string_agg(lpad(to_hex(o_orderkey), 16, '0') || lpad(to_hex(o_orderkey), 16, '0') || w || '7C', '' ORDER BY CAST(floor(o_totalprice) AS BIGINT), o_orderkey))) AS solution_sha256 FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1
"""


def order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority and price come before those of the customer's order before."""
    return findings.out_of_order(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_totalprice"], ["o_custkey"], "o_orderkey").select("o_orderkey")


ORDER_FAULTS = """
SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority AS p, o_totalprice AS t, lag(o_orderpriority) OVER w AS q, lag(o_totalprice) OVER w AS u FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE q > p OR q = p AND u > t
"""


def detector_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as detectors: type words are languages, brands classes; small ones have no specification and serve every class."""
    d = read(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("languages"), F.col("p_brand").alias("class"), F.when(F.col("p_size") > 10, F.col("p_partkey")).alias("spec_id"))
    return findings.detectors_for(d, "SMALL", "Brand#11").select("p_partkey")


DETECTOR_CHOICE = "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'SMALL') AND (p_size <= 10 OR p_brand = 'Brand#11')"


def related_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts by return flag, in the order of items."""
    e = read(spark, sf_dir, "lineitem").select(F.lit("g").alias("graph_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"))
    return governance.related(e, ["A", "R"]).select(F.col("node").alias("l_orderkey"), "kind", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


RELATED_TARGETS = "SELECT l_orderkey, l_returnflag AS kind, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS targets FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2"


def same_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's finished and open orders have the same priorities."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias(s) for s in "FO"))
    return o.select("o_custkey", governance.same_set(F.col("F"), F.col("O")).alias("same"))


SAME_PRIORITIES = """
WITH s AS (SELECT o_custkey, list_sort(list_distinct(coalesce(list(o_orderpriority) FILTER (o_orderstatus = 'F'), []))) AS f, list_sort(list_distinct(coalesce(list(o_orderpriority) FILTER (o_orderstatus = 'O'), []))) AS o FROM orders GROUP BY 1)
SELECT o_custkey, f = o AS same FROM s
"""


def triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What triage may write of line items: the discount as a score."""
    li = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("id"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("label"), F.col("l_tax").alias("secret"))
    return governance.triage_columns(li, ["score", "label"], "id").withColumn("score", F.col("score").cast("string"))


TRIAGE_ROWS = "SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS id, CAST(CAST(l_discount AS DECIMAL(5, 4)) AS VARCHAR) AS score, l_returnflag AS label FROM lineitem"


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by events, with extensions in either case."""
    ends = [".py", ".JAVA", ".rb", ".php", ".js", ".ts", ".go", ".txt", "", ".tar.py"]
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("dir.x/"), "event_type", F.get(F.array(*map(F.lit, ends)), (F.col("event_id") % 10).cast("int"))).alias("path"))
    return e.select("path", textscan.language_of(F.col("path")).alias("language")).groupBy("path", "language").agg(F.count("*").alias("n"))


FILE_LANGUAGES = """
WITH e AS (SELECT 'dir.x/' || event_type || ['.py', '.JAVA', '.rb', '.php', '.js', '.ts', '.go', '.txt', '', '.tar.py'][event_id % 10 + 1] AS path, ['python', 'java', 'ruby', 'php', 'js', 'ts', 'go', NULL, NULL, 'python'][event_id % 10 + 1] AS language FROM events)
SELECT path, language, count(*) AS n FROM e GROUP BY 1, 2
"""


def region_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions made of line items: lines by number, columns by quantity, some ends missing."""
    li = read(spark, sf_dir, "lineitem")
    end, column, end_column = (F.when(t, F.col(c).cast("int")) for c, t in (("l_linenumber", F.col("l_tax") > 0.02), ("l_quantity", F.col("l_discount") > 0.01), ("l_quantity", F.col("l_discount") > 0.05)))
    ok = reports.region_valid(F.col("l_linenumber") - 1, column - 1, end - F.when(F.col("l_returnflag") == "R", 2).otherwise(0), end_column - 2)
    return li.select("l_returnflag", ok.alias("valid")).groupBy("l_returnflag", "valid").agg(F.count("*").alias("n"))


REGION_CHECKS = """
WITH r AS (
  SELECT l_returnflag, l_linenumber - 1 AS l1, CASE WHEN l_discount > 0.01 THEN CAST(l_quantity AS INTEGER) - 1 END AS c, CASE WHEN l_tax > 0.02 THEN l_linenumber - CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END END AS e, CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS INTEGER) - 2 END AS d FROM lineitem),
s AS (SELECT l_returnflag, l1, coalesce(e, l1) AS l2, coalesce(c, 1) AS c1, coalesce(d, coalesce(c, 1)) AS c2 FROM r)
SELECT l_returnflag, l1 >= 1 AND c1 >= 1 AND c2 >= 1 AND (l2 > l1 OR l2 = l1 AND c2 >= c1) AS valid, count(*) AS n FROM s GROUP BY 1, 2
"""


def campaign_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer segment's cells would pass as a baseline, for acceptance and as no regression; balances tell what is contrary."""
    c = read(spark, sf_dir, "customer")
    b = F.col("c_acctbal")
    cells = materialized(c.select("c_mktsegment", (b > 0).alias("as_expected"), (b < -990).cast("int").alias("contrary"), F.lit(0).alias("unevaluated"), (b > 9990).cast("int").alias("regressions")))
    segments = sorted(r[0] for r in cells.select("c_mktsegment").distinct().limit(100).collect())
    out = [refactor.accepted(cells.where(F.col("c_mktsegment") == s), m).select(F.lit(s).alias("c_mktsegment"), F.lit(m).alias("mode"), "passed") for s in segments for m in ("baseline", "acceptance", "nonregression")]
    return union_all(out)


CAMPAIGN_ACCEPTANCE = """
SELECT c_mktsegment, 'baseline' AS mode, true AS passed FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 'acceptance', NOT bool_or(c_acctbal < -990) FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 'nonregression', NOT bool_or(c_acctbal > 9990) FROM customer GROUP BY 1
"""


_ALL = (call_proofs, case_verdicts, canonical_cycles, branching_witnesses, fallback_order, solution_digests, order_faults, detector_choice, related_targets, same_priorities, triage_rows, file_languages, region_checks, campaign_acceptance)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

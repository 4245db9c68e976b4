"""Findings, continuity and statistics over the driver's tables.

Events stand for detector runs and adjudications, documents for occurrences (even ids: the scan before,
odd ids: the scan after), line items for located nodes, orders for provenance chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import framing
from heddle.functions.tables import parts, read
from heddle.operators import attest, continuity, findings, stats

ENGINES = {"signup": "ifds", "purchase": "ide", "click": "semgrep", "view": "codeql", "error": "mixed"}
LEVELS = {"signup": "INFO", "purchase": "WARNING", "click": "INFO", "view": "WARNING", "error": "ERROR"}


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def origin_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("engine", findings.looked_up(F.col("event_type"), ENGINES, "event type"))
    origin = findings.origin(F.col("engine"), F.col("engine") == "mixed", F.col("value") > 50)
    rows = e.select(origin.alias("origin"), findings.claim(origin).alias("claim"), findings.partition_of(F.col("engine")).alias("partition_name"), "engine")
    return rows.groupBy("engine", "origin", "claim", "partition_name").agg(F.count("*").alias("n"))


ORIGIN_STAMP = f"""
WITH e AS (SELECT {_case("event_type", ENGINES)} AS engine, value FROM events),
o AS (SELECT engine, CASE WHEN engine = 'mixed' THEN CASE WHEN value > 50 THEN 'deterministic-core' ELSE 'oracle' END WHEN engine IN ('ifds', 'ide') THEN 'deterministic-core' ELSE 'oracle' END AS origin FROM e)
SELECT engine, origin, CASE origin WHEN 'deterministic-core' THEN 'CONDITIONAL_THEOREM' ELSE 'EMPIRICAL' END AS claim,
  CASE WHEN engine IN ('ifds', 'ide') THEN 'core' ELSE 'oracle' END AS partition_name, count(*) AS n FROM o GROUP BY 1, 2, 3, 4
"""


def severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("severity", findings.severity(findings.looked_up(F.col("event_type"), LEVELS, "event type")))
    return e.select("event_id", "severity", findings.sarif_level(F.col("severity")).alias("level"))


SEVERITY_MAP = f"""
WITH s AS (SELECT event_id, CASE {_case("event_type", LEVELS)} WHEN 'ERROR' THEN 'critical' WHEN 'WARNING' THEN 'medium' ELSE 'low' END AS severity FROM events)
SELECT event_id, severity, CASE severity WHEN 'critical' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM s
"""


def sink_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders point at line items: those with flag N are calls, the part's number mod 10 is the column."""
    nodes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit(1).alias("line"), (F.col("l_partkey") % 10).alias("column"), F.when(F.col("l_returnflag") == "N", "CALL").otherwise("IDENTIFIER").alias("kind"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("node_id"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("line"))
    return findings.located(orders, nodes).select(F.col("file").alias("o_orderkey"), "node_id")


SINK_LOCATE = """
WITH n AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'N', l_partkey % 10 = 0, l_partkey % 10, l_linenumber * 1000000 + l_partkey) AS rn FROM lineitem)
SELECT o_orderkey, CAST(node_id AS BIGINT) AS node_id FROM orders LEFT JOIN n ON l_orderkey = o_orderkey AND rn = 1
"""


def dup_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.duplicate_ordinals(read(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "duplicate_ordinal")


DUP_ORDINAL = "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS duplicate_ordinal FROM documents"


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each supplier by rule (part), line and the rest of the key."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return findings.ordered(li, ["l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], ["l_suppkey"])


CANONICAL_ORDER = "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS position FROM lineitem"


def finding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings: those without enough quality of data to be emitted."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 300, F.col("source")).alias("uri"), "lang", (F.col("n_chars") - 200).alias("line"))
    return findings.violations(d, ["uri"], {"lang": ["en", "fr", "de"]}).select("doc_id", F.array_join("broken", ";").alias("broken"))


FINDING_VIOLATIONS = """
SELECT * FROM (SELECT doc_id, concat_ws(';', CASE WHEN NOT n_chars > 300 OR source IS NULL OR source = '' THEN 'missing uri' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unknown lang' END, CASE WHEN n_chars < 201 THEN 'line below 1' END) AS broken FROM documents) WHERE broken <> ''
"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    chain = o.select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "O", "semgrep").otherwise("ifds").alias("engine"), F.when(F.col("o_orderstatus") == "O", findings.ORACLE).otherwise(findings.CORE).alias("origin"))
    return chain, read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("parent_record_id"))


def effective_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.effective_origin(*_chain(spark, sf_dir)).select("record_id", "effective_origin")


EFFECTIVE_ORIGIN = """
SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'O' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'oracle' ELSE 'deterministic-core' END AS effective_origin FROM orders
"""


def repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.repartitioned(*_chain(spark, sf_dir)).select("record_id")


REPARTITION = "SELECT o_orderkey AS record_id FROM orders WHERE o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


def continuity_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids before, odd ids after; the slice is the text, the profile the language; ids divisible by 8 have no entity."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("occurrence_id"), F.col("lang").alias("profile"), F.sha2("text", 256).alias("slice_digest"), F.col("doc_id").cast("string").alias("sink"), F.lit(True).alias("eligible"))
    before, after = d.where("occurrence_id % 2 = 0"), d.where("occurrence_id % 2 = 1")
    entities = before.where("occurrence_id % 8 <> 0").select("occurrence_id", F.concat(F.lit("e"), F.col("occurrence_id").cast("string")).alias("entity_id"))
    return continuity.plan(before, after, entities)


CONTINUITY_PLAN = """
WITH b AS (SELECT lang, text, count(*) AS n, min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2),
a AS (SELECT lang, text, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1, 2),
r AS (SELECT d.doc_id AS occurrence_id, CASE WHEN b.n > 1 OR a.n > 1 THEN 'ambiguous_equal_slice' WHEN b.n IS NULL THEN 'no_equal_eligible_predecessor' WHEN b.id % 8 = 0 THEN 'predecessor_entity_unavailable' ELSE 'unique_eligible_identity' END AS reason, b.id
  FROM documents d JOIN a USING (lang, text) LEFT JOIN b USING (lang, text) WHERE d.doc_id % 2 = 1)
SELECT occurrence_id, CASE reason WHEN 'unique_eligible_identity' THEN 'linked' WHEN 'no_equal_eligible_predecessor' THEN 'new_identity' ELSE 'blocked' END AS disposition, reason,
  CASE WHEN reason = 'unique_eligible_identity' THEN id END AS predecessor_id, CASE WHEN reason = 'unique_eligible_identity' THEN 'e' || id END AS entity_id FROM r
"""


def effective_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' own verdicts from quality labels, inherited ones from their source's least labelled document."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("occurrence_id"), "n_chars")
    lab = read(spark, sf_dir, "labels")
    direct = lab.where("quality = 0").select(F.col("doc_id").alias("occurrence_id"), F.lit("dismissed").alias("verdict"))
    linked = lab.join(d.withColumnRenamed("occurrence_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("occurrence_id"), F.when(F.col("toxic") == 1, "confirmed").otherwise("unclear").alias("verdict"), F.when(F.col("n_chars") % 3 == 0, "resolved").otherwise("open").alias("lifecycle"), (F.col("n_chars") % 2).alias("generation"), F.lit(0).cast("long").alias("authorized_generation"))
    return continuity.effective_decisions(d, direct, linked)


EFFECTIVE_DECISION = """
SELECT d.doc_id AS occurrence_id,
  CASE WHEN l.quality = 0 THEN 'dismissed' WHEN l.doc_id IS NOT NULL AND n_chars % 3 <> 0 AND n_chars % 2 = 0 THEN CASE toxic WHEN 1 THEN 'confirmed' ELSE 'unclear' END ELSE 'unreviewed' END AS verdict,
  CASE WHEN l.quality = 0 THEN 'occurrence' WHEN l.doc_id IS NOT NULL AND n_chars % 3 <> 0 AND n_chars % 2 = 0 THEN 'entity' ELSE 'default' END AS source
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def entity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are an entity's versions: revision by place in date order, one skipped after each urgent order."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").withColumns({"rn": F.row_number().over(w), "urgent": F.sum((F.col("o_orderpriority") == "1-URGENT").cast("int")).over(w)})
    life = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "reappeared").otherwise("open")
    versions = o.select(F.col("o_custkey").alias("entity_id"), (F.col("rn") + F.col("urgent")).cast("long").alias("revision"), F.lit(0).alias("generation"), life.alias("lifecycle"))
    return continuity.transition_violations(versions).select("entity_id", "revision")


ENTITY_TRANSITIONS = """
WITH o AS (SELECT *, row_number() OVER w + sum(CAST(o_orderpriority = '1-URGENT' AS INT)) OVER w AS revision FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
v AS (SELECT *, lag(revision) OVER w AS r0, lag(o_orderstatus) OVER w AS s0 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY revision))
SELECT o_custkey AS entity_id, CAST(revision AS BIGINT) AS revision FROM v WHERE r0 IS NOT NULL AND (revision <> r0 + 1 OR (o_orderstatus = 'P' AND s0 = 'F'))
"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").cast("double").alias("outcome"))


def eprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.e_process(_outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return p.select("event_id", "n", F.round("log_wealth", 6).alias("log_wealth"))


_STEPS = """
WITH x AS (SELECT user_id, ts, event_id, CAST(event_type <> 'error' AS DOUBLE) AS x FROM events),
m AS (SELECT *, coalesce(avg(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mu,
  coalesce(avg(1 - x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nu FROM x),
s AS (SELECT *, ln(1 + greatest(0, least(0.5::DOUBLE / 0.7::DOUBLE, 2 * (mu - 0.7::DOUBLE))) * (x - 0.7::DOUBLE)) AS a,
  ln(1 + greatest(0, least(0.5::DOUBLE / (1 - 0.7::DOUBLE), 2 * (nu - (1 - 0.7::DOUBLE)))) * (1 - x - (1 - 0.7::DOUBLE))) AS b FROM m),
w AS (SELECT user_id, event_id, count(*) OVER p AS n, sum(a) OVER p AS lw, sum(b) OVER p AS ld FROM s WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
"""
EPROCESS = _STEPS + "SELECT event_id, n, round(lw, 6) AS log_wealth FROM w"


def eprocess_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.e_process(_outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"], drift=True)
    return stats.revalidation(p, ["user_id"]).select("user_id", "decision", F.round("log_wealth", 6).alias("log_wealth"), F.round("log_wealth_drift", 6).alias("log_wealth_drift"))


EPROCESS_DRIFT = _STEPS + "SELECT user_id, CASE WHEN ld >= ln(20) THEN 'quarantined' WHEN lw >= ln(20) THEN 'revalidated' ELSE 'pending' END AS decision, round(lw, 6) AS log_wealth, round(ld, 6) AS log_wealth_drift FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM w) WHERE k = 1"


def eprocess_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.e_process(_outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return stats.accepted(p, ["user_id"]).select("user_id", "n", F.round("max_log_wealth", 6).alias("max_log_wealth"), "first_look", "accepted")


EPROCESS_ACCEPT = _STEPS + "SELECT user_id, max(n) AS n, round(max(lw), 6) AS max_log_wealth, min(n) FILTER (lw >= ln(20)) AS first_look, count(*) FILTER (lw >= ln(20)) > 0 AS accepted FROM w GROUP BY 1"


def combined_e_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.e_process(_outcomes(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    last = p.groupBy("user_id").agg(F.max_by("log_wealth", "n").alias("log_wealth"))
    return stats.combined_e_value(last.withColumn("org", F.col("user_id") % 7), ["org"]).select("org", F.round("e_value", 6).alias("e_value"))


COMBINED_E_VALUE = _STEPS + "SELECT user_id % 7 AS org, round(avg(exp(lw)), 6) AS e_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM w) WHERE k = 1 GROUP BY 1"


def fidelity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as corpus files of their language; predictions by length."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    c = F.col
    long_ = c("n_chars") > 400
    items = d.select("lang", (c("n_chars") > 60).alias("parsed"), ((c("quality") == 1) & long_).cast("long").alias("call_tp"), ((c("quality") == 0) & long_).cast("long").alias("call_fp"), ((c("quality") == 1) & ~long_).cast("long").alias("call_fn"), ((c("toxic") == 0) & long_).cast("long").alias("pdg_tp"), ((c("toxic") == 0) & ~long_).cast("long").alias("pdg_fn"))
    out = stats.gate(stats.fidelity(items, ["lang"]), F.col("lang") != "es")
    return out.select("lang", *(F.col(m).cast("double").alias(m) for m in stats.GATE), F.array_join("failing", ",").alias("failing"), "overall")


FIDELITY_GATE = """
WITH s AS (SELECT lang, count(*) AS f, count(*) FILTER (n_chars > 60) AS p, count(*) FILTER (quality = 1 AND n_chars > 400) AS tp, count(*) FILTER (quality = 0 AND n_chars > 400) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 400) AS fn,
  count(*) FILTER (toxic = 0 AND n_chars > 400) AS dtp, count(*) FILTER (toxic = 0 AND n_chars <= 400) AS dfn FROM documents JOIN labels USING (doc_id) GROUP BY 1),
r AS (SELECT lang, round_even(p::DECIMAL(18,0) / f, 6) AS a, CASE WHEN tp + fp = 0 THEN 1 ELSE round_even(tp::DOUBLE / (tp + fp), 6) END AS b, CASE WHEN tp + fn = 0 THEN 1 ELSE round_even(tp::DOUBLE / (tp + fn), 6) END AS c, CASE WHEN dtp + dfn = 0 THEN 1 ELSE round_even(dtp::DOUBLE / (dtp + dfn), 6) END AS d FROM s),
t AS (SELECT *, concat_ws(',', CASE WHEN a < 0.995 THEN 'parse_success_rate' END, CASE WHEN b < 0.90 THEN 'call_edge_precision' END, CASE WHEN c < 0.85 THEN 'call_edge_recall' END, CASE WHEN d < 0.80 THEN 'pdg_recall' END) AS failing FROM r)
SELECT lang, CAST(a AS DOUBLE) AS parse_success_rate, CAST(b AS DOUBLE) AS call_edge_precision, CAST(c AS DOUBLE) AS call_edge_recall, CAST(d AS DOUBLE) AS pdg_recall, failing,
  CASE WHEN lang = 'es' THEN 'ungated' WHEN failing <> '' THEN 'GATE-FAIL' ELSE 'GATE-PASS' END AS overall FROM t
"""


def reproduction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return stats.reproduction_rate(li.where("l_quantity > 10").drop("l_quantity"), li.where("l_quantity % 7 <> 0").drop("l_quantity")).select(F.col("rate").cast("double").alias("rate"))


REPRODUCTION_RATE = """
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity % 7 <> 0)
SELECT round_even((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::DOUBLE / (SELECT count(*) FROM a), 4) AS rate
"""


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "unevaluated").when(F.col("toxic") == 1, "flipped").otherwise("stayed")
    return stats.cells(d.withColumn("outcome", outcome), ["lang"], "outcome", ["stayed", "flipped", "unevaluated"])


REPORT_CELLS = "SELECT lang, count(*) AS total, count(*) FILTER (toxic = 0) AS stayed, count(*) FILTER (toxic = 1) AS flipped, count(*) FILTER (quality IS NULL) AS unevaluated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"


def report_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("passed"), F.col("quality"))
    return stats.regressions(lab.where("quality = 1").select("doc_id", "passed"), lab.select("doc_id", "passed"), ["doc_id"])


REPORT_REGRESSIONS = "SELECT doc_id FROM labels WHERE toxic = 0 AND quality <> 1"


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stages, customers' segments as languages' verdicts."""
    c = read(spark, sf_dir, "customer")
    verdict = F.when(F.col("c_mktsegment") == "BUILDING", "GATE-FAIL").when(F.col("c_acctbal") < -900, None).otherwise("GATE-PASS")
    rows = c.where("c_mktsegment <> 'BUILDING' OR c_nationkey % 3 = 0").select("c_nationkey", verdict.alias("verdict"), (F.col("c_acctbal") > -990).alias("attested"))
    return stats.status_table(rows, ["c_nationkey"])


STAGE_STATUS = """
WITH r AS (SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'GATE-FAIL' WHEN c_acctbal < -900 THEN NULL ELSE 'GATE-PASS' END AS v, c_acctbal > -990 AS a FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey % 3 = 0)
SELECT c_nationkey, CASE WHEN bool_or(v IS NULL) THEN 'ungated' WHEN bool_or(v <> 'GATE-PASS') THEN 'front-end-blocked' WHEN bool_and(a) THEN 'ready' ELSE 'not-attested' END AS status FROM r GROUP BY 1
"""

def attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items once and again as the core's runs, the second without those of quantity 50; two filters as the oracle's."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    run = lambda c: li.where(c).select("l_orderkey", "l_partkey")
    out = attest.attested((run("true"), run("l_quantity <> 50")), (run("l_quantity < 30"), run("l_quantity % 2 = 0")), parts(spark, 2 * li.count()))
    return out.select("identical", "only_first", "only_second", F.col("oracle_rate").cast("double").alias("oracle_rate"))


ATTESTATION = """
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 30), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity % 2 = 0)
SELECT count(*) FILTER (l_quantity = 50) = 0 AS identical, count(*) FILTER (l_quantity = 50) AS only_first, 0::BIGINT AS only_second,
  round_even((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::DOUBLE / (SELECT count(*) FROM a), 4) AS oracle_rate FROM lineitem
"""


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first 101 bytes, without a character that is cut."""
    d = read(spark, sf_dir, "documents").select("doc_id", framing.truncated(F.col("text"), 101).alias("short"))
    return d.select("doc_id", F.sha2("short", 256).alias("short_sha256"), F.octet_length("short").cast("long").alias("n_bytes"))


SHORT_TEXTS = """
WITH c AS (SELECT doc_id, text, max(k) AS k FROM documents, range(102) r(k) WHERE strlen(left(text, k)) <= 101 AND k <= length(text) GROUP BY 1, 2)
SELECT doc_id, sha256(left(text, k)) AS short_sha256, strlen(left(text, k)) AS n_bytes FROM c
"""

_ALL = (attestation, short_texts, origin_stamp, severity_map, sink_locate, dup_ordinal, canonical_order, finding_violations, effective_origin, repartition, continuity_plan, effective_decision, entity_transitions, eprocess, eprocess_drift, eprocess_accept, combined_e_value, fidelity_gate, reproduction_rate, report_cells, report_regressions, stage_status)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

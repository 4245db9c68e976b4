"""Procedure summaries over the events' graph, from nothing and from a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.tables import own_folder, together
from heddle.operators import summaries
from heddle.plans.graph_queries import event_graph

VERSION, ENVIRONMENT = "1.4.0", "0" * 64


def _changed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the errors of users whose number ends in 3 have become purchases that call nobody, and their signups views: the sources that were those are gone."""
    hit = (F.col("kind") == "CALL") & (F.expr("try_cast(enclosing_decl_fqn as bigint)") % 10 == 3)
    name = F.col("operator_or_literal")
    after = nodes.withColumn("operator_or_literal", F.when(hit & (name == "error"), "purchase").when(hit & (name == "signup"), "view").otherwise(name))
    affected = nodes.where("kind = 'METHOD' and cast(resolved_fqn as bigint) % 10 = 3").select("graph_id", F.col("node_id").alias("proc"))
    return after, affected


def _numbered(findings: DataFrame, *more: Column) -> DataFrame:
    return findings.select("sink", F.split("fact", ":")[0].cast("long").alias("source"), *more)


def summary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at sinks with summaries spliced, and whether each gets there only by a summary."""
    p = summaries.program(*event_graph(spark, sf_dir))
    s = summaries.tabulate(summaries.graph(p, plain=True), p.seeds)
    return _numbered(summaries.only_by_summaries(p, s), F.col("by_summary"))


def procedure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact at the entry of a procedure with the number, the least and the largest of the facts of its body, which are counted before they meet the entry's."""
    p = summaries.program(*event_graph(spark, sf_dir))
    s = summaries.tabulate(summaries.graph(p), p.seeds)
    fact = lambda c: F.split(c, ":")[0].cast("long")
    entries, bodies = summaries.summary_totals(p, s)
    totals = s.facts.join(bodies.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.count("*").alias("n_facts"), F.min(fact("fact")).alias("least"), F.max(fact("fact")).alias("largest"))
    rows = entries.join(bodies.join(totals, "rep"), [*summaries.GRAPH, "proc"])
    return rows.select((-F.col("proc") - 1).alias("user_id"), fact("entry_fact").alias("entry_source"), "n_facts", "least", "largest")


def resumed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after a change, from the cache that a run before the change wrote: the rows of a full run. The graph after the change is made while that run goes on; it doesn't need the cache."""
    nodes, edges, clauses = event_graph(spark, sf_dir)
    folder = own_folder(spark, "summaries")
    after, affected = _changed(nodes)

    def run_before() -> None:
        p = summaries.program(nodes, edges, clauses)
        summaries.write_cache(summaries.tabulate(summaries.graph(p), p.seeds), folder, VERSION, ENVIRONMENT)

    def graph_after() -> tuple[summaries.Program, summaries.Graph]:
        p = summaries.program(after, edges, clauses)
        return p, summaries.graph(p)

    _, (p, g) = together(spark, run_before, graph_after)
    cached = summaries.read_solution(spark, folder, VERSION, ENVIRONMENT)
    kept, again = summaries.resumed(p, cached, affected, g)
    return _numbered(summaries.findings(p, kept).unionByName(summaries.findings(p, again)))


def _sql(kind: str) -> str:
    """The full solution as SQL: first the nodes that any fact holds at (a fact that returns is at a node that is reached anyway), then all facts, with moves from each body to the return sites of calls that are left."""
    return f"""
WITH RECURSIVE named AS (SELECT event_id, user_id, ts, event_type AS was, {kind} AS event_type FROM events),
e AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM named),
calls AS (SELECT event_id, user_id // 2 AS callee, after FROM e WHERE was = 'purchase' AND user_id // 2 IN (SELECT user_id FROM events)),
moves AS MATERIALIZED (
  SELECT event_id AS src, after AS dst FROM e WHERE after IS NOT NULL AND event_type NOT IN ('error', 'view', 'click')
  UNION ALL SELECT -user_id - 1, event_id FROM e WHERE rn = 1
  UNION ALL SELECT event_id, -callee - 1 FROM calls JOIN e USING (event_id) WHERE event_type NOT IN ('error', 'view', 'click')),
seed AS (SELECT event_id FROM e WHERE event_type = 'signup'),
live AS (SELECT event_id AS node FROM seed UNION SELECT m.dst FROM live r JOIN moves m ON m.src = r.node),
body AS (SELECT event_id AS node, user_id FROM events UNION SELECT -user_id - 1, user_id FROM events),
back AS MATERIALIZED (
  SELECT DISTINCT b.node AS src, c.after AS dst FROM calls c JOIN live l ON l.node = c.event_id JOIN e USING (event_id) JOIN body b ON b.user_id = c.callee
  WHERE c.after IS NOT NULL AND e.event_type NOT IN ('error', 'view', 'click')),
every AS MATERIALIZED (SELECT src, dst FROM moves UNION SELECT src, dst FROM back),
plain AS (SELECT event_id AS source, event_id AS node FROM seed UNION SELECT r.source, m.dst FROM plain r JOIN moves m ON m.src = r.node),
r AS (SELECT event_id AS source, event_id AS node FROM seed UNION SELECT r.source, m.dst FROM r JOIN every m ON m.src = r.node)
"""


SUMMARY_FINDINGS = _sql("event_type") + """
SELECT node AS sink, source, NOT EXISTS (SELECT 1 FROM plain p WHERE p.source = r.source AND p.node = r.node) AS by_summary
FROM r JOIN e ON e.event_id = r.node AND e.event_type IN ('purchase', 'error')"""
PROCEDURE_SUMMARIES = _sql("event_type") + """
, facts AS (SELECT DISTINCT user_id, source FROM r JOIN body USING (node)),
totals AS (SELECT user_id, count(*) AS n_facts, min(source) AS least, max(source) AS largest FROM facts GROUP BY user_id)
SELECT t.user_id, r.source AS entry_source, n_facts, least, largest FROM r JOIN totals t ON r.node = -t.user_id - 1"""
RESUMED_FINDINGS = _sql("CASE WHEN user_id % 10 = 3 AND event_type = 'error' THEN 'purchase' WHEN user_id % 10 = 3 AND event_type = 'signup' THEN 'view' ELSE event_type END") + """
SELECT node AS sink, source FROM r JOIN e ON e.event_id = r.node AND e.event_type IN ('purchase', 'error')"""

_ALL = (summary_findings, procedure_summaries, resumed_findings)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

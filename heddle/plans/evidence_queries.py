"""Reaching definitions, byte differences, stored objects and leases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.tables import materialized, read
from heddle.operators import attest, definitions, leases
from heddle.sources import objects


def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are procedures: signups and clicks define the variable that their properties name, purchases and errors use it, views do both. Lines are days."""
    e = read(spark, sf_dir, "events")
    e = e.withColumn("var", F.get_json_object("props", "$.k"))
    kinds = F.when(F.col("event_type").isin("signup", "click"), F.array(F.lit(True))).when(F.col("event_type") == "view", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    refs = e.select("user_id", "var", F.col("event_id").alias("place"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("line"), F.explode(kinds).alias("is_def"))
    return definitions.data_dependences(refs, ["user_id"], block=512).select("user_id", F.col("from_line").cast("long").alias("from_line"), F.col("to_line").cast("long").alias("to_line"), "var").distinct()


REACHING_DEFINITIONS = """
WITH r AS (
  SELECT user_id, json_extract_string(props, '$.k') AS var, event_id, event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS line FROM events),
d AS (
  SELECT *, last_value(CASE WHEN event_type IN ('signup', 'click', 'view') THEN line END IGNORE NULLS) OVER (PARTITION BY user_id, var ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_line FROM r)
SELECT DISTINCT user_id, CAST(from_line AS BIGINT) AS from_line, CAST(line AS BIGINT) AS to_line, var FROM d WHERE event_type IN ('purchase', 'error', 'view') AND from_line <> line
"""


def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's bytes first differ from the next one's, by doc_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("a"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    out = attest.differences(pairs, "a", "b", 8)
    return out.select("doc_id", F.col("offset").cast("long").alias("offset"), F.col("first_length").cast("long").alias("first_length"), F.col("second_length").cast("long").alias("second_length"), "first_bytes", "second_bytes")


FIRST_DIFFERENCES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT x.doc_id, x.h AS a, y.h AS b, least(length(x.h), length(y.h)) // 2 AS n FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 WHERE x.h <> y.h),
o AS (SELECT *, coalesce(list_position(list_transform(range(n), lambda i: substr(a, 2 * i + 1, 2) <> substr(b, 2 * i + 1, 2)), true) - 1, n) AS spot FROM p)
SELECT doc_id, CAST(spot AS BIGINT) AS "offset", length(a) // 2 AS first_length, length(b) // 2 AS second_length, substr(a, 2 * spot + 1, 16) AS first_bytes, substr(b, 2 * spot + 1, 16) AS second_bytes FROM o
"""


def _repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects: documents are blobs, in a tree for each source, under a root tree for each language, to which a commit points."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    object_, stored = objects.stored("blob", F.col("payload"))
    blobs = materialized(docs.select("doc_id", "lang", "source", object_, stored))

    def tree(rows: DataFrame, by: list[str]) -> DataFrame:
        """rows: by..., mode, name, object."""
        entry = F.concat(F.concat_ws(" ", "mode", "name").cast("binary"), F.unhex(F.lit("00")), F.unhex("object"))
        order = F.concat(F.col("name"), F.when(F.col("mode") == "40000", "/").otherwise("\x00"))
        sorted_ = F.sort_array(F.collect_list(F.struct(order.alias("order"), F.hex(entry).alias("entry"))))
        lists = rows.groupBy(*by).agg(F.unhex(F.array_join(F.transform(sorted_, lambda x: x["entry"]), "")).alias("payload"))
        name, kept = objects.stored("tree", F.col("payload"))
        return materialized(lists.select(*by, name, kept))

    inner = tree(blobs.select("lang", "source", F.lit("100644").alias("mode"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "object"), ["lang", "source"])
    roots = tree(inner.select("lang", F.lit("40000").alias("mode"), F.col("source").alias("name"), "object"), ["lang"])
    payload = F.concat(F.lit("tree "), F.col("object"), F.lit("\nauthor a <a@b> 0 +0000\n\n"), F.col("lang")).cast("binary")
    name, kept = objects.stored("commit", F.col("payload"))
    commits = roots.select("lang", payload.alias("payload")).select("lang", name, kept)
    every = [t.select("object", "stored") for t in (blobs, inner, roots, commits)]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).dropDuplicates(["object"])


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of all commits, read back from the stored objects."""
    rows = materialized(objects.read(_repository(spark, sf_dir)))
    return objects.files(rows).select("path", "object", "size", "content_sha256")


REPOSITORY_FILES = """
SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS object, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS content_sha256 FROM documents
"""


def repository_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds when objects of long documents are cut short, those of French ones stand under another id, and those of Spanish ones are gone."""
    docs = read(spark, sf_dir, "documents").select("lang", "n_chars", F.sha1(objects.whole("blob", F.coalesce("text", F.lit("")).cast("binary"))).alias("object"))
    # equal texts are one object: what holds for one of its documents holds for it
    facts = docs.groupBy("object").agg(F.bool_or(F.col("lang") == "es").alias("gone"), F.bool_or(F.col("lang") == "fr").alias("moved"), F.max("n_chars").alias("n_chars"))
    o = _repository(spark, sf_dir).join(facts, "object", "left")
    long = F.coalesce(F.col("n_chars") > 5000, F.lit(False))
    moved = F.coalesce(F.col("moved"), F.lit(False)) & ~long
    o = o.where("gone IS NULL OR NOT gone")
    o = o.select(F.when(moved, F.sha1("object")).otherwise(F.col("object")).alias("object"), F.when(long, F.expr("substring(stored, 1, length(stored) - 5)")).otherwise(F.col("stored")).alias("stored"))
    rows = materialized(objects.read(o))
    return objects.problems(rows).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("object").alias("objects"))


REPOSITORY_PROBLEMS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source, n_chars, sha256(coalesce(text, '')) AS object FROM documents),
o AS (SELECT object, bool_or(lang = 'es') AS gone, bool_or(lang = 'fr') AS moved, max(n_chars) > 5000 AS long FROM d GROUP BY object),
j AS (SELECT d.*, gone, moved, long FROM d JOIN o USING (object))
SELECT 'trailing or missing bytes' AS problem, count(*) AS n, count(*) AS objects FROM o WHERE NOT gone AND long HAVING count(*) > 0
UNION ALL SELECT 'id', count(*), count(*) FROM o WHERE NOT gone AND moved AND NOT long HAVING count(*) > 0
UNION ALL SELECT 'absent child', count(*), count(DISTINCT lang || source) FROM j WHERE gone OR long OR moved HAVING count(*) > 0
"""

HOUR = 3_600_000_000
POLICY = leases.Policy(lease=8 * HOUR, attempts=4, initial=HOUR, most=3 * HOUR)


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as those of a work item for each of its variables: views claim, signups renew, clicks complete, the others fail, each with the number of views so far as its token."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "signup", "renew").when(F.col("event_type") == "click", "complete").otherwise("fail")
    item = F.concat_ws("/", "user_id", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string"))
    token = F.sum((F.col("event_type") == "view").cast("long")).over(W.partitionBy("item").orderBy("ts", "event_id"))
    return e.withColumn("item", item).select("item", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), token.alias("token"))


def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each event, and the leases that expired."""
    return leases.folded(lease_events(spark, sf_dir), POLICY).select("item", "at", "seq", "outcome", "token", "state")


_DELAY = f"least({POLICY.most}, {POLICY.initial} * (1 << (token - 1)))"
LEASE_OUTCOMES = f"""
WITH RECURSIVE k AS (SELECT *, user_id || '/' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 10) AS item FROM events),
e AS (
  SELECT item, epoch_us(ts) AS at_, event_id AS seq, CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'renew' WHEN 'click' THEN 'complete' ELSE 'fail' END AS kind,
    sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS given, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY item ORDER BY ts, event_id)),
r AS (
  SELECT item, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS at_, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, 'pending' AS state, CAST(0 AS BIGINT) AS token, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS due,
    CAST(NULL AS BIGINT) AS expired_at, CAST(NULL AS VARCHAR) AS expired_state FROM (SELECT DISTINCT item FROM e)
  UNION ALL
  SELECT item, rn, at_, seq, outcome,
    CASE outcome WHEN 'granted' THEN 'running' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN CASE WHEN token < {POLICY.attempts} THEN 'pending' ELSE 'failed' END ELSE state END,
    CASE WHEN outcome = 'granted' THEN token + 1 ELSE token END, CASE WHEN outcome IN ('granted', 'renewed') THEN at_ + {POLICY.lease} ELSE until END,
    CASE WHEN outcome = 'failed' AND token < {POLICY.attempts} THEN at_ + {_DELAY} ELSE due END, expired_at, expired_state
  FROM (
    SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN state <> 'pending' THEN 'refused_' || state WHEN due > at_ THEN 'refused_not_due' ELSE 'granted' END
      WHEN state <> 'running' OR given <> token THEN 'stale' ELSE CASE kind WHEN 'renew' THEN 'renewed' WHEN 'complete' THEN 'completed' ELSE 'failed' END END AS outcome
    FROM (
      SELECT e.item, e.rn, e.at_, e.seq, e.kind, e.given, p.token, p.until,
        CASE WHEN ended THEN CASE WHEN p.token < {POLICY.attempts} THEN 'pending' ELSE 'failed' END ELSE p.state END AS state,
        CASE WHEN ended AND p.token < {POLICY.attempts} THEN p.until + {_DELAY} ELSE p.due END AS due,
        CASE WHEN ended THEN p.until END AS expired_at, CASE WHEN ended THEN CASE WHEN p.token < {POLICY.attempts} THEN 'pending' ELSE 'failed' END END AS expired_state
      FROM (SELECT r.*, e.at_ AS next_at, r.state = 'running' AND r.until <= e.at_ AS ended FROM r JOIN e ON e.item = r.item AND e.rn = r.rn + 1) p JOIN e ON e.item = p.item AND e.rn = p.rn + 1)))
SELECT item, at_ AS "at", seq, outcome, token, state FROM r WHERE rn > 0
UNION ALL
SELECT item, expired_at, NULL, 'expired', CASE WHEN outcome = 'granted' THEN token - 1 ELSE token END, expired_state FROM r WHERE expired_at IS NOT NULL
"""

_ALL = (reaching_definitions, first_differences, repository_files, repository_problems, lease_outcomes)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

"""Ledger folds, identities and text scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import framing
from heddle.functions.tables import read
from heddle.operators import identity, ledger, textscan


def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests, their orders as work items; customers without orders are completed if their balance isn't negative."""
    o = read(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("completed")).when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 97 == 0, "running").otherwise("pending")).otherwise(F.when(F.col("o_orderkey") % 50 == 0, "cancelled").otherwise("completed"))
    items = read(spark, sf_dir, "customer").join(o.withColumn("state", state), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = ledger.stage_state(items.select("c_custkey", "c_acctbal", "state"), ["c_custkey", "c_acctbal"], F.col("c_acctbal") >= 0)
    return out.select("c_custkey", "total", "failed", "pending", "stage")


STAGE_ROLLUP = """
WITH i AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'completed' END WHEN 'P' THEN CASE WHEN o_orderkey % 97 = 0 THEN 'running' ELSE 'pending' END ELSE CASE WHEN o_orderkey % 50 = 0 THEN 'cancelled' ELSE 'completed' END END AS state FROM orders),
c AS (SELECT c_custkey, c_acctbal, count(state) AS total, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'pending') AS pending FROM customer LEFT JOIN i ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey, total, failed, pending, CASE WHEN failed > 0 THEN 'failed' WHEN cancelled > 0 THEN 'cancelled' WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'pending' WHEN total > 0 OR c_acctbal >= 0 THEN 'completed' ELSE 'pending' END AS stage FROM c
"""


def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("org"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("next_attempt_at"))
    return ledger.claim_next(o, ["org", "kind"], F.lit("1996-01-01").cast("timestamp")).select("org", "kind", "id")


CLAIM_NEXT = """
SELECT org, kind, id FROM (SELECT o_custkey % 10 AS org, o_orderpriority AS kind, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 10, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
  WHERE o_orderstatus = 'P' AND CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY ELSE o_orderdate END <= TIMESTAMP '1996-01-01') WHERE rn = 1
"""


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("attempts"), F.lit(5).alias("max_attempts"), F.lit(2.0).alias("initial_seconds"), F.lit(12.0).alias("max_seconds"), "l_partkey")
    return ledger.after_failure(li).select("l_orderkey", "l_linenumber", "l_partkey", "state", "delay_seconds")


RETRY_BACKOFF = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 5 THEN 'pending' ELSE 'failed' END AS state, CASE WHEN l_linenumber < 5 THEN least(12.0::DOUBLE, 2.0 * pow(2.0, l_linenumber - 1)) END AS delay_seconds FROM lineitem"


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as runs; a run supersedes the run of half its number."""
    state = F.when(F.col("p_size") % 3 == 0, "failed").when(F.col("p_size") % 11 == 0, "completed").otherwise("interrupted")
    runs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("supersedes"), state.alias("state"), F.when(F.col("p_size") == 50, 1).otherwise(0).alias("result_count"))
    return ledger.uncovered_failures(runs).select(F.col("id").alias("p_partkey"), "state")


SUPERSESSION = """
WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS sup, CASE WHEN p_size % 3 = 0 THEN 'failed' WHEN p_size % 11 = 0 THEN 'completed' ELSE 'interrupted' END AS state, CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS n FROM part),
c AS (SELECT id, sup FROM r WHERE state = 'completed' UNION SELECT r.id, r.sup FROM c JOIN r ON r.id = c.sup AND r.n = 0)
SELECT id AS p_partkey, state FROM r WHERE state IN ('failed', 'interrupted') AND id NOT IN (SELECT id FROM c)
"""

STATUS = {"view": "running", "click": "running", "signup": "queued", "purchase": "done", "error": "failed"}


def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("event_type")]
    e = read(spark, sf_dir, "events").withColumn("job", F.concat_ws(":", "user_id", F.to_date("ts").cast("string"))).withColumn("status", status)
    return ledger.fold_jobs(e, ["job"], ["ts", "event_id"]).select("event_id", "outcome", "state")


JOB_STATE_FOLD = """
WITH RECURSIVE e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn, user_id, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS s FROM events),
f AS (
  SELECT event_id, rn, user_id, day, 'applied' AS outcome, s AS state FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.rn, e.user_id, e.day, CASE WHEN f.state = e.s THEN 'duplicate' WHEN f.state IN ('done', 'failed') THEN 'conflict' ELSE 'applied' END,
    CASE WHEN f.state IN ('done', 'failed') THEN f.state ELSE e.s END FROM f JOIN e ON e.user_id = f.user_id AND e.day = f.day AND e.rn = f.rn + 1)
SELECT event_id, outcome, state FROM f
"""


def idempotent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return ledger.consumed_once(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("value") > 2).select("event_id", "user_id", "event_type")


IDEMPOTENT_DEDUP = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events WHERE value > 2) WHERE rn = 1"


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("handled", F.col("value") > 30)
    return ledger.dead_letters(e, ["user_id", "event_type"])


DEAD_LETTERS = "SELECT user_id, event_type, count(*) AS receives FROM events GROUP BY 1, 2 HAVING count(*) >= 3 AND NOT bool_or(value > 30)"


def replay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replay_conflicts(read(spark, sf_dir, "documents"), ["source", "lang"], "text")


REPLAY_CONFLICTS = "SELECT source, lang, count(DISTINCT text) AS contents FROM documents GROUP BY 1, 2 HAVING count(DISTINCT text) > 1"


def latest_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


LATEST_SPEC = "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2"


def next_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "part").select("p_brand", F.concat_ws(".", F.lit(1), (F.col("p_size") % 12), (F.col("p_partkey") % 13)).alias("version"))
    return ledger.next_versions(v, ["p_brand"])


NEXT_SEMVER = "SELECT p_brand, '1.' || (max(p_size % 12 * 100 + p_partkey % 13) // 100) || '.' || (max(p_size % 12 * 100 + p_partkey % 13) % 100 + 1) AS next_version FROM part GROUP BY 1"


def denial_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = [("suspended", c("c_acctbal") < -500), ("unknown_segment", c("c_mktsegment") == "MACHINERY"), ("over_limit", c("c_acctbal") > 9000), ("region_closed", c("c_nationkey") % 9 == 0)]
    return read(spark, sf_dir, "customer").select("c_custkey", ledger.denial(rules).alias("reason"))


DENIAL_REASON = "SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'suspended' WHEN c_mktsegment = 'MACHINERY' THEN 'unknown_segment' WHEN c_acctbal > 9000 THEN 'over_limit' WHEN c_nationkey % 9 = 0 THEN 'region_closed' END AS reason FROM customer"


def tiered_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), (F.col("p_size") * 100).alias("stars"))
    return ledger.tiered(r, [4500, 3000, 1000])


TIERED_REPOS = "SELECT p_brand AS owner, p_name AS name, min(CASE WHEN p_size >= 45 THEN 0 WHEN p_size >= 30 THEN 1 WHEN p_size >= 10 THEN 2 ELSE 3 END) AS tier, max(p_size * 100) AS stars FROM part GROUP BY 1, 2"


def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", schema, {"mode": "FAILFAST"}).alias("p"), F.array_join(F.json_object_keys("props"), ",").alias("prop_keys"))
    return e.select("event_id", F.col("p.k").alias("k"), "prop_keys")


JSON_PROJECTION = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(json_keys(props), ',') AS prop_keys FROM events"


def distributivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of five flow functions distributes over union, on the sets of facts that hold at successive events of a user.

    A set is the kinds of a user's last three events and the remainders of their variables, as bits; each is joined with the next one.
    """
    e = read(spark, sf_dir, "events")
    kinds = F.create_map(*(F.lit(x) for i, k in enumerate(EVENT_KINDS) for x in (k, 1 << i)))
    bits = kinds[F.col("event_type")].bitwiseOR(F.expr("shiftleft(1, cast(get_json_object(props, '$.k') as int) % 8)"))
    w = W.partitionBy("user_id").orderBy("event_id")
    sets = e.withColumn("b", bits).withColumn("x", F.bit_or("b").over(w.rowsBetween(-2, 0))).withColumn("y", F.lead("x").over(w)).where("y IS NOT NULL")
    f = {"identity": lambda s: s, "kill_low": lambda s: s.bitwiseAND(F.lit(240)), "gen_one": lambda s: s.bitwiseOR(F.lit(1)), "move": lambda s: F.shiftleft(s.bitwiseAND(F.lit(15)), 4).bitwiseOR(s), "needs_both": lambda s: F.when(s.bitwiseAND(F.lit(3)) == 3, s.bitwiseOR(F.lit(128))).otherwise(s)}
    x, y = F.col("x"), F.col("y")
    row = sets.agg(*(F.count_if(g(x.bitwiseOR(y)) != g(x).bitwiseOR(g(y))).alias(n) for n, g in f.items()))
    return row.unpivot([], list(f), "flow", "violations")


EVENT_KINDS = ("signup", "view", "click", "purchase", "error")
DISTRIBUTIVITY = f"""
WITH e AS (SELECT user_id, event_id, (1 << (list_position({list(EVENT_KINDS)}, event_type) - 1)) | (1 << (CAST(json_extract_string(props, '$.k') AS INTEGER) % 8)) AS b FROM events),
s AS (SELECT user_id, event_id, bit_or(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM e),
p AS (SELECT * FROM (SELECT x, lead(x) OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM s) WHERE y IS NOT NULL),
v AS (SELECT count(*) FILTER (FALSE) AS identity, count(*) FILTER (((x | y) & 240) <> ((x & 240) | (y & 240))) AS kill_low, count(*) FILTER (((x | y) | 1) <> ((x | 1) | (y | 1))) AS gen_one,
  count(*) FILTER (((((x | y) & 15) << 4) | (x | y)) <> ((((x & 15) << 4) | x) | (((y & 15) << 4) | y))) AS move,
  count(*) FILTER ((CASE WHEN ((x | y) & 3) = 3 THEN (x | y) | 128 ELSE x | y END) <> ((CASE WHEN (x & 3) = 3 THEN x | 128 ELSE x END) | (CASE WHEN (y & 3) = 3 THEN y | 128 ELSE y END))) AS needs_both FROM p)
UNPIVOT v ON COLUMNS(*) INTO NAME flow VALUE violations
"""


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("row_id", framing.row_id("case:", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")))
    return d.select("doc_id", "row_id", framing.held_out(F.col("row_id")).alias("held_out"))


HOLDOUT_SPLIT = """
WITH r AS (SELECT doc_id, 'case:' || substr(sha256(source || chr(0) || lang || chr(0) || doc_id), 1, 32) AS row_id FROM documents)
SELECT doc_id, row_id, (list_sum([6 * (strpos('0123456789abcdef', substr(sha256(row_id), i, 1)) - 1) for i in range(1, 64)]) + strpos('0123456789abcdef', substr(sha256(row_id), 64, 1)) - 1) % 10 = 9 AS held_out FROM r
"""


def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return identity.tree_digest(d, ["source"], "path", "text")


TREE_DIGEST = "SELECT source, sha256(string_agg(lpad(CAST(doc_id AS VARCHAR), 12, '0') || chr(0) || sha256(text) || chr(10), '' ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS tree_sha256, count(*) AS files FROM documents GROUP BY 1"


def request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("detectors"))
    return e.select("user_id", framing.request_fingerprint(F.lit("c0ffee"), F.col("user_id").cast("string"), F.col("detectors")).alias("fingerprint"))


REQUEST_FINGERPRINT = "SELECT user_id, sha256('c0ffee' || chr(10) || user_id || chr(10) || string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS fingerprint FROM events GROUP BY 1"


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", framing.content_id(F.lit("head"), F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_partkey")).alias("content_id"))


CONTENT_IDS = "SELECT l_orderkey, l_linenumber, l_partkey, sha256(concat_ws('|', 'head', l_linestatus, l_returnflag, l_orderkey, l_partkey)) AS content_id FROM lineitem"

# Patterns without word boundaries next to accented letters, which the two regex engines see differently.
WORDS = {"en": {"python-getattr": r"\b(?:the|and)\s+(?:of|for)\b", "python-eval-exec": r"\bworthless\b"}, "fr": {"java-class-forname": r"(?:^| )dans[ ,.]", "java-method-invoke": r"^L[ae] "}, "de": {"go-reflect-call": r" (?:von|mit) d[a-z]+"}}


def reflection_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by language; Spanish is not searched, so those are uncertain."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".doc")).alias("file"), F.col("lang").alias("language"), "text")
    return textscan.reflection_sites(d, WORDS).groupBy("file", "kind").agg(F.count("*").alias("sites"), F.min("line").cast("long").alias("first_line"))


_SITES = (
    "WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, n, '{kind}' AS kind FROM l WHERE lang = '{lang}' AND regexp_matches(t, '{p}')" for lang, kinds in WORDS.items() for kind, p in kinds.items())
    + " UNION ALL SELECT doc_id, 0, 'structural-uncertainty' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')) "
)
REFLECTION_SITES = _SITES + "SELECT doc_id || '.doc' AS file, kind, count(*) AS sites, CAST(min(n) AS BIGINT) AS first_line FROM s GROUP BY 1, 2"


def routing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".doc")).alias("file"), F.col("lang").alias("language"), "text")
    v = textscan.verdicts(textscan.reflection_sites(d, WORDS), d, "file")
    return textscan.routing_rate(v).select(F.round("rate", 6).alias("rate"))


ROUTING_RATE = _SITES + "SELECT round(count(DISTINCT doc_id)::DOUBLE / (SELECT count(*) FROM documents), 6) AS rate FROM s"


def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = textscan.language_mix(read(spark, sf_dir, "documents"), "source", "lang")
    mix = F.array_join(F.transform("mix", lambda m: F.concat_ws(":", m["lang"], m["n"].cast("string"))), ",")
    return out.select("source", "primary", mix.alias("mix"))


LANGUAGE_MIX = "SELECT source, arg_max(lang, (n, lang)) AS primary, string_agg(lang || ':' || n, ',' ORDER BY lang) AS mix FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1"


def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("symbol"))
    return textscan.symbol_index(p, "symbol", "p_partkey").select("symbol", F.sha2(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","), 256).alias("nodes_sha256"), F.size("nodes").cast("long").alias("n"))


SYMBOL_INDEX = "SELECT symbol, sha256(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS nodes_sha256, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS symbol FROM part) GROUP BY 1"


def fqn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, "").otherwise(F.concat_ws(".", "p_brand", F.regexp_replace("p_name", " ", "."))).alias("fqn"))
    return p.select("p_partkey", framing.last_segment(F.col("fqn")).alias("name"), framing.sha256(framing.framed_all(F.col("fqn"), framing.last_segment(F.col("fqn")))).alias("label_sha256"))


FQN_SEGMENTS = """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand || '.' || replace(p_name, ' ', '.') END AS fqn FROM part),
n AS (SELECT p_partkey, fqn, CASE WHEN fqn = '' THEN '' ELSE '%pkg.' || split_part(fqn, '.', -1) END AS name FROM p)
SELECT p_partkey, name, sha256(unhex(lpad(printf('%x', strlen(fqn)), 16, '0')) || encode(fqn) || unhex(lpad(printf('%x', strlen(name)), 16, '0')) || encode(name)) AS label_sha256 FROM n
"""

_ALL = (stage_rollup, claim_next, retry_backoff, supersession, job_state_fold, idempotent_dedup, dead_letters, replay_conflicts, latest_spec, next_semver, denial_reason, tiered_repos, json_projection, distributivity, holdout_split, tree_digest, request_fingerprint, content_ids, reflection_sites, routing_rate, language_mix, symbol_index, fqn_segments)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}

"""Reports of scanning tools: JSON results, SARIF runs, and canonical SARIF out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.findings import duplicate_ordinals, ordered, sarif_level, severity

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# The parts of the formats that are read.
POINT = _struct(line=_I, col=_I, offset=_I)
RESULT = _struct(check_id=_S, path=_S, start=POINT, end=POINT, extra=_struct(message=_S, severity=_S))
RULE_REF = _struct(id=_S, index=_I)
LOCATION = _struct(physicalLocation=_struct(artifactLocation=_struct(uri=_S, index=_I, uriBaseId=_S), region=_struct(startLine=_I, startColumn=_I, endLine=_I, endColumn=_I)))
SARIF_RESULT = _struct(ruleId=_S, ruleIndex=_I, rule=RULE_REF, message=_struct(text=_S), locations=T.ArrayType(LOCATION))
RUN = _struct(tool=_struct(driver=_struct(name=_S, rules=T.ArrayType(_struct(id=_S)))), artifacts=T.ArrayType(_struct(location=_struct(uri=_S))), results=T.ArrayType(SARIF_RESULT))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result of JSON reports: report, tool_ordinal, rule, path, start and end, message, severity, duplicate_ordinal. An unknown severity raises."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.from_json("value", _struct(results=T.ArrayType(RESULT)), {"mode": "FAILFAST"}).alias("r"))
    rows = files.select("report", F.posexplode("r.results").alias("tool_ordinal", "x"))
    rows = rows.select("report", "tool_ordinal", F.col("x.check_id").alias("rule"), "x.path", F.col("x.start.line").alias("line"), F.col("x.start.col").alias("column"), F.col("x.end.line").alias("end_line"), F.col("x.extra.message").alias("message"), severity(F.col("x.extra.severity")).alias("severity"), F.to_json("x").alias("raw"))
    return duplicate_ordinals(rows, "raw", ["report", "tool_ordinal"]).drop("raw")


def relative_path(uri: Column) -> Column:
    """A report's URI as a path within the tree, null where it leaves it: absolute, with a scheme, a backslash or a `..` part."""
    plain = F.try_url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    outside = uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | plain.startswith("/") | plain.contains("\\") | plain.rlike(r"(^|/)\.\.(/|$)") | (plain == "")
    return F.when(~outside, F.regexp_replace(plain, r"^(\./)+", ""))


def read_sarif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, rules, artifacts) of SARIF files: run and result ordinals, with every location of a result."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.from_json("value", _struct(runs=T.ArrayType(RUN)), {"mode": "FAILFAST"}).alias("s"))
    runs = files.select("report", F.posexplode("s.runs").alias("run", "r"))
    rules = runs.select("report", "run", F.posexplode("r.tool.driver.rules").alias("rule_index", "x")).select("report", "run", "rule_index", F.col("x.id").alias("rule_id"))
    artifacts = runs.select("report", "run", F.posexplode("r.artifacts").alias("artifact_index", "x")).select("report", "run", "artifact_index", F.col("x.location.uri").alias("uri"))
    results = runs.select("report", "run", F.posexplode("r.results").alias("result", "x"))
    results = results.select("report", "run", "result", F.coalesce("x.ruleId", "x.rule.id").alias("rule_id"), F.coalesce("x.ruleIndex", "x.rule.index").alias("rule_index"), F.col("x.message.text").alias("message"), F.posexplode_outer("x.locations").alias("location", "l"))
    return results.select("report", "run", "result", "rule_id", "rule_index", "message", "location", F.col("l.physicalLocation.artifactLocation.uri").alias("uri"), F.col("l.physicalLocation.artifactLocation.index").alias("artifact_index"), F.col("l.physicalLocation.region").alias("region")), rules, artifacts


def rule_join(results: DataFrame, rules: DataFrame) -> DataFrame:
    """results with rule_status: matched, missing, unindexed-id, ambiguous, inconsistent or invalid."""
    by_index = rules.select("report", "run", "rule_index", F.col("rule_id").alias("indexed_id"))
    by_id = rules.groupBy("report", "run", "rule_id").agg(F.count("*").alias("named"))
    rows = results.join(by_index, ["report", "run", "rule_index"], "left").join(by_id, ["report", "run", "rule_id"], "left")
    c = F.col
    status = (
        F.when(c("rule_id").isNull() & c("rule_index").isNull(), "missing")
        .when(c("rule_index").isNotNull() & c("indexed_id").isNull(), "invalid")
        .when(c("rule_index").isNotNull() & c("rule_id").isNotNull() & (c("rule_id") != c("indexed_id")), "inconsistent")
        .when(c("rule_index").isNotNull(), "matched")
        .when(c("named").isNull(), "unindexed-id")
        .when(c("named") > 1, "ambiguous")
        .otherwise("matched")
    )
    return rows.withColumn("rule_status", status)


def path_join(results: DataFrame, artifacts: DataFrame, inventory: DataFrame) -> DataFrame:
    """results with path and path_status: matched, missing, outside, contradiction (URI and artifact differ) or not-in-inventory. inventory: path."""
    listed = artifacts.select("report", "run", "artifact_index", F.col("uri").alias("artifact_uri"))
    rows = results.join(listed, ["report", "run", "artifact_index"], "left")
    rows = rows.withColumn("path", relative_path(F.coalesce("uri", "artifact_uri")))
    rows = rows.join(inventory.select("path", F.lit(True).alias("_known")).distinct(), "path", "left")
    c = F.col
    status = F.when(F.coalesce("uri", "artifact_uri").isNull(), "missing").when(c("uri").isNotNull() & c("artifact_uri").isNotNull() & (c("uri") != c("artifact_uri")), "contradiction").when(c("path").isNull(), "outside").when(c("_known").isNull(), "not-in-inventory").otherwise("matched")
    return rows.withColumn("path_status", status).drop("_known")


def region_valid(line: Column, column: Column, end_line: Column, end_column: Column) -> Column:
    """Lines and columns from 1, and an end that isn't before the start; absent ends count as the start."""
    l2, c1 = F.coalesce(end_line, line), F.coalesce(column, F.lit(1))
    c2 = F.coalesce(end_column, c1)
    return F.coalesce((line >= 1) & (c1 >= 1) & (c2 >= 1) & ((l2 > line) | ((l2 == line) & (c2 >= c1))), F.lit(False))


# ---- out


def canonical_json(value: object, ascii_only: bool = False) -> str:
    """Sorted keys, no spaces. Findings keep their characters; provenance records escape all but ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def sarif_lines(findings: DataFrame, by: Sequence[str] = ("partition",)) -> DataFrame:
    """(by..., position, line): each finding as canonical JSON, in canonical order within its partition; a writer can store them as they are.

    findings: by..., graph_sha256, rule, uri, line, column, message, severity, origin, slice_sha256.
    """
    result = F.struct(
        sarif_level(F.col("severity")).alias("level"),
        F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("column").alias("startColumn"), F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct("graph_sha256", "origin", "slice_sha256").alias("properties"),
        F.col("rule").alias("ruleId"),
    )
    rows = findings.withColumn("line_json", F.to_json(result, {"ignoreNullFields": "false"}))
    return ordered(rows, ["graph_sha256", "rule", "uri", "line", "slice_sha256", "line_json"], list(by)).select(*by, "position", F.col("line_json").alias("line"))

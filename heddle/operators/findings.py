"""Findings: where they come from, how severe they are, where they point, and in which order they stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Engines of the deterministic core, and the severities of tool reports and of SARIF.
CORE_ENGINES = ("ifds", "ide")
TOOL_SEVERITY = {"ERROR": "critical", "WARNING": "medium", "INFO": "low"}
SARIF_LEVEL = {"info": "note", "low": "note", "medium": "warning", "high": "error", "critical": "error"}
CORE, ORACLE = "deterministic-core", "oracle"
CORE_CLAIM, ORACLE_CLAIM = "CONDITIONAL_THEOREM", "EMPIRICAL"


def looked_up(value: Column, table: dict[str, str], what: str) -> Column:
    """The table's entry; a value that it lacks raises."""
    found = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[value]
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def partition_of(engine: Column) -> Column:
    return F.when(engine.isin(*CORE_ENGINES), "core").otherwise("oracle")


def origin(engine: Column, mixed: Column, from_core: Column) -> Column:
    """By engine, or in a mixed detector by the finding's own flag, which must be set there."""
    flagged = F.when(from_core.isNull(), F.raise_error(F.lit("a mixed detector's finding needs its flag")).cast("string")).when(from_core, CORE).otherwise(ORACLE)
    return F.when(mixed, flagged).when(engine.isin(*CORE_ENGINES), CORE).otherwise(ORACLE)


def claim(origin_: Column) -> Column:
    return F.when(origin_ == CORE, CORE_CLAIM).otherwise(ORACLE_CLAIM)


def severity(tool_severity: Column) -> Column:
    return looked_up(tool_severity, TOOL_SEVERITY, "severity")


def sarif_level(severity_: Column) -> Column:
    return looked_up(severity_, SARIF_LEVEL, "severity")


def located(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """findings (file, line, ...) with the node_id that each points at, null without one: calls first, then known columns, then the least column and id.

    nodes: file, line, column, kind, node_id. The least key is an aggregate, so nodes shrink before the join.
    """
    key = F.struct((F.col("kind") != "CALL").alias("a"), (F.col("column") == 0).alias("b"), F.col("column").alias("c"), F.col("node_id").alias("d"))
    best = nodes.groupBy("file", "line").agg(F.min(key)["d"].alias("node_id"))
    return findings.join(best, ["file", "line"], "left")


def duplicate_ordinals(rows: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """rows with duplicate_ordinal: how many rows before have the same content."""
    w = W.partitionBy(F.sha2(content, 256)).orderBy(*order)
    return rows.withColumn("duplicate_ordinal", (F.row_number().over(w) - 1).cast("long"))


def ordered(rows: DataFrame, keys: Sequence[str], by: Sequence[str], name: str = "position") -> DataFrame:
    """rows with their place from 0 in canonical order, within `by`."""
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*keys)) - 1).cast("long"))


def out_of_order(rows: DataFrame, keys: Sequence[str], by: Sequence[str], position: str) -> DataFrame:
    """Rows whose key is less than that of the row before them."""
    key = F.struct(*keys)
    before = F.lag(key).over(W.partitionBy(*by).orderBy(position))
    return rows.withColumn("_before", before).where(F.col("_before") > key).drop("_before")


def violations(findings: DataFrame, required: Sequence[str], allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Findings that may not be emitted, with the names of the rules that they break: required values, closed vocabularies, line from 1, and a claim and confidence that fit the origin."""
    missing = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    closed = [F.when(~F.col(c).isin(*v), F.lit(f"unknown {c}")) for c, v in allowed.items()]
    lines = [F.when(F.col("line") < 1, F.lit("line below 1"))] if "line" in findings.columns else []
    broken = F.filter(F.array(*missing, *closed, *lines), lambda x: x.isNotNull())
    return findings.withColumn("broken", broken).where(F.size("broken") > 0)


def repartitioned(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Core findings that no event has moved to the oracle side yet: the rows that a new event would be written for."""
    mine = findings.where((F.col("origin") == CORE) & F.col("engine").isin(*CORE_ENGINES))
    return mine.join(events.select(F.col("parent_record_id").alias("record_id")), "record_id", "left_anti")


def effective_origin(findings: DataFrame, events: DataFrame) -> DataFrame:
    """findings with effective_origin: the oracle's once an event moved them, however often."""
    moved = events.select(F.col("parent_record_id").alias("record_id"), F.lit(True).alias("_moved")).distinct()
    out = findings.join(moved, "record_id", "left")
    return out.withColumn("effective_origin", F.when(F.col("_moved"), ORACLE).otherwise(F.col("origin"))).drop("_moved")


def detectors_for(detectors: DataFrame, language: str, vulnerability_class: str) -> DataFrame:
    """Detectors of a language and class; those without a specification serve every class."""
    return detectors.where(F.array_contains("languages", language) & (F.col("spec_id").isNull() | (F.col("class") == vulnerability_class)))

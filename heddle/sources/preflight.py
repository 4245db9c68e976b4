"""What a document is refused for before and after it is parsed, each refusal a row; no document is shortened.

`measured` reads a JSON text once, without building a value: its bytes, depth, values, longest string and repeated keys.
`refusals` holds these against limits. `report_violations` checks the shape of two-run reports (SARIF 2.1.0) path by path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.tables import materialized, union_all

_TOKEN = re.compile(rb'\s+|"((?:[^"\\]|\\.)*)"|([{}\[\],:])|[^\s{}\[\],:"]+', re.S)
MEASURES = (("bytes", T.LongType()), ("depth", T.LongType()), ("values", T.LongType()), ("longest_string", T.LongType()))


def measure(text: bytes) -> tuple[int, int, int, int, list[str], bool]:
    """Bytes, greatest depth of objects and arrays, values of any kind, bytes of the longest string as written (keys count), keys that an object has twice (as a path), and whether the text can be cut into tokens whose brackets fit."""
    depth = most = values = longest = 0
    keys: list[set | None] = []  # of the objects that are open; None for an array
    path: list[str] = []
    repeated, fits, at = [], True, 0
    expects_key = False
    last: bytes | None = None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            fits = False
            break
        at = m.end()
        string, mark = m[1], m[2]
        if mark in (b"{", b"["):
            depth, values = depth + 1, values + 1
            most = max(most, depth)
            keys.append(set() if mark == b"{" else None)
            path.append(last.decode("utf-8", "replace") if last is not None else "")
            expects_key, last = mark == b"{", None
        elif mark in (b"}", b"]"):
            if not keys or (keys[-1] is None) != (mark == b"]"):
                fits = False
                break
            keys.pop()
            path.pop()
            depth, expects_key = depth - 1, False
        elif mark == b",":
            expects_key = bool(keys) and keys[-1] is not None
        elif mark == b":":
            expects_key = False
        elif string is not None:
            longest = max(longest, len(string))
            if expects_key:
                if string in keys[-1]:
                    repeated.append("/".join([*path[1:], string.decode("utf-8", "replace")]))
                keys[-1].add(string)
                last = string
            else:
                values += 1
        elif not m[0].isspace():
            values += 1
    return len(text), most, values, longest, repeated, fits and not keys


def measured(documents: DataFrame, column: str = "json") -> DataFrame:
    """documents with bytes, depth, values, longest_string, repeated_keys and closed; a null text is empty."""
    names = [n for n, _ in MEASURES]
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, t) for n, t in MEASURES), T.StructField("repeated_keys", T.ArrayType(T.StringType())), T.StructField("closed", T.BooleanType())])
    place = documents.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure((t.as_py() or "").encode()) for t in b.column(place)]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *names, "repeated_keys", "closed"])

    return documents.mapInArrow(run, schema)


def refusals(documents: DataFrame, key: str, limits: Mapping[str, int]) -> DataFrame:
    """(key, resource, observed, limit) of measured documents: each limit (by the measure's name) that is passed, each repeated key, and brackets that don't fit."""
    m = materialized(documents.select(key, *(n for n, _ in MEASURES), "repeated_keys", "closed"))
    none = F.lit(None).cast("long")
    over = [m.where(F.col(n) > limit).select(key, F.lit(n).alias("resource"), F.col(n).alias("observed"), F.lit(limit).cast("long").alias("limit")) for n, limit in limits.items()]
    repeated = m.select(key, F.explode("repeated_keys").alias("k")).groupBy(key, "k").agg((F.count("*") + 1).alias("observed"))
    return union_all([*over, repeated.select(key, F.concat(F.lit("repeated_key:"), "k").alias("resource"), "observed", F.lit(1).cast("long").alias("limit")), m.where("NOT closed").select(key, F.lit("unclosed").alias("resource"), none.alias("observed"), none.alias("limit"))])


# ---- reports of two runs


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def report_violations(reports: DataFrame, schema_uri: str, tool: str, run_texts: Mapping[str, str], result_texts: Mapping[str, str], partitions: tuple[str, ...] = ("core", "oracle"), version: str = "2.1.0") -> DataFrame:
    """(report_id, path, problem) of reports (report_id, json).

    A report has the schema's address, the version, and a run for each of `partitions`, in order. A run names the tool and its
    partition, and has the texts `run_texts` (name to path in the run), none empty. A result has a ruleId that
    its run's rules have, a level, a message with text, and the texts `result_texts`. Nothing of a report that isn't JSON, or has
    another number of runs, is looked at further.
    """
    v = materialized(reports.select("report_id", F.try_parse_json("json").alias("v")))
    said = lambda df, path, problem: df.select("report_id", (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(problem).alias("problem"))
    top = F.col("v")
    whole = v.where(F.coalesce(F.schema_of_variant(top).startswith("OBJECT"), F.lit(False)))
    runs_of = F.try_variant_get(top, "$.runs", "array<variant>")
    right = whole.where(F.coalesce(F.size(runs_of) == len(partitions), F.lit(False)))
    runs = right.select("report_id", F.posexplode(runs_of).alias("run", "v"))
    run = F.concat(F.lit("runs["), "run", F.lit("]"))
    r = F.col("v")
    expected = F.get(F.array(*map(F.lit, partitions)), F.col("run"))
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    empty = lambda df, path: F.coalesce(_string(df, path), F.lit("")) == ""
    rules = runs.select("report_id", "run", F.explode(F.try_variant_get(r, "$.tool.driver.rules", "array<variant>")).alias("rule")).select("report_id", "run", _string(F.col("rule"), "$.id").alias("rule_id")).where("rule_id IS NOT NULL").distinct()
    results_of = F.try_variant_get(r, "$.results", "array<variant>")
    results = runs.select("report_id", "run", F.posexplode(results_of).alias("n", "v")).withColumn("rule_id", _string(F.col("v"), "$.ruleId"))
    at = F.concat(run, F.lit(".results["), "n", F.lit("]"))
    undefined = results.join(rules.withColumn("known", F.lit(True)), ["report_id", "run", "rule_id"], "left").where("known IS NULL")
    under = lambda base, name: F.concat(base, F.lit("." + name))
    return union_all(
        [
            said(v.where(top.isNull()), "", "not JSON"),
            said(v.where(top.isNotNull() & ~F.coalesce(F.schema_of_variant(top).startswith("OBJECT"), F.lit(False))), "", "not an object"),
            said(whole.where(differs(_string(top, "$['$schema']"), F.lit(schema_uri))), "$schema", "another schema"),
            said(whole.where(differs(_string(top, "$.version"), F.lit(version))), "version", "another version"),
            said(whole.where(~F.coalesce(F.size(runs_of) == len(partitions), F.lit(False))), "runs", "another number of runs"),
            said(runs.where(differs(_string(r, "$.tool.driver.name"), F.lit(tool))), under(run, "tool.driver.name"), "another tool"),
            said(runs.where(differs(_string(r, "$.properties.partition"), expected)), under(run, "properties.partition"), "another partition"),
            *(said(runs.where(empty(r, f"$.{p}")), under(run, n), "missing or empty") for n, p in run_texts.items()),
            said(runs.where(~F.coalesce(_kind(r, "$.results").startswith("ARRAY"), F.lit(False))), under(run, "results"), "not an array"),
            said(undefined, under(at, "ruleId"), "no such rule"),
            said(results.where(~F.coalesce(_string(F.col("v"), "$.level").isin("none", "note", "warning", "error"), F.lit(False))), under(at, "level"), "no level"),
            said(results.where(empty(F.col("v"), "$.message.text")), under(at, "message.text"), "missing or empty"),
            *(said(results.where(empty(F.col("v"), f"$.{p}")), under(at, n), "missing or empty") for n, p in result_texts.items()),
        ]
    )

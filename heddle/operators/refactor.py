"""Before-and-after comparison of refactored programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.textscan import lines as text_lines

# Outcomes that the ground truth expects.
EXPECTED = {"should-stay": "stayed", "should-flip": "flipped"}
CALL = r"(?U)\b([A-Za-z_]\w*)\s*\("


def callee_token(line: Column) -> Column:
    """The last name before a bracket, null without one."""
    return F.try_element_at(F.regexp_extract_all(line, F.lit(CALL), 1), F.lit(-1))


def sink_lines(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """(file, token, lines) of all lines that call the token. files: file, text; tokens: file, token."""
    calls = text_lines(files).select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("line_text", F.lit(CALL), 1))).alias("token"))
    found = calls.groupBy("file", "token").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return tokens.join(found, ["file", "token"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))


def evaluated(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, truth, candidates, before, before_class, after, after_class) with outcome, reason, validity and as_expected.

    A pair with no line or several for its sink, or without a fingerprint on a side, is unevaluated; that
    is never a flip. A comparison is strong only if both sides are.
    """
    c = F.col
    reason = F.when(c("candidates") == 0, "sink-not-found").when(c("candidates") > 1, "sink-ambiguous").when(c("before").isNull(), "no-fingerprint-before").when(c("after").isNull(), "no-fingerprint-after")
    rows = pairs.withColumn("reason", reason)
    outcome = F.when(c("reason").isNotNull(), "unevaluated").when(c("before") == c("after"), "stayed").otherwise("flipped")
    validity = F.when(c("reason").isNull(), F.when((c("before_class") == "strong") & (c("after_class") == "strong"), "strong").otherwise("weak"))
    expected = F.create_map(*(F.lit(x) for kv in EXPECTED.items() for x in kv))[c("truth")]
    return rows.withColumns({"outcome": outcome, "validity": validity}).withColumn("as_expected", F.when(F.col("outcome") != "unevaluated", F.col("outcome") == expected))


def accepted(cells: DataFrame, mode: str) -> DataFrame:
    """One row `passed` for a report's cells (as_expected, contrary, unevaluated, regressions): a baseline only needs to be complete, acceptance that nothing is contrary or unevaluated, nonregression that nothing got worse."""
    rule = {"baseline": F.lit(True), "acceptance": (F.col("contrary") == 0) & (F.col("unevaluated") == 0), "nonregression": F.col("regressions") == 0}[mode]
    return cells.agg(F.coalesce(F.bool_and(rule), F.lit(False)).alias("passed"))


def observed_calls(expected: DataFrame, source: DataFrame, raw: DataFrame, mapped: DataFrame) -> DataFrame:
    """expected (case_id, file, line, column, callee) with raw_id, node_id and `problem`: proof that a line's call is one raw call and one mapped node.

    source: file, line, line_text; raw: raw_id, file (null: not said), line, column, name, code, full_name; mapped: node_id,
    file, line, column, resolved_fqn. The source has the token once and at the column told; the raw call has its name, or is a constructor
    whose code has it, and its code stands in the line, white space aside; the mapped node is at the raw
    call's place and of its full name. A candidate that is one of several is never taken.
    """
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    rows = expected.join(source, ["file", "line"], "left")
    escaped = F.regexp_replace("callee", r"([^\w])", r"\\$1")
    pattern = F.concat(F.lit(r"\b"), escaped, F.lit(r"\s*\("))
    count = F.coalesce(F.regexp_count("line_text", pattern), F.lit(0))
    begins = F.regexp_instr("line_text", pattern)
    problem = F.when(F.col("line_text").isNull(), "no-line").when(count == 0, "no-token").when(count > 1, "ambiguous-token").when(begins != F.col("column"), "another-column")
    rows = rows.withColumn("problem", problem)
    at = rows.where("problem IS NULL").select("case_id", "file", "line", "callee", squeezed(F.col("line_text")).alias("squeezed"))
    r = raw.select("raw_id", F.col("file").alias("raw_file"), "line", F.col("column").alias("raw_column"), "name", "code", "full_name")
    fits = (F.col("name") == F.col("callee")) | ((F.col("name") == "<init>") & F.col("code").contains(F.col("callee")))
    near = at.join(r, "line").where(fits & (F.col("code") != "") & F.col("squeezed").contains(squeezed(F.col("code"))) & F.coalesce(F.col("raw_file") == F.col("file"), F.lit(True)))
    m = mapped.select("node_id", "file", "line", F.col("column").alias("raw_column"), F.col("resolved_fqn").alias("full_name"))
    found = near.join(m, ["file", "line", "raw_column", "full_name"]).groupBy("case_id").agg(F.count_distinct("raw_id").alias("raws"), F.count("*").alias("pairs"), F.min("raw_id").alias("raw_id"), F.min("node_id").alias("node_id"))
    rows = rows.join(found, "case_id", "left")
    n = F.coalesce("pairs", F.lit(0))
    problem = F.coalesce("problem", F.when(n == 0, "no-call").when(F.col("pairs") > F.col("raws"), "ambiguous-node").when(n > 1, "ambiguous-call"))
    rows = rows.withColumn("problem", problem)
    proved = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return rows.select(*expected.columns, proved("raw_id"), proved("node_id"), "problem")


SIDE = "status, class, namespace, hash, finding, rule, scan, scan_id, covered_files, covered_rules, skipped_files, failed_files, error_stage, error_visible, located, evidence"


def case_verdicts(cases: DataFrame, namespaces: Sequence[str], requires_attempts: bool = True) -> DataFrame:
    """cases with passed, reason, outcome and baseline_eligible.

    A case has case_id, evidence_type (structural_comparison, finding_removal, analysis_failure), expected, run_eligible, baseline_run, correspondence,
    preconditions and demanded (maps of name to status), before_file, after_files, lifecycle (struct before_finding, after_scan, state,
    reason, inherited; null: none), before and after (structs with the fields of SIDE).

    Structures are compared only where both fingerprints are strong and of one accepted namespace. A removal counts only if the finding was
    there in a completed scan that covered its file and rule, and the later scan covered just the files there are, skipped and
    failed none, and closed it as fixed. A failed analysis must stay open, visibly. Preconditions not observed as demanded,
    and runs that aren't eligible, fail any case.
    """
    c = F.col
    b, a, life = c("before"), c("after"), c("lifecycle")
    no = lambda x: F.coalesce(x, F.lit(False))
    same = lambda x, y: no((F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0))
    has = lambda xs, x: no(F.array_contains(xs, x))
    fits = no((b["class"] == "strong") & (a["class"] == "strong") & (b["namespace"] == a["namespace"]) & b["namespace"].isin(*namespaces))
    known = b["hash"].isNotNull() & a["hash"].isNotNull()
    structural = c("evidence_type") == "structural_comparison"
    outcome = F.when(structural & known & fits, F.when(b["hash"] == a["hash"], "stay").otherwise("flip"))
    previous = no((b["status"] == "completed") & (b["finding"] == "present") & (b["scan"] == "completed") & b["located"]) & has(b["covered_files"], c("before_file")) & has(b["covered_rules"], b["rule"]) & ~has(b["skipped_files"], c("before_file")) & ~has(b["failed_files"], c("before_file"))
    linked = previous & life.isNotNull()
    covered = no(a["scan"] == "completed") & same(a["covered_files"], c("after_files")) & has(a["covered_rules"], b["rule"]) & no((F.size(a["skipped_files"]) == 0) & (F.size(a["failed_files"]) == 0))
    removed = linked & covered & no((a["status"] == "completed") & (a["finding"] == "absent") & (a["rule"] == b["rule"]) & (life["state"] == "resolved") & (life["reason"] == "fixed") & ~life["inherited"])
    failed = linked & no((a["status"] == "failed") & (a["scan"] == "failed") & (a["error_stage"] == "parse") & a["error_visible"] & (life["state"] == "open") & (life["reason"] == "analysis_failed") & ~life["inherited"])
    right = F.when(structural, no(outcome == c("expected")) & no(c("correspondence") == "established")).when(c("evidence_type") == "finding_removal", removed).otherwise(failed)
    observed = F.forall(F.map_keys("demanded"), lambda k: no(F.element_at("preconditions", k) == F.element_at("demanded", k)))
    weak = F.when(structural & known & ~fits, "weak-or-incompatible-identity").when(structural & ~known, "missing-computed-fingerprint").otherwise("incomplete-or-contrary-typed-evidence")
    reason = F.when(~no(c("run_eligible")), "run-environment-or-freshness-not-eligible").when(~observed, "required-preconditions-not-observed").when(~right, weak).otherwise("pass")
    tried = lambda s: no(s["status"].isin("completed", "failed") & (F.size(s["evidence"]) > 0))
    eligible = no(c("baseline_run")) & ((tried(b) & tried(a)) | F.lit(not requires_attempts))
    return cases.withColumns({"outcome": outcome, "reason": reason, "baseline_eligible": eligible}).withColumn("passed", F.col("reason") == "pass")

"""Sequential acceptance statistics, fidelity gates and report cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Floor of precision, level, the bet's slope and its cap.
PI_ZERO = 0.7
ALPHA = 0.05
KAPPA = 2.0
CAP = 0.5
#: Least rates that a language's front end must reach.
GATE = {"parse_success_rate": "0.995", "call_edge_precision": "0.90", "call_edge_recall": "0.85", "pdg_recall": "0.80"}


def _wealth_step(x: Column, seen: W, pi_zero: float, kappa: float, cap: float) -> Column:
    """log1p of bet times gain. The bet is set by the outcomes before: kappa times what their mean has over pi_zero, within [0, cap / pi_zero]; without any their mean is 0."""
    mean = F.coalesce(F.avg(x).over(seen), F.lit(0.0))
    bet = F.greatest(F.lit(0.0), F.least(F.lit(cap / pi_zero), kappa * (mean - pi_zero)))
    return F.log1p(bet * (x - pi_zero))


def e_process(stream: DataFrame, by: Sequence[str], order: Sequence[str], outcome: str = "outcome", pi_zero: float = PI_ZERO, kappa: float = KAPPA, cap: float = CAP, drift: bool = False) -> DataFrame:
    """stream with n, log_wealth and, if drift, log_wealth_drift (outcomes and floor mirrored) after each row."""
    ordered = W.partitionBy(*by).orderBy(*order)
    before, upto = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(W.unboundedPreceding, 0)
    x = F.col(outcome).cast("double")
    rows = stream.withColumn("_s", _wealth_step(x, before, pi_zero, kappa, cap))
    if drift:
        rows = rows.withColumn("_d", _wealth_step(1 - x, before, 1 - pi_zero, kappa, cap))
    rows = rows.withColumns({"n": F.count("*").over(upto), "log_wealth": F.sum("_s").over(upto)} | ({"log_wealth_drift": F.sum("_d").over(upto)} if drift else {}))
    return rows.drop("_s", "_d")


def accepted(process: DataFrame, by: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """by, n, max_log_wealth, accepted, first_look: whether and when the wealth first reached 1 / alpha, at any look."""
    reached = F.col("log_wealth") >= F.log(F.lit(1 / alpha))
    out = process.groupBy(*by).agg(F.max("n").alias("n"), F.max("log_wealth").alias("max_log_wealth"), F.min(F.when(reached, F.col("n"))).alias("first_look"))
    return out.withColumn("accepted", F.col("first_look").isNotNull())


def revalidation(process: DataFrame, by: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """by, decision: quarantined if the drift wealth stands at 1 / alpha, else revalidated if the other does, else pending."""
    last = process.groupBy(*by).agg(F.max_by(F.struct("log_wealth", "log_wealth_drift"), "n").alias("s"))
    level = F.log(F.lit(1 / alpha))
    decision = F.when(F.col("s.log_wealth_drift") >= level, "quarantined").when(F.col("s.log_wealth") >= level, "revalidated").otherwise("pending")
    return last.select(*by, decision.alias("decision"), F.col("s.log_wealth").alias("log_wealth"), F.col("s.log_wealth_drift").alias("log_wealth_drift"))


def combined_e_value(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the e-values; 1 without any."""
    return states.groupBy(*by).agg(F.coalesce(F.avg(F.exp("log_wealth")), F.lit(1.0)).alias("e_value"))


def exact_ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """Decimal ratio, half-even; 1 where there is nothing to miss."""
    r = part.cast("decimal(18,0)") / whole.cast("decimal(18,0)")
    return F.when(whole == 0, F.lit(1).cast(f"decimal(20,{places})")).otherwise(F.bround(r.cast("decimal(30,12)"), places).cast(f"decimal(20,{places})"))


def fidelity(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates for each language. items: parsed, call_tp, call_fp, call_fn, pdg_tp, pdg_fn."""
    sums = items.groupBy(*by).agg(F.count("*").alias("files"), F.count_if("parsed").alias("files_parsed"), *(F.sum(c).alias(c) for c in ("call_tp", "call_fp", "call_fn", "pdg_tp", "pdg_fn")))
    c = F.col
    return sums.select(
        *by,
        exact_ratio(c("files_parsed"), c("files")).alias("parse_success_rate"),
        exact_ratio(c("call_tp"), c("call_tp") + c("call_fp")).alias("call_edge_precision"),
        exact_ratio(c("call_tp"), c("call_tp") + c("call_fn")).alias("call_edge_recall"),
        exact_ratio(c("pdg_tp"), c("pdg_tp") + c("pdg_fn")).alias("pdg_recall"),
    )


def gate(rates: DataFrame, gate_strength: Column) -> DataFrame:
    """rates with overall (GATE-PASS, GATE-FAIL, ungated) and the failing metrics in fixed order; a corpus below gate strength never passes, and lists what fails all the same."""
    failing = F.array_compact(F.array(*(F.when(F.col(m) < F.lit(t).cast("decimal(20,6)"), F.lit(m)) for m, t in GATE.items())))
    rows = rates.withColumn("failing", failing)
    overall = F.when(~gate_strength, "ungated").when(F.size("failing") > 0, "GATE-FAIL").otherwise("GATE-PASS")
    return rows.withColumn("overall", overall)


def reproduction_rate(first: DataFrame, second: DataFrame, places: int = 4) -> DataFrame:
    """Share of the first run's distinct rows that the second has, too; 1 for an empty first run."""
    a = first.distinct()
    both = a.join(second.distinct().withColumn("_in", F.lit(True)), first.columns, "left")
    return both.agg(exact_ratio(F.count_if("_in"), F.count("*"), places).alias("rate"))


def cells(rows: DataFrame, by: Sequence[str], outcome: str, values: Sequence[str]) -> DataFrame:
    """A count of each outcome and a total, in each cell."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(outcome) == v).alias(v) for v in values))


def regressions(current: DataFrame, reference: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cases that passed in the reference and don't now, missing ones among them."""
    now = current.where("passed").select(*key)
    return reference.where("passed").select(*key).join(now, list(key), "left_anti")


def status_table(gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Status of each stage from its languages' gates: without a verdict ungated; any verdict but a pass blocks (a recorded `ungated`, too); else ready if attested."""
    s = gates.groupBy(*by).agg(F.bool_or(F.col("verdict").isNull()).alias("open"), F.bool_or(F.col("verdict") != "GATE-PASS").alias("blocked"), F.bool_and(F.coalesce("attested", F.lit(False))).alias("attested"))
    status = F.when(F.col("open"), "ungated").when(F.col("blocked"), "front-end-blocked").when(F.col("attested"), "ready").otherwise("not-attested")
    return s.select(*by, status.alias("status"))

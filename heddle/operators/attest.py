"""Attestation: a scan is run twice; the core's rows must be the same, the oracle's are only measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.stats import reproduction_rate


def identical(first: DataFrame, second: DataFrame, parts: int | None = None) -> DataFrame:
    """One row: whether two tables have the same rows as often, and how many rows only one has. parts: how many tasks the rows are dealt to."""
    cols = first.columns
    both = first.withColumn("d", F.lit(1)).unionByName(second.withColumn("d", F.lit(-1)))
    odd = _dealt(both, cols, parts).groupBy(*cols).agg(F.sum("d").alias("d"))
    out = odd.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_second"))
    return out.withColumn("identical", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def _dealt(df: DataFrame, cols: list[str], parts: int | None) -> DataFrame:
    return df.repartition(parts, *cols) if parts else df


def attested(core: tuple[DataFrame, DataFrame], oracle: tuple[DataFrame, DataFrame], parts: int | None = None) -> DataFrame:
    """One row: identical, only_first, only_second of the core's runs, and the oracle's reproduction rate, which never decides."""
    first, second = (_dealt(df, oracle[0].columns, parts) for df in oracle)
    return identical(*core, parts).crossJoin(reproduction_rate(first, second).select(F.col("rate").alias("oracle_rate")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading bytes two binary columns share.

    Halves what is open each step, and compares only the half in question, so all steps together read each
    byte about once. 40 steps are enough for any length that a value can have.
    """
    most = F.least(F.octet_length(a), F.octet_length(b))
    start = F.struct(F.lit(0).alias("lo"), most.alias("hi"))

    def step(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        mid = F.floor((lo + hi + 1) / 2).cast("int")
        same = F.substring(a, lo + 1, mid - lo) == F.substring(b, lo + 1, mid - lo)
        moved = F.when(same, F.struct(mid.alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), (mid - 1).alias("hi")))
        return F.when(lo < hi, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.least(F.lit(40), F.ceil(F.log2(most + 1)).cast("int") + 1))
    return F.aggregate(steps, start, step, lambda s: s["lo"])


def differences(pairs: DataFrame, a: str, b: str, shown: int = 16) -> DataFrame:
    """pairs whose binary columns differ, with `offset` (of the first differing byte, or the shorter one's length), both lengths and the `shown` bytes there as hex."""
    x, y = F.col(a), F.col(b)
    rows = pairs.where(x != y).withColumn("offset", common_prefix(x, y))
    at = lambda c: F.hex(F.substring(c, F.col("offset") + 1, F.lit(shown)))
    return rows.withColumns({"first_length": F.octet_length(x), "second_length": F.octet_length(y), "first_bytes": at(x), "second_bytes": at(y)})

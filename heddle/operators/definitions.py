"""Definitions that reach uses, by the order of statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a group that are looked at together.
BLOCK = 1 << 16


def last_before(rows: DataFrame, by: Sequence[str], place: str, value: Column, name: str, first: Sequence[Column] = (), block: int = BLOCK) -> DataFrame:
    """rows with `name`: the last value of the group that isn't null in a row before this one, in order of `place` (a whole number, not null) and then of `first`.

    A group is cut into blocks of places, so that one with very many rows is many tasks: within a block a
    frame finds the value, and blocks without one before a row take the last of the blocks before, of which
    there is one row each.
    """
    rows = rows.withColumns({"_value": value, "_block": F.floor(F.col(place) / block)})
    order = [place, *first]
    inside = F.last("_value", ignorenulls=True).over(W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    last = F.max_by("_value", F.struct(place, *(c.alias(f"_k{i}") for i, c in enumerate(first))))
    ends = rows.where("_value IS NOT NULL").groupBy(*by, "_block").agg(last.alias("_last"))
    blocks = rows.groupBy(*by, "_block").agg(F.count("*")).drop("count(1)").join(ends, [*by, "_block"], "left")
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(*by, "_block", carried.alias("_carried"))
    out = rows.withColumn("_inside", inside).join(blocks, [*by, "_block"])
    return out.withColumn(name, F.coalesce("_inside", "_carried")).drop("_value", "_block", "_inside", "_carried", "_last")


def data_dependences(refs: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(by..., from_line, to_line, var): each use and the line of the latest definition of its name before it.

    refs: by... (the procedure), var, place (the statement's number), line, is_def. A statement's uses come before its own
    definitions; a use on the line of the definition isn't told, nor is one without any.
    """
    names = [*by, "var"]
    distinct = refs.select(*names, "place", "line", "is_def").distinct()
    found = last_before(distinct, names, "place", F.when(F.col("is_def"), F.col("line")), "from_line", [F.col("is_def").cast("int")], block)
    uses = found.where("NOT is_def AND from_line IS NOT NULL AND from_line <> line")
    return uses.select(*by, "from_line", F.col("line").alias("to_line"), "var")


def control_dependences(statements: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., from_line, to_line): statements and the line of the test that they stand under. statements: by..., line, control (null: none)."""
    return statements.where("control IS NOT NULL").select(*by, F.col("control").alias("from_line"), F.col("line").alias("to_line"))

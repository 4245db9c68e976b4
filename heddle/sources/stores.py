"""Where artifacts live: partitioned Parquet keyed by tenant, and small catalogues read on the driver."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.framing import held_out, row_id

KEYS = ("org_id", "codebase_id", "commit_sha", "env_digest")
# What keys look like.
SHAPES = {"org_id": r"[0-9a-f-]{36}", "codebase_id": r"[0-9a-f-]{36}", "commit_sha": r"[0-9a-f]{40}", "env_digest": r"[0-9a-f]{64}"}


def guarded(**keys: str) -> dict[str, str]:
    """Keys that are what they should be; nothing else gets into a path."""
    for k, v in keys.items():
        if k not in SHAPES or not re.fullmatch(SHAPES[k], v):
            raise ValueError(f"not a {k}")
    return keys


def put(rows: DataFrame, root: str, **keys: str) -> None:
    """Writes one artifact's rows under its keys."""
    for k, v in guarded(**keys).items():
        rows = rows.withColumn(k, F.lit(v))
    rows.write.mode("append").partitionBy(*keys).parquet(root)


def get(spark: SparkSession, root: str, **keys: str) -> DataFrame:
    """Rows under the keys given; partitions of other keys aren't listed."""
    rows = spark.read.parquet(root)
    for k, v in guarded(**keys).items():
        rows = rows.where(F.col(k) == v)
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled functions of a CSV file (commit_sha, file_path, func_name, cwe, positive, language, class) with a row id; a quotation mark inside quotes is doubled."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').schema("commit_sha string, file_path string, func_name string, cwe string, positive string, language string, class string").csv(path)
    return rows.withColumn("row_id", row_id("case:", F.col("commit_sha"), F.col("file_path"), F.col("func_name")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each part's ids, joined by newlines, as they come in order; no more than a batch is held."""
    done, now, first = [], None, True
    for batch in batches:
        for part, name in zip(batch["held_out"].to_pylist(), batch["row_id"].to_pylist(), strict=True):
            if now is None or now[0] != part:
                now, first = (part, hashlib.sha256()), True
                done.append(now)
            if name is not None:
                now[1].update(name.encode() if first else b"\n" + name.encode())
                first = False
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.bool_()), pa.array([h.hexdigest() for _, h in done], pa.string())], ["held_out", "ids_sha256"])


def splits(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held out, training, digest of each part's sorted ids) of rows with row_id; the parts never share a row."""
    marked = rows.withColumn("held_out", held_out(F.col("row_id")))
    # a digest reads its ids in order, in one task; they get there as 16 bytes each, where they are what `read_corpus` makes
    id_ = F.col("row_id")
    code = F.when(id_.rlike("^case:[0-9a-f]{32}$"), F.unhex(F.substring(id_, 6, 32)))
    ids = marked.select("held_out", code.alias("code"), F.when(code.isNull(), id_).alias("other")).distinct().repartition("held_out")
    ids = ids.select("held_out", F.coalesce("other", F.concat(F.lit("case:"), F.lower(F.hex("code")))).alias("row_id"))
    digest = ids.sortWithinPartitions("held_out", "row_id").mapInArrow(_digests, "held_out boolean, ids_sha256 string")
    return marked.where("held_out"), marked.where("NOT held_out"), digest

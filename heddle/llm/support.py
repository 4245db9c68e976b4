"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id stands after all others.
LAST_ID = (1 << 63) - 1
#: Rows that a Python worker hands back to Spark at once; bounds memory when texts are long.
OUT_ROWS = 512


#: Rows of an Arrow batch on the way to Python, where the session has Spark's own 10,000: long texts make those too large.
BATCH_ROWS = "1000"


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only: the machines of a cluster don't share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="heddle-")
        shared_dir.own = where
    return where.rstrip("/")


#: Paths of the tables that each open scope has written.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that are written inside it, but for those written with `outside`: what comes after must read only these."""
    mine: list[tuple[SparkSession, str]] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for spark, path in mine:
            _drop(spark, path)


def stored(df: DataFrame, tag: str, outside: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, so that a lost executor costs no rerun of what came before."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    if _SCOPES and not outside:
        _SCOPES[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where written tables are, as long as somebody holds them.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, such as the rounds of a loop."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            _drop(t.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended: the cluster owns the folder
        pass


def text_tag(column: str) -> Column:
    """128 bits that tell a text; null: as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a string column, over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def pieces(n_bytes: int, target: int, least: int = 1) -> int:
    """How many groups of about `target` bytes n_bytes make."""
    return max(least, math.ceil(n_bytes / target))


def parallelism(spark: SparkSession) -> int:
    """Groups at least, so that small inputs use the whole cluster, too."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rows_out(schema: pa.Schema, rows: Iterator[tuple], size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples in the schema's order as record batches of at most `size` rows."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _batch(schema, part)
            part = []
    if part:
        yield _batch(schema, part)


def _batch(schema: pa.Schema, part: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*part, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, fn: Callable[..., tuple], arrow: pa.Schema, spark_schema: str) -> DataFrame:
    """fn(*values of a row) -> a row of the result, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for i in range(0, b.num_rows, OUT_ROWS):
                    part = b.slice(i, OUT_ROWS)
                    for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        yield fn(*row)

        return rows_out(arrow, each())

    return df.mapInArrow(run, spark_schema)

"""Reading tables, and writing the state of a fixpoint between its rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table for each task where tasks hold what they get.
TASK_ROWS = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """How many tasks that many rows are dealt to, so that a task's share stays the same on larger tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode only: the machines of a cluster don't share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="heddle-")
        shared_folder.own = where
    return where.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """df as a written table, and its rows (those of `which`), which are counted on the way: the lineage ends here, and a lost executor costs no earlier round."""
    table, (n,) = counted(df, F.lit(True) if which is None else which)
    return table, n


def counted(df: DataFrame, *which: Column) -> tuple[DataFrame, list[int]]:
    """The same with a number of rows for each of `which`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, *(F.count_if(w).alias(f"n{k}") for k, w in enumerate(which))).write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out, [rows.get[f"n{k}"] for k in range(len(which))]


#: Where written tables are, as long as somebody holds them.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            _remove(t.sparkSession, path)


def materialized(df: DataFrame) -> DataFrame:
    return written(df)[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def together(spark: SparkSession, *work: Callable[[], Any]) -> list[Any]:
    """What each of `work` gives. Their jobs run at the same time: the jobs of a round leave most cores idle."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Found:
    """What the rounds of a fixpoint have found, in a few written tables.

    A round adds one. Beyond MOST tables the later ones are rewritten as one, and the first with them once they
    have as many rows, so a row is rewritten about as often as the whole doubles, and what each round
    has to read stays a few files' worth, however many rounds there are.
    """

    MOST = 8

    def __init__(self) -> None:
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, table: DataFrame, rows: int) -> None:
        """table: a written one, distinct from all before. What `all` gave before may not be read after this: the tables may be gone."""
        if len(self.parts) >= self.MOST:
            later = sum(n for _, n in self.parts[1:])
            keep = 0 if later >= self.parts[0][1] else 1
            # the newest is the frontier that the next round still reads
            old, newest = self.parts[keep:-1], self.parts[-1:]
            merged = written(union_all([t for t, _ in old]))
            forget(*(t for t, _ in old))
            self.parts = [*self.parts[:keep], merged, *newest]
        self.parts.append((table, rows))

    def all(self) -> DataFrame:
        return union_all([t for t, _ in self.parts])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row in the order of all rows, from 0; the columns must tell all rows apart.

    Rows are sorted in ranges, and each range's places begin after those of the ranges before: only the
    ranges' sizes come to the driver, and no task sees more than its range.
    """
    ranges = materialized(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted((r["p"], r["count"]) for r in ranges.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    start = F.create_map(*starts)[part] if starts else F.lit(0)
    return ranges.withColumn(name, (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id")

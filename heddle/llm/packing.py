"""Best-fit packing into bins of several permitted lengths.

Documents' lengths are in byte-level tokens: the UTF-8 bytes and one token for the end. A document
longer than the largest capacity is cut into pieces of that capacity and a rest; every other one is a
piece. Pieces are dealt by hash into groups of about GROUP_TOKENS (a piece counts ROW_TOKENS more, so groups of
tiny pieces stay small, too), and each group is packed by itself:

* longest first, a piece goes to the open bin that it leaves least room in (the older one of equals);
* where none has room, the bin size that costs least for what it can still hold is opened: cost(c) over
  min(c, tokens of the group that have no place yet), among the sizes that the piece fits;
* in the end each bin is cut down to the smallest permitted size that holds its contents.

cost(c) = PER_BIN + c + c * c / QUADRATIC: a fixed part, a token's work, and attention.

Rows with equal doc_id and text are counted before they are dealt, and travel as a row with their number, at
most SHARED_TOKENS of them together, so no group gets all of them.

Defined results: null and empty texts are one token; ties go by doc_id, then text hash; rows with equal
doc_id are packed each; the capacities must be positive and distinct.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.support import load, pieces

CAPACITIES = (2_048, 8_192, 32_768)
PER_BIN = 64.0
QUADRATIC = 262_144.0
GROUP_TOKENS = 32 << 20
ROW_TOKENS = 32
SHARED_TOKENS = 1 << 20


def cost(capacity: int) -> float:
    return PER_BIN + capacity + capacity * capacity / QUADRATIC


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, offset in it, its final capacity) of each length, none above the largest capacity; lengths from the longest on."""
    sizes = sorted(capacities)
    costs = [cost(c) for c in sizes]
    room: dict[int, list[int]] = {}  # free tokens -> a heap of bins
    free = 0  # bit r is set where a bin has r free tokens
    used: list[int] = []
    out: list[tuple[int, int]] = []
    left = sum(lengths)
    for n in lengths:
        if fits := free >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = heappop(room[r])
            if not room[r]:
                free &= ~(1 << r)
        else:
            _, r = min((c / min(s, left), s) for c, s in zip(costs, sizes, strict=True) if s >= n)
            b = len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        left -= n
        if r > n:
            heappush(room.setdefault(r - n, []), b)
            free |= 1 << (r - n)
    final = [next(s for s in sizes if s >= u) for u in used]
    return [(b, at, final[b]) for b, at in out]


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("grp", pa.int64()), ("bin", pa.int64()), ("capacity", pa.int64()), ("offset", pa.int64())])
OUT = "doc_id bigint, piece bigint, start bigint, length bigint, grp bigint, bin bigint, capacity bigint, offset bigint"


def _pack(capacities: tuple[int, ...]):
    def run(key, table):
        table = table.take(np.repeat(np.arange(table.num_rows), table["copies"].to_numpy()))
        length, doc, piece = table["length"].to_numpy(), table["doc_id"].fill_null(-(1 << 63)).to_numpy(), table["piece"].to_numpy()
        order = np.lexsort((piece, table["tie"].to_numpy(), doc, -length))
        table = table.take(order)
        bins, offsets, final = zip(*pack(length[order].tolist(), capacities), strict=True)
        own = {"grp": pa.array([key[0].as_py()] * len(order), pa.int64()), "bin": pa.array(bins, pa.int64()), "capacity": pa.array(final, pa.int64()), "offset": pa.array(offsets, pa.int64())}
        return pa.Table.from_arrays([own[f.name] if f.name in own else table[f.name] for f in _OUT], schema=_OUT)

    return run


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """A row for each piece of docs (doc_id, text): the piece's place in its text and its bin (grp, bin), that bin's capacity and the offset in it."""
    if len(set(capacities)) < len(capacities) or min(capacities) < 1:
        raise ValueError("capacities must be positive and distinct")
    most = max(capacities)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long"), size.alias("size"), F.xxhash64("text").alias("tie"))
    total = rows.agg(F.sum(F.col("size") + ROW_TOKENS).alias("n")).first()["n"] or 0
    equal = rows.groupBy("doc_id", "tie", "size").agg(F.count("*").alias("n"))
    most_equal = F.greatest(F.lit(1), F.least(F.lit(SHARED_TOKENS // 256), F.floor(SHARED_TOKENS / F.col("size")))).cast("long")
    equal = equal.withColumn("together", most_equal).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("together")).cast("long"))))
    equal = equal.withColumn("copies", F.least("together", F.col("n") - F.col("share") * F.col("together")))
    cut = equal.select("doc_id", "tie", "size", "copies", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / most).cast("long"))).alias("piece"))
    cut = cut.select("doc_id", "tie", "copies", "share", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("size") - F.col("piece") * most).alias("length"))
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "tie", "piece", "share"), F.lit(pieces(total, GROUP_TOKENS))).cast("long")
    return cut.withColumn("grp", group).groupBy("grp").applyInArrow(_pack(tuple(capacities)), OUT)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of CAPACITIES."""
    return packed(load(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit": op6_best_fit}
ORACLES: dict[str, str] = {}

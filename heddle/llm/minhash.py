"""Document fingerprints by one-permutation MinHash.

Each distinct shingle of five words (ASCII white space parts words, A-Z is lowered) is hashed once. The
hash's high part picks one of BINS bins, in which the least low part stays. An empty bin copies another
bin by optimal densification: a hash of (bin, attempt) names bins until one is filled, so that empty
bins draw from all filled ones alike and equal sets fill alike. Of each bin the low BITS bits are
packed. Unequal bins agree by chance with C = 2**-BITS, so a share p of agreeing bins estimates the
likeness (p - C) / (1 - C), held to [0, 1].

Defined results: a text of fewer than five words is one shingle; a null, empty or white text has no
shingles and an empty fingerprint, which is like another empty one (1.0) and unlike all others (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.support import load, pieces, rows_out, total_bytes

SHINGLE = 5
BINS = 512
BITS = 4
PART_BYTES = 8 << 20
#: Ranges at most; a range is read as a stream, so its size bounds no memory.
MAX_PARTS = 20_000

_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of `size` words, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.dtype(">u8")).astype(np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _STEP + h[k : k + n]
    return mix(out + np.uint64(size))


_ATTEMPTS: dict[int, np.ndarray] = {}


def _attempts(bins: int, block: int) -> np.ndarray:
    """Bins that attempts 64 * block ... of each bin name."""
    if (key := bins << 20 | block) not in _ATTEMPTS:
        at = np.arange(bins, dtype=np.uint64)[:, None] << np.uint64(32) | (np.arange(64, dtype=np.uint64) + np.uint64(64 * block))
        _ATTEMPTS[key] = (mix(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)
    return _ATTEMPTS[key]


def densified(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Values of all bins, the empty ones copied from filled ones."""
    out, left, block, bins = least.copy(), np.flatnonzero(~filled), 0, len(least)
    if filled.sum() == 1:
        return np.full(bins, least[filled][0])
    while len(left):
        names = _attempts(bins, block)[left]
        hit = filled[names]
        found = hit.any(1)
        out[left[found]] = least[names[found, hit[found].argmax(1)]]
        left, block = left[~found], block + 1
    return out


def fingerprint(text: bytes | None, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> bytes:
    """bins * bits / 8 bytes, or none for a text without words."""
    h = shingle_hashes(text, size)
    if not len(h):
        return b""
    bin_ = (h >> np.uint64(40)).astype(np.int64) % bins
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bin_, h & np.uint64((1 << 40) - 1))
    values = densified(least, least != np.iinfo(np.uint64).max)
    low = (mix(values) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimate of the Jaccard likeness of two texts' shingles, corrected for chance agreement."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (1 - x.any(1).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """All rows and columns of docs, and `fingerprint` (binary)."""
    at, names = docs.columns.index(column), [*docs.columns, "fingerprint"]
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.BinaryType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(_bytes(t)) for t in b.column(at).to_pylist()], pa.binary())], names=names)

    return docs.mapInArrow(run, schema)


def _bytes(t) -> bytes:
    return t.encode() if isinstance(t, str) else t or b""


# ---- each document, its edited text and the next document


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, n_parts: int) -> DataFrame:
    """Rows dealt into ranges of descending doc_id, each range followed by a copy (`extra`) of the row that comes next.

    Ranges are cut at approximate quantiles of doc_id. To the driver come the cuts and each range's
    largest doc_id, as many values as ranges. After the last row comes the first.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [k / n_parts for k in range(1, n_parts)], 0.25 / n_parts)}) if n_parts > 1 else []
    part = F.lit(0)
    if cuts:  # how many cuts lie at or above doc_id: the ranges are numbered downward
        step = max(1, int(len(cuts) ** 0.5))
        blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
        below = F.size(F.filter(F.lit([b[-1] for b in blocks]).cast("array<bigint>"), lambda c: c < F.col("doc_id")))  # whole blocks
        block = F.get(F.array(*(F.lit(b).cast("array<bigint>") for b in blocks)), below)
        inside = F.coalesce(F.size(F.filter(block, lambda c: c >= F.col("doc_id"))), F.lit(0))
        part = F.greatest(F.lit(0), F.lit(len(cuts)) - (below + 1) * step) + F.greatest(F.lit(0), inside)
    docs = docs.withColumn("part", part.cast("int"))
    tops = {r["part"]: r["top"] for r in docs.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)  # from the largest ids on
    rows = docs.withColumn("extra", F.lit(False))
    if order:
        # the first row of each range, once more at the end of the one before it
        before = F.create_map(*(F.lit(int(x)) for i, p in enumerate(order) for x in (p, order[i - 1])))
        heads = docs.where(F.col("doc_id").isin([int(t) for t in tops.values()]))
        heads = heads.groupBy("doc_id", "part").agg(F.min("no_id").alias("no_id"), F.min("text").alias("text"))
        heads = heads.select("doc_id", "no_id", "text", before[F.col("part")].cast("int").alias("part"), F.lit(True).alias("extra"))
        rows = rows.unionByName(heads)
    # the extra row of a range has a smaller id, but for the last range, where `extra` sorts it to the end
    return rows.repartition(max(1, len(order)), "part").sortWithinPartitions("part", "extra", F.desc("doc_id"), "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        last = None
        for b in batches:
            for doc_id, no_id, text, part, extra in zip(*(c.to_pylist() for c in b.select(["doc_id", "no_id", "text", "part", "extra"]).columns), strict=True):
                fp = fingerprint(text.encode())
                if last and last[0] == part:
                    _, i, before, fp0 = last
                    new = edited(before, text)
                    fp1 = fp0 if new == before else fingerprint(new.encode())
                    yield i, len(before), hashlib.sha256(new.encode()).hexdigest(), fp0.hex(), fp1.hex(), likeness(fp0, fp1), likeness(fp0, fp)
                last = None if extra else (part, None if no_id else doc_id, text, fp)

    return rows_out(_OUT, rows())


def compared(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text), in order of descending doc_id (null: last; equal ids: by text)."""
    n = min(MAX_PARTS, pieces(total_bytes(docs, "text"), PART_BYTES))
    return neighbours(docs, n).mapInArrow(_compare, OUT)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, compared with their edited texts' and the next documents'."""
    return compared(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_minhash": op5_minhash}
ORACLES: dict[str, str] = {}

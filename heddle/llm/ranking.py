"""Ranked lexical search over document shards.

An index row is one shard: some documents in CSR form, term by term, with the integer impact of each
posting worked out beforehand. A search reads each shard once: term at a time it adds weight times impact into
a dense accumulator of the shard's documents, takes the best by argpartition with all that tie with the
last of them, and the shards' best are merged. Nothing is shuffled but those.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z is lowered. With N
documents that have a term, L their terms in all, n a document's, df a term's documents, tf its occurrences:

    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m      = 100 - 75 + (75 * n * N) div L
    impact = (1000000000 * tf) div (1000 * tf + 8 * m)

Defined results: a null or empty text has no terms, is in no ranking and counts in no total; a query without
terms has no rows. Equal scores go by doc_id, a null one last; rows that share a doc_id are documents of their own. Queries
are told apart by (item_id, text), so an equal row adds none. A text of any length is read whole; one above SHARD_BYTES is a shard by itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.support import LAST_ID, load, pieces, rows_out, stored, total_bytes

#: Text of a shard, about, and its documents at most.
SHARD_BYTES = 4 << 20
SHARD_DOCS = 1 << 16
#: Text of the queries that are searched together, about.
QUERY_BYTES = 4 << 20
#: Groups in which the shards' best of a query are merged before they meet.
MERGES = 32

_IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and _IS_TERM[b] else b if b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Ids(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


# ---- totals


def _lengths(texts: pa.Array) -> np.ndarray:
    """Terms of each text, counted where runs begin."""
    out = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t.is_valid and (buffer := t.as_buffer()) and buffer.size:
            inside = _IS_TERM[np.frombuffer(buffer, np.uint8)]
            out[i] = np.count_nonzero(inside[1:] & ~inside[:-1]) + int(inside[0])
    return out


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            found = _lengths(b.column(0))
            n, total = n + int(np.count_nonzero(found)), total + int(found.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["docs", "terms"])

    counts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "docs bigint, terms bigint")
    row = counts.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


# ---- the index

#: doc_ids: int64; terms: joined by spaces, which no term has; ends: where each term's postings end (int64); docs, impacts: int32.
INDEX = "doc_ids binary, terms binary, ends binary, docs binary, impacts binary"
_INDEX = pa.schema([(n, pa.binary()) for n in ("doc_ids", "terms", "ends", "docs", "impacts")])


def shard(ids: list[int], texts: list[bytes | None], n_docs: int, n_terms: int) -> tuple | None:
    """The index row of these documents; none if they have no terms. n_docs, n_terms: the totals of all documents."""
    known, kept, found, lengths = Ids(), [], [], []
    for i, t in zip(ids, texts, strict=True):
        if own := terms(t):
            kept.append(i)
            lengths.append(len(own))
            found.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
    if not kept:
        return None
    doc = np.repeat(np.arange(len(kept)), lengths)
    posting, tf = np.unique(np.concatenate(found) * len(kept) + doc, return_counts=True)
    term, doc = np.divmod(posting, len(kept))
    m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths], np.int64)
    impact = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf + 8 * m[doc])
    ends = np.cumsum(np.bincount(term, minlength=len(known)))
    return np.array(kept, np.int64).tobytes(), b" ".join(known), ends.astype(np.int64).tobytes(), doc.astype(np.int32).tobytes(), impact.astype(np.int32).tobytes()


def index(docs: DataFrame) -> DataFrame:
    """The shards of all documents (doc_id, text), as a written table."""
    n_docs, n_terms = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            ids, texts, size = [], [], 0
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text = t.as_py()
                    ids.append(i)
                    texts.append(text)
                    size += len(text or b"")
                    if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                        if row := shard(ids, texts, n_docs, n_terms):
                            yield row
                        ids, texts, size = [], [], 0
            if ids and (row := shard(ids, texts, n_docs, n_terms)):
                yield row

        return rows_out(_INDEX, rows(), 1)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.col("text").cast("binary"))
    return stored(rows.mapInArrow(run, INDEX), "postings")


# ---- the search


def document_counts(shards: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents have each of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for words, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = np.diff(np.frombuffer(ends, np.int64), prepend=0)
                counts.update({w: int(n[k]) for k, w in enumerate(words.split(b" ")) if w in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    found = shards.select("terms", "ends").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by id: what ties with the k-th is taken before it is ordered."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        kth = scores[at[np.argpartition(scores[at], len(at) - k)[len(at) - k]]]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _scored(queries: list[list[tuple[bytes, int]]], k: int):
    """The best k of a task's shards for each query: rows of (query, doc_id, score)."""
    wanted = {t for q in queries for t, _ in q}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for b in batches:
            for ids, words, ends, docs, impacts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, docs, impacts = np.frombuffer(ids, np.int64), np.frombuffer(docs, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64)
                ends = np.frombuffer(ends, np.int64)
                at = {w: (int(ends[i - 1]) if i else 0, int(ends[i])) for i, w in enumerate(words.split(b" ")) if w in wanted}
                for q, asked in enumerate(queries):
                    total = np.zeros(len(ids), np.int64)
                    for t, weight in asked:
                        if t in at:
                            s = slice(*at[t])
                            total[docs[s]] += weight * impacts[s]  # a term has a document once
                    found = best(total, ids, k)
                    score, doc = np.concatenate((top[q][0], total[found])), np.concatenate((top[q][1], ids[found]))
                    merged = best(score, doc, k)
                    top[q] = score[merged], doc[merged]
        for q, (score, doc) in enumerate(top):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), q)), pa.array(doc), pa.array(score)], names=["query", "doc_id", "score"])

    return run


def search(shards: DataFrame, items: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents; items: item_id, text; n_docs: documents that have a term.

    Items are searched in blocks of about QUERY_BYTES of text, which is what the driver and each task hold
    of them; each block reads the index once for its terms' document counts and once for scores.
    """
    spark = shards.sparkSession
    items = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    n = pieces(total_bytes(items, "text"), QUERY_BYTES)
    out = [spark.createDataFrame([], items.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))]
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        rows = [(r["item_id"], Counter(terms(r["text"]))) for r in rows]
        counts = document_counts(shards, {t for _, c in rows for t in c})
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in counts.items()}
        queries = [[(t, c * weights[t]) for t, c in asked.items() if t in weights] for _, asked in rows]
        named = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(rows)], items.select(F.lit(0).cast("long").alias("query"), "item_id").schema)
        found = shards.mapInArrow(_scored(queries, k), "query bigint, doc_id bigint, score bigint").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
        by = [F.desc("score"), F.asc("doc_id")]
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*by))).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by))).where(F.col("rank") <= k)
        out.append(found.join(F.broadcast(named), "query").select("item_id", "rank", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, out)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Indexes docs (doc_id, text) and searches them for items (item_id, text)."""
    shards = index(docs)
    n = shards.agg(F.sum(F.octet_length("doc_ids") / 8).cast("long").alias("n")).first()["n"] or 0
    return search(shards, items, n, k)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, {_SQL_TERMS.format("text")} AS t FROM documents),
s AS MATERIALIZED (SELECT count(*) AS nd, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT k, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT k, doc_id, t, unnest(t) AS term FROM d) GROUP BY k, doc_id, len(t), term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_SQL_TERMS.format("text")}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, nd),
scores AS (
  SELECT item_id, k, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, k, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {"op12_ranked_search": _SQL}

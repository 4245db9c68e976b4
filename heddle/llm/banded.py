"""Near-duplicates by one-permutation MinHash in bands, and exact links.

A set is the distinct runs of `size` words of a text (A-Z lowered, ASCII white space parts words). Its
signature (one hash of each shingle, BINS bins, empty ones filled by optimal densification) is cut into
bands of ROWS bins; sets that agree in a band share a bucket. A bucket gives a star: an edge from each
set to its least one, so it has fewer edges than sets. Stars say only which sets stand together: the
edges are judged on the full sets, and `simhash.linked_sets` then finds, on the full sets as well, the further
links among all sets that edges connect, so that links between two tips of a star aren't lost.

With 54 bands of 7 bins two sets exactly at 0.85 share no bucket with a chance of about 10^-9 (in short
texts, where few bins are filled by shingles of their own, some 10^-4); all links between sets that share one are found.

Equal sets are one node throughout, so a group of copies weighs as much as one document. Buckets are found
by counting and by joins on the bucket, which Spark can split; no task has to hold a bucket.

Defined results: a text with fewer words than a shingle is one shingle of all of them; a null, empty or white
text has no set, n_shingles 0, and is linked with nothing. A null doc_id comes after all others (component_id
is null only where all ids of a component are); rows that share a doc_id are judged each by its own
text. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.minhash import densified, mix
from heddle.llm.simhash import linked_sets, shingle_set, shingle_sets, spread
from heddle.llm.support import LAST_ID, load, map_rows, stored, text_tag

SHINGLE = 5
LIKENESS = 0.85
ROWS = 7
BANDS = 54

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands(hashes: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64 bits for each band of a set that isn't empty."""
    bins = n_bands * rows
    at = (hashes >> np.uint64(40)).astype(np.int64) % bins
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at, hashes & np.uint64((1 << 40) - 1))
    value = densified(least, least != np.iinfo(np.uint64).max).reshape(n_bands, rows)
    out = np.arange(n_bands, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * _STEP + value[:, k])
    return out


def signatures(docs: DataFrame, size: int, n_bands: int, rows: int) -> DataFrame:
    """id, tag, node (digest of the set), n_shingles, bands (8 bytes each) of every row of docs (id, tag, text)."""

    def one(id_, tag, text):
        found = shingle_set(text, size)
        return id_, tag, xxhash.xxh128_digest(found.tobytes()), len(found), bands(found, n_bands, rows).tobytes() if len(found) else b""

    arrow = pa.schema([("id", pa.int64()), ("tag", pa.binary()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.binary())])
    return map_rows(docs.select("id", "tag", F.col("text").cast("binary")), one, arrow, "id bigint, tag binary, node binary, n_shingles bigint, bands binary")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 4096):
            node, raw = batch.slice(s, 4096).columns
            key = np.frombuffer(b"".join(raw.to_pylist()), np.int64)
            each = len(key) // len(node)
            yield pa.RecordBatch.from_arrays([pa.array(key), node.take(pa.array(np.repeat(np.arange(len(node)), each)))], names=["bucket", "node"])


def star_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): each node (node, bands) with the least one of each of its buckets, where that is another."""
    rows = nodes.select("node", "bands").mapInArrow(_buckets, "bucket bigint, node binary")
    centre = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    return rows.join(centre, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def near_sets(docs: DataFrame, size: int = SHINGLE, likeness: float = LIKENESS, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links of at least `likeness` reach) and kept for each row of docs (doc_id, text)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_tag("text").alias("tag"), "text")
    of = stored(signatures(docs, size, n_bands, rows), "signatures")
    full = of.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min(F.struct("id", "tag")).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("node", "first.id", "first.tag", "bands", "copies"), "nodes")
    pairs = stored(star_edges(nodes), "stars")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(shingle_sets(docs, nodes.join(wanted, "node").select("node", "id", "tag"), size), "sets")
    labels = linked_sets(pairs, sets, likeness)
    least = labels.join(nodes.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("copies"))
    component = spread(labels, "label", stored(least, "least"), "component").select("node", "component")
    each = stored(nodes.join(component, "node", "left").select("node", "copies", F.coalesce("component", "id").alias("component")), "components")
    out = spread(full.select("id", "node", "n_shingles"), "node", each, "component")
    out = out.select("id", "n_shingles", "component").unionByName(of.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component")))
    known = [F.when(F.col(c) != LAST_ID, F.col(c)).alias(n) for c, n in (("id", "doc_id"), ("component", "component_id"))]
    return out.select(known[0], "n_shingles", known[1], (F.col("id") == F.col("component")).alias("kept"))


def op13_banded_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of links at a likeness of 0.85 or more over all documents."""
    return near_sets(load(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM spots),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.other FROM reach r JOIN (SELECT a AS node, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id GROUP BY d.doc_id, n
"""

QUERIES = {"op13_banded_minhash": op13_banded_minhash}
ORACLES = {"op13_banded_minhash": _SQL}

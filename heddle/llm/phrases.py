"""Phrase collocation mining by hashed bucket counts (PCY, DHP) with Apriori pruning.

Phrases of 1 to MOST words are counted pass by pass. While a pass counts its phrases exactly, it also counts
the phrases of one word more in hashed buckets; the next pass counts a phrase only if

* its bucket reached `least` (a bitmap, broadcast),
* its two parts that lack one word are frequent (a second bitmap, of the exact counts before).

Both bitmaps have one bit a bucket, MAX_BUCKETS / 8 bytes at most however large the input; what passes
them is counted exactly, by its words, so collisions cost work and no result. A task sums what it has
read before anything is shuffled, buckets hold no more than `least`, and no phrase, however frequent, has
more rows than tasks.

Everything is per language (null: `und`). Texts are lowered in A-Z and split at . , ; : ! ? and
line ends into pieces, and these at spaces and tabs into words; no phrase crosses a piece.

Defined results: null, empty and white texts have no words; repeated rows count each; an empty table
gives no phrases. Texts of any length are read whole: a task holds about CHUNK_BYTES of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.minhash import mix
from heddle.llm.support import forget, load, parallelism, stored, total_bytes

MOST = 5
LEAST = 100
TOP = 2000
CHUNK_BYTES = 8 << 20
#: Text for each bucket, about; buckets are a power of two.
BYTES_PER_BUCKET = 128
MIN_BUCKETS, MAX_BUCKETS = 1 << 16, 1 << 26
#: Buckets that travel in one row.
BLOCK = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(ord(".") if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words, and a full stop between pieces (no word has one)."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


class _Words(dict):
    """Numbers words as they come; the full stop is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _hashes(words: _Words, lang: str) -> np.ndarray:
    """64 bits for each word, by its number."""
    seed = _seed(lang)
    return np.frombuffer(b"".join(xxhash.xxh64_digest(w, seed) for w in words), ">u8").astype(np.uint64)


def _grown(shorter: np.ndarray, single: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words that begin at each place, from those of k - 1 words and of words."""
    n = max(0, len(single) - k + 1)
    return mix(shorter[:n] * _STEP + single[k - 1 : k - 1 + n])


class _Buckets:
    """Counts up to `least`."""

    def __init__(self, size: int, least: int):
        self.size, self.least = size, least
        self.n = np.zeros(size, np.uint8 if least < 256 else np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        for s in range(0, len(hashes), 1 << 20):
            at, n = np.unique((hashes[s : s + (1 << 20)] & np.uint64(self.size - 1)).astype(np.uint32), return_counts=True)
            self.n[at] = np.minimum(self.n[at].astype(np.int64) + n, self.least)

    def rows(self) -> Iterator[tuple]:
        for s in range(0, self.size, BLOCK):
            if (part := self.n[s : s + BLOCK]).any():
                yield None, None, None, s // BLOCK, part.tobytes()


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
PASS = "lang string, phrase binary, n bigint, block int, counts binary"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PASS, strict=True)], schema=_PASS)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= (64 if r[4] is not None else 20_000):
            yield _record(held)
            held = []
    if held:
        yield _record(held)


def _distinct(words: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase of k words that begins at one of `at`, and how many do."""
    order = np.argsort(hashes)
    at, hashes = at[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    n = np.diff(np.append(first, len(at)))
    like = np.repeat(at[first], n)
    if all(np.array_equal(words[at + j], words[like + j]) for j in range(k)):
        return at[first], n
    # two phrases of one hash: by their words
    _, first, n = np.unique(np.stack([words[at + j] for j in range(k)], 1), axis=0, return_index=True, return_counts=True)
    return at[first], n


def _counted(k: int, size: int, least: int, crowded, frequent):
    """Rows of exact counts of phrases of k words, and of bucket counts of those of k + 1 words (k < MOST)."""

    def phrases(text: bytes, lang: str, buckets: _Buckets | None) -> Iterator[tuple]:
        found, number = tokens(text), _Words()
        words = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
        single = _hashes(number, lang)[words]
        # whether each place begins a phrase that stays in its piece and may be frequent
        live = words > 0
        if k == 1:
            for w, n in zip(number, np.bincount(words, minlength=len(number)).tolist(), strict=True):
                if n and w != b".":
                    yield lang, w, n, None, None
            h = single
        else:
            h = single
            for j in range(2, k):
                h = _grown(h, single, j)
            shorter, h = h, _grown(h, single, k)
            inside = live[: len(h)].copy()
            for j in range(1, k):
                inside &= live[j : j + len(h)]
            at = np.flatnonzero(inside)
            at = at[_has(crowded.value, h[at])]
            at = at[_has(frequent.value, shorter[at])]
            at = at[_has(frequent.value, shorter[at + 1])]
            live = np.zeros(len(h), bool)
            live[at] = True
            if len(at):
                for i, n in zip(*(x.tolist() for x in _distinct(words, at, h[at], k)), strict=True):
                    yield lang, b" ".join(found[i : i + k]), n, None, None
        if buckets and len(single) > k:
            longer = _grown(h, single, k + 1)
            buckets.add(longer[live[: len(longer)] & live[1 : len(longer) + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(size, least) if k < MOST else None

        def rows() -> Iterator[tuple]:
            held: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if text.is_valid and (t := text.as_py()):
                        held.setdefault(lang, []).append(t)
                        sizes[lang] = sizes.get(lang, 0) + len(t)
                        if sizes[lang] >= CHUNK_BYTES or sum(sizes.values()) >= 2 * CHUNK_BYTES:
                            most = max(sizes, key=sizes.get)
                            del sizes[most]
                            yield from phrases(b".".join(held.pop(most)), most, buckets)
            for lang in list(held):
                yield from phrases(b".".join(held.pop(lang)), lang, buckets)
            if buckets:
                yield from buckets.rows()

        return _batches(rows())

    return run


def _bitmap(spark: SparkSession, blocks: DataFrame, size: int, least: int):
    """A broadcast bitmap of the buckets whose counts (block, counts) reach `least` together: size / 8 bytes, on the driver, too."""
    kind = np.uint8 if least < 256 else np.uint32

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, total = block, np.zeros(min(BLOCK, size), np.int64)
                total = np.minimum(total + np.frombuffer(counts.as_buffer(), kind), least)
        if now is not None:
            yield row()

    n = min(max(1, size // BLOCK), parallelism(spark))
    rows = blocks.select("block", "counts").repartition(n, "block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in rows.collect():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] * BLOCK // 8 : r["block"] * BLOCK // 8 + len(bits)] = bits
    return spark.sparkContext.broadcast(out)


def _marked(k: int, size: int, least: int):
    """Bucket rows that mark each of the phrases of k words given (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(size, least)
        for b in batches:
            of: dict[str, list[bytes]] = {}
            for lang, phrase in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of.setdefault(lang, []).append(phrase)
            for lang, phrases in of.items():
                number = _Words()
                words = np.array([number[w] for w in b" ".join(phrases).split(b" ")]).reshape(-1, k)
                single = _hashes(number, lang)[words]
                h = single[:, 0]
                for j in range(1, k):
                    h = mix(h * _STEP + single[:, j])
                buckets.n[(h & np.uint64(size - 1)).astype(np.int64)] = least
        yield from _batches(buckets.rows())

    return run


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of the phrases of 1 to `most` words that occur `least` times or more in their language, and (lang, n): all words of each.

    docs: lang, text. Both are written tables.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (total_bytes(docs, "text") // BYTES_PER_BUCKET).bit_length()))
    crowded = known = totals = None
    found = []
    for k in range(1, most + 1):
        counts = stored(docs.mapInArrow(_counted(k, size, least, crowded, known), PASS), f"phrases{k}")
        if k == 1:
            totals = stored(counts.where("block is null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        exact = counts.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        found.append(stored(exact.select("lang", "phrase", F.lit(k).alias("k"), "a"), "frequent"))
        if k < most:
            for old in (crowded, known):
                if old is not None:
                    old.unpersist()
            crowded = _bitmap(spark, counts.where("block is not null"), size, least)
            known = _bitmap(spark, found[-1].select("lang", "phrase").mapInArrow(_marked(k, size, least), PASS), size, least)
        forget(counts)
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("phrase", F.col("phrase").cast("string")), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of two words or more; docs: lang, text.

    A phrase's score is that of its worst cut: floor(1000 a n / (l r)) for l and r occurrences of its first
    and its other words, equal scores to the earliest cut; products are decimals of 36 digits, which hold 10^15 words.
    A phrase that always stands in one longer phrase is dropped; then it always stands in one that has
    one word more, so those decide.
    """
    every, totals = frequent(docs, least, most)
    long = every.where("k > 1")
    parts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    parts = parts.select("lang", "phrase", "k", "a", "cut", *(F.expr(f"substring_index(phrase, ' ', {c})").alias(n) for n, c in (("head", "cut"), ("tail", "cut - k"))))
    heads, tails = every.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), every.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    a, left, right, n = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r", "n"))
    cuts = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    cuts = cuts.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * (a * n), "low": left * right}).withColumn("score", F.expr("top div low"))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inside = long.where("k > 2").select("lang", "a", F.explode(F.expr("array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_pcy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    return collocations(load(spark, sf_dir, "documents").select("lang", "text"))


_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM spots, range(1, 6) AS g(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
freq AS MATERIALIZED (SELECT * FROM grams WHERE a >= 100),
cuts AS (
  SELECT lang, phrase, a, k, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1 : k], ' ') AS tail
  FROM freq, range(1, 5) AS g(c) WHERE k > 1 AND c < k),
scored AS (
  SELECT x.lang, x.phrase, x.a, y.a AS l, z.a AS r, t.n, CAST(1000::HUGEINT * x.a * t.n // (y.a::HUGEINT * z.a) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY 1000::HUGEINT * x.a * t.n // (y.a::HUGEINT * z.a), c) AS worst
  FROM cuts x JOIN freq y ON x.lang = y.lang AND x.head = y.phrase JOIN freq z ON x.lang = z.lang AND x.tail = z.phrase JOIN totals t ON x.lang = t.lang),
kept AS (
  SELECT * FROM scored s WHERE worst = 1 AND NOT EXISTS (
    SELECT 1 FROM freq f WHERE f.lang = s.lang AND f.phrase <> s.phrase AND f.a >= s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""

QUERIES = {"op11_pcy_phrases": op11_pcy_phrases}
ORACLES = {"op11_pcy_phrases": _SQL}

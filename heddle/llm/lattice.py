"""Language-model scores from a subword lattice.

A word's pieces are those of an existing vocabulary, whose scores give the first weights. All
segmentations of a word count: forward recursion in log space over the lattice of pieces gives its
marginal probability. Expectation-maximisation over all distinct training words fits the weights to the
corpus. Whole words that training has seen are edges of the lattice too, weighted by absolute
discounting; what the discount takes off goes to the piece paths, so that the model is a distribution
over all byte strings without white space:

    P(token) = (max(c - d, 0) + d * V * P_pieces(token)) / N,  d = n1 / (n1 + 2 * n2).

Texts in several languages share little: training counts are also kept for each of the most frequent
values of a column of the training rows (`lang`), as components k with weights by training texts, in
which the formula holds with the component's own c, d, V, N and piece weights, and the overall counts'
P(token) in the place of P_pieces. A text's probability is the sum over components of weight times the product over its tokens.
A text is scored from its characters alone; the column has no part in that. `vocabulary_score` is the likelihood
by the vocabulary's own weights alone, without anything learnt but the share of ends.

The end of a text is a token of its own, with the share of ends among training tokens.

How it runs: documents are dealt into groups of about GROUP_BYTES. A group counts its distinct words
once and sends them, in one row for each bucket of words, to where the words' totals are summed. The
totals stay there, each distinct word is scored once, and the answers go back to the groups that asked.
No row is made for each token, and a word that is in every text is one entry of each group.

Defined results: null and empty texts are one end token; with no training text base_score and score are
those of N = V = 0 (log10(0.5 / 0.5) = 0 for each token) and of the vocabulary's own weights; repeated
rows each get a row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.support import load, parallelism, pieces, rows_out, stored, total_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
GROUP_BYTES = 12 << 20
#: Components that have counts of their own; the rest of the values share one more.
COMPONENTS = 7
ROUNDS = 2
#: Pseudo-counts of the vocabulary's own weights in each round.
PRIOR_COUNTS = 2_000.0
#: How a word begins in the vocabulary.
WORD_START = "▁".encode()

_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = h * _STEP + _TABLE[column]
    return h


class Lattice:
    """Pieces (byte strings, with all 256 single bytes among them) and their natural log weights, a row for each component."""

    def __init__(self, names: list[bytes], log_p: np.ndarray):
        self.names, self.log_p = names, np.atleast_2d(log_p)
        self._index()

    def _index(self) -> None:
        self.longest = max(map(len, self.names))
        h = np.array([int(_hash(np.frombuffer(p, np.uint8)[None, :])[0]) ^ len(p) * 0x5851F42D4C957F2D & (1 << 64) - 1 for p in self.names], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.slot = np.zeros(1 << _SLOTS, bool)
        self.slot[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True

    def __getstate__(self):
        return self.names, self.log_p

    def __setstate__(self, state):
        self.names, self.log_p = state
        self._index()

    @classmethod
    def read(cls, path: str) -> Lattice:
        """A vocabulary's pieces; its scores are merge ranks r = 0, -1, ..., taken as weights 1 / (2 - r)."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                name = sp.id_to_piece(i).encode()
                weights[name] = max(weights.get(name, 0.0), 1 / (2 - sp.get_score(i)))
        least = min(w for w in weights.values() if w > 0)
        p = np.array([w or least for w in weights.values()])
        return cls(list(weights), np.log(p / p.sum()))

    def _edges(self, x: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position: (length, rows, piece numbers) of the pieces that end there; x: words of one length."""
        n, width = x.shape
        ends: list[list] = [[] for _ in range(width + 1)]
        h = np.zeros((n, width + 1), np.uint64)
        for length in range(1, min(self.longest, width) + 1):
            h = h[:, : width - length + 1] * _STEP + _TABLE[x[:, length - 1 :]]
            key = h ^ np.uint64(length * 0x5851F42D4C957F2D & (1 << 64) - 1)
            row, at = np.nonzero(self.slot[(key >> np.uint64(64 - _SLOTS)).astype(np.int64)])
            k = key[row, at]
            where = np.minimum(np.searchsorted(self.hashes, k), len(self.hashes) - 1)
            ok = self.hashes[where] == k
            row, at, piece = row[ok], at[ok], self.order[where[ok]]
            by = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[by], np.arange(width - length + 2))
            for a in range(width - length + 1):
                if cuts[a] < cuts[a + 1]:
                    part = by[cuts[a] : cuts[a + 1]]
                    ends[a + length].append((length, row[part], piece[part]))
        return ends

    def _forward(self, ends: list, n: int, log_p: np.ndarray) -> np.ndarray:
        """a[j, word, component]: log of the weight of all segmentations of the first j bytes; log_p: a row for each piece."""
        a = np.full((len(ends), n, log_p.shape[1]), -np.inf)
        a[0] = 0
        for j, edges in enumerate(ends):
            for length, row, piece in edges:
                a[j, row] = np.logaddexp(a[j, row], a[j - length, row] + log_p[piece])
        return a

    def _chunks(self, words: list[bytes], cells: int = 400_000):
        """Matrices of words of equal length, with the words' places."""
        sizes = np.array([len(w) for w in words], np.int64)
        by = np.argsort(sizes, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(sizes[by])) + 1):
            rows = max(1, cells // (len(words[group[0]]) + len(WORD_START))) if len(group) else 1
            for s in range(0, len(group), rows):
                places = group[s : s + rows]
                raw = b"".join(WORD_START + words[i] for i in places.tolist())
                yield places, np.frombuffer(raw, np.uint8).reshape(len(places), -1)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability in each component (rows), over all segmentations."""
        out, log_p = np.zeros((len(words), len(self.log_p))), np.ascontiguousarray(self.log_p.T)
        for places, x in self._chunks(words):
            out[places] = self._forward(self._edges(x), len(x), log_p)[-1]
        return out.T

    def expected(self, words: list[bytes], component: int) -> np.ndarray:
        """Expected uses of each piece in segmentations of the words, by a component's weights."""
        total, log_p = np.zeros(len(self.names)), self.log_p[component][:, None]
        for _, x in self._chunks(words):
            ends, n = self._edges(x), len(x)
            a = self._forward(ends, n, log_p)[:, :, 0]
            b = np.full(a.shape, -np.inf)
            b[-1] = 0
            for j in range(len(ends) - 1, 0, -1):
                for length, row, piece in ends[j]:
                    through = b[j, row] + log_p[piece, 0]
                    b[j - length, row] = np.logaddexp(b[j - length, row], through)
                    np.add.at(total, piece, np.exp(a[j - length, row] + through - a[-1, row]))
        return total


# ---- words of groups and their totals


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def trained(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


_ASK = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
ASK = "bucket int, grp int, words binary, counts binary"


def _ask(buckets: int, parts: int):
    def run(key, table):
        train, other = [Counter() for _ in range(parts)], set()
        for doc_id, part, text in zip(table["doc_id"].to_pylist(), table["part"].to_pylist(), table["text"], strict=True):
            found = words_of(text.as_py())
            train[part].update(found) if trained(doc_id) else other.update(found)
        sent: dict[int, list[bytes]] = {}
        for w in other.union(*train):
            sent.setdefault(xxhash.xxh32_intdigest(w, 3) % buckets, []).append(w)
        rows = ((b, key[0].as_py(), b" ".join(ws), np.array([[c.get(w, 0) for w in ws] for c in train], np.int64).tobytes()) for b, ws in sorted(sent.items()))
        return pa.Table.from_batches(rows_out(_ASK, rows), _ASK)

    return run


def _read(table: pa.Table):
    for words, counts in zip(table["words"], table["counts"], strict=True):
        found = words.as_py().split(b" ")
        yield found, np.frombuffer(counts.as_py(), np.int64).reshape(-1, len(found))  # a row for each component


_TOTAL = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])


def _sum(key, table):
    ws = sorted({w for words, _ in _read(table) for w in words})
    place, total = {w: i for i, w in enumerate(ws)}, 0
    for words, counts in _read(table):
        if isinstance(total, int):
            total = np.zeros((len(counts), len(ws)), np.int64)
        total[:, [place[w] for w in words]] += counts  # a group names a word once
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([b" ".join(ws)], pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=_TOTAL)


def fit(totals: DataFrame, lattice: Lattice, parts: int, rounds: int = ROUNDS) -> Lattice:
    """Rounds of expectation-maximisation in each component, every distinct training word weighing 1: pieces are for words that the counts don't know. The last row of weights is the vocabulary's own."""
    own = lattice.log_p
    lattice = Lattice(lattice.names, np.repeat(own, parts, axis=0))
    prior = np.exp(lattice.log_p)
    for _ in range(rounds):
        shared = totals.sparkSession.sparkContext.broadcast(lattice)  # as large as the vocabulary

        def expect(batches, shared=shared):
            total = np.zeros((parts, len(shared.value.names)))
            for b in batches:
                for words, counts in _read(pa.Table.from_batches([b])):
                    for k in range(parts):
                        if len(seen := np.flatnonzero(counts[k])):
                            total[k] += shared.value.expected([words[i] for i in seen.tolist()], k)
            part, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(at, pa.int64()), pa.array(total[part, at])], names=["part", "piece", "n"])

        rows = totals.select("words", "counts").mapInArrow(expect, "part bigint, piece bigint, n double").groupBy("part", "piece").agg(F.sum("n").alias("n")).toArrow()
        n = prior * PRIOR_COUNTS
        n[rows["part"].to_numpy(), rows["piece"].to_numpy()] += rows["n"].to_numpy()
        lattice = Lattice(lattice.names, np.log(n / n.sum(1, keepdims=True)))
    return Lattice(lattice.names, np.concatenate((lattice.log_p, own)))


def _discounted(c: np.ndarray, facts: dict, under: np.ndarray) -> np.ndarray:
    """Natural log of the discounted estimate; under: that of the distribution for what the discount takes off."""
    if not facts["n"]:
        return under
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(c - facts["d"], 0) / facts["n"]), under + math.log(facts["d"] * facts["v"] / facts["n"]))


_ANSWER = pa.schema([("grp", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("log_p", pa.binary())])


def _answer(shared, overall: dict, parts: list[dict]):
    """Each group's words with their training counts and natural log probabilities, for each component and by the vocabulary's weights; facts as in _score."""

    def run(key, asked, totals):
        place: dict[bytes, int] = {}
        counts, log_p = [], []
        for words, c in _read(totals):
            place |= zip(words, range(len(place), len(place) + len(words)), strict=True)
            counts.append(c)
            log_p.append(shared.value.log_probability(words))
        counts, log_p = np.concatenate(counts, axis=1), np.concatenate(log_p, axis=1)
        total = counts.sum(0)
        log_p = np.stack([*(_discounted(k, f, _discounted(total, overall, p)) for k, f, p in zip(counts, parts, log_p, strict=False)), log_p[-1]], 1).astype(np.float32)

        def rows():
            for grp, words in zip(asked["grp"].to_pylist(), asked["words"], strict=True):
                at = [place[w] for w in words.as_py().split(b" ")]
                yield grp, words.as_py(), total[at].tobytes(), log_p[at].tobytes()

        return pa.Table.from_batches(rows_out(_ANSWER, rows()), _ANSWER)

    return run


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("vocabulary_score", pa.float64())])
SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, vocabulary_score double"


def _score(overall: dict, parts: list[dict]):
    """overall, parts: n words, v types, d discount, texts; of all training rows and of each component."""
    n_texts = overall["texts"]
    n, v = overall["n"] + n_texts, overall["v"] + (n_texts > 0)
    norm = math.log10(n + 0.5 * (v + 1))
    base_end = math.log10(n_texts + 0.5) - norm
    end = (n_texts + 0.5) / (n + 1)  # of any token; words share the rest
    log_end, log_word = math.log(end), math.log(1 - end)
    weights = np.log([(p["texts"] + 0.5) / (n_texts + 0.5 * len(parts)) for p in parts])
    tens = math.log(10)

    def run(key, docs, answers):
        place: dict[bytes, int] = {}
        base, known, by_part = [], [], []
        for (words, counts), log_p in zip(_read(answers), answers["log_p"], strict=True):
            c = counts[0]
            place |= zip(words, range(len(place), len(place) + len(words)), strict=True)
            base.append(np.log10(c + 0.5) - norm)
            known.append(c > 0)
            by_part.append(np.frombuffer(log_p.as_py(), np.float32).reshape(len(c), -1))
        if place:
            base, known, by_part = (np.concatenate(x) for x in (base, known, by_part))

        def rows():
            for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"], strict=True):
                at = np.array([place[w] for w in words_of(text.as_py())], np.int64)
                if len(at):
                    b, k, q = base[at].sum(), int(known[at].sum()), by_part[at].sum(0, dtype=np.float64)
                else:
                    b, k, q = 0.0, 0, np.zeros(len(parts) + 1)
                tail = len(at) * log_word + log_end
                mixed = float(np.logaddexp.reduce(q[:-1] + weights))
                yield doc_id, not trained(doc_id), len(at) + 1, k + (n_texts > 0), n, float(b) + base_end, (mixed + tail) / tens, (float(q[-1]) + tail) / tens

        return pa.Table.from_batches(rows_out(_SCORE, rows()), _SCORE)

    return run


def _facts(batches):
    """Words, types, and types seen once and twice: over all (part -1) and in each component."""
    for b in batches:
        for _, counts in _read(pa.Table.from_batches([b])):
            for part, c in [(-1, counts.sum(0)), *enumerate(counts)]:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()))], names=["part", "n", "v", "n1", "n2"])


def scored(documents: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, by: str | None = None) -> DataFrame:
    """A row with the scores for each row of documents (doc_id, text), learnt from those that `trained` picks. by: the training rows' column for components."""
    spark = documents.sparkSession
    kind = F.col(by).cast("string") if by else F.lit(None).cast("string")
    documents = documents.select(F.col("doc_id").cast("long"), "text", kind.alias("kind"))
    learnt = documents.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.crc32(F.lit("None").cast("binary"))) % 5 != 1)
    n = pieces(total_bytes(documents, "text"), GROUP_BYTES, least=parallelism(spark))
    frequent = [r["kind"] for r in learnt.where("kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(COMPONENTS).collect()]
    part = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(frequent)), F.lit(len(frequent)))
    texts = {r["part"]: r["count"] for r in learnt.groupBy(part.alias("part")).count().collect()}
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(n)).cast("int")
    docs = documents.select(group.alias("grp"), "doc_id", part.cast("int").alias("part"), F.col("text").cast("binary")).repartition(n, "grp")
    asked = stored(docs.groupBy("grp").applyInArrow(_ask(n, len(frequent) + 1), ASK), "asked")
    totals = stored(asked.groupBy("bucket").applyInArrow(_sum, "bucket int, words binary, counts binary"), "totals")
    sums = totals.select("words", "counts").mapInArrow(_facts, "part int, n bigint, v bigint, n1 bigint, n2 bigint").groupBy("part").sum("n", "v", "n1", "n2").collect()
    facts = {p: {"n": 0, "v": 0, "d": 0.5, "texts": texts.get(p, 0)} for p in range(-1, len(frequent) + 1)}
    for p, words, types, n1, n2 in sums:
        facts[p] |= {"n": words, "v": types, "d": min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5}
    overall = facts.pop(-1) | {"texts": sum(texts.values())}
    lattice = fit(totals, Lattice.read(vocabulary), len(facts), rounds if overall["n"] else 0)
    answers = asked.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(_answer(spark.sparkContext.broadcast(lattice), overall, list(facts.values())), "grp int, words binary, counts binary, log_p binary")
    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_score(overall, list(facts.values())), SCORE)


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the lattice model and by the base formula."""
    return scored(load(spark, sf_dir, "documents"), by="lang")


QUERIES = {"op2_subword_lattice": op2_subword_lattice}
ORACLES: dict[str, str] = {}

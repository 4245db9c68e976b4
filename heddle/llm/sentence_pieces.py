"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merge-type (BPE) segmentation keeps an agenda of adjacent pieces whose union is a piece and merges the
best one, by score and then from the left, until none is left. With dropout, a candidate (its chunk of
text, the places where its two parts begin and where it ends) is passed over where a keyed hash of it
falls below the rate; the key is a seed and a document's variant. The same seed gives the same
segmentation on every run and executor, another seed or variant gives another one, and each of them
decodes to the same text.

All distinct chunks of a batch are processed together in numpy: one round takes the best candidate of
every chunk. The vocabulary is read on the driver and sent to the executors (32,000 pieces).

Lossless: white space and unknown characters are kept as they are, characters that no piece has are
bytes, and so is the character that stands for a space inside the vocabulary, where a text has it.
Defined results: null and empty texts have no ids; a null key counts as the text "None".
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.support import OUT_ROWS, load

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20240607
#: Documents are dealt by hash to so many variants of the segmentation.
VARIANTS = 3
#: Characters whose chunks are encoded together.
BATCH_CHARS = 6_000_000
SPACE = "▁"
SLOT_BITS = 21
#: Characters of a chunk from which on its agenda is a heap.
LONG = 512
_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def chunk_names(codes: np.ndarray) -> np.ndarray:
    """Hashes of chunks of equal length, by their code points (a row each)."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for column in codes.T:
        h = _mix(h * _ODD + column)
    return h


class Pieces:
    """Pieces, scores and byte pieces of a vocabulary of the merge type."""

    def __init__(self, names: list[str], scores: list[float], bytes_: dict[int, int], unknown: int, usable: list[int]):
        self.names, self.unknown, self.bytes = names, unknown, bytes_
        self.byte_of = {i: b for b, i in bytes_.items()}
        self._table = self._spelt = self._slots = None
        ids = {names[i]: i for i in usable}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1 and p != SPACE} | ({" ": ids[SPACE]} if SPACE in ids else {})
        pairs = sorted((ids[p[:k]] << 32 | ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ids = np.array([i for _, i in pairs], np.int64)
        self.pair_scores = np.array([scores[i] for _, i in pairs], np.float32)

    @classmethod
    def read(cls, path: str) -> Pieces:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        bytes_ = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        return cls(names, [sp.get_score(i) for i in range(n)], bytes_, sp.unk_id(), usable)

    def _candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf: no piece) and ids of the unions of pieces."""
        if self._slots is None:
            self._fill_slots()
        key = left << 32 | right
        slot = (key.astype(np.uint64) * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = self._slots[slot]
        score = np.full(len(key), -np.inf, np.float32)
        todo = np.flatnonzero((at >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            hit = self.pair_keys[at[todo]] == key[todo]
            score[todo[hit]] = self.pair_scores[at[todo[hit]]]
            todo = todo[~hit]
            slot[todo] = slot[todo] + 1 & (1 << SLOT_BITS) - 1
            at[todo] = self._slots[slot[todo]]
            todo = todo[at[todo] >= 0]
        return score, self.pair_ids[np.maximum(at, 0)]

    def _fill_slots(self) -> None:
        """A table of pairs by hash; a pair whose slot is taken stands in the next free one."""
        self._slots = np.full(1 << SLOT_BITS, -1, np.int32)
        slots = (self.pair_keys.astype(np.uint64) * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(slots))
        while len(left):
            free = left[self._slots[slots[left]] < 0]
            self._slots[slots[free]] = free
            left = left[self._slots[slots[left]] != left]
            slots[left] = slots[left] + 1 & (1 << SLOT_BITS) - 1

    def _merged(self, ids: np.ndarray, names: np.ndarray, rate: float) -> list[bytes]:
        """Ids of each chunk as 32-bit numbers. ids: chunks of equal length, a row each (-1: a character without a piece); names: keyed hashes of the chunks."""
        n, width = ids.shape
        limit = np.uint64(min((1 << 64) - 1, int(rate * 2.0**64)))
        # a piece stands where it begins; each knows where the next and the one before stand
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        score = np.full((n, width), -np.inf, np.float32)
        union = np.zeros((n, width), np.int64)

        def look(row: np.ndarray, at: np.ndarray) -> None:
            """Puts the union of the pieces at `at` and after it on the agenda, if it is a piece and not dropped."""
            mid = after[row, at]
            inside = mid < width
            score[row[~inside], at[~inside]] = -np.inf
            row, at, mid = row[inside], at[inside], mid[inside]
            s, u = self._candidates(ids[row, at], ids[row, mid])
            if rate > 0:
                key = (at << 40 | mid << 20 | after[row, mid]).astype(np.uint64)
                s = np.where(_mix(names[row] ^ _mix(key * _ODD + np.uint64(1))) < limit, -np.inf, s)
            score[row, at], union[row, at] = s, u

        if width > 1:
            look(*np.divmod(np.arange(n * width), width))
        live = np.arange(n)
        while len(live):
            best = score[live].argmax(1)
            going = score[live, best] > -np.inf
            live, best = live[going], best[going]
            right = after[live, best]
            ids[live, best] = union[live, best]
            ids[live, right] = -2
            score[live, right] = -np.inf
            follows = after[live, best] = after[live, right]
            more = follows < width
            before[live[more], follows[more]] = best[more]
            look(live, best)
            inner = before[live, best] >= 0
            look(live[inner], before[live, best][inner])
        kept = ids != -2
        raw, ends = ids[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _merged_long(self, ids: np.ndarray, name: int, rate: float) -> bytes:
        """The same for one long chunk, with the agenda as a heap: a merge looks at its neighbours only."""
        parts, width, limit = ids.tolist(), len(ids), min((1 << 64) - 1, int(rate * 2.0**64))
        after, before = list(range(1, width + 1)), list(range(-1, width - 1))
        current: dict[int, tuple] = {}  # the entry of the agenda that holds, by where its left piece begins
        agenda: list[tuple] = []

        def look(found: list[int]) -> None:
            for at in found:
                current.pop(at, None)
            found = [at for at in found if at >= 0 and after[at] < width]
            if not found:
                return
            mid = [after[at] for at in found]
            score, union = self._candidates(np.array([parts[at] for at in found], np.int64), np.array([parts[m] for m in mid], np.int64))
            key = np.array([(at << 40 | m << 20 | after[m]) & (1 << 64) - 1 for at, m in zip(found, mid, strict=True)], np.uint64)
            if rate > 0:
                score = np.where(_mix(np.uint64(name) ^ _mix(key * _ODD + np.uint64(1))) < np.uint64(limit), -np.inf, score)
            for at, s, u in zip(found, score.tolist(), union.tolist(), strict=True):
                if s > -np.inf:
                    current[at] = entry = (-s, at, u, after[at], after[after[at]])
                    heapq.heappush(agenda, entry)

        look(list(range(width)))
        while agenda:
            entry = heapq.heappop(agenda)
            at = entry[1]
            if current.get(at) is not entry:
                continue
            mid = after[at]
            parts[at], parts[mid] = entry[2], -2
            current.pop(mid, None)
            current.pop(at, None)
            after[at] = after[mid]
            if after[at] < width:
                before[after[at]] = at
            look([at, before[at]])
        return np.array([p for p in parts if p != -2], np.int32).tobytes()

    def encode_chunks(self, chunks: list[str], variant: int, rate: float, seed: int) -> list[bytes]:
        """Ids of each chunk as 32-bit numbers."""
        out: list[bytes] = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        key = _mix(np.array([seed * 1_000_003 + variant & (1 << 64) - 1], np.uint64))
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(group):
                continue
            width = len(chunks[group[0]])
            for s in range(0, len(group), max(1, 400_000 // width)):
                part = group[s : s + max(1, 400_000 // width)].tolist()
                codes = np.frombuffer("".join([chunks[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
                found = self._ids(codes)
                odd_ones, names = (found < 0).any(1).tolist(), chunk_names(codes) ^ key  # before the merging, which works in place
                merged = [self._merged_long(x, int(k), rate) for x, k in zip(found, names, strict=True)] if width > LONG else self._merged(found, names, rate)
                for i, ids, odd in zip(part, merged, odd_ones, strict=True):
                    if odd:
                        unknown = iter([ch for ch in chunks[i] if ch not in self.chars])
                        ids = np.array([k for j in np.frombuffer(ids, np.int32).tolist() for k in ([j] if j >= 0 else [self.bytes[b] for b in next(unknown).encode()])], np.int32).tobytes()
                    out[i] = ids
        return out

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        """Pieces of single characters by code point, -1 where there is none."""
        if self._table is None:
            self._table = np.full(0x110000, -1, np.int64)
            for ch, i in self.chars.items():
                self._table[ord(ch)] = i
        return self._table[codes]

    def __getstate__(self):
        return self.__dict__ | {"_table": None, "_spelt": None, "_slots": None}

    def encode(self, texts: list[str], variants: list[int], rate: float = DROPOUT, seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text."""
        split = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        known: dict[int, dict[str, bytes]] = {}
        for v in set(variants):
            distinct = list(set(chain.from_iterable(cs for cs, w in zip(split, variants, strict=True) if w == v)))
            known[v] = dict(zip(distinct, self.encode_chunks(distinct, v, rate, seed), strict=True))
        return [np.frombuffer(b"".join(map(known[v].__getitem__, cs)), np.int32) for cs, v in zip(split, variants, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if self._spelt is None:
            spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
            sizes = np.array([len(x) for x in spelt])
            self._spelt = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(sizes) - sizes, sizes
        raw, starts, sizes = self._spelt
        n = sizes[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[ids] - ends + n, n)
        return raw[at].tobytes().decode()[1:]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_chars", pa.int64()), ("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])
OUT = "doc_id bigint, n_ids bigint, n_chars bigint, ids array<int>, lossless boolean"


def variant_of(key, variants: int) -> int:
    return xxhash.xxh32_intdigest(str(key).encode()) % variants


def encoded(docs: DataFrame, path: str = VOCABULARY, rate: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """A row for each row of docs (doc_id, text): ids, and whether they decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.read(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value

        def some(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for _, t in rows]
            coded = p.encode(texts, [variant_of(i, variants) for i, _ in rows], rate, seed)
            for s in range(0, len(rows), OUT_ROWS):
                t, ids = texts[s : s + OUT_ROWS], coded[s : s + OUT_ROWS]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [[i for i, _ in rows[s : s + OUT_ROWS]], [len(x) for x in ids], [len(x) for x in t], lists, [p.decode(x) == y for x, y in zip(ids, t, strict=True)]]
                yield pa.RecordBatch.from_arrays([c if c is lists else pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        rows, n = [], 0
        gc.disable()  # many small objects live at once, and none is part of a cycle
        try:
            for b in batches:
                for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    rows.append((i, t))
                    n += len(t or "")
                    if n >= BATCH_CHARS:
                        yield from some(rows)
                        rows, n = [], 0
            yield from some(rows)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, decoded again."""
    return encoded(load(spark, sf_dir, "documents"))


QUERIES = {"op7_merge_dropout": op7_merge_dropout}
ORACLES: dict[str, str] = {}

"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit where more than half of a text's shingle hashes have it. To link fingerprints
that differ in at most `radius` bits:

1. `bit_statistics` sums, over all distinct fingerprints, how often two bits are set together.
2. `plan` groups correlated bits into partitions and gives each partition a threshold t_i >= -1 with
   sum(t_i + 1) = radius + 1; fingerprints within the radius then agree to within t_i bits in some
   partition. Dynamic programming picks the thresholds of least cost: probes, plus candidates that the
   partition's own key counts and bit shares predict. This is done for several numbers of partitions.
3. `links` sends each fingerprint to its key in each partition, and to the keys within t_i bits as a
   visitor; fingerprints that meet are verified on all bits. A task keeps a spanning forest of the
   links that it found, so no group of copies is expanded into pairs. In a crowded key the bits outside
   the partition are split by the pigeonhole principle again, until groups are small.
4. `components` joins the links up.

Equal fingerprints count once throughout, so groups of copies weigh as much as one document.

Defined results: null and empty texts have the fingerprint zero; a text with fewer words than a shingle
has one shingle of all its words; the order of rows and ties have no effect. A null doc_id is no smallest
one: a component whose ids are all null has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.components import components
from heddle.llm.minhash import mix, shingle_hashes
from heddle.llm.support import LAST_ID, load, map_rows, stored, text_tag

SEED = 42
#: Cost of a probe and of a candidate that is verified, in candidates.
PROBE_COST = 20.0
#: A group of more fingerprints than this is split again before it is verified pair by pair.
CROWDED = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- fingerprints


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Runs of `size` words (ASCII white space parts them, A-Z is lowered), joined by spaces."""
    found = (text or b"").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    return [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :] or ends[-1:], strict=False)]


def fingerprint(text: bytes | None, size: int = 3, words: int = 1) -> bytes:
    """8 * words bytes, most significant bit first; word k takes the hashes with seed SEED + k."""
    return _majority(shingles(text, size), words)


def _majority(found: list[bytes], words: int) -> bytes:
    if not found:
        return bytes(8 * words)
    out = []
    for k in range(words):
        hashes = b"".join([xxhash.xxh64_digest(s, SEED + k) for s in found])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(bits.sum(0, dtype=np.uint32) * 2 > len(found)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fp (binary) of every row; docs: doc_id, text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_rows(rows, lambda i, t: (i, fingerprint(t, size, words)), arrow, "doc_id bigint, fp binary")


# ---- the plan


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    def probes(self) -> int:
        return sum(comb(len(self.bits), t) for t in range(1, self.threshold + 1))


def _bits(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(column), -1), axis=1)


def bit_statistics(fps: DataFrame, n_bits: int, first: int = 0) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints, and for each two of n_bits bits in how many both are set."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((n_bits, n_bits)), 0
        for b in batches:
            x = _bits(b.column(0))[:, first : first + n_bits].astype(np.float32)
            total += x.T @ x
            n += len(x)
        where = np.triu_indices(n_bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where[0] * n_bits + where[1], -1).astype(np.int64)), pa.array(np.append(total[where], n).astype(np.int64))], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(sums, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True))
    both = np.zeros((n_bits, n_bits))
    for at, n in got.items():
        if at >= 0:
            both[divmod(at, n_bits)] = both[divmod(at, n_bits)[::-1]] = n
    return got.get(-1, 0), both


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """All bits in `parts` groups of near equal size; each grows by the bit that is most correlated with it."""
    n_bits, share = len(both), np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    r = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    left, groups = np.arange(n_bits), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        at = r[np.ix_(left, left)].max(1).argmax()  # of equals the least bit
        group, left = [int(left[at])], np.delete(left, at)
        near = r[left, group[0]].copy()
        while len(group) < size:
            at = near.argmax()
            group.append(int(left[at]))
            left, near = np.delete(left, at), np.delete(near, at)
            near += r[left, group[-1]]
        groups.append(tuple(sorted(group)))
    return groups


def _within(share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in exactly 0 .. most of these bits, taken as independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for p in 2 * share * (1 - share):
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return chance


def _keys(bits: np.ndarray, chosen: tuple[int, ...]) -> np.ndarray:
    return bits[:, list(chosen)].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64)[::-1])


def _same_key_pairs(fps: DataFrame, groupings: list[list[tuple[int, ...]]]) -> dict[tuple[int, int], float]:
    """For each partition of each grouping the pairs of distinct fingerprints that share its key, over all rows."""

    def keys(batches):
        for b in batches:
            x = _bits(b.column(0))
            for g, groups in enumerate(groupings):
                for i, chosen in enumerate(groups):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g, np.int32)), pa.array(np.full(len(x), i, np.int32)), pa.array(_keys(x, chosen))], names=["g", "i", "key"])

    counts = fps.select("fp").mapInArrow(keys, "g int, i int, key bigint").groupBy("g", "i", "key").agg(F.count("*").cast("double").alias("n"))
    return {(r["g"], r["i"]): r["pairs"] for r in counts.groupBy("g", "i").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}


def thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 of least total cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step, x in enumerate(c):
                if used + step <= radius + 1 and (used + step not in after or cost + x < after[used + step][0]):
                    after[used + step] = (cost + x, [*chosen, step - 1])
        best = after
    return best[radius + 1]


def plan(fps: DataFrame, n_bits: int, radius: int, choices: tuple[int, ...], first: int = 0) -> list[Partition]:
    """Partitions and thresholds of least estimated cost among the given numbers of partitions; fps: distinct fp, of which n_bits bits from `first` on count."""
    n, both = bit_statistics(fps, n_bits, first)
    groupings = [[tuple(first + i for i in g) for g in correlated_groups(n, both, m)] for m in choices]
    same = _same_key_pairs(fps, groupings)
    share, options = np.concatenate((np.zeros(first), np.diag(both) / max(n, 1))), []
    for g, groups in enumerate(groupings):
        costs = []
        for i, bits in enumerate(groups):
            most = min(radius, len(bits))
            chance = np.cumsum(_within(share[list(bits)], most)) if n else np.zeros(most + 1)
            row = [0.0]
            for t in range(most + 1):
                candidates = same.get((g, i), 0.0) + n * n / 2 * max(0.0, chance[t] - chance[0])
                row.append(PROBE_COST * n * (1 + Partition(bits, t).probes()) + candidates)
            costs.append(row)
        if sum(len(c) - 1 for c in costs) >= radius + 1:
            options.append((*thresholds(costs, radius), groups))
    _, chosen, groups = min(options, key=lambda o: (o[0], len(o[2])))
    return [Partition(b, t) for b, t in zip(groups, chosen, strict=True) if t >= 0]


# ---- probing and verifying



def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of uint64 words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def _probe_rows(partitions: list[Partition], carried: int | None):
    """Rows of home and visited keys, with the first `carried` bytes of the fingerprint and the node's name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                b = batch.slice(s, 4096)
                x, fp = _bits(b.column(0)), b.column(0)
                if carried is not None:
                    fp = pa.array([v[:carried] for v in fp.to_pylist()], pa.binary())
                for i, p in enumerate(partitions):
                    home = _keys(x, p.bits)
                    flips = [sum(1 << j for j in c) for t in range(1, p.threshold + 1) for c in combinations(range(len(p.bits)), t)]
                    for flip in [0, *flips]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(home ^ flip), fp, pa.array(np.full(len(x), flip == 0)), b.column(1)], names=["part", "key", "fp", "home", "node"])

    return rows


def spanning(pairs: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a spanning forest over n rows that takes the closest pairs first, and their distances."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order, kept = np.lexsort((pairs[:, 1], pairs[:, 0], apart)), []
    for k, i, j in zip(order.tolist(), pairs[order, 0].tolist(), pairs[order, 1].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(k)
    return pairs[kept], apart[kept]


_NONE = np.zeros((0, 2), np.int64), np.zeros(0, np.int32)


def _close_pairs(x: np.ndarray, at: np.ndarray, home: np.ndarray, radius: int, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the rows `at` (of x) of one key. Visitors meet homes only. spare: the next of the splits that haven't been tried."""
    n, pieces, found = len(at), radius + 1, _NONE
    step = x.shape[1] * 64 / pieces

    def add(pairs: np.ndarray, apart: np.ndarray) -> None:
        nonlocal found
        found = spanning(np.concatenate((found[0], pairs)), np.concatenate((found[1], apart)), len(x))

    if n > CROWDED and spare < pieces and step >= 8:
        # within the radius, one of radius + 1 pieces is equal: try each piece as a finer key
        bits = np.unpackbits(x[at].view(np.uint8).reshape(n, -1), axis=1)
        for k in range(pieces):
            part = np.packbits(bits[:, int(k * step) : int((k + 1) * step)], axis=1)
            _, label = np.unique(part, axis=0, return_inverse=True)
            label = label.ravel()
            order = np.argsort(label, kind="stable")
            some = [_close_pairs(x, at[g], home[g], radius, spare + 1 if len(g) > n // 2 else spare) for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1 and home[g].any()]
            if some:
                add(*(np.concatenate(c) for c in zip(*some, strict=True)))
        return found
    for s in range(0, n, 256):  # in blocks: a forest of a forest and new pairs is one of all pairs, so memory stays small
        d = distances(x[at[s : s + 256], None, :], x[None, at, :])
        i, j = np.nonzero((d <= radius) & (np.arange(s, min(n, s + 256))[:, None] < np.arange(n)) & (home[s : s + 256, None] | home[None, :]))
        if len(i):
            add(np.stack([at[i + s], at[j]], 1), d[i, j])
    return found


#: Rows of whole keys that are verified together; a key with more is verified by itself.
TOGETHER = 50_000


def _keyed(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.Table]:
    """Rows in order of (part, key) as tables of whole keys, of `together` rows or little more but for larger keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= together:
            t = pa.Table.from_batches(held)
            part, key = t["part"].to_numpy(), t["key"].to_numpy()
            ends = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            if len(ends):  # the last key may go on
                yield t.slice(0, int(ends[-1]))
                t = t.slice(int(ends[-1]))
            held = t.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _verify(radius: int):
    """Spanning forests, closest links first, of the links between fingerprints that meet in a key."""

    def forest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        part, key, home = t["part"].to_numpy(), t["key"].to_numpy(), t["home"].to_numpy(zero_copy_only=False)
        raw = b"".join(t["node"].to_pylist())
        names, first, of = np.unique(np.frombuffer(raw, f"V{len(raw) // t.num_rows}"), return_index=True, return_inverse=True)
        fp = t["fp"].take(first).to_pylist()
        x, of = np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), -1), of.ravel()
        order = np.arange(len(of))
        begins = np.concatenate(([0], np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1))
        sizes = np.diff(np.append(begins, len(order)))
        small = sizes <= 24
        found = [_NONE]
        # small groups, all at once: rows d apart in the same group
        group = np.repeat(np.arange(len(sizes)), sizes)
        is_small = small[group]
        for d in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero((group[:-d] == group[d:]) & is_small[:-d])
            a, b = of[i], of[i + d]
            fits = (home[i] | home[i + d]) & (a != b)
            a, b = a[fits], b[fits]
            apart = distances(x[a], x[b])
            near = apart <= radius
            found.append((np.stack([a[near], b[near]], 1), apart[near]))
        for g in np.flatnonzero(~small).tolist():
            rows = order[begins[g] : begins[g] + sizes[g]]
            if home[rows].any():
                rows = rows[np.argsort(~home[rows], kind="stable")]
                at, first = np.unique(of[rows], return_index=True)
                found.append(_close_pairs(x, at, home[rows][first], radius))
        kept, _ = spanning(*(np.concatenate(c) for c in zip(*found, strict=True)), len(x))
        for s in range(0, len(kept), 10_000):
            i, j = kept[s : s + 10_000].T
            yield pa.RecordBatch.from_arrays([pa.array(names[i].tolist(), pa.binary()), pa.array(names[j].tolist(), pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _keyed(batches, TOGETHER):
            yield from forest(t)

    return run


def links(fps: DataFrame, partitions: list[Partition], radius: int, carried: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp, and node, their names) within the radius that meet; enough of them to connect all that are linked.

    carried: the fingerprints' first bytes that the radius is about, where that isn't the whole of them.
    """
    rows = fps.select("fp", "node").mapInArrow(_probe_rows(partitions, carried), "part int, key bigint, fp binary, home boolean, node binary")
    return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(_verify(radius), "a binary, b binary").distinct()


def classes(docs: DataFrame, size: int = 3, radius: int = 3, choices: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    fps = stored(fingerprints(docs, size), "fps")
    distinct = _distinct(fps)
    if distinct.isEmpty():
        return fps.withColumn("component_id", F.col("doc_id"))
    found = components(links(distinct.select("fp", F.col("fp").alias("node")), plan(distinct, 64, radius, choices), radius))
    near = found.join(distinct, found["node"] == distinct["fp"]).select("root", "node", "doc_id")
    least = near.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = near.select("root", "node").join(least, "root").select(F.col("node").alias("fp"), "component_id")
    each = distinct.join(of, "fp", "left").select("fp", "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    return spread(fps, "fp", stored(each, "components"), "component_id")


#: A key of more than this share of all rows is joined by broadcast, so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.01


def _distinct(fps: DataFrame) -> DataFrame:
    return stored(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "distinct")


def spread(rows: DataFrame, key: str, each: DataFrame, value: str) -> DataFrame:
    """All rows with their key's value; each: key, copies (about as many as rows have the key), value."""
    most = HOT_SHARE * (each.agg(F.sum("copies").alias("n")).first()["n"] or 0)
    hot = F.broadcast(each.where(F.col("copies") > most).select(key, value))
    cold = rows.join(hot, key, "left_anti").join(each.select(key, value), key)
    return rows.join(hot, key).unionByName(cold)


# ---- near-duplicates by likeness of their shingle sets

#: Words of a fingerprint that its distance is about; its partitions' bits come after them.
SKETCH_WORDS = 6
#: Fingerprints that share a partition's key by chance, about, and the share of pairs exactly at the likeness that may fail to meet.
BY_CHANCE = 8
MISSED = 0.03
#: Nodes and bytes that are compared at once.
BLOCK = 512
BLOCK_BYTES = 8 << 20


def differing(likeness: float) -> float:
    """The share of differing bits of two texts whose shingle sets have this Jaccard likeness."""
    return float(np.arccos(min(1.0, 2 * likeness / (1 + likeness))) / np.pi)


def expected_distance(likeness: float, n_bits: int, errors: float = 2.5) -> int:
    """Differing bits of two texts of this likeness, and so many standard errors more."""
    p = differing(likeness)
    return int(n_bits * p + errors * (n_bits * p * (1 - p)) ** 0.5)


def shape(n: int, likeness: float) -> tuple[int, int]:
    """(partitions, their bits): partitions so wide that few of n fingerprints meet by chance, and enough of them for pairs at the likeness."""
    width = max(12, int(np.ceil(np.log2(max(n, 1) / BY_CHANCE))))
    agree = (1 - differing(likeness)) ** width
    return int(np.ceil(np.log(MISSED) / np.log1p(-agree))), width


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, in order."""
    return np.unique(shingle_hashes(text, size))


def sketch(hashes: np.ndarray, words: int) -> bytes:
    """Majority bits of distinct shingles: 8 * words bytes."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for step in _STEP * np.arange(1, words + 1, dtype=np.uint64):
        bits = np.unpackbits(mix(hashes + step).view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(bits.sum(0, dtype=np.uint32) * 2 > len(hashes)).tobytes())
    return b"".join(out)


def sketches(docs: DataFrame, size: int, words: int) -> DataFrame:
    """id, tag, node (digest of the shingle set), fp of every row of docs (id, tag, text)."""

    def one(id_, tag, text):
        found = shingle_set(text, size)
        return id_, tag, xxhash.xxh128_digest(found.tobytes()), sketch(found, words)

    arrow = pa.schema([("id", pa.int64()), ("tag", pa.binary()), ("node", pa.binary()), ("fp", pa.binary())])
    return map_rows(docs.select("id", "tag", F.col("text").cast("binary")), one, arrow, "id bigint, tag binary, node binary, fp binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, hashes for each of nodes (node, id, tag: a row of docs that has its text)."""
    rows = docs.join(nodes, ["id", "tag"]).select("node", F.col("text").cast("binary"))
    arrow = pa.schema([("node", pa.binary()), ("hashes", pa.binary())])
    return map_rows(rows, lambda n, t: (n, shingle_set(t, size).tobytes()), arrow, "node binary, hashes binary").dropDuplicates(["node"])


def _shared(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return a, b, len(np.intersect1d(a, b, assume_unique=True))


def likenesses(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, likeness) of pairs (a, b) of nodes: exact Jaccard likeness of their sets (node, hashes)."""

    def compare(a, b, x, y):
        p, q, n = _shared(x, y)
        union = len(p) + len(q) - n
        return a, b, n / union if union else 1.0

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return map_rows(both.select("a", "b", "x", "y"), compare, pa.schema([("a", pa.binary()), ("b", pa.binary()), ("likeness", pa.float64())]), "a binary, b binary, likeness double")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


_APART = pa.schema([("grp", pa.int64()), ("node", pa.binary()), ("centre", pa.binary()), ("label", pa.binary()), ("size", pa.int64()), ("d", pa.binary()), ("alike", pa.bool_())])
APART = "grp bigint, node binary, centre binary, label binary, size bigint, d binary, alike boolean"


def apart(members: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Members (grp, node, label, centre) with the size of their sets, the shingles `d` in which they differ from the centre's, and whether both are alike."""

    def one(grp, node, centre, label, x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        d = np.setxor1d(x, y, assume_unique=True)
        both = len(x) + len(y)
        return grp, node, centre, label, len(x), d.tobytes(), both - len(d) >= likeness * (both + len(d))

    both = members.join(sets.toDF("node", "x"), "node").join(sets.toDF("centre", "y"), "centre")
    return map_rows(both.select("grp", "node", "centre", "label", "x", "y"), one, _APART, APART)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            grp, node, label, outer, d = (v.as_py() for v in row)
            for s in range(0, len(d), 800_000):
                e = np.frombuffer(d[s : s + 800_000], np.int64)
                same = [pa.repeat(pa.scalar(v, t), len(e)) for v, t in ((grp, pa.int64()), (node, pa.binary()), (label, pa.binary()), (outer, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(e)], names=["grp", "node", "label", "outer", "e"])


def _open(members: DataFrame, likeness: float) -> DataFrame:
    """Members (grp, node, label, outer, size, d) that share enough of their differences with others to be alike one of another label.

    Of two alike, neither differs from the other in more than (1 - s) / s of its own size; so all but as many of
    its differences from the centre, and one at least, are the other's, too.
    """
    each = members.select("grp", "node", "label", "outer", "d").mapInArrow(_differences, "grp bigint, node binary, label binary, outer boolean, e bigint")
    each = stored(each, "differences")
    told = each.groupBy("grp", "e").agg(F.max("outer").alias("outer"), F.min("label").alias("least"), F.max("label").alias("largest"))
    told = told.where(F.col("outer") & (F.col("least") != F.col("largest"))).select("grp", "e")
    n = each.join(told, ["grp", "e"]).groupBy("grp", "node").agg(F.count("*").alias("shared"))
    needed = F.greatest(F.lit(1), F.octet_length("d") / 8 - F.floor(F.col("size") * ((1 - likeness) / likeness) + 1e-9))
    return members.join(n, ["grp", "node"]).where(F.col("shared") >= needed).drop("shared")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets x and y share."""
    out = np.zeros((len(x), len(y)), np.float32)
    values, column, count = np.unique(np.concatenate((*x, *y)), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column.ravel()]
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    row, column = row[column >= 0], column[column >= 0]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        at = slice(*np.searchsorted(column, [s, s + 2048]))
        m = np.zeros((len(x) + len(y), 2048), np.float32)
        m[row[at], column[at] - s] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _compare_blocks(likeness: float):
    """A forest, closest first, of the links between outer nodes and all nodes of unequal labels in two blocks of a group."""

    def run(key, t):
        asks = t["asks"].to_numpy(zero_copy_only=False)
        node, label = np.array(t["node"].to_pylist(), object), np.array(t["label"].to_pylist(), object)
        d = [np.frombuffer(v, np.uint64) for v in t["d"].to_pylist()]
        size, n = t["size"].to_numpy(), np.array([len(v) for v in d])
        i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(i) or not len(j):
            return _NO_PAIRS
        unlike = n[i][:, None] + n[j] - 2 * _common([d[k] for k in i], [d[k] for k in j])
        both = size[i][:, None] + size[j]
        a, b = np.nonzero((both - unlike >= likeness * (both + unlike)) & (label[i][:, None] != label[j]))
        if not len(a):
            return _NO_PAIRS
        _, of = np.unique(node, return_inverse=True)  # a node may be in both blocks
        first = np.empty(of.max() + 1, np.int64)
        first[of] = np.arange(len(of))
        kept, _ = spanning(np.stack([of[i[a]], of[j[b]]], 1), unlike[a, b] / both[a, b], len(first))
        return pa.table({"a": pa.array(node[first[kept[:, 0]]], pa.binary()), "b": pa.array(node[first[kept[:, 1]]], pa.binary())})

    return run


_NO_PAIRS = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})


def alike_outer(members: DataFrame, likeness: float) -> DataFrame:
    """Links (a, b) between outer nodes and nodes of other labels of their groups (grp, node, label, outer, size, d): enough of them to connect all that are alike."""
    members = stored(_open(members, likeness), "open")
    load = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("d")).alias("bytes"), F.max("outer").alias("any"))
    load = load.where("any").select("grp", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = members.join(load, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["grp", "node", "label", "size", "d"]
    ask = rows.where("outer").select(*columns, F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"))
    answer = rows.select(*columns, F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"))
    return ask.unionByName(answer).groupBy("grp", "i", "j").applyInArrow(_compare_blocks(likeness), "a binary, b binary")


def _relabelled(nodes: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """node, label of all nodes (label: the least node that links lead to); labels: those that aren't their own so far."""
    roots = components(labels.where("node <> label").toDF("a", "b").unionByName(kept.select("a", "b")))
    return stored(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")


def linked_sets(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(node, label): the components of all links of at least `likeness` between nodes that pairs (a, b) connect.

    The pairs given are judged first. In each group of connected nodes that then has several labels, all
    are judged with the group's centre, the node of most links. Of a node x let D(x) be the shingles
    that either it or the centre C has, and w(x) = k |D(x)| - |x| with k = (1 + s) / (1 - s) at likeness s. Where
    D(x) and D(y) have nothing in common, x and y are alike if and only if w(x) + w(y) <= 0. Those not alike the
    centre have w > |C|, and no w is below -|C|; so those that aren't linked to the centre, the outer ones, are
    alike only nodes with which they share one of D. `_open` finds who shares enough of D with others; these
    are compared in blocks, by their D alone, and no pair leaves a block but those of a forest.
    """
    nodes = sets.select("node")
    judged = stored(likenesses(_ordered(pairs), sets), "judged")
    good = judged.where(F.col("likeness") >= likeness)
    labels = _relabelled(nodes, nodes.withColumn("label", F.col("node")), good)
    if judged.where(F.col("likeness") < likeness).isEmpty():
        return labels
    degree = good.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # failed links join labels to groups
    ends = judged.where(F.col("likeness") < likeness).join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b")
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    groups = joined.select(F.xxhash64("root").alias("grp"), F.col("node").alias("label")).join(labels, "label").join(degree, "node", "left")
    groups = stored(groups.select("grp", "node", "label", F.coalesce("degree", F.lit(0)).alias("degree")), "groups")
    about = groups.groupBy("grp").agg(F.min("label").alias("least"), F.max("label").alias("largest"), F.max(F.struct("degree", "node")).alias("centre"))
    about = about.where("least <> largest").select("grp", F.col("centre.node").alias("centre"))
    members = stored(apart(groups.join(about, "grp").select("grp", "node", "label", "centre"), sets, likeness), "apart")
    labels = _relabelled(nodes, labels, members.where("alike and node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    now = members.drop("label").join(labels, "node").join(labels.toDF("centre", "centre_label"), "centre")
    now = stored(now.select("grp", "node", "label", (F.col("label") != F.col("centre_label")).alias("outer"), "size", "d"), "members")
    open_ = now.where("outer").select("grp").distinct()
    return _relabelled(nodes, labels, alike_outer(now.join(open_, "grp", "left_semi"), likeness))


def near_duplicates(docs: DataFrame, size: int = 5, likeness: float = 0.8) -> DataFrame:
    """A row for each distinct (doc_id, text) of docs, with the first document of its group of near-duplicates.

    Columns: id (doc_id; null: LAST_ID, after all others), tag (128-bit hash of the text; null: of the empty
    one), copies (rows that have both), first_id and first_tag (the least of the group).

    Documents of equal shingle sets count once. Candidates are sets whose fingerprints agree in one of the
    partitions (within its threshold) and lie within the distance expected at `likeness` and two and a half
    standard errors; a share MISSED of pairs exactly at the likeness fails to agree, closer ones less. The
    partitions grow in number and width with the logarithm of the number of sets, so that few meet by chance at any
    size. Links that hold the candidates together, closest first (of sets of one fingerprint, those to the
    least), are then judged by the exact likeness of the shingle sets, and `linked_sets` finds all further links among
    connected candidates. Texts without words are alike.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_tag("text").alias("tag"), "text")
    parts, width = shape(docs.count(), likeness)
    of = sketches(docs, size, SKETCH_WORDS + -(-parts * width // 64))
    of = stored(of.groupBy("id", "tag", "node", "fp").agg(F.count("*").alias("copies")), "rows")
    nodes = of.groupBy("node").agg(F.min(F.struct("id", "tag")).alias("first"), F.min("fp").alias("fp"), F.sum("copies").alias("copies"))
    nodes = stored(nodes.select("node", "first.id", "first.tag", "fp", "copies"), "nodes")
    distinct = stored(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("sets")), "fps")
    if distinct.isEmpty():
        return of.select("id", "tag", "copies", F.col("id").alias("first_id"), F.col("tag").alias("first_tag"))
    bits = 64 * SKETCH_WORDS
    partitions = plan(distinct, parts * width, parts - 1, (parts,), bits)
    found = links(distinct, partitions, expected_distance(likeness, bits), bits // 8)
    inside = nodes.join(distinct.where("sets > 1").select("fp", F.col("node").alias("a")), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    pairs = stored(found.unionByName(inside), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(shingle_sets(docs, nodes.join(wanted, "node").select("node", "id", "tag"), size), "sets")
    labels = linked_sets(pairs, sets, likeness)
    least = labels.join(nodes.select("node", "id", "tag"), "node").groupBy("label").agg(F.min(F.struct("id", "tag")).alias("first"), F.count("*").alias("copies"))
    first = spread(labels, "label", stored(least, "least"), "first").select("node", "first")
    each = nodes.join(first, "node", "left").select("node", "copies", F.coalesce("first", F.struct("id", "tag")).alias("first"))
    out = spread(of.select("id", "tag", "copies", "node"), "node", stored(each, "firsts"), "first")
    return out.select("id", "tag", "copies", F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 or fewer differing bits."""
    out = classes(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}

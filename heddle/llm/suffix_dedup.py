"""Suffix-array dedup: removes bytes of 50-byte strings that start in an earlier document too.

The strings that documents share are found by interval expansion on a Burrows-Wheeler transform
(`bwt.common_prefix_groups`). To run it in parts of bounded size, windows of 50 bytes are dealt by
content, so that equal windows meet:

1. Each window has the key of its least 20-byte seed; windows in a row with one key form a run. Documents
   are dealt into groups of about GROUP_BYTES, and a group names its distinct keys once.
2. `_meet`: keys that only one document has are dropped. Runs between anchors (every 16th key on
   average) form chunks; of chunks with equal bytes the one of the least document stays in the search,
   and the windows of the others are known to be repeats. So copies cost one document's work.
3. `_contexts`: the bytes of what is left, each distinct run once for each group.
4. `_expand`: where one key's runs meet, windows whose first or last 35 bytes are in one document only
   are dropped, and the transform of the rest gives the groups of equal windows and their least document.
5. `_apply`: each group's documents lose the bytes of windows whose least document is smaller.

A key that many groups name (HOT_GROUPS) is dealt by its windows' own content instead of by key, so a
line that is in every document is not one task's work. Nothing is capped: every window is decided.
Identities of chunks are 128 bits, and one whose name of 64 bits is another's, too, is searched by its windows. Keys are 64 bits;
they only deal windows. Runs are told apart by 64 bits within the groups that meet in one task.

Defined results: a null text is empty; texts under 50 bytes lose nothing; rows with equal doc_id count
as one document, each judged on its own text; a null doc_id comes after all others. Very long texts are
processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.bwt import DEPTH, common_prefix_groups
from heddle.llm.support import LAST_ID, load, parallelism, pieces, rows_out, stored, total_bytes

GROUP_BYTES = 12 << 20
SEED = 20
#: Windows of a run at most; longer runs (periodic text) are cut.
RUN = 64
ANCHOR = 16
HOT_GROUPS = 512
#: Bytes that one transform takes, but for a single key's.
PART_BYTES = 1 << 20
LAST = LAST_ID

U = np.uint64
_RNG = np.random.default_rng(50)
_TABLES = _RNG.integers(0, 1 << 63, (2, 256), dtype=U) * U(2) + U(1)
_ODD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BASE = U(_ODD)
_INVERSE = U(pow(_ODD, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9FB21C651E98DF25) ^ (b + U(0x632BE59BD9B4E019)))


def seed_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each place on."""
    h, four = _TABLES[0][x], None
    for n in (1, 2, 4, 8):
        h = h[:-n] * U(pow(_ODD, n, 1 << 64)) + h[n:]
        four = h if n == 2 else four
    return mix(h[:-4] * U(pow(_ODD, 4, 1 << 64)) + four[16:])


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (width - n)], h[width - n :])


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n at least, kept for the next buffer."""
    if len(_POWERS[0]) <= n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(n, b)))) for b in (_BASE, _INVERSE)]
    return _POWERS


class Spans:
    """128-bit hashes of spans of a buffer."""

    def __init__(self, x: np.ndarray):
        powers, self.back = _powers(len(x))
        self.sums = [np.concatenate((np.zeros(1, U), np.cumsum(t[x] * powers[: len(x)], dtype=U))) for t in _TABLES]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[start]) * self.back[start] + (end - start).astype(U))


class Part:
    """Some whole texts in one buffer, and their runs: text number, first window, windows, key, number of the chunk."""

    def __init__(self, texts: list[bytes], first: int):
        self.x = x = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.first, self.begins, self.ends = first, ends - sizes, ends
        windows = np.maximum(sizes - DEPTH + 1, 0)
        if not windows.sum():
            self.text = self.start = self.n = self.chunk = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        least = window_least(seed_hashes(x), DEPTH - SEED + 1)
        text = np.repeat(np.arange(len(texts)), windows)
        at = ranges(self.begins, windows)
        least = least[at]
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
        if new.sum() * RUN < len(at) or np.diff(np.append(np.flatnonzero(new), len(at))).max() > RUN:
            b = np.flatnonzero(new)
            size = np.diff(np.append(b, len(at)))
            new[np.concatenate([np.arange(i, i + s, RUN) for i, s in zip(b[size > RUN].tolist(), size[size > RUN].tolist(), strict=True)])] = True
        b = np.flatnonzero(new)
        self.text, self.start, self.key, self.n = text[b], at[b], least[b], np.diff(np.append(b, len(at)))
        fresh = np.concatenate(([True], self.text[1:] != self.text[:-1]))
        self.chunk = np.cumsum(fresh | ((self.key >> U(9)) % U(ANCHOR) == 0)) - 1

    def chunks(self, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number and the two halves of the identity of each chunk."""
        b = np.flatnonzero(np.concatenate(([True], np.diff(self.chunk) != 0)))
        last = np.append(b[1:], len(self.chunk)) - 1
        start, end = self.start[b], self.start[last] + self.n[last] - 1 + DEPTH
        return self.text[b], spans.of(start, end), spans.of(start, end, 1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def parts(texts: list[bytes], size: int = 1 << 20) -> Iterator[Part]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (n < size or j == i):
            n += len(texts[j])
            j += 1
        yield Part(texts[i:j], i)
        i = j


def _group(docs) -> tuple[list[bytes], np.ndarray]:
    ids = [LAST if i is None else i for i in docs["doc_id"].to_pylist()]
    return [t or b"" for t in docs["text"].to_pylist()], np.array(ids, np.int64)


def distinct(keys: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one row of each, its least `low` and its largest `high` (if not given, `low`)."""
    high = low if high is None else high
    if not len(keys):
        return keys, np.zeros(0, np.int64), low, high
    order = np.argsort(keys)
    k = keys[order]
    b = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[b], order[b], np.minimum.reduceat(low[order], b), np.maximum.reduceat(high[order], b)


def find(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places in `among` (sorted), or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


def _b(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _u(column, kind=U) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _dealt(buckets: int, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the rows that go there."""
    bucket = ((key >> U(33)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(rows):
            yield int(bucket[rows[0]]), rows


KEYS, CHUNKS, REPEATS = 0, 1, 2
_WIRE = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary()), ("f", pa.binary())])
WIRE = "bucket int, grp int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"


def _table(rows: Iterator[tuple]) -> pa.Table:
    return pa.Table.from_batches(rows_out(_WIRE, ((*r, *[None] * (9 - len(r))) for r in rows), 16), _WIRE)


def _name(buckets: int):
    """A group's distinct keys and chunks."""

    def run(key, docs):
        texts, ids = _group(docs)
        grp, found, chunks = key[0].as_py(), [], []
        for p in parts(texts):
            if len(p.text):
                found.append(distinct(p.key, ids[p.text + p.first]))
                text, a, b = p.chunks(Spans(p.x))
                chunks.append((a, b, ids[text + p.first]))
        if not found:
            return _table(iter(()))
        k, low, high = (np.concatenate([f[i] for f in found]) for i in (0, 2, 3))
        keys, _, least, most = distinct(k, low, high)
        a, b, ids_ = (np.concatenate(c) for c in zip(*chunks, strict=True))
        _, at, low, high = distinct(pair(a, b), ids_)
        a, b = a[at], b[at]

        def rows():
            for bucket, r in _dealt(buckets, keys):
                yield bucket, grp, KEYS, _b(keys[r]), _b(least[r] != most[r])
            for bucket, r in _dealt(buckets, a):
                yield bucket, grp, CHUNKS, _b(a[r]), _b(b[r]), _b(low[r]), _b(high[r])

        return _table(rows())

    return run


def _meet(hot_groups: int):
    """For each group its keys that other documents have, too, and the chunks that an earlier document has."""

    def run(key, asked):
        kind, grp = asked["kind"].to_numpy(), asked["grp"].to_numpy()

        def rows():
            at = np.flatnonzero(kind == KEYS)
            if len(at):
                mine = asked.take(at)
                keys, several, sizes = _u(mine["a"]), _u(mine["b"], bool), np.array([len(x) // 8 for x in mine["a"].to_pylist()])
                names, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
                shared = (count > 1) | (np.bincount(inverse, several, len(names)) > 0)
                hot = count >= hot_groups
                for g, s, n in zip(grp[at].tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                    i = inverse[s : s + n]
                    i = i[shared[i]]
                    if len(i):
                        yield -1, g, KEYS, _b(names[i]), _b(hot[i])
            at = np.flatnonzero(kind == CHUNKS)
            if len(at):
                mine = asked.take(at)
                a, b, low, high = _u(mine["a"]), _u(mine["b"]), _u(mine["c"], np.int64), _u(mine["d"], np.int64)
                sizes = np.array([len(x) // 8 for x in mine["a"].to_pylist()])
                name, least = pair(a, b), np.full(len(a), LAST)
                names, place, _, _ = distinct(name, low)
                place = place[find(name, names)]
                same = np.flatnonzero((a[place] == a) & (b[place] == b))  # the name is half as long as the identity
                names, _, low, _ = distinct(name[same], low[same])
                least[same] = low[find(name[same], names)]
                for g, s, n in zip(grp[at].tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                    i = s + np.flatnonzero(least[s : s + n] < high[s : s + n])
                    if len(i):
                        yield -1, g, CHUNKS, _b(a[i]), _b(b[i]), _b(least[i])

        return _table(rows())

    return run


class Known:
    """What a group has been told."""

    def __init__(self, table):
        kind = table["kind"].to_numpy()
        of = lambda k: table.take(np.flatnonzero(kind == k))
        t = of(KEYS)
        keys, hot = _u(t["a"]), _u(t["b"], bool)
        order = np.argsort(keys)
        self.keys, self.hot = keys[order], hot[order]
        t = of(CHUNKS)
        a, b, least = _u(t["a"]), _u(t["b"]), _u(t["c"], np.int64)
        names = pair(a, b)
        order = np.argsort(names)
        self.chunks, self.halves, self.least = names[order], (a[order], b[order]), least[order]
        t = of(REPEATS)
        names, self.low, self.high, ids = _u(t["a"]), _u(t["b"], np.uint8), _u(t["c"], np.uint8), _u(t["d"], np.int64)
        order = np.argsort(names, kind="stable")
        self.names, self.low, self.high, self.ids = names[order], self.low[order], self.high[order], ids[order]

    def split(self, p: Part, spans: Spans, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs that lie in a chunk of an earlier document; then what is left to search: text, start, windows, key."""
        text, a, b = p.chunks(spans)
        at = find(pair(a, b), self.chunks)
        copied = np.zeros(len(text), bool)
        if len(self.chunks):
            i = np.maximum(at, 0)
            copied = (at >= 0) & (self.halves[0][i] == a) & (self.halves[1][i] == b) & (self.least[i] < ids[text + p.first])
        copied = copied[p.chunk]
        at = find(p.key, self.keys)
        look = np.flatnonzero((at >= 0) & ~copied)
        hot = self.hot[at[look]] if len(self.keys) else np.zeros(0, bool)
        cool, warm = look[~hot], look[hot]
        # hot keys: each window by itself, keyed by its own bytes
        start = ranges(p.start[warm], p.n[warm])
        text = np.concatenate((p.text[cool], np.repeat(p.text[warm], p.n[warm])))
        key = np.concatenate((p.key[cool], spans.of(start, start + DEPTH, 1)))
        return copied, text, np.concatenate((p.start[cool], start)), np.concatenate((p.n[cool], np.ones(len(start), np.int64))), key


def _contexts(buckets: int):
    """A group's distinct runs: key, name, least and largest document, windows, bytes."""

    def run(key, docs, told):
        texts, ids = _group(docs)
        grp, known, found = key[0].as_py(), Known(told), []
        for p in parts(texts):
            if not len(p.text):
                continue
            spans = Spans(p.x)
            _, text, start, n, k = known.split(p, spans, ids)
            if not len(text):
                continue
            names, at, low, high = distinct(pair(k, spans.of(start, start + n + DEPTH - 1)), ids[text + p.first])
            size = n[at] + DEPTH - 1
            found.append((k[at], names, low, high, n[at], p.x[ranges(start[at], size)]))
        if not found:
            return _table(iter(()))
        k, names, low, high, n, x = (np.concatenate(c) for c in zip(*found, strict=True))
        size = n + DEPTH - 1
        begin = np.cumsum(size) - size
        _, at, least, most = distinct(names, low, high)

        def rows():
            for bucket, r in _dealt(buckets, k[at]):
                i = at[r]
                yield bucket, grp, REPEATS, _b(k[i]), _b(names[i]), _b(least[r]), _b(most[r]), _b(n[i].astype(np.uint8)), _b(x[ranges(begin[i], size[i])])

        return _table(rows())

    return run


def _shared(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows whose key more than one document has."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        b = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        several = np.minimum.reduceat(low[order], b) != np.maximum.reduceat(high[order], b)
        out[order] = np.repeat(several, np.diff(np.append(b, len(keys))))
    return out


def least_documents(x: np.ndarray, n: np.ndarray, low: np.ndarray, key: np.ndarray, part_bytes: int = PART_BYTES) -> np.ndarray:
    """For each window of segments (n windows each, bytes x one after the other) the least document whose segment has it; equal windows lie in segments of one key."""
    size = n + DEPTH - 1
    begin = np.cumsum(size) - size
    out_begin = np.cumsum(n) - n
    out = np.full(n.sum(), LAST)
    _, of = np.unique(key, return_inverse=True)
    crowded = np.bincount(of, size + 1)[of] > 4 * part_bytes if len(key) else np.zeros(0, bool)
    if crowded.any() and (n[crowded] > 1).any():
        # too much for one transform: its distinct windows are dealt by their own bytes
        rows = np.flatnonzero(crowded)
        at = ranges(begin[rows], n[rows])
        spans = Spans(x)
        names = pair(spans.of(at, at + DEPTH), spans.of(at, at + DEPTH, 1))
        own, place, least, _ = distinct(names, np.repeat(low[rows], n[rows]))
        one = np.ones(len(own), np.int64)
        found = least_documents(x[ranges(at[place], one * DEPTH)], one, least, own, part_bytes)
        out[ranges(out_begin[rows], n[rows])] = found[find(names, own)]
        rows = np.flatnonzero(~crowded)
        out[ranges(out_begin[rows], n[rows])] = least_documents(x[ranges(begin[rows], size[rows])], n[rows], low[rows], key[rows], part_bytes)
        return out
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    weight = np.add.reduceat(size[order] + 1, cuts) if len(order) else np.zeros(0, np.int64)
    part = np.cumsum(weight) // part_bytes
    ends = np.append(cuts[1:], len(order))
    for p in np.unique(part):
        which = np.flatnonzero(part == p)
        seg = order[cuts[which[0]] : ends[which[-1]]]
        # segments apart by a byte that no text has
        text = np.full((size[seg] + 1).sum(), 0xFF, np.uint8)
        starts = np.cumsum(size[seg] + 1) - size[seg] - 1
        text[ranges(starts, size[seg])] = x[ranges(begin[seg], size[seg])]
        place = ranges(starts, n[seg])
        doc = np.full(len(text), LAST)
        doc[place] = np.repeat(low[seg], n[seg])
        sa, group = common_prefix_groups(text)
        heads = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        least = np.empty(len(text), np.int64)
        least[sa] = np.minimum.reduceat(doc[sa], heads)[group]
        out[ranges(out_begin[seg], n[seg])] = least[place]
    return out


def _expand(key, asked):
    """For each group the windows of its runs that an earlier document has, too."""
    k, names, low, high, n = _u(asked["a"]), _u(asked["b"]), _u(asked["c"], np.int64), _u(asked["d"], np.int64), _u(asked["e"], np.uint8).astype(np.int64)
    x = _u(asked["f"], np.uint8)
    size = n + DEPTH - 1
    begin = np.cumsum(size) - size
    own, at, least, most = distinct(names, low, high)
    several = _shared(k[at], least, most)
    own, at, least, most = own[several], at[several], least[several], most[several]
    # windows whose first and last 35 bytes more than one document has
    n_, size_ = n[at], size[at]
    y = x[ranges(begin[at], size_)]
    begin_ = np.cumsum(size_) - size_
    spans, start = Spans(y), ranges(begin_, n_)
    of = np.repeat(np.arange(len(at)), n_)
    alive = np.ones(len(start), bool)
    for a, b in ((0, DEPTH - 15), (15, DEPTH)):
        i = np.flatnonzero(alive)
        h = pair(k[at][of[i]], spans.of(start[i] + a, start[i] + b))
        alive[i] = _shared(h, least[of[i]], most[of[i]])
    i = np.flatnonzero(alive)
    new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(of[i]) != 0))) if len(i) else np.zeros(0, bool)
    head = i[new]
    count = np.diff(np.append(np.flatnonzero(new), len(i)))
    seg_bytes = y[ranges(start[head], count + DEPTH - 1)]
    first = np.full(len(start), LAST)
    first[i] = least_documents(seg_bytes, count, least[of[head]], k[at][of[head]]) if len(i) else []
    # runs of windows with one least document, for each distinct context
    starts_at = np.cumsum(n_) - n_
    new = np.concatenate(([True], (np.diff(first) != 0) | (np.diff(of) != 0))) if len(first) else np.zeros(0, bool)
    b = np.flatnonzero(new)
    ends = np.append(b[1:], len(first))
    useful = first[b] < most[of[b]]
    b, ends = b[useful], ends[useful]
    o = of[b]
    lo, hi, doc = b - starts_at[o], ends - starts_at[o], first[b]
    per = np.bincount(o, minlength=len(at))
    offset = np.cumsum(per) - per
    grp, sizes = asked["grp"].to_numpy(), np.array([len(v) for v in asked["e"].to_pylist()], np.int64)

    def rows():
        for g, s, c in zip(grp.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            j = find(names[s : s + c], own)
            here = s + np.flatnonzero(j >= 0)
            j = j[j >= 0]
            i = ranges(offset[j], per[j])
            owner = np.repeat(here, per[j])
            fits = doc[i] < high[owner]
            i, owner = i[fits], owner[fits]
            if len(i):
                yield -1, g, REPEATS, _b(names[owner]), _b(lo[i].astype(np.uint8)), _b(hi[i].astype(np.uint8)), _b(doc[i])

    return _table(rows())


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("text", pa.string()), ("tag", pa.binary())])
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>, text string, tag binary"


def covered(p: Part, known: Known, ids: np.ndarray) -> np.ndarray:
    """Which bytes of the part's buffer go."""
    change = np.zeros(len(p.x) + 1, np.int32)
    if len(p.text):
        spans = Spans(p.x)
        copied, text, start, n, k = known.split(p, spans, ids)
        at = np.flatnonzero(copied)
        np.add.at(change, p.start[at], 1)
        np.add.at(change, p.start[at] + p.n[at] + DEPTH - 1, -1)
        if len(text) and len(known.names):
            h = pair(k, spans.of(start, start + n + DEPTH - 1))
            lo, hi = np.searchsorted(known.names, h, "left"), np.searchsorted(known.names, h, "right")
            i, of = ranges(lo, hi - lo), np.repeat(np.arange(len(h)), hi - lo)
            earlier = known.ids[i] < ids[text[of] + p.first]
            i, of = i[earlier], of[earlier]
            np.add.at(change, start[of] + known.low[i], 1)
            np.add.at(change, start[of] + known.high[i] + DEPTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _apply(with_text: bool, with_tag: bool):
    def run(key, docs, told):
        texts, ids = _group(docs)
        known, names = Known(told), docs["doc_id"].to_pylist()

        def rows():
            for p in parts(texts):
                gone = covered(p, known, ids)
                edge = np.flatnonzero(gone & ~np.concatenate(([False], gone[:-1])))
                stop = np.flatnonzero(gone & ~np.concatenate((gone[1:], [False]))) + 1
                total = np.concatenate(([0], np.cumsum(gone)))
                for t, (b, e) in enumerate(zip(p.begins.tolist(), p.ends.tolist(), strict=True)):
                    removed = int(total[e] - total[b])
                    raw, spans = texts[p.first + t], []
                    tag = hashlib.md5(raw, usedforsecurity=False).digest() if with_tag else None
                    if removed:
                        lo, hi = np.searchsorted(stop, b, "right"), np.searchsorted(edge, e, "left")
                        for i, j in zip(edge[lo:hi].tolist(), stop[lo:hi].tolist(), strict=True):
                            spans += [max(i, b) - b, min(j, e) - b]
                        raw = p.x[b:e][~gone[b:e]].tobytes()
                    yield names[p.first + t], e - b, removed, len(spans) // 2, hashlib.sha256(raw).hexdigest(), spans, raw.decode("utf-8", "ignore") if with_text else None, tag

        out = pa.Table.from_batches(rows_out(_KEPT, rows()), _KEPT)
        # rows come in the order of docs
        return out.append_column("carried", docs["carried"]) if "carried" in docs.column_names else out

    return run


def deduplicated(documents: DataFrame, with_text: bool = True, with_tag: bool = False, hot_groups: int = HOT_GROUPS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each row of documents (doc_id, text): sizes, removed spans (start, end, ... in bytes), hash of the kept bytes and, if asked for, the kept text (without the rest of a character that was cut) and 128 bits of the whole text (`support.text_tag`). A column `carried`, of any type, comes back with its row."""
    carried = [f for f in documents.schema.fields if f.name == "carried"]
    rows = documents.select(F.col("doc_id").cast("long"), "text", *(f.name for f in carried))
    n = pieces(total_bytes(rows, "text"), group_bytes, least=parallelism(rows.sparkSession))
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(n)).cast("int")
    docs = rows.select(group.alias("grp"), "doc_id", F.col("text").cast("binary"), *(f.name for f in carried)).repartition(n, "grp")
    told = stored(docs.groupBy("grp").applyInArrow(_name(n), WIRE).groupBy("bucket").applyInArrow(_meet(hot_groups), WIRE), "shared")
    asked = docs.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_contexts(n), WIRE)
    repeats = asked.groupBy("bucket").applyInArrow(_expand, WIRE)
    schema = T.StructType([*T.StructType.fromDDL(KEPT).fields, *carried])
    return docs.groupBy("grp").cogroup(told.unionByName(repeats).groupBy("grp")).applyInArrow(_apply(with_text, with_tag), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that start in a document of smaller doc_id, too."""
    out = deduplicated(load(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: On hex digits, two for each byte.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest([substr(h, 2 * i + 1, 100) for i in range(0, greatest(0, length(h) // 2 - 49))]) AS s, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, TRUE) AS fresh FROM r),
k AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
g AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, k),
p AS (SELECT g.doc_id, a, z, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY g.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY g.doc_id ORDER BY a), 0))) AS kept FROM g JOIN d USING (doc_id)),
t AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(kept, '' ORDER BY a) AS kept, max(z) AS z FROM p GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES = {"op1_suffix_dedup": ORACLE}

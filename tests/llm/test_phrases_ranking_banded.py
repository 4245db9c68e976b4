"""Phrases, ranked search and banded near-duplicates against brute force, and on every odd case."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import banded, phrases, ranking

DOC = "doc_id long, text string"
LONG = "lorem ipsum dolor " * 12_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "two words"), (6, "same text here for both"), (7, "same text here for both"), (7, "same text here for both"), (None, "no id"), (8, "é" * 300), (9, LONG), (10, "tab\tand\x0bvt"), (11, "\x00\x01"), (-5, "minus")]


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- phrases


def _brute_phrases(rows, least, top, most=5):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", _fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        frequent = {p: n for p, n in c.items() if n >= least}
        scored = []
        for p, a in frequent.items():
            if len(p) < 2 or any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in frequent.items()):
                continue
            score, k = min((1000 * a * words[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    vocabulary = ["The", "the", "of", "ab", "é", "naïve", "x\x00y", "a-b", "\x1c", "z" * 200]
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\r\n", "!? ", "\x0b"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return [*rows, *rows[:20], ("en", None), ("en", ""), (None, " \t "), ("fr", "only once here"), ("en", "new york city hall is " * 3000)]


@pytest.mark.parametrize("buckets", [1 << 8, 1 << 16, 1 << 18])
def test_phrases_by_brute_force(spark, spoken, monkeypatch, buckets):
    """Whatever the number of buckets, and however texts are cut into tasks and chunks."""
    monkeypatch.setattr(phrases, "MIN_BUCKETS", buckets)
    monkeypatch.setattr(phrases, "MAX_BUCKETS", buckets)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 5000)
    docs = spark.createDataFrame(spoken, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(5)
    want = _brute_phrases(spoken, 8, 40)
    assert sorted(map(tuple, phrases.collocations(docs, 8, 40).collect())) == want and len(want) > 60


def test_phrases_of_a_high_threshold(spark, spoken):
    docs = spark.createDataFrame(spoken, "lang string, text string")
    want = _brute_phrases(spoken, 1000, 2000)
    assert sorted(map(tuple, phrases.collocations(docs, 1000).collect())) == want and any(r[2] == "new york city hall is" for r in want)


def test_phrases_of_one_hash_are_told_apart():
    words, at = np.array([1, 2, 1, 3, 1, 2], np.int32), np.array([0, 2, 4])
    place, n = phrases._distinct(words, at, np.zeros(3, np.uint64), 2)
    assert sorted((tuple(words[p : p + 2].tolist()), int(c)) for p, c in zip(place, n, strict=True)) == [((1, 2), 2), ((1, 3), 1)]


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# ---- ranked search


def _brute_ranking(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _fold(t))
    found = [(i, collections.Counter(split(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // total
            if score := sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c):
                scores.append((-score, math.inf if i is None else i))
        out += [(item, rank + 1, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def _ranked(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, DOC).withColumn("rank", F.lit("clash")).repartition(4)
    return sorted(map(tuple, ranking.ranked(d, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_ranking_by_brute_force(spark, monkeypatch, size):
    """Shards and blocks of queries of any size, with many ties."""
    monkeypatch.setattr(ranking, "SHARD_BYTES", size)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 100 * size)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "A1", "a1", "x_y", "ﬀ"]
    text = lambda n: rng.choice([" ", "-", "\x00", "\n"]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 12))) for i in range(150)] + [(1000 + i, "w1 w2 w3") for i in range(40)] + ODD
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(20, None), (21, ""), (22, "unheard"), (23, "w1 w1 w2"), (24, "same lorem NO"), (24, "two"), (23, "w1 w1 w2"), (None, "w3 w4")]
    want = _brute_ranking(docs, items)
    assert _ranked(spark, docs, items) == want and len(want) > 120


def test_ranking_of_ties_at_the_limit():
    scores, ids = np.array([5, 7, 5, 0, 5, 5]), np.array([9, 8, 2, 1, 4, 3])
    assert ids[ranking.best(scores, ids, 3)].tolist() == [8, 2, 3]
    assert ids[ranking.best(scores, ids, 9)].tolist() == [8, 2, 3, 4, 9]


def test_ranking_of_no_rows(spark):
    assert _ranked(spark, [], [(1, "a")]) == [] and _ranked(spark, [(1, None)], [(1, "a")]) == [] and _ranked(spark, [(1, "a")], []) == []


# ---- near-duplicates in bands


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _fold(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute_near(rows):
    sets, up = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), math.inf), math.inf if id_ is None else id_)
    known = lambda v: None if v == math.inf else v
    return sorted(((id_, len(sets[i]), known(least[root(i)]), known(least[root(i)]) == id_) for i, (id_, _) in enumerate(rows)), key=repr)


def _near(spark, rows):
    docs = spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("clash")).withColumn("node", F.lit(1))
    return sorted(map(tuple, banded.near_sets(docs).collect()), key=repr)


def test_near_sets_by_brute_force(spark):
    """Copies of copies, about as far as links go, texts of a few shingles, shared and missing ids."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for n in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 11, 14, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 9)):
            base = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.3:
                base = base[: -rng.randrange(1, 1 + len(base) // 12)] if len(base) > 12 else base[1:]
            rows.append((rng.randrange(10_000), " ".join(base).title() if n % 5 == 0 else "\n".join(base)))
    rows += ODD + [(None, "all of these have no id at all"), (None, "all of these have no id at all")]
    want = _brute_near(rows)
    assert len({r[2] for r in want}) < len(rows) - 60
    assert _near(spark, rows) == want


def test_near_sets_between_the_tips_of_a_star(spark):
    """All copies stand around one text; some are linked to it, some only to each other."""
    rng = random.Random(14)
    base = [f"b{i}" for i in range(160)]
    rows = [(500, " ".join(base))]
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(160), rng.choice((1, 2, 4, 5, 6))):
            copy[at] = f"n{rng.randrange(10**9)}"
        rows.append((rng.randrange(10**6), " ".join(copy)))
        further = list(copy)
        further[rng.randrange(160)] = "f"
        rows.append((rng.randrange(10**6), " ".join(further)))
    want = _brute_near(rows)
    assert 3 < len({r[2] for r in want}) < 60
    assert _near(spark, rows) == want


def test_stars_have_fewer_edges_than_rows(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, bytearray(str(i).encode()), f"{base} end{i}") for i in range(60)], "id long, tag binary, text string")
    edges = banded.star_edges(banded.signatures(docs, 5, banded.BANDS, banded.ROWS)).count()
    assert 59 <= edges <= 60 * banded.BANDS < 60 * 59


def test_near_sets_of_no_rows(spark):
    assert _near(spark, []) == [] and _near(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_a_band_agrees_where_its_bins_do():
    a = banded.shingle_set(b"one two three four five six seven", 5)
    assert np.array_equal(banded.bands(a), banded.bands(a[::-1].copy())) and len(banded.bands(a)) == banded.BANDS

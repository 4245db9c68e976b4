"""The pipeline's operators against brute force, on small tables and on every odd case."""

import collections
import hashlib
import itertools
import os
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import bwt, chat, components, lattice, media, minhash, packing, sentence_pieces, simhash, site_tree, suffix_dedup, support, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOC = "doc_id long, text string"
LONG = "lorem ipsum dolor " * 12_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "two words"), (6, "same text here for both"), (7, "same text here for both"), (7, "same text here for both"), (None, "no id"), (8, "é" * 300), (9, LONG), (10, "tab\tand\x0bvt"), (11, "\x00\x01"), (-5, "minus")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# ---- 1


def _brute_dedup(rows):
    first = {}
    for i, b in sorted(rows, key=lambda r: r[0]):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = 1
        gone = gone[: len(b)]
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[gone == 0])).hexdigest()))
    return sorted(out)


def _brute_kept(rows):
    """What is left of each row's text, without characters that are cut in two."""
    first, out = {}, []
    for i, b in rows:
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(i, first.get(w, i))
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        out.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return sorted(out)


def _dedup(df, **kw):
    return sorted((support_none(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df, **kw).collect())


def support_none(i):
    return suffix_dedup.LAST if i is None else i


@pytest.mark.parametrize("kw", [{}, {"group_bytes": 60_000}, {"group_bytes": 60_000, "hot_groups": 2}])
def test_op1_against_brute_force(docs, texts, kw):
    assert _dedup(docs, **kw) == _brute_dedup([(i, t.encode()) for i, t in texts.items()])


def test_op1_odd(spark, odd, none):
    assert _dedup(odd) == _brute_dedup([(support_none(i), (t or "").encode()) for i, t in ODD])
    assert suffix_dedup.deduplicated(none).count() == 0
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(60)]  # few distinct windows, all of them shared
    assert _dedup(spark.createDataFrame(rows, DOC)) == _brute_dedup([(i, t.encode()) for i, t in rows])


def test_op1_text_loses_cut_characters(spark):
    t = "x" + "é" * 60
    out = {r.doc_id: r.text for r in suffix_dedup.deduplicated(spark.createDataFrame([(1, t), (2, "y" + t[1:] + "z")], DOC)).collect()}
    assert out == {1: t, 2: "yz"}


def test_interval_expansion():
    rng = np.random.default_rng(0)
    for n, letters in itertools.product((1, 2, 60, 300), (1, 2, 4)):
        x = rng.integers(97, 97 + letters, n).astype(np.uint8)
        order, group = bwt.common_prefix_groups(x)
        ring = bytes(np.resize(x, n + 50))
        by = collections.defaultdict(set)
        for i, g in zip(order, group, strict=True):
            by[g].add(ring[i : i + 50])
        assert all(len(s) == 1 for s in by.values()) and len(by) == len({ring[i : i + 50] for i in range(n)})


def test_crowded_keys_are_dealt_by_window():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 101, 300).astype(np.uint8)
    at, n, low = rng.integers(0, 200, 200), rng.integers(1, 40, 200), rng.integers(0, 999, 200)
    segments = [base[a : a + k + 49] for a, k in zip(at, n, strict=True)]
    got = suffix_dedup.least_documents(np.concatenate(segments), n, low, np.zeros(200, np.uint64), 500)
    least = {}
    for s, d in zip(segments, low.tolist(), strict=True):
        for j in range(len(s) - 49):
            least[s[j : j + 50].tobytes()] = min(d, least.get(s[j : j + 50].tobytes(), 1 << 60))
    assert got.tolist() == [least[s[j : j + 50].tobytes()] for s in segments for j in range(len(s) - 49)]


# ---- 2


def test_op2_base_score(docs, texts):
    count = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*t.encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    rows = lattice.scored(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        toks = [*texts[r.doc_id].encode().lower().split(), None]
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(toks), sum(count[w] > 0 for w in toks), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.score < 0


def test_op2_lattice_sums_all_segmentations():
    names = [bytes([b]) for b in range(256)] + [lattice.WORD_START + b"a", b"ab", b"bc", b"abc", b"aa"]
    p = np.full(len(names), 1.0)
    p[256:] = 30
    lat = lattice.Lattice(names, np.log(p / p.sum()))
    prob = dict(zip(names, np.exp(lat.log_p[0]), strict=True))

    def total(s):
        return 1.0 if not s else sum(prob[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in prob)

    words = [b"a", b"abc", b"aabcab", b"zz", "é".encode(), b"", b"abcabc"]
    got = lat.log_probability(words)[0]
    assert np.allclose(np.exp(got), [total(lattice.WORD_START + w) for w in words])
    # expected uses are derivatives of the log probability: of k bytes each is covered once
    e = lat.expected([b"aabcab"], 0)
    assert e @ np.array([len(x) for x in names]) == pytest.approx(len(lattice.WORD_START) + 6)


def test_op2_vocabulary_score(spark):
    """The likelihood by the vocabulary's own weights, over all segmentations of each word, and the share of ends."""
    rows = [(i, f"Some words here, {i} and more") for i in range(12)] + [(100, ""), (101, None)]
    got = {r.doc_id: r for r in lattice.scored(spark.createDataFrame(rows, DOC)).collect()}
    lat = lattice.Lattice.read(lattice.VOCABULARY)
    ends = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)
    n = next(iter(got.values())).train_tokens
    end = (ends + 0.5) / (n - ends + ends + 1)
    for i, t in rows:
        words = lattice.words_of((t or "").encode())
        want = lat.log_probability(words)[0].sum() if words else 0.0
        assert got[i].vocabulary_score == pytest.approx((want + len(words) * np.log(1 - end) + np.log(end)) / np.log(10), rel=1e-5)


def test_op2_odd(odd, none):
    rows = lattice.scored(odd).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lattice.scored(none).count() == 0


# ---- 3


def test_op3_blocks():
    page = '<body><header><h1>Site</h1></header><div class="sidebar">x</div><article><header><h1>T &amp; &lt;b&gt;</h1></header><p>a <b>bold</b>ly&nbsp; x<br>y<p>c<span class="ad">AD</span>d</p><ul><li>1<li>2</ul><script>if(a<b){"</p>"}</script><form>f</form><section class="comments"><p>c1</p></section></article><aside>z</aside><footer>f</footer>'
    assert site_tree.Page(page).main_text() == "T & <b>\na boldly x y\ncd\n1\n2"
    assert site_tree.Page("").main_text() == "" and site_tree.Page("1 < 2 & x &eacute;").main_text() == "1 < 2 & x é"
    assert site_tree.Page("<div id=cookieNotice>c</div><p>a<script>b</script>c</p>").main_text() == "ac"
    assert site_tree.Page("<p>open <b>tags <!-- end").main_text() == "open tags"


def test_op3_importance_removes_what_all_pages_share(spark):
    rows = [(i, f"http://h.example:80/{i}", f'<html><body><div class="top"><p>Welcome</p></div><div class="c"><p>Text {i}</p></div></body></html>') for i in range(12)]
    rows += [(100, None, None), (101, "http://other.example/", '<div class="top"><p>Welcome</p></div>'), (101, "http://other.example/", '<div class="top"><p>Welcome</p></div>')]
    got = sorted((r.page_id, r.text) for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [*((i, f"Text {i}") for i in range(12)), (100, ""), (101, "Welcome"), (101, "Welcome")]
    assert site_tree.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(pages)]
    return [r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_op3_template_branches_inside_articles_go(spark):
    """A licence branch on every page goes; a paragraph that all articles quote stays."""
    pages = [f'<article><h1>Title {i}</h1><div class="story"><p>Text {i}</p><p>As they say</p></div><div class="lic"><p>Free to copy</p></div></article>' for i in range(12)]
    assert _extracted(spark, pages) == [f"Title {i}\nText {i}\nAs they say" for i in range(12)]
    # what only half of the pages show is no template
    assert _extracted(spark, pages + [f"<article><p>Other {i}</p></article>" for i in range(12)])[0] == "Title 0\nText 0\nAs they say\nFree to copy"


@pytest.mark.parametrize("tag", ["article", "section"])
def test_op3_copies_count_once(spark, tag):
    """Copies of one page don't make the wrapper of all pages a template; an article stays in any wrapper."""
    texts = ["Copied"] * 300 + [f"Text {i}" for i in range(20)]
    pages = [f'<div id="page"><{tag}><p>{t}</p></{tag}></div>' for t in texts]
    assert _extracted(spark, pages) == texts


def test_op3_article_in_a_removed_wrapper_stays():
    page = '<div id="page"><p>Welcome</p><article><p>Text</p></article></div>'
    gone = frozenset(p for p, _, _ in site_tree.Page('<div id="page"><p>Welcome</p></div>').nodes)
    assert site_tree.Page(page, gone).main_text() == "Text"


def test_op3_tags_are_read_by_the_rules_of_html():
    text = lambda s: site_tree.Page(s).main_text()
    assert text('<p class="a"">First</p><p class=b\'>Second') == "First\nSecond"
    assert text('<p title="a > b">x</p><p title=\'<p>\'>y</p>') == "x\ny"
    assert text('<p a=">z') == "" and text("kept<p") == "kept" and text("<p/class=x>y</p >z</ p>") == "y\nz"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after") == "deep\nafter"


@pytest.mark.parametrize("unit", ["<a ", "<b>", "<b></x>", "<div>x", "<p><b>", "<", "\"'<p a=", "<!--", "</", "&"])
def test_op3_hostile_pages_are_read_in_one_pass(unit):
    """Twice the page, about twice the work."""
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        site_tree.Page("<b>" * 1000 + unit * (n // len(unit))).main_text()
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_op3_importance_by_brute_force(spark):
    rng = random.Random(33)
    pages = []
    for i in range(40):
        body = "".join(f'<div class="{rng.choice("abc")}">' + "".join(f"<{t}>{rng.choice(['same', f'own {i}', 'other'])}</{t}>" for t in rng.choices(("p", "h2"), k=rng.randrange(4))) + "</div>" for _ in range(rng.randrange(4)))
        pages.append((i, f"http://{rng.choice('xy')}.example/", f"<body>{body}<p>page {i}</p>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.host, r.node): (r.pages, r.presentation, r.content, r.importance) for r in site_tree.importance(site_tree.observed(df)).collect()}
    shown = collections.defaultdict(lambda: ([], []))
    for _, url, source in pages:
        styles, blocks = collections.defaultdict(set), collections.defaultdict(set)
        for path, style, found in site_tree.Page(source).nodes:
            styles[path].add(style)
            blocks[path] |= set(found)
        for path in styles:
            node = shown[site_tree.host_of(url), path]
            node[0].append(styles[path])
            node[1].append(blocks[path])
    assert got.keys() == shown.keys()
    for key, (styles, blocks) in shown.items():
        n = collections.Counter(s for x in styles for s in x)
        m = sum(n.values())
        presentation = -sum(c / m * np.log(c / m) for c in n.values()) / np.log(m) if m > 1 else 1.0
        k = collections.Counter(b for x in blocks for b in x)
        each = [np.log(k[b]) / np.log(m) for x in blocks for b in x] if m > 1 else []
        content = presentation if not k else 1 - min(1, np.mean(each)) if m > 1 else 1.0
        assert got[key] == (m, pytest.approx(presentation), pytest.approx(content), pytest.approx(0.1 * presentation + 0.9 * content))


def test_op3_a_name_inside_an_article_is_a_prior_only(spark):
    """A branch that is called like noise stays where it says something of its own on each page, and goes where it repeats."""
    pages = [f'<article><p>Text {i}</p><div class="response"><p>Answer {i}</p></div><div class="alert"><p>{"Old" if i % 2 else "New"}</p></div><section class="comments"><p>Says {i}</p></section></article>' for i in range(12)]
    assert _extracted(spark, pages) == [f"Text {i}\nAnswer {i}" for i in range(12)]


def test_op3_the_tree_alone(spark):
    """Without names, entropy tells the menus of a host from its articles."""
    pages = [f'<nav><p>Home</p><p>News</p></nav><div class="x1"><h1>Title {i}</h1><p>Text {i}</p></div><footer><p>All rights</p></footer>' for i in range(12)]
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extracted(rows, named=False).collect()}
    assert got == {i: f"Title {i}\nText {i}" for i in range(12)}


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("ids", [(100, 200), (None, None), (3, 3)])
def test_op3_rows_that_share_an_id_keep_their_text(spark, ids):
    """What one host repeats is another page's own, whatever the rows' ids are."""
    rows = [(ids[0] if i == 0 else i + 50, f"http://a.com/{i}", f'<body><div class="box"><p>beta box text of its own</p></div><div class="c"><p>alpha main {i}</p></div></body>') for i in range(12)]
    rows += [(ids[1], "http://b.com/", '<body><div class="box"><p>beta box text of its own</p></div><div class="c"><p>beta main</p></div></body>')]
    got = {r.url: r.text for r in site_tree.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {f"http://a.com/{i}": f"alpha main {i}" for i in range(12)} | {"http://b.com/": "beta box text of its own\nbeta main"}


def test_op3_unmarked_pages_go_by_the_tree(spark):
    """A name that a page's own part may have is a prior: what repeats over the host goes, what is a page's own stays, on small hosts, too."""
    pages = [f'<div class="notice"><p>We use cookies</p></div><div class="search-results"><p>Result {i}</p></div><div class="ad"><p>Buy {i}</p></div>' for i in range(12)]
    assert _extracted(spark, pages) == [f"Result {i}" for i in range(12)]
    assert _extracted(spark, ['<div class="search-results"><p>All my text</p></div>', '<div class="widget-content"><p>Main body</p></div>']) == ["All my text", "Main body"]


def _brute_extracted(rows):
    """The texts by plain counting over each host: nodes of all pages, their importance, and what goes."""
    out, hosts = [], collections.defaultdict(list)
    for _, url, source in rows:
        hosts[site_tree.host_of(url)].append(site_tree.Page(source or ""))
    for i, url, source in rows:
        every = hosts[site_tree.host_of(url)]
        pages = list({tuple(b for _, b in p.found): p for p in reversed(every)}.values())
        gone = set()
        for path in {n[0] for p in pages for n in p.nodes}:
            shown = [[n for n in p.nodes if n[0] == path] for p in pages]
            shown = [s for s in shown if s]
            styles = collections.Counter(v for s in shown for v in {n[1] for n in s})
            blocks = collections.Counter(v for s in shown for v in {b for n in s for b in n[2]})
            m = sum(styles.values())
            if m < site_tree.MIN_PAGES:
                continue
            presentation = -sum(c / m * np.log(c / m) for c in styles.values()) / np.log(m)
            content = 1 - min(1, sum(c * np.log(c) for c in blocks.values()) / (sum(blocks.values()) * np.log(m))) if blocks else presentation
            called = path >> 1 & 3
            low = (0.1 * presentation + 0.9 * content) * (1.0, 0.3, 0.1)[called] < 0.25
            if low and (not path & 1 or called or m >= 0.9 * len(pages)):
                gone.add(path)
        out.append((i, site_tree.Page(source or "", frozenset(gone)).main_text()))
    return sorted(out, key=repr)


def test_op3_text_by_brute_force(spark):
    rng = random.Random(34)
    rows = []
    for i in range(120):
        names = ["c", "notice", "search", "ad", "related", "x"]
        body = "".join(f'<div class="{rng.choice(names)}"><p>{rng.choice(["same", f"own {i}", "other", f"own {i} too"])}</p></div>' for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.5:
            body = f"<article>{body}<p>end {i % 30}</p></article><div class=c><p>out</p></div>"
        rows.append((rng.choice([i, None, 7]), f"http://{rng.choice('xxxxyz')}.example/", rng.choice([body] * 20 + [None])))
    got = sorted(((r.page_id, r.text) for r in site_tree.extracted(spark.createDataFrame(rows, PAGES)).collect()), key=repr)
    assert got == _brute_extracted(rows) and len({t for _, t in got}) > 60


# ---- 4


def test_op4_conversations_without_an_id(spark):
    """Rows without conv_id are one conversation, as in SQL."""
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None)]
    messages = chat.as_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    paths = chat.root_paths(messages)
    assert sorted(((r.tree_id, r.leaf_id, r.node_id, r.depth) for r in paths.collect()), key=repr) == sorted([(None, 2, 1, 0), (None, 2, 2, 1), (1, 2, 1, 0), (1, 2, 2, 1), (2, 1, 1, 0)], key=repr)
    out = {r.tree_id: r.formatted for r in chat.formatted(chat.ranked_branches(paths, messages, keep=1), messages).collect()}
    assert out[None] == "[INST] hi [/INST]<s>yes</s>" and out.keys() == {None, 1, 2}


def test_op4_round_trip():
    turns = [("system", "</s>[INST] ok [/INST]"), ("user", "\\l \\\\ <s>[SYS]"), ("assistant", ""), (None, None), ("tool] x", "a[ROLE:b] [/ROLE]"), ("assistant", " spaced </s> \n")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(text[a:b]) for a, b in spans] == ["", " spaced </s> \n"]


def test_op4_paths_of_trees(spark):
    rng = random.Random(3)
    up = {(t, n): (rng.randrange(n) if n and rng.random() < 0.9 else None) for t in range(3) for n in range(25)}
    up[0, 30] = 99  # a parent that isn't there
    df = spark.createDataFrame([(t, n, p) for (t, n), p in up.items()], "tree_id long, node_id long, parent_id long")
    got = {(r.tree_id, r.leaf_id, r.depth, r.node_id) for r in chat.root_paths(df).collect()}
    want = set()
    for t, n in up:
        if not any(k[0] == t and p == n for k, p in up.items()):
            path, at = [], n
            while at is not None and (t, at) in up:
                path.append(at)
                at = up[t, at]
            want |= {(t, n, d, m) for d, m in enumerate(path[::-1])}
    assert got == want
    ranked = chat.ranked_branches(chat.root_paths(df), df.withColumn("score", F.col("node_id").cast("double")), keep=1)
    assert ranked.select("tree_id", "leaf_id").distinct().groupBy("tree_id").count().where("count > 1").count() == 0


def test_op4_cycles_are_on_no_path(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 0)]
    for tree, size in ((1, 3), (2, 2), (3, 4), (4, 1), (5, 7)):  # cycles, and a tail that hangs on each
        rows += [(tree, 100 + k, 100 + (k + 1) % size) for k in range(size)] + [(tree, 200, 100), (tree, 201, 200)]
    rows += [(6, k, k - 1 if k else None) for k in range(40)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long")
    got = {(r.tree_id, r.leaf_id, r.depth, r.node_id) for r in chat.root_paths(df).collect()}
    assert got == {(1, 3, d, d) for d in range(4)} | {(1, 4, 0, 0), (1, 4, 1, 4)} | {(6, 39, d, d) for d in range(40)}


# ---- 5


def test_op5_ranges(spark, monkeypatch):
    """Many small ranges give what one gives."""
    rows = [(i * 7 % 1000, f"text {i} of many words that go on") for i in range(700)] + [(5, "same")] * 3
    df = spark.createDataFrame(rows, DOC)
    one = sorted(map(tuple, minhash.compared(df).collect()))
    monkeypatch.setattr(minhash, "PART_BYTES", 300)
    assert sorted(map(tuple, minhash.compared(df).collect())) == one


def test_op5_likeness_and_edits(docs, texts):
    got = {r.doc_id: r for r in minhash.compared(docs).collect()}
    order = sorted(texts, reverse=True)
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in texts.items()}
    error = []
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        new = minhash.edited(texts[i], following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        other = set(simhash.shingles(new.encode(), 5))
        error.append(r.near_edited - len(sets[i] & other) / max(1, len(sets[i] | other)))
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.05


def test_op5_odd(odd, none):
    rows = minhash.compared(odd).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.fingerprint)
    assert by[6] == by[7] and len(by[7]) == 1 and by[1] == by[2] == by[3] == {""}
    assert minhash.compared(none).count() == 0
    assert minhash.likeness(b"", b"") == 1.0 and minhash.likeness(b"", b"\x01" * 256) == 0.0


# ---- 6


def test_op6_bins(docs, texts, odd, none):
    for df, n in ((docs, len(texts)), (odd, len(ODD))):
        rows = packing.packed(df, (512, 2048, 8192)).collect()
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.grp, r.bin].append(r)
        assert sum(r.piece == 0 for r in rows) == n
        for b in bins.values():
            b.sort(key=lambda r: r.offset)
            assert all(x.offset + x.length == y.offset for x, y in itertools.pairwise(b)) and b[0].offset == 0
            used = b[-1].offset + b[-1].length
            assert b[0].capacity == min(c for c in (512, 2048, 8192) if c >= used) and len({r.capacity for r in b}) == 1
    whole = collections.Counter()
    for r in packing.packed(docs, (512, 2048, 8192)).collect():
        whole[r.doc_id] += r.length
    assert whole == {i: len(t.encode()) + 1 for i, t in texts.items()}
    assert packing.packed(none).count() == 0


def test_op6_best_fit_by_hand():
    # 70 and 60 don't share; 40 goes where least room is left, 30 beside 70
    assert [b for b, _, _ in packing.pack([70, 60, 40, 30], (100,))] == [0, 1, 1, 0]
    assert [c for _, _, c in packing.pack([5], (8, 100))] == [8]


def test_op6_equal_rows_are_dealt(spark, monkeypatch):
    """Many equal rows are packed each, and no group gets them all."""
    monkeypatch.setattr(packing, "GROUP_TOKENS", 40_000)
    monkeypatch.setattr(packing, "SHARED_TOKENS", 25_600)
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    df = df.unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 300).alias("text")))
    rows = packing.packed(df, (512, 2048)).collect()
    assert len(rows) == 3500 and sum(r.length for r in rows) == 3000 + 500 * 301
    assert max(collections.Counter(r.grp for r in rows).values()) < 1750
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.grp, r.bin].append((r.offset, r.length))
    for b in bins.values():
        assert all(a + n == c for (a, n), (c, _) in itertools.pairwise(sorted(b)))


def _pack_by_rule(lengths, capacities):
    """The rule as it is stated, without its data structures."""
    bins, out, left = [], [], sum(lengths)
    for n in lengths:
        open_ = [(c - u, k) for k, (c, u) in enumerate(bins) if c - u >= n]
        if open_:
            k = min(open_)[1]
        else:
            _, c = min((packing.cost(c) / min(c, left), c) for c in capacities if c >= n)
            k = len(bins)
            bins.append([c, 0])
        out.append((k, bins[k][1]))
        bins[k][1] += n
        left -= n
    return [(k, at, min(c for c in capacities if c >= bins[k][1])) for k, at in out]


def test_op6_by_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        sizes = sorted(rng.sample(range(5, 200), rng.randrange(1, 4)))
        lengths = sorted((rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(1, 80))), reverse=True)
        assert packing.pack(lengths, tuple(sizes)) == _pack_by_rule(lengths, sizes)


# ---- 7


def test_op7_without_dropout_is_the_librarys(texts):
    p = sentence_pieces.Pieces.read(sentence_pieces.VOCABULARY)
    sample = [*texts.values(), "hello  world\n x", "é \t\x00a", "  a", "", "   ", "x" * 300, "日本語😀  x"]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.VOCABULARY)
    assert [x.tolist() for x in p.encode(sample, [0] * len(sample), rate=0)] == sp.encode(sample)


def test_op7_dropout_is_seeded_varied_and_lossless(odd, none):
    p = sentence_pieces.Pieces.read(sentence_pieces.VOCABULARY)
    t = ["the quick brown fox jumps over the lazy dog again and again ▁ é\n"] * 2
    ids = lambda seed: [x.tolist() for x in p.encode(t, [0, 1], rate=0.3, seed=seed)]
    a, b = ids(1)
    assert a != b and ids(1) == [a, b] != ids(2)
    assert p.decode(np.array(a)) == p.decode(np.array(b)) == t[0]
    rows = sentence_pieces.encoded(odd).collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert sentence_pieces.encoded(none).count() == 0


def test_op7_agenda_by_hand(texts):
    p = sentence_pieces.Pieces.read(sentence_pieces.VOCABULARY)
    look = {int(k): (float(s), int(i)) for k, s, i in zip(p.pair_keys, p.pair_scores, p.pair_ids, strict=True)}

    def agenda(chunk, rate, seed, variant):
        name = sentence_pieces.chunk_names(np.array([[ord(c) for c in chunk]], np.uint32)) ^ sentence_pieces._mix(np.array([seed * 1_000_003 + variant], np.uint64))
        parts = [(k, k + 1, p.chars[c]) for k, c in enumerate(chunk)]
        while True:
            best = None
            for k, (a, b) in enumerate(itertools.pairwise(parts)):
                c = look.get(a[2] << 32 | b[2])
                key = np.array([a[0] << 40 | b[0] << 20 | b[1]], np.uint64)
                if c and int(sentence_pieces._mix(name ^ sentence_pieces._mix(key * sentence_pieces._ODD + np.uint64(1)))[0]) >= int(rate * 2**64) and (best is None or c[0] > best[0]):
                    best = (c[0], k, c[1])
            if best is None:
                return [x[2] for x in parts]
            k = best[1]
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], best[2])]

    chunks = sorted({c for t in list(texts.values())[:20] for c in sentence_pieces._CHUNK.findall(" " + t) if all(ch in p.chars for ch in c)})[:300]
    assert [np.frombuffer(x, np.int32).tolist() for x in p.encode_chunks(chunks, 3, 0.3, 5)] == [agenda(c, 0.3, 5, 3) for c in chunks]


def test_op7_long_chunks_give_the_same(texts, monkeypatch):
    """The heap's agenda and the rounds over all chunks merge alike; an unbroken text takes seconds."""
    p = sentence_pieces.Pieces.read(sentence_pieces.VOCABULARY)
    chunks = sorted({c for t in list(texts.values())[:30] for c in sentence_pieces._CHUNK.findall(" " + t)})[:400] + ["x" * 300, "ab" * 200, "".join(texts.values()).replace(" ", "").replace("\n", "")[:3000], "日本語" * 90]
    for rate in (0, 0.3):
        monkeypatch.setattr(sentence_pieces, "LONG", 10_000)
        want = p.encode_chunks(chunks, 2, rate, 5)
        monkeypatch.setattr(sentence_pieces, "LONG", 1)
        assert p.encode_chunks(chunks, 2, rate, 5) == want
    monkeypatch.undo()
    whole = "".join(texts.values()).replace(" ", "").replace("\n", "")[:80_000]
    assert p.decode(p.encode([whole], [0])[0]) == whole


# ---- 8


def _fp(text):
    words = text.encode().lower().split()
    found = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if found else 0


def _linked(ids, near):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(ids), 2):
        if near(a, b):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_op8_against_brute_force(docs, texts):
    fps = {i: _fp(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in simhash.classes(docs).collect()}
    assert {i: int(r.fp.hex(), 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == _linked(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


@pytest.mark.parametrize("parts", [(2,), (3,), (4,), (1, 2, 3, 4)])
def test_op8_pigeonhole_finds_all(spark, parts, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 40)
    rng = random.Random(parts[0])
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centres for _ in range(12)}
    fps |= {7 ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # one crowded ball
    df = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")), bytearray(f.to_bytes(8, "big"))) for f in fps], "fp binary, node binary")
    if parts == (1, 2, 3, 4):
        parts = (2, 4)
    plan = simhash.plan(df, 64, 3, parts)
    assert sum(p.threshold + 1 for p in plan) == 4
    found = components.components(simhash.links(df, plan, 3))
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in found.collect()}
    want = _linked(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    linked = {i for i in fps if sum(want[j] == want[i] for j in fps) > 1}
    assert got == {i: want[i] for i in linked}


def test_op8_thresholds():
    assert simhash.thresholds([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 3) == (16, [0, 1, 0])
    assert simhash.thresholds([[0, 100, 200], [0, 1, 2], [0, 2, 4]], 3)[1] == [-1, 1, 1]


def test_op8_odd(odd, none):
    got = [(r.doc_id, r.fp.hex(), r.component_id) for r in simhash.classes(odd).collect()]
    assert len(got) == len(ODD) and {f for i, f, _ in got if i in (1, 2, 3)} == {"0" * 16}
    assert {c for i, _, c in got if i in (1, 2, 3)} == {1} and {c for i, _, c in got if i in (6, 7)} == {6}
    assert simhash.classes(none).count() == 0


def _near(spark, rows):
    return {r.id: r.first_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}


def _sets(rows):
    return {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows}


def _exact(sets):
    return _linked(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows}
    want = _linked(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = _near(spark, rows)
    assert sum(got[i] != want[i] for i in want) <= 1 and all(got[i] == i or len(sets[i] & sets[got[i]]) > 0 for i in got)


def test_near_duplicates_lose_no_link_beside_unlike_candidates(spark):
    """Trees of copies of copies: alike enough are a text and its copy only, but all of a tree are candidates."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(4000)]
    rows, parent = [], {}
    for _ in range(4):
        first = len(rows)
        rows.append([rng.choice(words) for _ in range(70)])
        for _ in range(40):
            parent[len(rows)] = of = rng.randrange(first, len(rows))
            copy = list(rows[of])
            copy[rng.randrange(5, 65)] = rng.choice(words)
            rows.append(copy)
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)]
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in docs}
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in parent.items())
    got = _near(spark, docs)
    assert sum(got[i] != got[j] for i, j in parent.items()) <= 1


def test_near_duplicates_of_one_fingerprint_are_judged(spark):
    """A long run of one token fixes a fingerprint that counts repeats, whatever the other words are."""
    rng = random.Random(21)
    bases = [[f"u{rng.randrange(10**9)}" for _ in range(150)] for _ in range(8)]
    # each base, and a copy of it that is its only near text
    words = [*bases, *([*b[:-2], "x", f"y{i}"] for i, b in enumerate(bases))]
    docs = [(i, " ".join(["-"] * 2000 + w)) for i, w in enumerate(words)]
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in docs}
    want = _linked(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert want == {i: i % 8 for i in range(16)}
    assert _near(spark, docs) == want


def test_near_duplicates_of_repeated_lines(spark):
    """Lines that a copy repeats change its shingle set little."""
    rng = random.Random(22)
    rows = []
    for repeats in (5, 20, 50, 200):
        base = [f"u{rng.randrange(10**9)}" for _ in range(600)]
        line = [f"l{rng.randrange(10**9)}" for _ in range(8)]
        rows += [base, base + line * repeats]
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)]
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in docs}
    want = _linked(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert want == {i: i - i % 2 for i in range(8)}
    assert _near(spark, docs) == want


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates_around_one_text(spark, monkeypatch, block):
    """Copies of one text, too many of them too far from it and from each other: who is alike only an outlying one is found, too."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(23)
    base = [f"b{i}" for i in range(120)]
    rows = [base]
    for n in range(90):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 4, 6, 7))):
            copy[at] = f"n{rng.randrange(10**9)}"
        rows.append(copy)
        if n % 3 == 0:  # and one that follows the copy
            further = list(copy)
            for at in rng.sample(range(120), 2):
                further[at] = f"f{rng.randrange(10**9)}"
            rows.append(further)
    rng.shuffle(rows)
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want = _exact(_sets(docs))
    assert 5 < len(set(want.values())) < 100
    got = _near(spark, docs)
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want) and all(want[got[i]] == want[i] for i in want)


def test_linked_sets_are_all_links(spark):
    """Given any pairs that connect all nodes, the labels are those of all links."""
    rng = random.Random(24)
    base = set(range(100))
    sets = [base] + [(base - set(rng.sample(range(100), k := rng.randrange(25)))) | {rng.randrange(10**6) for _ in range(rng.randrange(12))} for _ in range(150)]
    sets += [{rng.randrange(200, 260) for _ in range(50)} for _ in range(60)] + [set(range(1000, 1000 + k)) for k in range(1, 12)]
    name = lambda i: bytearray(i.to_bytes(4, "big"))
    nodes = spark.createDataFrame([(name(i), bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)], "node binary, hashes binary")
    pairs = spark.createDataFrame([(name(i), name(i + 1)) for i in range(len(sets) - 1)], "a binary, b binary")
    want = _exact(dict(enumerate(sets)))
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in simhash.linked_sets(pairs, nodes, 0.8).collect()} == want


def test_near_duplicates_are_judged_by_row(spark):
    """Rows that share an id go by their own texts; a null id comes last."""
    text = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (None, text(3)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (None, None), (8, ""), (9, " ")]
    docs = spark.createDataFrame(rows, DOC).withColumn("first_id", F.lit("clash"))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, text(1)), (5, text(2)), (7, text(3)), (7, text(4)), (8, "")])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_repeats_are_cut_by_row(spark):
    """Rows that share an id keep what is their own; a null id comes last."""
    rng = random.Random(25)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(3))
    rows = [(1, a), (5, "x" + a), (5, b), (None, b + "tail"), (None, c), (5, "x" + a)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], DOC + ", n_chars int")
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()) == sorted([(1, a, 120), (5, "x", 1), (5, b, 120), (0, "tail", 4), (0, c, 120), (5, "x", 1)])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    nodes = sorted({i for p in pairs for i in p})
    up = {i: i for i in nodes}
    for _ in nodes:
        for a, b in pairs and (tuple(p) for p in pairs):
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


# ---- 9


def test_op9_round_trip_at_all_sizes():
    rng = np.random.default_rng(9)
    for n in [*range(400), 4095, 4096, 4097, 8192, 40_000]:
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        d = media.demux(media.mux(data))
        assert d["data"].get(media.ES_PID, b"") == data and d["gaps"] == d["errors"] == 0
    assert d["programs"] == [(1, media.PMT_PID)] and d["streams"] == [(media.ES_PID, media.STREAM_TYPE)]
    assert [u[1] for u in d["units"]] == [i * media.TICKS for i in range(10)] and [u[3] for u in d["units"]] == [True, *[False] * 7, True, False]


def test_op9_lost_packets_and_noise_are_seen():
    stream = media.mux(bytes(range(256)) * 40)
    cut = stream[: 188 * 5] + stream[188 * 6 :]
    assert media.demux(cut)["gaps"] == 1 and media.demux(stream + b"xx")["errors"] == 2
    assert media.demux(b"\x00" * 188)["errors"] == 188 and media.demux(None)["units"] == []


def test_op9_packets_may_repeat_and_noise_may_stand_anywhere():
    data = bytes(range(256)) * 40
    stream = media.mux(data)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    read = lambda s: (media.demux(s)["data"].get(media.ES_PID), *(media.demux(s)[k] for k in ("gaps", "repeats", "errors")))
    assert read(b"".join(p for p in packets for _ in range(2))) == (data, 0, len(packets), 0)
    assert read(b"".join([*packets[:7], packets[6], *packets[7:]])) == (data, 0, 1, 0)
    for noise in (b"x", b"G", b"Gx" * 40, bytes(500)):
        assert read(noise + stream)[:2] == (data, 0) and media.demux(noise + stream)["errors"] == len(noise)
        assert read(b"".join(packets[:9]) + noise + b"".join(packets[9:]))[:2] == (data, 0)
    assert read(stream + stream[:100]) == (data, 0, 0, 100)
    # a damaged sync byte costs its packet only
    got = media.demux(b"".join([*packets[:9], b"\x00" + packets[9][1:], *packets[10:]]))
    assert (got["gaps"], got["errors"]) == (1, 188) and len(got["units"]) == 3
    rng = random.Random(9)
    for _ in range(200):  # whatever comes
        media.demux(bytes(rng.choice((0x47, 0, 1, 255)) for _ in range(rng.randrange(900))))


def test_op9_tables_over_packets():
    """Two long tables in one PID, cut over packets at odd places."""
    many = b"".join((k).to_bytes(2, "big") + (0xE000 | 0x200 + k).to_bytes(2, "big") for k in range(1, 91))
    one, two = media._section(0, 1, many), media._section(0, 2, (500).to_bytes(2, "big") + (0xE000 | 0x500).to_bytes(2, "big"))
    packets, rest, first = [], one, True
    while rest:
        room = 184 - first
        part, rest = rest[:room], rest[room:]
        body = (b"\x00" if first else b"") + part
        if not rest:  # the second begins where the first ends
            body = bytes([len(part)]) + part + two
            packets.append(media._head(0, True, 1, len(packets)) + body.ljust(184, b"\xff"))
        else:
            packets.append(media._head(0, first, 1, len(packets)) + body)
        first = False
    want = [(k, 0x200 + k) for k in range(1, 91)] + [(500, 0x500)]
    assert media.demux(b"".join(packets))["programs"] == want
    assert media.demux(packets[0] + packets[2])["programs"] in ([], [(500, 0x500)])


def test_op9_operators(spark, odd, none):
    back = media.read_streams(media.write_streams(odd.withColumn("units_", F.lit(1)), "text"))
    got = back.collect()
    assert sorted((support_none(r.doc_id), bytes(r.data)) for r in got) == sorted((support_none(i), (t or "").encode()) for i, t in ODD)
    long = next(r for r in got if r.doc_id == 9)
    assert [u.pts for u in long.units] == [k * media.TICKS for k in range(-(-len(LONG) // media.UNIT_BYTES))] and [u.random_access for u in long.units[:9]] == [True, *[False] * 7, True]
    assert media.read_streams(media.write_streams(none, "text")).count() == 0


def test_op9_query_by_brute_force(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r)[:7] for r in media.op9_transport_streams(spark, str(tmp_path)).na.fill({"doc_id": support.LAST_ID}).collect())
    want = []
    for i, t in ODD:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        m = media.mux(p)
        want.append((support_none(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    assert got == sorted(want)


# ---- 10


def test_op10_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(10)
    clean = [f"word{i}" for i in range(300)]
    bad = ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        ws = [rng.choice(clean) for _ in range(40)]
        if toxic:
            ws[3], ws[9] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(ws)))
        if i % 3 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOC)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert np.mean([got[i] >= 0.3 for i in got if i % 8 == 0]) > 0.95
    assert np.mean([got[i] >= 0.3 for i in got if i % 8]) < 0.02


def test_op10_sample_is_bounded(spark, monkeypatch):
    """Rows that share a doc_id count once in the sample."""
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 5)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 9)
    seen = []
    monkeypatch.setattr(toxicity, "learn_model", lambda p, u, prior: seen.append((len(p), len(u), prior)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, f"vile {i}") for i in range(2, 40)] + [(None, "x")] * 5, DOC)
    toxicity.train(docs, spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int"), F.lit(True))
    assert seen == [(5, 9, pytest.approx(19 / 39))]


def test_op10_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for d, n in ((odd, len(ODD)), (none, 0)):
        for lab in (labels, labels.limit(0)):
            rows = toxicity.scored(d, toxicity.train(d, lab, F.lit(True))).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    model = toxicity.train(odd, labels, F.lit(True))
    clash = odd.withColumn("score", F.lit("x"))
    assert toxicity.scored(clash, model, "p").columns == ["doc_id", "text", "score", "p"]


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    more = spark.createDataFrame([(i and i + 10**6, t, None, None, None, 2) for i, t in ODD], base.schema)
    base.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(support.stored(stage(spark, kept[-1], str(tmp_path)), name))
        assert kept[-1].columns == docs.columns
    ids = [sorted(support_none(r.doc_id) for r in d.select("doc_id").collect()) for d in kept]
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) == len(ids[3])
    # stage 2 keeps the first row of each group by brute force
    rows = sorted((support_none(r.doc_id), r.text or "") for r in kept[1].collect())
    sets = {k: frozenset(simhash.shingles(t.encode(), 5)) for k, (_, t) in enumerate(rows)}
    groups = _linked(sets, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert ids[2] == sorted(rows[k][0] for k in set(groups.values()))
    # stage 3 by brute force
    before = sorted((support_none(r.doc_id), (r.text or "").encode()) for r in kept[2].collect())
    assert sorted((support_none(r.doc_id), r.text or "") for r in kept[3].collect()) == _brute_kept(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[3], str(tmp_path)).collect()
    assert sorted({support_none(r.doc_id) for r in packed}) == sorted(set(ids[3]))


def _plain_fit(positive, unlabelled, prior, steps, rate=0.05, shrink=1e-4, least=3):
    """The fit in loops over texts and features: weights by feature, intercept, and in how many steps the risk of clean texts was below zero."""
    counts = {}
    for k, rows in enumerate((positive, unlabelled)):
        for ids in rows:
            for f in ids:
                counts.setdefault(int(f), [0, 0])[k] += 1
    used = []
    for f, (a, u) in sorted(counts.items()):
        q = (a + u) / (len(positive) + len(unlabelled))
        error = (max(q * (1 - q), 1e-12) * (1 / len(positive) + 1 / len(unlabelled))) ** 0.5
        if abs(a / len(positive) - u / len(unlabelled)) >= 2.5 * error and a + u >= least:
            used.append(f)
    w, b = dict.fromkeys(used, 0.0), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, below = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0), 0.0, 0.0, 0
    texts = [(True, [int(f) for f in r if int(f) in w]) for r in positive] + [(False, [int(f) for f in r if int(f) in w]) for r in unlabelled]
    for t in range(1, steps + 1):
        z = [b + sum(w[f] for f in ids) for _, ids in texts]
        clean_loss = [np.log1p(np.exp(x)) for x in z]
        rest = sum(x for x, (p, _) in zip(clean_loss, texts, strict=True) if not p) / len(unlabelled) - prior * sum(x for x, (p, _) in zip(clean_loss, texts, strict=True) if p) / len(positive)
        below += rest < 0
        gw, gb = dict.fromkeys(used, 0.0), 0.0
        for x, (p, ids) in zip(z, texts, strict=True):
            s = 1 / (1 + np.exp(-x))
            as_clean = -prior * s / len(positive) if p else s / len(unlabelled)  # of the corrected risk of clean texts
            as_toxic = -prior * (1 - s) / len(positive) if p else 0.0
            g = as_toxic + as_clean if rest >= 0 else -as_clean  # below zero, that risk alone is led back
            gb += g
            for f in ids:
                gw[f] += g
        step = rate / (1 - 0.9**t)
        for f in used:
            m[f], v[f] = 0.9 * m[f] + 0.1 * gw[f], 0.999 * v[f] + 0.001 * gw[f] ** 2
            scale = (v[f] / (1 - 0.999**t)) ** 0.5 + 1e-8
            w[f] -= step * m[f] / scale
            w[f] = np.sign(w[f]) * max(0.0, abs(w[f]) - rate * shrink / scale)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= step * mb / ((vb / (1 - 0.999**t)) ** 0.5 + 1e-8)
    return w, b, below


@pytest.mark.parametrize(("prior", "steps", "switches"), [(0.2, 5, False), (0.2, 40, True), (0.9, 40, True)])
def test_op10_fit_is_the_plain_computation(prior, steps, switches):
    rng = random.Random(40)
    text = lambda marks: np.array(sorted({f for f in range(40) if rng.random() < (0.7 if f in marks else 0.15)}), np.int64)
    positive, unlabelled = [text(range(6)) for _ in range(30)], [text(range(6, 9)) for _ in range(70)]
    w, b, below = _plain_fit(positive, unlabelled, prior, steps)
    model = toxicity.fit(positive, unlabelled, prior, steps)
    assert set(np.flatnonzero(model.weights)) == {f for f, x in w.items() if x} and len(w) > 4
    assert model.intercept == pytest.approx(b, abs=1e-6) and all(model.weights[f] == pytest.approx(x, abs=1e-5) for f, x in w.items())
    assert (below > 0) == switches

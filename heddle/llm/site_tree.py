"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged by path (tags with their classes): a node of the tree has, over the
pages that show it, a distribution of presentations (its sequence of child tags) and of contents (its
blocks of text). With m pages,

    presentation = entropy of the child sequences to base m,
    content      = 1 - mean over text blocks of log_m(pages with that block there),
    importance   = (1 - GAMMA) * presentation + GAMMA * content,

so what looks and reads alike on every page has an importance near 0; a branch that fewer than MIN_PAGES
pages show has 1. Pages of a host that show the same text count once. What a branch is called gives a prior by
which its importance is multiplied: MAYBE_NOISE for words that an article's or a page's own parts may have as well
(`response`, `notice`, `search`), CALLED_NOISE where tag, role or class name a menu, advert, form, reader comment
and the like, else 1. Branches whose product is below THRESHOLD go from each page, wherever they are. No importance
is above 1, so a class whose prior itself is below THRESHOLD is decided before the tree is built, and its branches
are no nodes; with the constants as they are this holds for CALLED_NOISE, and the tree decides on all
others, on pages with and without a marked article. Inside an article a branch without a prior goes only if
NEARLY_ALL pages of the host show it, too: a template's branch has a path of its own with the same content everywhere, but a
paragraph that many articles quote shares its path with their other paragraphs. The element that marks an
article or main part has no importance itself, so no wrapper takes it along. On hosts of fewer than MIN_PAGES
pages the priors decide alone.

Tags are read by HTML's rules in one pass: a quote opens a value only after "=", a tag that the page's end cuts is
dropped, and the work is linear in the page. Elements nested deeper than MAX_DEPTH are part of the branch at
that depth.

Defined results: a null html is empty and gives an empty text; a null url is the host ''; rows are told apart by
url and html, so those that share a page_id, or have none, keep each its own text; a page without
a marked article gives all blocks that are left; rows that repeat give rows that repeat. White space is
what Python's str.split takes; <br> is white space inside a block. Unclosed tags, comments and elements
end with the page.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.support import load, map_rows, rows_out, stored

GAMMA = 0.9
THRESHOLD = 0.25
MIN_PAGES = 8
NEARLY_ALL = 0.9
#: Priors of branches that are called noise, or may be.
CALLED_NOISE = 0.1
MAYBE_NOISE = 0.3
#: By class of what a branch is called.
PRIORS = (1.0, MAYBE_NOISE, CALLED_NOISE)
PLAIN, MAYBE, CALLED = range(3)
MAX_DEPTH = 64

# Elements of HTML and the words that sites name their parts by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset("script style noscript template head title nav footer aside form button select textarea input label dialog menu iframe object svg canvas map audio video".split())
NOISE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs crumbs sidebar sidebars aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus respond response responses reply replies discussion footer masthead pagination pager toolbar skip login search tracking".split())
#: Of these, what an article's or a page's own parts may be called.
OPEN_WORDS = frozenset("alert alerts banner crumbs discussion login masthead modal notice notices notification notifications overlay pager pagination popup promotion replies reply response responses search share sharing skip social toolbar tracking widget widgets".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
ARTICLE_CLASSES = frozenset("article-body article-content article-text articlebody entry-content post-body post-content post-text story-body story-content".split())
CLOSES = {
    **{t: frozenset({"p"}) for t in BLOCK},
    "li": frozenset({"p", "li"}),
    "dt": frozenset({"p", "dt", "dd"}),
    "dd": frozenset({"p", "dt", "dd"}),
    "tr": frozenset({"p", "tr", "td", "th"}),
    "td": frozenset({"p", "td", "th"}),
    "th": frozenset({"p", "td", "th"}),
    "option": frozenset({"option"}),
}
#: What every page has is no branch to remove.
ROOTS = frozenset(("", "html", "body"))
#: An element that ends the search for one to close.
SCOPES = frozenset("table ul ol dl div section article main body html td th button select form".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The end of a tag, or an attribute and its value; a quoted value and its closing quote.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"|\Z)|'([^']*+)('|\Z)|([^\s>\"'][^\s>]*+)?))?)")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

BODY, MAIN, ARTICLE = 0, 1, 2


@dataclass
class Element:
    tag: str
    path: int
    noise: bool
    level: int  # BODY, MAIN or ARTICLE: how the page marks what is in it
    marks: bool = False  # it is what makes the level
    gone: bool = False  # in a branch that the tree removes
    children: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


#: Elements that the search for one to close looks at.
CLOSING = SCOPES | frozenset().union(*CLOSES.values())


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _tag(s: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes of a tag whose name ends at `at`, and where it ends; None if the page ends first."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(s, at):
        at = m.end()
        if m[1]:
            return found, at
        if m[4] == "" or m[6] == "":
            return None
        value = m[3] or m[5] or m[7]
        found.setdefault(m[2].lower(), html_.unescape(value) if value else "")
    return None


class Page:
    """One pass over a page. gone: paths of branches to leave out; prior: whether what branches are called counts."""

    def __init__(self, source: str, gone: frozenset[int] = frozenset(), prior: bool = True):
        self.gone, self.prior, self.stack, self.nodes = gone, prior, [Element("", 0, False, BODY)], []
        self.closing: list[int] = []  # places of such elements in the stack
        self.open: Counter[str] = Counter()
        self.found: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.dark: list[str] = []  # text of noise, for the tree only
        self._read(source)

    def _flush(self) -> None:
        """Ends the block: of its words those outside noise are a block of the page."""
        if self.text or self.dark:
            top, node = self.stack[-1], self.stack[: MAX_DEPTH][-1]
            for text, out in ((self.text, self.found), (self.dark, None)):
                if words := "".join(text).split():
                    block = " ".join(words)
                    node.blocks.append(_hash(block))
                    if out is not None:
                        out.append((top.level, block))
            self.text, self.dark = [], []

    def _say(self, text: str) -> None:
        top = self.stack[-1]
        (self.dark if top.noise or top.gone else self.text).append(text)

    def _pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if self.closing and self.closing[-1] == len(self.stack):
            self.closing.pop()
        if e.tag not in ROOTS and len(self.stack) < MAX_DEPTH:
            if not e.marks and not e.noise:  # what no importance could keep is no node
                self.nodes.append((e.path, _hash(" ".join(e.children)), e.blocks))
            self.stack[-1].blocks += e.blocks  # a branch's content is all text in it

    def _open(self, tag: str, a: dict[str, str]) -> None:
        if tag in CLOSES:
            for i in reversed(self.closing):
                t = self.stack[i].tag
                if t in CLOSES[tag]:
                    while len(self.stack) > i:
                        self._pop()
                    break
                if t in SCOPES:
                    break
        top = self.stack[-1]
        if not top.children or top.children[-1] != tag:
            top.children.append(tag)
        if tag in VOID:
            return
        names = f"{a.get('class', '')} {a.get('id', '')}"
        words = {w.lower() for w in _WORDS.findall(names)} if names.strip() else set()
        level = top.level
        if tag == "article" or a.get("itemprop", "").lower() == "articlebody" or not ARTICLE_CLASSES.isdisjoint(names.lower().split()):
            level = ARTICLE
        elif level == BODY and (tag == "main" or a.get("role", "").lower() == "main" or a.get("id", "").lower() == "main-content"):
            level = MAIN
        called = self._called(tag, a, words, level) if self.prior else PLAIN
        noise = tag in RAW or PRIORS[called] < THRESHOLD  # times 1, the most that importance can be
        # the last bits tell what is inside a marked part, and the class of the name
        path = _hash(f"{top.path}/{tag}.{re.sub(r'[0-9]+', '#', names.strip())}") & ~7 | (level != BODY) | called << 1
        marks = level > top.level
        if tag in CLOSING:
            self.closing.append(len(self.stack))
        self.open[tag] += 1
        self.stack.append(Element(tag, path, top.noise or noise, level, marks, not marks and (top.gone or path in self.gone)))

    @staticmethod
    def _called(tag: str, a: dict[str, str], words: set[str], level: int) -> int:
        """The class of what the markup calls an element."""
        if tag in NOISE_TAGS or a.get("role", "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return CALLED
        if tag in ("html", "body", "main"):
            return PLAIN
        if level != ARTICLE and (tag == "header" or "header" in words):
            return CALLED
        named = words & NOISE_WORDS
        if tag == "article":
            return CALLED if named and not words.isdisjoint(("comment", "comments", "reply", "related")) else PLAIN
        return PLAIN if not named else MAYBE if named <= OPEN_WORDS else CALLED

    def _close(self, tag: str) -> None:
        while self.open[tag] > 0:
            last = self.stack[-1].tag
            self._pop()
            if last == tag:
                return

    def _read(self, s: str) -> None:
        at, end = 0, len(s)
        while at < end:
            begin = s.find("<", at)
            # a "<" that begins no tag is text
            while 0 <= begin < end - 1 and not (s[begin + 1] in "!?/" or s[begin + 1].isascii() and s[begin + 1].isalpha()):
                begin = s.find("<", begin + 1)
            if begin < 0 or begin == end - 1:
                self._say(html_.unescape(s[at:]))
                break
            if begin > at:
                self._say(html_.unescape(s[at:begin]))
            at = self._markup(s, begin, end)
        self._flush()
        while self.stack:
            self._pop()

    def _markup(self, s: str, at: int, end: int) -> int:
        """Reads the tag, comment or declaration at `at`, and says where it ends."""

        def after(mark: str, start: int) -> int:
            found = s.find(mark, start)
            return end if found < 0 else found + len(mark)

        if s.startswith("<!--", at):
            return after("-->", at + 4)
        if s.startswith("<![CDATA[", at):
            stop = after("]]>", at + 9)
            self._say(s[at + 9 : stop - 3 if s.startswith("]]>", stop - 3) else stop])
            return stop
        closing = s[at + 1] == "/"
        name = _NAME.match(s, at + 1 + closing)
        if not name:  # a declaration, or an end tag without a name, which HTML takes as a comment
            return after(">", at + 1)
        tag, found = name[0].lower(), _tag(s, name.end())
        if not found:
            return end
        attributes, at = found
        if tag == "br":
            self._say(" ")
            return at
        if tag in BLOCK:
            self._flush()
        if closing:
            self._close(tag)
            return at
        self._open(tag, attributes)
        if tag in RAW and s[at - 2] != "/":
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
            return stop.start() if stop else end
        return at

    def main_text(self) -> str:
        """The blocks of the best marked level that has any."""
        best = max((level for level, _ in self.found), default=BODY)
        return "\n".join(b for level, b in self.found if level == best)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower() if m else ""


# ---- the tree of each host

STYLE, CONTENT, PAGE = 0, 1, 2
_SEEN = pa.schema([("page", pa.binary()), ("row", pa.int64()), ("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])
SEEN = "page binary, row bigint, host string, node bigint, kind int, value bigint"


def _observe(batches: Iterator[pa.RecordBatch], named: bool) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for name, row, url, source in zip(b["page"].to_pylist(), b["row"].to_pylist(), b["url"].to_pylist(), b["html"], strict=True):
                host, page, seen = host_of(url), Page(source.as_py() or "", prior=named), set()
                for path, style, blocks in page.nodes:
                    seen.add((path, STYLE, style))
                    seen.update((path, CONTENT, x) for x in blocks)
                yield name, row, host, 0, PAGE, _hash("\n".join(block for _, block in page.found))
                for node, kind, value in sorted(seen):
                    yield name, row, host, node, kind, value

    return rows_out(_SEEN, rows(), 4096)


def page_tag() -> Column:
    """128 bits that tell a page: its url, which has its host, and its html."""
    return F.unhex(F.md5(F.concat_ws(" ", F.octet_length(F.coalesce("url", F.lit(""))).cast("string"), "url", "html").cast("binary")))


def observed(pages: DataFrame, named: bool = True) -> DataFrame:
    """For each page (its tag) a hash of its text, and the nodes that it shows, with their child sequences and text blocks (hashes)."""
    return pages.select(page_tag().alias("page"), F.monotonically_increasing_id().alias("row"), "url", "html").mapInArrow(lambda batches: _observe(batches, named), SEEN)


def once(seen: DataFrame) -> DataFrame:
    """What one of the pages of each text shows, for each host; seen: written, so that its row numbers hold."""
    first = seen.where(F.col("kind") == PAGE).groupBy("host", "value").agg(F.min("row").alias("row"))
    return seen.join(first.select("row"), "row", "left_semi")


def importance(seen: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content, importance over all pages of each host."""
    # counts are summed before they meet by node, so a host with many pages is a few rows from each task
    each = seen.where(F.col("kind") != PAGE).groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"))
    log = F.col("n") * F.log(F.col("n").cast("double"))
    sums = each.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == STYLE, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == STYLE, log)).alias("styles"),
        F.sum(F.when(F.col("kind") == CONTENT, F.col("n"))).alias("blocks"),
        F.sum(F.when(F.col("kind") == CONTENT, log)).alias("texts"),
    )
    m = F.log(F.col("pages").cast("double"))
    presentation = F.when(F.col("pages") > 1, 1 - F.col("styles") / (F.col("pages") * m)).otherwise(1.0)
    content = F.when(F.col("blocks").isNull(), presentation).when(F.col("pages") > 1, 1 - F.least(F.lit(1.0), F.col("texts") / (F.col("blocks") * m))).otherwise(1.0)
    out = sums.select("host", "node", "pages", presentation.alias("presentation"), content.alias("content"))
    return out.withColumn("importance", (1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content"))


def extracted(pages: DataFrame, named: bool = True) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html). named: whether what branches are called counts, or the tree alone."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    seen = stored(observed(pages, named), "nodes")
    each = once(seen)
    called = F.shiftright("node", 1).bitwiseAND(F.lit(3)).cast("int")
    prior = F.get(F.array(*map(F.lit, PRIORS)), called)
    low = importance(each).where((F.col("importance") * prior < THRESHOLD) & (F.col("pages") >= MIN_PAGES)).select("host", "node", "pages")
    total = each.where(F.col("kind") == PAGE).groupBy("host").agg(F.count("*").alias("total"))
    free = (F.col("node").bitwiseAND(F.lit(1)) == 0) | (called != PLAIN)
    low = low.join(total, "host").where(free | (F.col("pages") >= NEARLY_ALL * F.col("total"))).select("host", "node")
    shown = seen.where(F.col("kind") == STYLE).select("page", "host", "node").distinct()
    gone = shown.join(low, ["host", "node"]).groupBy("page").agg(F.collect_set("node").alias("gone"))
    gone = stored(gone, "gone")  # a small table is sent to all tasks, and the pages stay where they are
    rows = pages.withColumn("page", page_tag()).join(gone, "page", "left").select("page_id", "url", "html", "gone")
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    return map_rows(rows, lambda i, u, h, g: (i, u, Page(h or "", frozenset(g or ()), named).main_text()), arrow, "page_id bigint, url string, text string")


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_site_style_tree": op3_site_style_tree}
ORACLES: dict[str, str] = {}

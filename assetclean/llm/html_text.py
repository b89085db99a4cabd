"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of styles: a node is a path of
tags with their class and id. Two entropies judge a node:

* presentation: over the different sequences of children it has on the host's
  pages, 1 - 1 / l for l = exp(-sum p ln p), the number of equally frequent
  sequences of that entropy; l does not change with the number of pages;
* content: each text run beneath it that k of the m pages share has entropy
  log k / log m, so text that every page repeats gives 1 and text of one page
  gives 0; the node's content importance is 1 minus the mean over its runs.

A node's importance is (1 - GAMMA^l) * presentation + GAMMA^l * content. A
branch is removed from every page of the host if its node and all nodes with
text beneath it are of low importance, and none has a content importance of
OWN or more; nodes that too few pages have to be judged are not low. Pages with equal main text count once, and a host needs MIN_PAGES
different pages before it is judged. Marks in a page itself (nav, footer,
form, class "ad" and so on) remove branches outright, but where names alone
mark all text of a page, the branch with more than half of it stays; where a
page has an article or main element, only what is inside can stay. A class
name is judged by the word that says what it is for ("site-footer-inner", not
"nav-fixed" or "notice-of-motion").

Text rules: character references decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by a newline.

Defined results: null html is empty text; a null url, or one without a host,
is the host ''; broken markup is read to its end; a page whose branches
would all go keeps those that its own marks allow; repeated rows get equal
texts; extra columns are ignored; an empty table gives no rows. A task holds
one Arrow batch of pages; hosts are judged by sums, never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

GAMMA = 0.9
MIN_PAGES = 4
#: a branch goes below this importance; one inside an article only where
#: nearly every page repeats it
LOW, LOW_IN_ARTICLE = 0.25, 0.05
#: nodes of this content importance never go
OWN = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NOISE_TAGS = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noscript object option script select style svg template textarea title video".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = re.compile(r"^(ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disclaimer|disqus|footer|forms?|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar\w*|signup|skip\w*|social|sponsor\w*|subscribe|toolbar|widgets?)$")
LAYOUT = frozenset(["no", "has", "with", "without"])  # "has-sidebar" names the layout, not the branch
#: parts of a class name that say what is built, after what it is for: "footer-inner", "ad-slot-1"
STRUCTURE = re.compile(r"^(area|articles?|bars?|blocks?|body|box|boxes|buttons?|cols?|columns?|container|content|groups?|holder|icons?|inner|items?|left|links?|lists?|main|outer|panels?|posts?|primary|region|right|rows?|secondary|sections?|slots?|stories|tabs|text|title|toggle|top|bottom|units?|wrap|wrapper|zone|\d+|\d+x\d+)$")
PAGE_ONLY = frozenset(["header"])  # noise outside an article alone
MAIN = frozenset(["article", "main"])
#: an open element of the first kind ends where one of the second begins
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: an open element is not ended from inside these
SCOPE = frozenset(["table", "td", "th", "ul", "ol", "dl", "article", "main", "section", "div", "body", "html", "nav", "aside", "footer", "header", "form", "button"])
CELLS = frozenset(["td", "th", "br"])


def code(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def purpose(name: str) -> str:
    """The word of a class name or id that says what it is for: the last one
    before those of STRUCTURE; none if the name is about the layout."""
    words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    while len(words) > 1 and STRUCTURE.match(words[-1]):
        words.pop()
    return "" if not words or LAYOUT & set(words) else words[-1]


class Node:
    """``noise``: a tag or an attribute of it or of a node around it says that
    it is no text; ``marks``: numbers of the nodes, from the outside in, of
    which a class name or id says so."""

    __slots__ = ("tag", "path", "noise", "marks", "main", "children")

    def __init__(self, tag: str, path: int, noise: bool, marks: tuple[int, ...], main: bool):
        self.tag, self.path, self.noise, self.marks, self.main = tag, path, noise, marks, main
        self.children: list[str] = []


class Page(HTMLParser):
    """Collects text runs (blocks) with the nodes around them, and each
    node's sequence of children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", 0, False, (), False)]
        self.runs: list[tuple[str, list[int], Node]] = []  # text, path codes from the outside in, innermost node
        self.styles: list[tuple[int, int, tuple[int, ...]]] = []  # path, children, marks
        self.n_marks = 0
        self.text: list[str] = []
        self.text_at: list[Node] = []

    def end_block(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                last = self.text_at[-1]
                self.runs.append((line, [n.path for n in self.text_at], last))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if tag in ENDS.get(self.stack[k].tag, ()):
                self.pop_to(k)
                break
            if self.stack[k].tag in SCOPE:
                break
        if tag in BLOCK:
            self.end_block()
        elif tag in CELLS:
            self.text.append(" ")
        top, a = self.stack[-1], dict(attrs)
        names = f"{a.get('class') or ''} {a.get('id') or ''}"
        top.children.append(f"{tag}.{names}")
        main = top.main or tag in MAIN or a.get("role") == "main" or a.get("itemprop") == "articleBody"
        noise = top.noise or tag in NOISE_TAGS or (a.get("role") or "") in NOISE_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        noise = noise or "display:none" in (a.get("style") or "").replace(" ", "").lower() or (not main and tag in PAGE_ONLY)
        marks = top.marks
        if tag not in ("body", "html"):
            words = set(map(purpose, names.split()))
            if (tag not in MAIN and any(map(NOISE_WORDS.match, words))) or (not main and words & PAGE_ONLY):
                self.n_marks += 1
                marks = (*marks, self.n_marks)
        if tag not in VOID:
            self.stack.append(Node(tag, code(top.path, tag, names), noise, marks, main))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.pop_to(k)
                return
            if tag not in BLOCK and self.stack[k].tag in SCOPE:
                return
        if tag == "p":
            self.end_block()

    def pop_to(self, k: int) -> None:
        if any(n.tag in BLOCK for n in self.stack[k:]):
            self.end_block()
        elif any(n.tag in CELLS for n in self.stack[k:]):
            self.text.append(" ")
        for n in self.stack[k:]:
            if not n.noise:
                self.styles.append((n.path, code(*n.children), n.marks))
        del self.stack[k:]

    def handle_data(self, data: str) -> None:
        # inline noise (a script, a button) must not enter the block around it
        top, block = self.stack[-1], self.block_nodes()[-1]
        if top.noise > block.noise or len(top.marks) > len(block.marks):
            return
        if not self.text or not data.isspace():
            if not any(not t.isspace() for t in self.text):
                self.text_at = self.block_nodes()
        self.text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        # "<![" begins a comment up to the next ">", as in browsers; the parser
        # raises an error on words it does not know there
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def block_nodes(self) -> list[Node]:
        """The open elements down to the innermost block."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in BLOCK:
                return self.stack[: k + 1]
        return self.stack[:1]


def believed(runs: list[tuple]) -> set[int]:
    """Marks by names that must be wrong: while no text is left without a mark,
    the outermost branch with more than half of the marked text is freed of its
    own; the marks inside it still count."""
    undone: set[int] = set()
    total = sum(len(r[0]) for r in runs)
    while runs and not any(undone.issuperset(r[2]) for r in runs):
        sizes: dict[int, int] = {}
        for text, _, marks, _ in runs:
            first = next(m for m in marks if m not in undone)
            sizes[first] = sizes.get(first, 0) + len(text)
        most = max(sizes, key=lambda m: sizes[m])
        if 2 * sizes[most] <= total:
            break
        undone.add(most)
    return undone


def parse_page(html: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(runs, chains, styles) of a page. Runs hold what the page's own marks
    allow, with the number of their chain of nodes."""
    p = Page()
    p.feed(html)
    p.close()
    p.pop_to(1)
    p.end_block()
    every = [(t, c, n.marks, n.main) for t, c, n in p.runs if not n.noise]
    undone = believed(every)
    runs = [r for r in every if undone.issuperset(r[2])]
    if any(r[3] for r in runs):
        runs = [r for r in runs if r[3]]
    # equal (path, style) pairs of a page count once
    chains = {c: i for i, c in enumerate(dict.fromkeys((tuple(c), m) for _, c, _, m in runs))}
    return [{"text": t, "chain": chains[tuple(c), m]} for t, c, _, m in runs], [{"path": list(c), "main": m} for c, m in chains], [{"path": a, "style": b} for a, b in dict.fromkeys((a, b) for a, b, m in p.styles if undone.issuperset(m))]


PARSED = "page_id long, url string, host string, fingerprint long, runs array<struct<text:string,chain:int>>, chains array<struct<path:array<long>,main:boolean>>, styles array<struct<path:long,style:long>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, chain = pa.struct([("text", pa.string()), ("chain", pa.int32())]), pa.struct([("path", pa.list_(pa.int64())), ("main", pa.bool_())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("fingerprint", pa.int64()), ("runs", pa.list_(run)), ("chains", pa.list_(chain)), ("styles", pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64())])))])
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part, out = b.slice(at, 200), []
            for key, url, html in zip(*(part.column(i) for i in range(3)), strict=True):
                runs, chains, styles = parse_page(html.as_py() or "")
                m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url.as_py() or "", re.I)
                out.append({"page_id": key.as_py(), "url": url.as_py(), "host": m[1].lower() if m else "", "fingerprint": code(*(r["text"] for r in runs)), "runs": runs, "chains": chains, "styles": styles})
            yield pa.RecordBatch.from_pylist(out, schema)


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, gone: paths of low importance) for hosts that have any."""
    features = F.array_distinct(F.transform("runs", lambda r: F.struct(r["chain"].alias("chain"), F.xxhash64(r["text"]).alias("feature"))))
    one = pages.select("host", "fingerprint", "chains", "styles", features.alias("features")).dropDuplicates(["host", "fingerprint"])
    styles = one.select("host", F.explode("styles").alias("s")).groupBy("host", F.col("s.path").alias("path"), F.col("s.style").alias("style")).agg(F.count("*").alias("n"))
    shape = styles.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    variants = F.exp(F.log("m") - F.col("nlogn") / F.col("m"))  # exp(-sum p ln p)
    # pages that have a node with text, and for each of its texts the pages that share it
    leaf = F.element_at("c.path", -1)
    leaves = one.select("host", F.explode("chains").alias("c")).groupBy("host", leaf.alias("leaf")).agg(F.count("*").alias("m"), F.first("c.path").alias("chain"), F.max("c.main").alias("main"))
    shared = one.select("host", "chains", F.explode("features").alias("f")).select("host", F.get("chains", F.col("f.chain")).alias("c"), "f.feature").groupBy("host", leaf.alias("leaf"), "feature").agg(F.count("*").alias("k"))
    sums = shared.groupBy("host", "leaf").agg(F.sum("k").alias("w"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    by_leaf = sums.join(leaves, ["host", "leaf"]).filter(F.col("m") > 1)
    content = by_leaf.select("host", F.explode("chain").alias("path"), "w", (F.col("klogk") / F.log("m")).alias("h"), "main").groupBy("host", "path").agg((1 - F.sum("h") / F.sum("w")).alias("content"), F.min("main").alias("main"))
    both = content.join(shape, ["host", "path"]).filter(F.col("m") >= MIN_PAGES)
    share = F.pow(F.lit(GAMMA), variants)
    importance = (1 - share) * (1 - 1 / variants) + share * F.col("content")
    low = both.filter((importance < F.when(F.col("main"), LOW_IN_ARTICLE).otherwise(LOW)) & (F.col("content") < OWN))
    low = cut(low.groupBy("host").agg(F.collect_set("path").alias("low")), "low-nodes")
    # of each chain, all down to its last node that is not low stay
    last = F.array_max(F.transform("chain", lambda p, i: F.when(F.array_contains("low", p), 0).otherwise(i + 1)))
    stay = leaves.join(low.withColumnRenamed("host", "l_host"), F.col("host") == F.col("l_host")).select("host", F.explode(F.slice("chain", F.lit(1), last)).alias("path")).distinct()
    gone = low.select("host", F.explode("low").alias("path")).join(stay, ["host", "path"], "left_anti")
    return gone.groupBy("host").agg(F.collect_set("path").alias("gone"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_removed (blocks that the
    host's tree removed)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    parsed = cut(rows.mapInArrow(_parse, PARSED), "pages")
    low = cut(low_branches(parsed), "low").withColumnRenamed("host", "low_host")  # few rows: known to the planner once written
    joined = parsed.join(low, F.col("host") == F.col("low_host"), "left")
    stays = F.filter("runs", lambda r: ~F.arrays_overlap(F.get("chains", r["chain"])["path"], F.col("gone")))
    left = F.when(F.col("gone").isNull() | (F.size(stays) == 0), F.col("runs")).otherwise(stays)
    text = F.array_join(F.transform(left, lambda r: r["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.size(left).cast("long").alias("n_blocks"), (F.size("runs") - F.size(left)).cast("long").alias("n_removed"))


def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

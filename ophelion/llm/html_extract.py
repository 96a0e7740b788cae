"""Main-text extraction with a site style tree.

The DOMs of a host's pages are merged by style path (the tags and class names from the
root, numbers of three digits or more in names left out): a presentation node is a path, a content node the
text that a page shows directly at it. All blocks take part, whatever their tags.

* Presentation importance of a path: 1 - exp(-H), H the entropy of the child sequences
  that the pages show there. A path of one layout has 0; the share of log(pages) isn't
  used because the layouts of an article level off while a host grows.
* Content importance: the entropy of the contents shown there as a share of the
  greatest possible, log(pages); 0 for what every page repeats.
* Composite importance, bottom up: (1 - G) * presentation + G * the mean of the
  children's composites and the path's own content, weighted by their text. It is
  linear in the nodes below, so one sum over (node, ancestor) pairs gives it.

Equal pages of a host count once. What n different pages of a host say about a path
weighs n - 1; against it the tree of all hosts, merged as if they were one, weighs PRIOR,
and against that a neutral value does. So a host of one page is judged by the tree of all
hosts, a large one by its own, and nothing switches at a size; a path of one page in all
has no importance.

The importance of a block is that of the outermost branch around it; what holds all text
of every page (html, body, a wrapper) is no branch. A branch inside counts instead where
its composite is under RELATIVE * G, half of what one text that no other page has gets:
so a low branch takes all inside it along, and an important one keeps what isn't as poor
as a menu. Blocks under RELATIVE times the
page's most important block go, and so does text that nearly every page repeats. A
heading stays with the block that follows it. This is decided first, for every block,
``n_by_tree`` counts what goes by it. Of the rest, what the marks of HTML say is no
content goes too (navigation, footers, asides, forms, class names, what stands outside an
article): a tree can't tell reader comments from a text. Marks protect as well: inside an
article only repeated text goes. Class names and forms give way where they would leave
nothing, or wrap the only article. ``marks=False`` turns them all off.

The tree is a table of a few rows per page and path, summed before the shuffle; a
hot host is a few keys with many counts, not a large group. Its importances
are broadcast where they are few (their number is checked), so the pages themselves
aren't shuffled; beyond that number each page's paths are joined to them. Pages are
parsed twice, which costs less than keeping the parsed ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import release, small_batches, staged

#: Share of what lies below in the composite; blocks under RELATIVE of the page's top go;
#: content importance under REPEATED is text that nearly every page shows. PRIOR: the
#: weight, in pages, of all hosts against one and of NEUTRAL against all hosts.
G, RELATIVE, REPEATED, PRIOR, NEUTRAL = 0.4, 0.5, 0.05, 4, 0.5
#: Ancestors that a node counts for: G**40 is below what a double can add.
NEAR = 40
#: Importances that are broadcast at most (a few MB).
BROADCAST_ROWS = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?=[\s=>/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = frozenset("script style textarea iframe noembed noframes xmp title".split())
#: Elements whose contents aren't shown as text, but which may lack an end tag: then
#: only the tag goes. HTML in svg or select ends it, as in browsers.
_HIDDEN = frozenset("svg select canvas template noscript".split())
_ENDED_BY_BLOCKS = frozenset(("svg", "select"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption", "button"}
#: Tags that say what they hold is no main text, and roles that do; forms may wrap a page.
_STRONG_TAGS = frozenset("nav footer aside head button menu dialog label input select option".split())
_WEAK_TAGS = frozenset("form fieldset".split())
_STRONG_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar".split())
_WEAK_ROLES = frozenset("search form".split())
_NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side-?bar|widget\w*|footer|foot|masthead|site-?header|page-?header|topbar|cookies?\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|comments?\w*|disqus|replies|pagination|pager|toolbar|skip-?link|hidden|sr-only|legal|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)


_DIGITS = re.compile(r"\d{3,}")
_ANY_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCK))})(?=[\s/>])", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_MARK, WEAK, STRONG = 0, 1, 2


def _style_of(name: str, attributes: str) -> tuple[str, int]:
    """(style of the node, how HTML marks it as no content)."""
    mark = STRONG if name in _STRONG_TAGS else WEAK if name in _WEAK_TAGS else NO_MARK
    style = name
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), unescape(a or b or c)
            if key in ("class", "id"):
                if _NOISE_NAMES.search(value):
                    mark = max(mark, WEAK)
                if key == "class":
                    style += "." + ".".join(sorted(_DIGITS.sub("", value).split()))
            elif key == "role":
                mark = max(mark, STRONG if value.lower() in _STRONG_ROLES else WEAK if value.lower() in _WEAK_ROLES else NO_MARK)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                mark = STRONG
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                mark = STRONG
    return style, mark


class Mark:
    """A weak mark of one element; ``article`` tells whether an article or main element
    stands inside it."""

    __slots__ = ("article",)

    def __init__(self):
        self.article = False


@dataclass
class Block:
    """Text of a page: its path, and the marks of the elements around it."""

    path: int
    text: str
    strong: bool
    weak: tuple[Mark, ...]
    article: bool


@dataclass
class Page:
    """Blocks in page order, and the paths: name, parent (-1 for the root), the child
    styles of all its elements, the texts directly at it."""

    blocks: list[Block] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    children: list[list[str]] = field(default_factory=lambda: [[]])

    def above(self, path: int) -> list[int]:
        """The path and its ancestors, nearest first, without the root."""
        out = []
        while path > 0:
            out.append(path)
            path = self.parents[path]
        return out

    def hashes(self) -> list[int]:
        return [_hash(x) for x in self.names]


def _hidden_end(html: str, name: str, at: int) -> int:
    """Where the hidden element that begins at ``at`` ends; ``at`` where it has no end."""
    closing = re.compile(rf"</{name}\s*>", re.I).search(html, at)
    if name in _ENDED_BY_BLOCKS:
        block = _ANY_BLOCK.search(html, at, closing.start() if closing else len(html))
        return block.start() if block else closing.end() if closing else at
    if not closing or re.compile(rf"<{name}(?=[\s/>])", re.I).search(html, at, closing.start()):
        return at
    return closing.end()


def parse_page(html: str | None) -> Page:
    html = html or ""
    page = Page()
    known: dict[str, int] = {"": 0}
    # open nodes: tag, path, strongly marked, weak marks, inside an article
    stack: list[tuple[str, int, bool, tuple[Mark, ...], bool]] = [("", 0, False, (), False)]
    text: list[str] = []

    def flush():
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                k = len(stack) - 1
                while k and stack[k][0] not in _BLOCK:
                    k -= 1
                page.blocks.append(Block(stack[k][1], joined, *stack[-1][2:]))

    def close(name: str, stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        end = bool(m[1])
        block = name in _BLOCK
        if block:
            flush()
        if end:
            if name == "p" and all(x[0] != "p" for x in stack):
                continue
            close(name, frozenset() if block else _BLOCK)
            continue
        if name in _RAW:  # its contents are no text of the page
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = closing.end() if closing else size
            text.append(" ")
            continue
        if name in _HIDDEN:
            if not m[3].rstrip().endswith("/"):
                at = _hidden_end(html, name, at)
            text.append(" ")
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P:
            if any(x[0] == "p" for x in stack):
                close("p", frozenset(("article", "td", "th", "li", "div", "section", "main")))
            if name == "li":
                close("li", frozenset(("ul", "ol", "menu")))
            elif name in ("dd", "dt"):
                close("dd", frozenset(("dl", "dt")))
                close("dt", frozenset(("dl", "dd")))
        elif name in ("td", "th"):
            close("td", frozenset(("tr", "table")))
            close("th", frozenset(("tr", "table")))
        elif name == "tr":
            close("tr", frozenset(("table",)))
        style, mark = _style_of(name, m[3])
        up = stack[-1]
        article = name in ("article", "main")
        if name == "header" and not up[4]:  # the page's header, not an article's
            mark = STRONG
        if article or name in ("body", "html"):
            mark = NO_MARK if mark == WEAK else mark
        if article:
            for x in up[3]:
                x.article = True
        path = up[1]
        if block:
            page.children[path].append(style)
            path_name = f"{page.names[path]}>{style}"
            path = known.setdefault(path_name, len(page.names))
            if path == len(page.names):
                page.names.append(path_name)
                page.parents.append(up[1])
                page.children.append([])
            page.children[path].append("|")  # where an element of the path begins
        stack.append((name, path, up[2] or mark == STRONG, (*up[3], Mark()) if mark == WEAK else up[3], up[4] or article))
    flush()
    return page


Importance = tuple[float, bool, bool]


def branch_scores(page: Page, importances: dict[int, Importance], hashes: list[int]) -> list[float | None]:
    """The importance of each block: that of the outermost branch around it, or of one
    inside that is under RELATIVE * G and lower; of text beside all branches its own.
    None where nothing is known."""
    known = [importances.get(h) for h in hashes]
    branch: list[float | None] = [None] * len(known)  # down to the path
    for k in range(1, len(known)):  # parents come first
        up, own = branch[page.parents[k]], known[k]
        if own is None or own[2]:
            branch[k] = up
        elif up is None or own[0] < min(up, RELATIVE * G):
            branch[k] = own[0]
        else:
            branch[k] = up
    return [known[b.path][0] if branch[b.path] is None and known[b.path] else branch[b.path] for b in page.blocks]


def decide(page: Page, importances: dict[int, Importance], hashes: list[int], marks: bool = True) -> tuple[list[bool], int, int, int]:
    """(whether each block is kept, blocks that the marks would have kept and the tree
    removed, blocks of which the tree has an importance, blocks that the tree removed
    whatever their marks). ``importances`` of path hashes: (score, whether its text is
    repeated, whether it holds all text)."""
    blocks = page.blocks
    every = range(len(blocks))
    score = branch_scores(page, importances, hashes)
    unknown = (NEUTRAL, False, False)
    repeated = [importances.get(hashes[b.path], unknown)[1] for b in blocks]
    clean, inside = list(every), set()
    if marks:
        usable = [i for i in every if not blocks[i].strong]
        clean = [i for i in usable if not blocks[i].weak]
        if not any(blocks[i].article for i in clean):  # weak marks that wrap the only article give way
            clean = [i for i in usable if all(x.article for x in blocks[i].weak)]
        if not clean and usable:  # or that would leave nothing
            least = min(len(blocks[i].weak) for i in usable)
            clean = [i for i in usable if len(blocks[i].weak) == least]
        inside = {i for i in clean if blocks[i].article}
    top = max((score[i] for i in clean if score[i] is not None), default=0.0)
    low = [x is not None and x < RELATIVE * top for x in score]
    for i in reversed(every):  # a heading stays with what it heads
        tag = page.names[blocks[i].path].rpartition(">")[2].partition(".")[0]
        if low[i] and tag in _HEADINGS and i + 1 < len(blocks) and not low[i + 1] and page.parents[blocks[i].path] == page.parents[blocks[i + 1].path]:
            low[i] = False
    out = [repeated[i] or low[i] and i not in inside for i in every]
    wanted = [i for i in clean if not inside or i in inside]
    kept = [i for i in wanted if not out[i]] or wanted  # nothing more important to keep in their place
    chosen = set(kept)
    return [i in chosen for i in every], len(wanted) - len(kept), sum(x is not None for x in score), sum(out[i] and i not in chosen for i in every)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_of(url):
    return F.xxhash64(host_of(url))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_NODES = "array<struct<path:long,up:array<long>,style:long,content:long,own:long,below:long,wide:boolean>>"


def _nodes(page: Page) -> list[dict]:
    """What a page shows at each of its paths, without the root: hashes of the whole
    child sequence and of the texts, characters at the path and in all below it."""
    hashes = page.hashes()
    texts: list[list[str]] = [[] for _ in hashes]
    for b in page.blocks:
        texts[b.path].append(b.text)
    own = [sum(map(len, x)) for x in texts]
    below = list(own)
    for k in range(len(own) - 1, 0, -1):
        below[page.parents[k]] += below[k]
    return [
        {
            "path": hashes[k],
            "up": [hashes[j] for j in page.above(page.parents[k])[: NEAR - 1]],
            "style": _hash(" ".join(page.children[k])),
            "content": _hash("\n".join(texts[k])),
            "own": own[k],
            "below": below[k],
            "wide": below[k] == below[0] or page.names[k].rpartition(">")[2].partition(".")[0] in ("html", "body"),
        }
        for k in range(1, len(hashes))
        if below[k]
    ]


def shown_nodes(pages: DataFrame) -> DataFrame:
    """(site, path, up, style, content, own, below, wide) of every path with text on the
    different pages of a host; equal pages of a host are one."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("up", pa.list_(pa.int64())), ("style", pa.int64()), ("content", pa.int64()), ("own", pa.int64()), ("below", pa.int64()), ("wide", pa.bool_())]))

    def run(batches):
        for batch in batches:
            found, same = [], []
            for html in batch["html"].to_pylist():
                nodes = _nodes(parse_page(html))
                found.append(nodes)
                same.append(_hash(repr([(n["path"], n["style"], n["content"]) for n in nodes])))
            yield pa.RecordBatch.from_arrays([batch["site"], pa.array(same, pa.int64()), pa.array(found, kind)], ["site", "page", "nodes"])
        release()

    rows = small_batches(pages).select(site_of(pages["url"].cast("string")).alias("site"), pages["html"].cast("string").alias("html"))
    parsed = rows.mapInArrow(run, f"site long, page long, nodes {_NODES}")
    different = parsed.groupBy("site", "page").agg(F.first("nodes").alias("nodes"))
    return different.select("site", F.explode("nodes").alias("n")).select("site", "n.*")


def style_tree(shown: DataFrame, min_pages: int = 2) -> DataFrame:
    """(site, path, pages, presentation, content, composite, own, wide): the importance
    of each path that ``min_pages`` pages or more show; ``wide`` where it holds all text
    of all its pages."""
    each = shown.select("site", "path", "up", "own", "below", "wide", F.explode(F.array(F.struct(F.lit(True).alias("styled"), F.col("style").alias("value")), F.struct(F.lit(False).alias("styled"), F.col("content").alias("value")))).alias("v"))
    n = each.groupBy("site", "path", "v").agg(F.count(F.lit(1)).alias("n"), F.first("up").alias("up"), F.sum("own").alias("own"), F.sum("below").alias("below"), F.min("wide").alias("wide"))
    of = lambda styled, x: F.sum(F.when(F.col("v.styled") == F.lit(styled), x))
    spread = F.col("n") * F.log("n")
    paths = n.groupBy("site", "path").agg(F.first("up").alias("up"), F.min("wide").alias("wide"), of(True, F.col("n")).alias("pages"), of(True, F.col("own")).alias("own"), of(True, F.col("below")).alias("below"), of(True, spread).alias("s"), of(False, spread).alias("c"))
    entropy = lambda x: F.log("pages") - F.col(x) / F.col("pages")
    few = F.col("pages") < max(2, min_pages)  # a path of few pages says nothing: no layout, all its content its own
    known = staged(
        paths.select(
            "site",
            "path",
            "up",
            "wide",
            "pages",
            "own",
            "below",
            F.when(few, 0.0).otherwise(1 - F.exp(-entropy("s"))).alias("presentation"),
            F.when(few, 1.0).otherwise(entropy("c") / F.log("pages")).alias("content"),
        ),
        "paths",
    )
    weight = (1 - G) * F.col("presentation") * F.col("below") + G * F.col("content") * F.col("own")
    gives = known.select("site", F.posexplode(F.concat(F.array("path"), "up")).alias("far", "at"), weight.alias("w"))
    composite = gives.groupBy("site", F.col("at").alias("path")).agg(F.sum(F.col("w") * F.pow(F.lit(G), F.col("far"))).alias("w"))
    return known.where(~few).join(composite, ["site", "path"]).select("site", "path", "pages", "presentation", "content", (F.col("w") / F.col("below")).alias("composite"), "own", "wide")


_OF_PATH = ("score", "repeated", "wide")


def importances(shown: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(site, path, score, repeated, wide): what the pages of a host and those of all
    hosts say of each path, weighted; site is null for all hosts together. The score of a
    wide path is that of its own text alone."""
    pages = F.col("pages") - 1
    toward = lambda own, others: (pages * own + prior * others) / (pages + prior)
    score = F.when(F.col("wide"), G * F.col("content")).otherwise(F.col("composite"))
    repeated = (F.col("content") < REPEATED) & (F.col("own") > 0)
    everywhere = style_tree(shown.withColumn("site", F.lit(0).cast("long"))).withColumn("score", toward(score, F.lit(NEUTRAL))).withColumn("content", toward(F.col("content"), F.lit(1.0)))
    everywhere = staged(everywhere.select(F.lit(None).cast("long").alias("site"), "path", "score", "content", repeated.alias("repeated"), "wide"), "everywhere")
    others = everywhere.select("path", F.col("score").alias("all_score"), F.col("content").alias("all_content"))
    of_host = style_tree(shown).join(others, "path").withColumn("score", toward(score, F.col("all_score"))).withColumn("content", toward(F.col("content"), F.col("all_content")))
    columns = ("site", "path", "score", "repeated", "wide")
    return of_host.withColumn("repeated", repeated).select(*columns).unionByName(everywhere.select(*columns))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the importances of each page's own paths, joined by path: a row
    carries what its page needs, however many paths its host has."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["site"], batch["digest"], pa.array([parse_page(x).hashes()[1:] for x in batch["html"].to_pylist()], pa.list_(pa.int64()))], ["site", "digest", "paths"])
        release()

    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    paths = rows.select("site", "digest", "html").mapInArrow(run, "site long, digest string, paths array<long>").groupBy("site", "digest").agg(F.first("paths").alias("paths"))
    each = paths.select("site", "digest", F.explode("paths").alias("path"))
    value = F.struct(*_OF_PATH)
    own = found.where("site is not null").select("site", "path", value.alias("own"))
    everywhere = found.where("site is null").select("path", value.alias("everywhere"))
    known = each.join(own, ["site", "path"], "left").join(everywhere, "path", "left").select("site", "digest", "path", F.coalesce("own", "everywhere").alias("v")).where("v is not null")
    of_page = staged(known.groupBy("site", "digest").agg(F.collect_list(F.struct("path", *(F.col(f"v.{x}").alias(x) for x in _OF_PATH))).alias("known")), "of_page")
    return rows.join(of_page, ["site", "digest"], "left")


def extract_main_text(pages: DataFrame, prior: float = PRIOR, marks: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_removed (blocks that the marks
    would have kept and the tree removed), n_judged (blocks of which the tree knows an
    importance), n_by_tree (blocks that the tree removed, whatever their marks), n_blocks.

    White space inside a block becomes one space; blocks are joined by one newline in
    page order. Null or empty html gives an empty text; a null or odd url belongs to
    the host ''. Repeated rows each give a row and count once in the tree; ties have no
    order to break. Pages are parsed whole, however long. Extra columns are ignored; an
    empty table gives no rows.
    """
    found = staged(importances(staged(shown_nodes(pages), "shown"), prior), "importances")
    rows = small_batches(pages).select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), site_of(pages["url"].cast("string")).alias("site"), pages["html"].cast("string").alias("html"))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        table: dict[int | None, dict[int, Importance]] = {}
        for r in found.collect():
            table.setdefault(r["site"], {})[r["path"]] = (r["score"], r["repeated"], r["wide"])
        sent = pages.sparkSession.sparkContext.broadcast(table)
        rows = rows.withColumn("known", F.lit(None).cast("array<struct<path:long,score:double,repeated:boolean,wide:boolean>>"))
    else:
        rows, sent = _joined(rows, found), None

    def run(batches):
        merged: dict[int, dict[int, Importance]] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            columns = (batch[c].to_pylist() for c in ("site", "html", "known"))
            for site, html, own in zip(*columns, strict=True):
                page = parse_page(html)
                if sent and site not in merged:
                    merged[site] = sent.value.get(None, {}) | sent.value.get(site, {})
                of_site = merged[site] if sent else {x["path"]: (x["score"], x["repeated"], x["wide"]) for x in own or ()}
                kept, *counts = decide(page, of_site, page.hashes(), marks)
                text = "\n".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k)
                for column, value in zip(out, (text, len(text), *counts, len(kept)), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["page_id", "url", "text", "n_chars", "n_removed", "n_judged", "n_by_tree", "n_blocks"])
        release()

    return rows.select("page_id", "url", "site", "html", "known").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_removed int, n_judged int, n_by_tree int, n_blocks int")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def importance(counts: list[int]) -> float:
    """Entropy share of one branch; what style_tree computes, for tests."""
    m = sum(counts)
    return 1.0 if m < 2 else -sum(c / m * math.log(c / m) for c in counts) / math.log(m)

"""Main text of web pages: semantic boilerplate goes, and so do element subtrees that recur across a host's pages."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import content_key, durable, map_batches, sized_join

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never part of the main text.
DROPPED = {
    "applet", "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "form", "frame", "frameset", "head", "iframe",
    "input", "link", "map", "menu", "meta", "nav", "noembed", "noframes", "noscript", "object", "option", "script", "select", "style",
    "svg", "template", "textarea", "title", "video", "xmp",
}
#: Words of class and id names, and roles, that mark boilerplate.
MARKS = set(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted related respond responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that make a compound with a mark, such as site-footer or related-posts; any other word beside a mark (has-sidebar, no-banner,
#: social-policy, comments-open) tells something else.
BESIDE = set(
    "site page main top bottom left right primary secondary global blog entry post posts article articles list area box block bar slot unit google "
    "container wrapper wrap inner outer section item items link links button buttons btn icon icons form body thread title widget text image".split()
)
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: An element that starts while one of these is open ends it, looking no further than the listed borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

FOUND = pa.list_(pa.struct([("subtree", pa.int64()), ("around", pa.int64()), ("titled", pa.bool_()), ("marked", pa.bool_()), ("short", pa.bool_())]))

#: Headings that belong to their article, however many articles share them.
HEADINGS = {"h1", "h2", "h3"}


class Element:
    __slots__ = ("tag", "attributes", "parts", "digest", "full", "size")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.parts, self.digest, self.full, self.size = tag, attributes, [], 0, 0, 0

    def named(self) -> dict[str, str]:
        return {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(self.attributes)} if self.attributes.strip() else {}


class Stack:
    """The open elements, with the places of each tag's, so that a search does not walk through all of them."""

    def __init__(self, root: Element):
        self.open, self.places = [root], defaultdict(list, {root.tag: [0]})

    def push(self, e: Element) -> None:
        self.places[e.tag].append(len(self.open))
        self.open.append(e)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of the tags; the root's if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """End the elements from a place on."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def end(self, tags: Iterable[str], borders: Iterable[str] = ()) -> None:
        """End the innermost element with one of the tags, unless a border is inside it."""
        place = self.last(tags)
        if place and place >= self.last(borders):
            self.cut(place)


def parse(page: str) -> Element:
    """The page's tree, with the implied ends of paragraphs, items and cells.  Cut-off markup ends with the page."""
    root = Element("html")
    stack, at = Stack(root), 0
    while at < len(page):
        found = _TOKEN.match(page, at)
        at = found.end()
        text, tag = found[0], found[2]
        if tag is None:
            if text[0] != "<" or text == "<":
                stack.open[-1].parts.append(html.unescape(text))
            continue
        tag = tag.lower()
        if found[1]:
            stack.end((tag,))
            continue
        if tag in BLOCK:
            stack.end(("p",), ("button", "td", "th", "caption", "object"))
        if tag in ENDS:
            stack.end(*ENDS[tag])
        if tag in ("html", "body"):
            root.attributes = root.attributes or found[3]
            continue
        new = Element(tag, found[3])
        stack.open[-1].parts.append(new)
        if tag in RAW and not found[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
        elif tag not in VOID and not (found[3].endswith("/") and tag not in BLOCK):
            stack.push(new)
    return root


def marked(e: Element, in_main: bool, named: dict[str, str] | None = None) -> bool:
    """Whether a whole class, or the id, is a mark or a compound of one."""
    named = e.named() if named is None else named
    for token in (named.get("class", "") + " " + named.get("id", "")).split():
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
        marks = (words & MARKS) - ({"header"} if in_main else set())
        if marks and words <= MARKS | BESIDE and (e.tag not in ("article", "main") or marks & {"comment", "comments", "ad", "advert", "related", "promo"}):
            return True
    return False


def boilerplate(e: Element, in_main: bool, by_name: bool = True) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or readers' comments by its tag, role or names."""
    if e.tag in DROPPED or e.tag == "header" and not in_main:
        return True
    named = e.named()
    if not named:
        return False
    if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", named.get("style", ""), re.I):
        return True
    return by_name and marked(e, in_main, named)


def _main(root: Element) -> list[Element]:
    """The outermost main element, else the outermost articles, else the whole page.

    Each is looked for outside elements that are boilerplate by their names, then also inside them.
    """
    for wanted in (lambda e: e.tag == "main" or e.named().get("role") == "main", lambda e: e.tag == "article"):
        for by_name in (True, False):
            found, stack = [], [root]
            while stack:
                e = stack.pop()
                if e is not root and wanted(e):
                    if not boilerplate(e, True, e.tag != "main" and e.named().get("role") != "main"):
                        found.append(e)
                elif e is root or not boilerplate(e, False, by_name) or e.tag == "header":
                    stack.extend(c for c in reversed(e.parts) if isinstance(c, Element))
            if found:
                return found
    return [root]


def _hash(order: list[Element], name: str) -> None:
    """The hash of each element's tag and content, parents first in order."""
    for e in reversed(order):
        said = "\x00".join(" ".join(c.split()) if isinstance(c, str) else f"\x01{getattr(c, name)}" for c in e.parts)
        setattr(e, name, xxhash.xxh3_64_intdigest(f"{e.tag}\x02{said}") - (1 << 63))


def _order(tops: list[Element]) -> list[Element]:
    """The elements in page order, parents first."""
    order, stack = [], tops[::-1]
    while stack:
        order.append(e := stack.pop())
        stack.extend(c for c in reversed(e.parts) if isinstance(c, Element))
    return order


def _split(page: str) -> tuple[list[Element], list[Element]]:
    """All elements of the page, with the hash and the length of what they hold, and the main elements without boilerplate."""
    root = parse(page)
    whole = _order([root])
    _hash(whole, "full")
    for e in reversed(whole):
        e.size = sum(len("".join(c.split())) if isinstance(c, str) else c.size for c in e.parts)
    tops = _main(root)
    for top in tops:
        stack = [top]
        while stack:
            e = stack.pop()
            e.parts = [c for c in e.parts if isinstance(c, str) or not boilerplate(c, top.tag != "html")]
            stack.extend(c for c in e.parts if isinstance(c, Element))
    _hash(_order(tops), "digest")
    return whole, tops


def main_tree(page: str) -> list[Element]:
    """The main elements without boilerplate; each element with the hash of its subtree before and after that."""
    return _split(page)[1]


def subtrees(page: str, short: int) -> tuple[int, dict[int, tuple[int, bool, bool, bool]], list[int]]:
    """The hash of the main tree, the page's block elements with text, and the hashes of those in the main tree.

    Elements are told by the hash of all they hold, and by that of what boilerplate leaves of them if it differs.  Each
    comes with its surrounding, the longest block of the main text outside it, and with whether it says the same as the
    page's first heading, whether its own tag or name marks it as boilerplate, and whether it has under `short`
    characters.  Headings of the main tree, and what holds nothing but one, are not among them: they are the
    article's.  Elements under `short` characters outside the main tree (menu entries) are left out, as they are nowhere
    to be taken from, and so are elements without a surrounding.
    """
    whole, tops = _split(page)
    order = _order(tops)
    last, text, owner = {}, [[] for _ in order], {}
    for i, e in enumerate(order):
        block = owner[id(e)] = i if e.tag in BLOCK or i == 0 else owner.get(id(e), i)
        for c in e.parts:
            if isinstance(c, str):
                text[block].append(c)
            else:
                owner[id(c)] = block
    for i in range(len(order) - 1, -1, -1):
        kids = [c for c in order[i].parts if isinstance(c, Element)]
        last[id(order[i])] = (i, last[id(kids[-1])][1] if kids else i + 1)
    said = [" ".join("".join(t).split()) for t in text]
    before, after = [""], [""]  # the longest block before each place, and from it on
    for t in said:
        before.append(t if len(t) > len(before[-1]) else before[-1])
    for t in reversed(said):
        after.append(t if len(t) >= len(after[-1]) else after[-1])
    after.reverse()
    top_ids, found, own = {id(t) for t in tops}, {}, []
    headings = [i for i, e in enumerate(order) if e.tag in HEADINGS and e.size]
    first = said[headings[0]] if headings else None
    for e in whole:
        if e.tag not in BLOCK or not e.size or id(e) in top_ids:
            continue
        place = last.get(id(e))
        if place:
            j = bisect_left(headings, place[0])
            if j < len(headings) and headings[j] < place[1] and order[headings[j]].size == e.size:
                continue
            own += {e.full, e.digest}
        elif e.size < short:
            continue
        start, end = place or (0, 0)
        around = max(before[start], after[end], key=len)
        if around:
            titled = bool(place and first and said[start] == first)
            marks = (titled, not place and boilerplate(e, True), e.size < short)
            for h in {e.full, e.digest} if place else {e.full}:
                found.setdefault(h, (xxhash.xxh3_64_intdigest(around) - (1 << 63), *marks))
    return xxhash.xxh3_64_intdigest(repr([t.digest for t in tops])) - (1 << 63), found, own


def text_of(tops: list[Element], templates: set[int]) -> str:
    """Blocks in page order, one a line: white space inside a block is one space, subtrees of the templates are left out."""
    blocks, now = [], []
    for top in tops:
        stack: list = [top]
        while stack:
            e = stack.pop()
            if e is None:
                blocks.append(now)
                now = []
            elif isinstance(e, str):
                now.append(e)
            elif e.tag == "br":
                now.append(" ")
            elif e is top or e.tag not in BLOCK or e.digest not in templates and e.full not in templates:
                if e.tag in BLOCK:
                    blocks.append(now)
                    now = []
                    stack.append(None)
                stack.extend(reversed(e.parts))
        blocks.append(now)
        now = []
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_subtrees(rows: DataFrame, short: int) -> DataFrame:
    """k1, k2, host, top, found (subtree, around, titled, marked, short), own of every page, as `subtrees` gives them; kept, as it is read twice."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            each = [subtrees(p, short) for p in batch.column(3).to_pylist()]
            names = ("around", "titled", "marked", "short")
            found = [[{"subtree": h, **dict(zip(names, v, strict=True))} for h, v in f.items()] for _, f, _ in each]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([t for t, *_ in each], pa.int64()), pa.array(found, FOUND), pa.array([o for *_, o in each], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "host", "top", "found", "own"])

        return apply

    return durable(map_batches(rows.select("k1", "k2", "host", "html"), make, "k1 bigint, k2 bigint, host string, top bigint, found array<struct<subtree:bigint,around:bigint,titled:boolean,marked:boolean,short:boolean>>, own array<bigint>"))


def site_templates(each: DataFrame, least: int, share: float, short_share: float) -> DataFrame:
    """host, subtree of the subtrees that stand among many different surroundings on a host: more than `share` times as
    many as the host has different main trees, and `least` at least.

    A short one, such as a cell that tables share by chance, needs `short_share`.  One that some page of the host marks
    as boilerplate by its own tag or name needs no share.  One that says what some page's first heading says is no
    template.  Counts are taken over all pages; repeated pages and the versions of an article that share their longest
    block give one surrounding, so a repeated article is no template.
    """
    trees = each.groupBy("host").agg(F.count_distinct("top").alias("n_trees"))
    over = {"titled": F.max, "marked": F.max, "short": F.min}
    counted = each.select("host", F.explode("found").alias("f")).groupBy("host", "f.subtree").agg(F.count_distinct("f.around").alias("n"), *[g(f"f.{c}").alias(c) for c, g in over.items()])
    often = durable(counted.where((F.col("n") >= least) & ~F.col("titled")))
    wide = F.col("n") > F.when(F.col("short"), short_share).otherwise(share) * F.col("n_trees")
    return sized_join(often, durable(trees), ["host"], "inner", row_bytes=64).where(wide | (F.col("marked") & ~F.col("short"))).select("host", "subtree")


def main_text(pages: DataFrame, least: int = 3, share: float = 0.3, short: int = 20, short_share: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Subtrees that recur among more than `share` of a host's different main trees, `least` at least, go, whatever their
    names; of those under `short` characters only what recurs among more than `short_share`.  Lines, quotations and
    licences that some articles share stay, and so do all headings (h1 to h3) of an article.  A null or empty html gives
    an empty text; a null url is the host of all pages without one.  Very long and deeply nested pages count whole, in
    time linear in their length.  Pages are told by host and html, so repeated pages fare alike.  An empty table gives an
    empty result.  Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    rows = rows.select("*", *content_key(F.col("host"), F.col("html")))
    each = site_subtrees(rows, short)
    templates = durable(site_templates(each, least, share, short_share))
    own = each.select("k1", "k2", "host", F.explode("own").alias("subtree"))
    hits = durable(sized_join(own, templates, ["host", "subtree"], "inner", row_bytes=96).groupBy("k1", "k2").agg(F.collect_set("subtree").alias("templates")))
    size = hits.agg(F.sum(F.size("templates") * 8 + 64)).first()[0] or 0

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text_of(main_tree(p), set(t or ())) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return apply

    joined = rows.join(F.broadcast(hits) if size <= 32 << 20 else hits, ["k1", "k2"], "left").select("page_id", "url", "html", "templates")
    return map_batches(joined, make, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")

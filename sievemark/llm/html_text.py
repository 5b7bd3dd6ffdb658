"""HTML extraction: the main text of pages without their sites' templates.

Method: site template removal. Each page is parsed into elements; every element's subtree is hashed
from its name, its children and its text. Spark counts, per host, on how many different pages a
subtree is (pages of equal content count once, so copies of an article don't make it a template), and subtrees on a
large share of a host's pages are deleted. On a host of fewer than LEAST_PAGES different pages that is only what is on
every page, on FEW_PAGES at least, and outside the article: two pages that share a paragraph are no evidence of a template.

What stays is read by meaning. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go by element, role, or a whole token of class or id all of whose parts are names of furniture or of
layout (`site-footer`, but neither `has-sidebar` nor `share-price`). An element that holds the page's main text is no furniture
whatever it is called. The text is then that of `main`, else of the articles, unless they hold only a small part of
what the page has left; then it is the whole page's.

Of a host only subtrees above the share go on, at most 1 / share times the mean number a page has. All
hosts' together are broadcast up to `broadcast_rows`; beyond that pages are joined by host and a
salt, so that a host of a third of all pages is read by many tasks.

Cases: null or empty html gives an empty text; null url has an empty host; broken markup is closed where a
browser would close it; repeated rows each keep a row and count as one page; other columns stay out; pages of any size
are parsed whole, in one pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.scratch import Scratch
from sievemark.llm.url_filters import host_of

#: Pages that a template is on at least: this many, and these shares outside and inside the article.
LEAST_PAGES, SHARE, INNER_SHARE, FEW_PAGES = 10, 0.3, 0.6, 3
BROADCAST_ROWS, SALTS = 500_000, 32
#: Shares of a page's text that main and articles have at least where they are taken for it.
MAIN_SHARE, ARTICLE_SHARE = 0.25, 0.5
#: Characters from which furniture by name can be the main text of a page that has neither main nor articles, and little else.
LEAST_HELD = 250

# Names of elements and of their parts.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that an opening one ends, up to the borders after the bar.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"})}
P_ENDERS = BLOCKS - {"caption", "dd", "dt", "legend", "li", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"} | {"li", "dd", "dt"}
P_BORDERS = {"table", "td", "th", "caption", "button", "object", "template", "html"}
UNSEEN = {"head", "script", "style", "noscript", "template", "title", "iframe", "svg", "math", "canvas", "object", "embed", "audio", "video", "button", "select", "textarea", "input", "datalist", "xmp", "noembed", "noframes"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog", "toolbar"}
COMMENTS = {"comment", "comments", "commentlist", "respond", "disqus"}
#: Parts of class and id tokens: furniture anywhere, furniture outside an article, and layout words that furniture is named with.
NAMES = COMMENTS | {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "promotions", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "popup", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "teaser", "teasers"}
OUTER_NAMES = {"header", "footer", "masthead", "topbar", "banner", "notice", "notices", "modal", "overlay", "login", "widget", "widgets", "toolbar"}
LAYOUT = {"site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "first", "second", "upper", "lower", "inner", "outer", "post", "posts", "article", "articles", "content", "links", "link", "list", "items", "item", "box", "block", "bar", "area", "section", "wrapper", "wrap", "container", "holder", "panel", "column", "col", "row", "slot", "unit", "zone", "button", "buttons", "icons", "form", "message", "thread", "reply", "replies", "title", "fixed", "sticky", "mobile", "desktop"}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True, eq=False)
class Node:
    """An element; children are elements and pieces of raw text."""

    name: str
    attributes: str = ""
    children: list = field(default_factory=list)
    mark: int = 0
    drop: bool = False

    def attribute(self, name: str) -> str:
        if name not in self.attributes.lower():
            return ""
        for key, value in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(value.strip("\"'")) or name
        return ""


def parse(text: str) -> Node:
    """The tree of a page."""
    root = Node("#page")
    stack, at, end = [root], 0, len(text)
    while at < end:
        found = _TAG.search(text, at)
        if not found:
            stack[-1].children.append(text[at:])
            break
        if found.start() > at:
            stack[-1].children.append(text[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:
            _close(stack, name)
            continue
        if name in P_ENDERS:
            _end(stack, {"p"}, P_BORDERS)
        if name in ENDS:
            _end(stack, *ENDS[name])
        node = Node(name, found[3])
        stack[-1].children.append(node)
        if name in VOID or found[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
            upto = stop.start() if stop else end
            node.children.append(text[at:upto])
            after = text.find(">", upto)
            at = after + 1 if stop and after >= 0 else end
            continue
        stack.append(node)
    return root


def _end(stack: list[Node], names: set[str], borders: set[str]) -> None:
    """Ends the outermost open element of these names within the borders."""
    cut = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in borders:
            break
        if stack[i].name in names:
            cut = i
            if names == {"p"}:
                break
    if cut:
        del stack[cut:]


def _close(stack: list[Node], name: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            if name in BLOCKS or not any(n.name in BLOCKS for n in stack[i + 1 :]):
                del stack[i:]
            else:
                del stack[i]  # a phrase that blocks were opened in: they stay open
            return
        if name not in BLOCKS and stack[i].name in P_BORDERS:
            return


def named(value: str, in_article: bool) -> str:
    """The furniture that a class or id names with one of its tokens: "comments", "furniture" or nothing."""
    for token in value.split():
        parts = {x.lower() for x in _PARTS.findall(token)}
        names = parts & (NAMES if in_article else NAMES | OUTER_NAMES)
        if names and all(x in names or x in LAYOUT or x.isdigit() for x in parts):
            return "comments" if names & COMMENTS else "furniture"
    return ""


def marked(node: Node, in_article: bool) -> str:
    """What an element is, by its name, role, class or id, if it is no part of an article: "unseen", "comments" or "furniture"."""
    if node.name in UNSEEN:
        return "unseen"
    if node.attributes:
        low = node.attributes.lower()
        if "hidden" in low or "display" in low:
            if re.search(r"(?:^|\s)hidden(?:\s|=|$)", low) or re.search(r"display\s*:\s*none", low) or node.attribute("aria-hidden") == "true":
                return "unseen"
        if node.name not in ("html", "body", "main") and ("class" in low or "id" in low) and (found := named(node.attribute("class") + " " + node.attribute("id"), in_article)):
            return found
        if "role" in low and node.attribute("role").lower() in ROLES:
            return "furniture"
    return "furniture" if node.name in FURNITURE or node.name == "header" and not in_article else ""


def is_main(node: Node) -> bool:
    return node.name == "main" or "main" in node.attributes and node.attribute("role") == "main"


def walk(node: Node, in_article: bool = False) -> Iterator[tuple[Node, bool]]:
    todo = [(node, in_article)]
    while todo:
        x, inside = todo.pop()
        yield x, inside
        deeper = inside or x.name in ("article", "main")
        todo += [(c, deeper) for c in reversed(x.children) if isinstance(c, Node)]


def hash_subtrees(root: Node) -> list[tuple[int, bool]]:
    """(hash, inside an article) of the elements with text; each element gets its hash as `mark`."""
    out = []
    for node, inside in reversed(list(walk(root))):
        parts, any_text = [node.name], False
        for c in node.children:
            if isinstance(c, Node):
                if c.mark:
                    any_text = True
                    parts.append(str(c.mark))
            elif s := _SPACE.sub(" ", c).strip():
                any_text = True
                parts.append(s)
        if any_text and node.name not in ("script", "style", "#page"):
            node.mark = xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63) or 1
            out.append((node.mark, inside or node.name in ("article", "main")))
    return out


def _size(node: Node) -> int:
    """Characters of the element's own pieces of text, but white space."""
    return sum(len("".join(c.split())) for c in node.children if isinstance(c, str))


def main_text(root: Node, templates: frozenset[int] = frozenset()) -> tuple[list[str], int]:
    """Blocks of the main text in page order, and how many subtrees were deleted as templates."""
    deleted = 0
    # Down the tree: what each element is, and whether it, or one around it, is furniture.
    nodes, kind, under, parent = [], [], [], []
    todo = [(root, -1, False, False)]
    while todo:
        x, above, inside, off = todo.pop()
        what = "" if x is root else marked(x, inside)
        if x.mark and x.mark in templates and x.name not in ("html", "body", "main", "article"):
            what, deleted = "unseen", deleted + 1
        if what == "unseen":
            x.drop = True
            continue
        at = len(nodes)
        nodes.append(x)
        kind.append(what)
        parent.append(above)
        off = off or bool(what)
        under.append(off)
        inside = inside or x.name == "article" or is_main(x)
        todo += [(c, at, inside, off) for c in reversed(x.children) if isinstance(c, Node)]
    # Up the tree: text of each element, and of the articles in it; comments count nowhere.
    own = [_size(x) for x in nodes]
    size, told = list(own), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if kind[i] != "comments":
            size[parent[i]] += size[i]
            told[parent[i]] += size[i] if nodes[i].name == "article" or is_main(nodes[i]) else told[i]
    plain = sum(n for n, off in zip(own, under, strict=True) if not off)
    for i, x in enumerate(nodes):
        if kind[i] in ("", "comments"):
            x.drop = kind[i] == "comments"
        elif told[0]:
            x.drop = not (2 * told[i] >= told[0] and told[i] >= plain and told[i] > 0)
        else:
            x.drop = size[i] < max(4 * plain, 1 if x.name == "form" else LEAST_HELD) or x.name not in ("form", "div", "section", "table", "td")
    # What is left, and the part of it in main and in articles.
    todo, mains, articles, left = [(root, False)], [], [], 0
    while todo:
        x, inside = todo.pop()
        if x.drop:
            continue
        left += _size(x)
        if not inside and is_main(x):
            mains.append(x)
        elif not inside and x.name == "article":
            articles.append(x)
        inside = inside or is_main(x) or x.name == "article"
        todo += [(c, inside) for c in reversed(x.children) if isinstance(c, Node)]
    parts = [root]
    for found, share in ((mains, MAIN_SHARE), (articles, ARTICLE_SHARE)):
        if found and (n := sum(map(_kept_size, found))) and n >= share * left:
            parts = found
            break
    blocks: list[str] = []
    for part in parts:
        _blocks(part, blocks)
    return blocks, deleted


def _kept_size(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        if not x.drop:
            n += _size(x)
            todo += [c for c in x.children if isinstance(c, Node)]
    return n


def _blocks(root: Node, out: list[str]) -> None:
    held: list[str] = []

    def cut() -> None:
        if held and (s := " ".join(html.unescape("".join(held)).split())):
            out.append(s)
        held.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            held.append(x)
        elif x.drop:
            if x.name in BLOCKS:
                cut()
        elif x.name == "br":
            held.append(" ")
        else:
            edge = x.name in BLOCKS or x is root
            if edge:
                cut()
                todo.append(None)
            todo += reversed(x.children)
    cut()


def _page_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, mark, inner, content = [], [], [], []
        for h, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            found = hash_subtrees(parse(page or ""))
            if found:
                whole = xxhash.xxh3_64_intdigest(repr(sorted(m for m, inside in found if inside) or found)) - (1 << 63)
                for m, inside in dict(found).items():
                    host.append(h)
                    mark.append(m)
                    inner.append(inside)
                    content.append(whole)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(mark, pa.int64()), pa.array(inner, pa.bool_()), pa.array(content, pa.int64())], ["host", "mark", "inner", "content"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, marks in zip(batch["html"].to_pylist(), batch["marks"].to_pylist(), strict=True):
            root = parse(page or "")
            if marks:
                hash_subtrees(root)
            blocks, deleted = main_text(root, frozenset(marks or ()))
            text = "\n\n".join(blocks)
            out.append((text, len(text), len(blocks), deleted))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["page_id", "url", "text", "n_chars", "n_blocks", "n_templates"])


def templates(scratch: Scratch, pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """(host, mark): subtrees on a large share of a host's different pages."""
    each = scratch.table(pages.select("host", "html").mapInArrow(_page_hashes, "host string, mark long, inner boolean, content long").distinct(), "subtrees")
    # Both are written: a join of two plain shuffles can be split where one host is hot.
    on = scratch.table(each.groupBy("host", "mark").agg(F.count("*").alias("pages"), F.max("inner").alias("inner")).where(F.col("pages") >= FEW_PAGES), "counts")
    total = scratch.table(each.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("total")), "totals")
    scratch.drop(each)
    many = F.greatest(F.lit(float(least)), F.col("total") * F.when(F.col("inner"), F.lit(inner_share)).otherwise(F.lit(share)))
    wanted = F.when((F.col("total") < least) & ~F.col("inner"), F.greatest(F.lit(float(FEW_PAGES)), F.col("total").cast("double"))).otherwise(many)
    return on.join(total.hint("shuffle_merge"), "host").where(F.col("pages") >= wanted).select("host", "mark")


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars, n_blocks, n_templates."""
    seen = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    scratch = Scratch(pages.sparkSession, "html-text")
    found = scratch.only(scratch.table(templates(scratch, seen), "templates"))
    by_host = found.groupBy("host").agg(F.collect_list("mark").alias("marks"))
    if found.count() <= broadcast_rows:
        met = seen.join(F.broadcast(by_host), "host", "left")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["host", "salt"], "left")
    schema = "page_id long, url string, text string, n_chars long, n_blocks long, n_templates long"
    return met.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "marks").mapInArrow(_extract, schema)

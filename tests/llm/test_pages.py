"""HTML extraction and URL filters."""

import pytest
from pyspark.sql import functions as F

from sievemark.llm import html_text as H
from sievemark.llm import url_filters as U


def text_of(page: str) -> str:
    return "\n\n".join(H.main_text(H.parse(page))[0])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>menu</nav><article><h1>T&eacute;</h1><p>a <b>b</b><br>c<p>d</article><footer>f</footer>", "Té\n\na b c\n\nd"),
        ("<article><p><b>open<p>next</p></article>", "open\n\nnext"),
        ("<body><div class='cookie-notice'>no</div><p>yes</p><form>no</form><aside>no</aside><script>if (a < b) { '</p>' }</script>", "yes"),
        ("<article>x<section class=comments>no</section></article><article class=comment>no</article>", "x"),
        ("<body><header>site</header><article><header><h1>head</h1></header>body</article>", "head\n\nbody"),
        ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
        ("<article>a &lt;b&gt; <!-- c --> d&nbsp;&#233;", "a <b> d é"),
        ("<article><div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
        ("<div class='has-sidebar'><article>kept</article><div class='sidebar-left'>no</div></div>", "kept"),
        ("<article>a<p class='share-price'>b</p><div id='related-work'>c</div><p class='notice'>d</p><p class='share-buttons'>no</p></article>", "a\n\nb\n\nc\n\nd"),
        ("<main><h1>title</h1><p>lead</p><article>body</article><aside>no</aside></main><div>no</div>", "title\n\nlead\n\nbody"),
        ("<article class='teaser'>no</article><div class='post'>the whole story</div>", "the whole story"),
        ("<article>read on</article><div class='post'>the whole story</div>", "read on\n\nthe whole story"),
        ("<div class='sidebar content'><article>a long story</article></div><div class='menu'>a menu</div>", "a long story"),
        ("<form><p>all of the page</p><input value=no><button>no</button></form>", "all of the page"),
        ("<article>x</article><div id=comments><article>a much longer comment</article></div>", "x"),
        ("<body><p>x</p><div class=siteFooter>no</div><div class='post-comments'>no</div><div class='noticeboard'>y</div>", "x\n\ny"),
        ("<div class=ad>only an advert</div>", ""),
        (f"<div class=widget>{'w' * 300}</div>", "w" * 300),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


def test_deep_and_broken():
    assert text_of("<div>" * 5000 + "deep") == "deep"
    assert text_of("<p>a</b></i></p></div>b < c <") == "a\n\nb < c <"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_templates(spark, broadcast):
    box = "<div><p>Welcome to our site</p></div>"
    pages = [(i, f"http://h.org/{i}", f"<body>{box}<p>text {i}</p>") for i in range(12)]
    pages += [(100 + i, "http://copies.org/", "<article><p>same article</p></article>") for i in range(15)]
    pages += [(200, None, None), (200, None, None), (201, "nourl", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in H.extract(df, broadcast).collect()}
    assert got[3] == "text 3" and got[103] == "same article" and got[200] == "" == got[201]
    assert H.extract(df, broadcast).count() == len(pages)
    assert H.extract(df.where("false")).isEmpty()


def _subtrees(node, inside=False):
    """(everything in an element, whether it is in the article) of the elements with text: a plain tree for a hash."""
    inside = inside or node.name in ("article", "main")
    parts, out = [], []
    for c in node.children:
        if isinstance(c, H.Node):
            own, found = _subtrees(c, inside)
            out += found
            parts += [own] if own else []
        elif t := " ".join(c.split()):
            parts.append(t)
    tree = (node.name, *parts) if parts and node.name not in ("script", "style", "#page") else None
    if tree:
        out.append((tree, inside))
        node.plain = tree
    return tree, out


def test_templates_against_plain_counts(spark, monkeypatch):
    import random

    monkeypatch.setattr(H, "Node", type("Node", (H.Node,), {}))  # with room for the plain tree
    rng = random.Random(5)
    pages = []
    for host, n in (("big.org", 40), ("mid.org", 12), ("four.org", 4), ("two.org", 2), ("", 5)):
        for i in range(n):
            own = " ".join(rng.choice("abcdefgh") * 3 for _ in range(6))
            quote = "<p>a quoted line</p>" if rng.random() < 0.7 else ""
            box = "<div><p>about us</p><ul><li>one<li>two</ul></div>" if rng.random() < 0.5 else "<div>old box</div>"
            rare = "<section><p>rare</p></section>" if i % 9 == 0 else ""
            pages.append((len(pages), f"http://{host}/{i}" if host else None, f"<body>{box}<div><p>on all pages</p></div>{rare}<div><p>{own}</p>{quote}</div>" if i % 2 else f"<body><div><p>on all pages</p></div><article><p>{own} {i}</p>{quote}</article>"))
        pages += [(len(pages) + k, pages[-1][1], pages[-1][2]) for k in range(15)]  # copies of a page
    trees, contents, seen = [], {}, {}
    for _, url, html in pages:
        host = url.split("/")[2] if url else ""
        root = H.parse(html)
        found = _subtrees(root)[1]
        content = repr(sorted((t for t, inside in found if inside), key=repr) or sorted(found, key=repr))
        trees.append((host, root, found))
        contents.setdefault(host, set()).add(content)
        for t, inside in found:
            at = seen.setdefault((host, t), [set(), False])
            at[0].add(content)
            at[1] |= inside
    templates = set()
    for (host, t), (on, inside) in seen.items():
        total, n = len(contents[host]), len(on)
        if total < H.LEAST_PAGES and not inside:
            wanted = max(H.FEW_PAGES, total)
        else:
            wanted = max(H.LEAST_PAGES, total * (H.INNER_SHARE if inside else H.SHARE))
        if n >= wanted:
            templates.add((host, t))
    want = []
    for host, root, found in trees:
        for x, _ in H.walk(root):
            x.mark = 1 if (host, getattr(x, "plain", None)) in templates else 0
        want.append("\n\n".join(H.main_text(root, frozenset([1]))[0]))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [r["text"] for r in H.extract(df).orderBy("page_id").collect()]
    assert got == want and len(templates) > 8 and len(set(got)) > 40


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_rules(spark, broadcast):
    rules = spark.createDataFrame([("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("bare.org", "", "block"), ("com", "/", "allow"), ("b.net", "/es", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://a.EXAMPLE.com/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://b.net/es/": ("b.net", "/es/", "b.net/es", "allow"),
        "http://bare.org?q": ("bare.org", "", "bare.org", "block"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, *cases])], "page_id long, url string").withColumn("rule", F.lit("x"))
    got = U.judge(pages, rules, broadcast_rules=broadcast).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [*cases.values(), *cases.values()]
    assert U.judge(pages, rules.where("false")).count() == len(got)

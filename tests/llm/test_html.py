"""The site style tree against an independent computation, without marks, and on pages
that marks alone would get wrong."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from ophelion.llm import html_extract

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(n))


def site(n, seed=1, wrap="<div class='x1'>{top}</div><div class='x2'>{body}</div><div class='x3'>{foot}</div>"):
    """Pages of one host without an article element; class names mean nothing."""
    rng = random.Random(seed)
    pages, want = [], []
    for k in range(n):
        paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 12))]
        want.append("\n".join(paragraphs))
        top = "<ul>" + "".join(f"<li>{x}</li>" for x in ("Home", "News", "About us")) + "</ul>"
        foot = f"<p>All rights reserved, {rng.choice(['one', 'two'])}</p>"
        pages.append((k, f"https://plain.example/{k}", "<html><body>" + wrap.format(top=top, body="".join(f"<p>{p}</p>" for p in paragraphs), foot=foot) + "</body></html>"))
    return pages, want


def texts(spark, pages, **how):
    return {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pages, SCHEMA), **how).collect()}


@pytest.mark.parametrize("marks", [True, False])
def test_no_article_and_meaningless_names(spark, marks):
    pages, want = site(40)
    found = texts(spark, pages, marks=marks)
    assert [found[k] for k in range(40)] == want


def test_tree_alone_on_the_test_tables(spark):
    """Without any mark the tree drops the menu, advert and footer of large hosts' pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    with_marks = html_extract.extract_main_text(pages).select("page_id", "text")
    alone = html_extract.extract_main_text(pages, marks=False).selectExpr("page_id", "text as alone", "n_judged", "n_blocks")
    r = with_marks.join(alone, "page_id").selectExpr("avg(int(text = alone)) as same", "sum(n_judged) / sum(n_blocks) as judged").first()
    assert r["same"] > 0.9 and r["judged"] > 0.5


def brute_tree(pages, min_pages):
    """Importance of each path of one host, bottom up by recursion over a dict."""
    shown = defaultdict(list)  # path name: (children, content, own, below) of each different page
    seen = set()
    for _, _, html in pages:
        page = html_extract.parse_page(html)
        own = defaultdict(list)
        for b in page.blocks:
            own[page.names[b.path]].append(b.text)
        rows = []
        for name, children in zip(page.names, page.children, strict=True):
            below = sum(len(t) for other, ts in own.items() for t in ts if other == name or other.startswith(name + ">"))
            if name and below:
                rows.append((name, tuple(children), tuple(own[name]), sum(map(len, own[name])), below))
        if tuple(rows) in seen:
            continue
        seen.add(tuple(rows))
        for name, *rest in rows:
            shown[name].append(rest)

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values())

    facts = {}
    for name, rows in shown.items():
        n = len(rows)
        few = n < min_pages
        facts[name] = (0.0 if few else 1 - math.exp(-entropy([r[0] for r in rows])), 1.0 if few else entropy([r[1] for r in rows]) / math.log(n), sum(r[2] for r in rows), sum(r[3] for r in rows), n)

    def composite(name):
        presentation, content, own, below, _ = facts[name]
        children = [x for x in facts if x.startswith(name + ">") and ">" not in x[len(name) + 1 :]]
        mean = (content * own + sum(composite(x) * facts[x][3] for x in children)) / below
        return (1 - html_extract.G) * presentation + html_extract.G * mean

    return {html_extract._hash(x): (f[4], f[0], f[1], composite(x)) for x, f in facts.items() if f[4] >= min_pages}


def test_tree_equals_brute_force(spark):
    pages, _ = site(25)
    pages += [(100, pages[0][1], pages[0][2]), (101, pages[0][1], "<div class='x2'>odd <p>one</p> more</div>")]  # an equal page, a rare path
    tree = html_extract.style_tree(html_extract.shown_nodes(spark.createDataFrame(pages, SCHEMA)), 8).collect()
    want = brute_tree(pages, 8)
    assert {r["path"] for r in tree} == set(want)
    for r in tree:
        assert (r["pages"], r["presentation"], r["content"], r["composite"]) == pytest.approx(want[r["path"]])


def test_marks_give_way_where_they_wrap_the_text(spark):
    pages = [
        (1, "http://a/", "<body><nav>Menu</nav><article class='post category-legal'><p>Real text</p><div class='share'>Share</div></article><div class='ad'>Buy</div></body>"),
        (2, "http://b/", "<body><form><div><p>All in a form</p></div><div class='ad'>Buy</div></form><footer>Foot</footer></body>"),
        (3, "http://c/", "<body><div id='social-policy'><main><p>Policy text</p></main></div><div class='ad'>Buy</div></body>"),
        (4, "http://d/", "<body><article><p>Main one</p></article><div class='related'><article>Teaser</article></div></body>"),
        (5, "http://e/", "<body><aside>Only aside</aside><footer>Foot</footer></body>"),
        (6, "http://f/", "<p>" + "long text " * 200_000 + "</p><nav>menu</nav>"),
        (7, "http://g/", "<div>" * 2000 + "deep" + "</div>" * 2000),
    ]
    found = texts(spark, pages)
    assert [found[k] for k in (1, 2, 3, 4, 5)] == ["Real text", "All in a form", "Policy text", "Main one", ""]
    assert found[6] == ("long text " * 200_000).strip() and found[7] == "deep"


def test_scrambled_names_and_no_article(spark):
    """The pages of sf0.01 with every tag of their structure a div and random class names:
    the tree alone finds the article's text."""
    import re

    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    rename = lambda html: re.sub(r'<div class="ad">', "<div class='q7'>", re.sub(r"</(nav|footer|article)>", "</div>", re.sub(r"<(nav|footer|article)(?=[\s>])", lambda m: {"nav": "<div class='k2'", "footer": "<div class='z9'", "article": "<div class='w4'"}[m[1]], html)))
    want = texts(spark, pages)
    found = texts(spark, [(i, u, rename(h)) for i, u, h in pages])
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)


def test_small_hosts_use_the_tree_of_all_hosts(spark):
    """One page a host: no host says anything alone."""
    pages, want = site(60, seed=4)
    pages = [(k, f"https://h{k}.example/", html) for k, _, html in pages]
    found = texts(spark, pages, marks=False)
    assert sum(found[k] == want[k] for k in range(60)) >= 57


def brute_kept(page, known, hashes):
    """The blocks that the tree alone keeps, from their paths' names."""
    of_name = {name: known.get(h) for name, h in zip(page.names, hashes, strict=True)}

    def score(name):
        parts = name.split(">")[1:]
        chain = [of_name[">" + ">".join(parts[: k + 1])] for k in range(len(parts))]
        branches = [x[0] for x in chain if x and not x[2]]
        if not branches:
            return chain[-1][0] if chain and chain[-1] else None
        poor = [x for x in branches[1:] if x < html_extract.RELATIVE * html_extract.G]
        return min([branches[0], *poor])

    scores = [score(page.names[b.path]) for b in page.blocks]
    top = max((x for x in scores if x is not None), default=0)
    low = [x is not None and x < html_extract.RELATIVE * top for x in scores]
    repeated = [bool(of_name[page.names[b.path]] and of_name[page.names[b.path]][1]) for b in page.blocks]
    keep = [not x and not y for x, y in zip(low, repeated, strict=True)]
    return keep if any(keep) else [True] * len(keep)


def test_decision_equals_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        html, depth = "<body>", 0
        for _ in range(rng.randint(1, 25)):
            if depth and rng.random() < 0.3:
                html, depth = html + "</div>", depth - 1
            elif rng.random() < 0.6:
                html, depth = html + f"<div class={rng.choice('abcd')}>", depth + 1
            else:
                html += f"<p>{rng.choice('xyz')}</p>"
        page = html_extract.parse_page(html)
        hashes = page.hashes()
        known = {h: (rng.random(), rng.random() < 0.1, rng.random() < 0.1) for h in hashes if rng.random() < 0.8}
        assert html_extract.decide(page, known, hashes, marks=False)[0] == brute_kept(page, known, hashes)


def test_tree_decides_the_test_tables(spark):
    """What goes, goes by the tree; with the marks it is the same text as the tree's alone."""
    r = html_extract.extract_main_text(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).selectExpr("sum(n_by_tree) as tree", "sum(n_judged) as judged", "sum(n_blocks) as blocks").first()
    assert r["tree"] > 0.3 * r["blocks"] and r["judged"] > 0.99 * r["blocks"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article><p>one</p><svg><path d="M0 0"><p>two</p></article>', "one\ntwo"),
        ('<p>x <object data="a.pdf"> y</p><p>z</p>', "x y\nz"),
        ("<p>if x <math><mi>a</mi></math> then</p>", "if x a then"),
        ("<p>a <svg><text>drawn</text></svg> b</p>", "a b"),
        ("<p>a <canvas> b</p><p>c <canvas>fallback</canvas> d</p>", "a b\nc d"),
        ("<p>a</p><noscript><p>on with it</p></noscript><template><p>no</p></template><p>b</p>", "a\nb"),
        ("<p>a <select><option>1<p>b</p>", "a\nb"),
        ("<p>a</p><template><p>b</p>", "a\nb"),
        ("<p>a <svg/> b</p>", "a b"),
    ],
)
def test_elements_without_an_end_lose_no_text(html, want):
    assert "\n".join(b.text for b in html_extract.parse_page(html).blocks) == want

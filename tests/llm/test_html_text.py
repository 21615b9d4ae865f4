import html
import math
import re

from clausemill.llm.html_text import _measure, article, extract, main_text, parse, prune

BODY = "<h1>Head</h1><p>First <b>bold</b>&amp; text that is long enough to count.</p><p>Second\n  paragraph, also long enough,<br>with a break.</p>"
TEXT = "Head First bold& text that is long enough to count. Second paragraph, also long enough, with a break."


def test_boilerplate_goes():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- c --><div class='cookie-notice'>We use cookies on this page for many purposes.</div>"
        "<div class=\"ad\">Buy now, a long advert text that goes on and on and on.</div><aside>Other things to read today.</aside><article>" + BODY + "<form><p>Your mail</p><input name=q></form><script>var t='</p>';</script></article>"
        "<section id='comments'><p>" + "A reader says a lot of things here. " * 30 + "</p></section><footer>Imprint</footer></body></html>"
    )
    assert extract(page) == TEXT
    assert extract(page.replace("<article>", "<div id=content>").replace("</article>", "</div>")) == TEXT


LINKS = "<ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul>"


def test_names_on_wrappers_and_missing_end_tags():
    for page in (
        f'<div class="wrapper has-sidebar"><article>{BODY}</article></div>',
        f'<body><nav>{LINKS}</nav><div id="content" class="post no-comments">{BODY}</div><footer>f</footer>',
        f"<form action=x><div><nav>{LINKS}</nav></div><div class=c>{BODY}</div></form>",
        f"<nav>{LINKS}<div id=content>{BODY}</div>",
        f"<nav>{LINKS}<article>{BODY}</article>",
        f'<article><p class="notice">Note this{BODY}</article>',
        f'<div><ul><li class="share">Share it</ul>{BODY}</div>',
        f"<div data-x=it's><nav>{LINKS}</nav><article>{BODY}</article></div><p>it's",
        f'<div class="page"><div class="article-header"><h1>Head</h1></div>{BODY.removeprefix("<h1>Head</h1>")}</div>',
        f'<div class="layout sidebar-right"><div class=side-nav>{LINKS}</div><div class=content>{BODY}</div></div>',
    ):
        assert extract(page) == TEXT, page


def test_articles_of_readers_and_teasers_are_not_the_article():
    said = '<article class="comment"><p>A reader says much here. </p></article>' * 30
    assert extract(f"<article>{BODY}</article><section id=comments>{said}</section>") == TEXT
    assert extract(f"<main>{BODY}</main><aside>{'<article><a href=x>Teaser one</a></article>' * 3}</aside>") == TEXT


def test_pages_without_an_article_element():
    """Density alone finds the text between lists of links, banners and boxes."""
    box = "<div><div><a href=#>Offer</a> <a href=#>More offers</a></div><div><a href=#>Terms</a></div></div>"
    body = "<h1>Head</h1>" + "".join(f"<p>Paragraph {k} of a text that goes on for quite a while, as texts do.</p>" for k in range(6))
    text = " ".join(["Head", *(f"Paragraph {k} of a text that goes on for quite a while, as texts do." for k in range(6))])
    for page in (f"<body>{box}<div>{body}</div>{box}</body>", f"<table><tr><td>{LINKS}<td><div>{body}</div><td>{box}</table>", f"<div><div>{LINKS}</div><section>{body}</section><div>{LINKS}{box}</div></div>"):
        assert extract(page) == text, page


def test_density_against_plain():
    """Counts, densities and sums of every node, by walking the tree anew for each."""
    root = prune(parse(f"<body><div><p>one <a href=x>two</a></p>loose <b>text</b><ul><li><a>three</a><li>four</ul></div><section>{BODY}</section></body>"))
    nodes = _measure(root)

    def walk(n):
        return [n, *(m for c in n.children for m in walk(c))]

    def text(n):
        return "".join(p if isinstance(p, str) else text(p) for p in n.parts)

    def size(x):
        return len(re.sub(r"\s", "", x))

    def link_chars(n):
        return size(text(n)) if n.tag == "a" else sum(map(link_chars, n.children))

    ratio = link_chars(root) / size(text(root))
    for n in nodes:
        below = walk(n)[1:]
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == (size(text(n)), len(below), link_chars(n), sum(m.tag == "a" for m in below))
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(c / max(1, c - n.link_chars) * lc + ratio * c + math.e)
            assert abs(n.density - c / t * math.log(c / lc * t / lt + 1) / max(1.0, math.log(base + math.e - 1))) < 1e-9
    best = max(nodes, key=lambda n: n.sum)
    top, _ = article(root)
    assert best in walk(top)


def test_link_lists_lose():
    links = "<div>" + "".join(f"<p><a href=#>Link number {k}</a></p>" for k in range(20)) + "</div>"
    assert extract(f"<body>{links}<div>{BODY}</div></body>") == TEXT


def paragraphs(name, count):
    return [f"Paragraph {name} number {k} of a text that goes on for quite a while, as texts do." for k in range(count)]


def html_of(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


A, B, C = paragraphs("a", 10), paragraphs("b", 10), paragraphs("c", 3)


def test_parts_of_an_article_stay_together():
    """Sections, columns, quotes, leads and lists, in page order; in an article element and in plain boxes."""
    lead = ["A lead that says in a few words what the text is about."]
    cases = [
        (f"<h1>Head</h1><section>{html_of(A)}</section><section>{html_of(B)}</section>", ["Head", *A, *B]),
        (f"<h1>Head</h1><section><h2>One</h2>{html_of(A)}</section><section><h2>Two</h2>{html_of(B)}</section><section><h2>Three</h2>{html_of(C)}</section>", ["Head", "One", *A, "Two", *B, "Three", *C]),
        (f"<h1>Head</h1><div class=lead>{html_of(lead)}</div><div class=body>{html_of(A)}</div>", ["Head", *lead, *A]),
        (f"<h1>Head</h1><p>{lead[0]}</p><blockquote>{html_of(B[:6])}</blockquote>{html_of(C)}", ["Head", *lead, *B[:6], *C]),
        (f"<h1>Head</h1><div class=page-content><div>{html_of(A)}</div><div>{html_of(B)}</div></div>", ["Head", *A, *B]),
        (f"<h1>Head</h1><table><tr><td>{html_of(A)}</td><td>{html_of(B)}</td></tr></table>", ["Head", *A, *B]),
        (f"<h1>Head</h1>{html_of(C)}<ul>{html_of(B[:4], 'li')}</ul>{html_of(A[:3])}", ["Head", *C, *B[:4], *A[:3]]),
        (f"<h1>Head</h1>{html_of(A)}<h2>Yes</h2><p>So.</p>{html_of(C)}", ["Head", *A, "Yes", "So.", *C]),
    ]
    for body, texts in cases:
        for page in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div id=wrap>{body}</div>", f"<div><div>{body}</div></div>", body):
            whole = f"<body><nav>{LINKS}</nav><div><div>{LINKS}</div>{page}<div>{LINKS}</div></div><footer>f</footer></body>"
            assert extract(whole) == " ".join(texts), whole


def test_names_in_an_article():
    text = " ".join(["Head", *A])
    for page in (
        f'<article><h1>Head</h1><h2 class="section-header">More</h2>{html_of(A)}</article>',
        f'<article><h1>Head</h1><h2 class="related">More</h2>{html_of(A)}</article>',
        f'<article><h1>Head</h1><div class="tracking-a-storm"><p>More</p></div>{html_of(A)}</article>',
        f'<article><h1>Head</h1><div class="search-for-truth">More</div>{html_of(A)}</article>',
    ):
        assert extract(page) == text.replace("Head", "Head More", 1), page
    for page in (
        f'<article class="product-review"><h1>Head</h1>{html_of(A)}</article>',
        f'<main class="review"><h1>Head</h1>{html_of(A)}</main>',
        f'<article class="review"><h1>Head</h1>{html_of(A)}</article>',
        f'<main class="reviews comments"><h1>Head</h1>{html_of(A)}</main>',
        f'<article class="sidebar-ad"><h1>Head</h1>{html_of(A)}</article>',
        f'<article><h1>Head</h1><div class="ad-box">Buy it now.</div>{html_of(A)}<div class="related-links"><a href=x>Other</a></div></article>',
        f'<article><h1>Head</h1>{html_of(A)}<section class="comments"><article class="comment"><p>{"A reader says so. " * 60}</p></article></section></article>',
        f'<main><h1>Head</h1>{html_of(A)}<div id="disqus_comments">{"<p>A reader says so.</p>" * 60}</div></main>',
        f'<article><h1>Head</h1>{html_of(A)}</article><article class="review"><p>{"A reader says so. " * 20}</p></article>',
    ):
        assert extract(page) == text, page


def test_an_article_element_is_found_by_its_density():
    """Small articles of teasers do not win over the text; an article among them does."""
    teasers = "".join(f"<article><h3><a href=x>Teaser {k}</a></h3></article>" for k in range(5))
    assert extract(f"<body>{teasers}<div>{html_of(A)}</div></body>") == " ".join(A)
    assert extract(f"<body><main>{html_of(C)}<article>{html_of(A)}</article></main>{teasers}</body>") == " ".join(A)
    assert extract(f"<body><main><article>{html_of(A)}</article><article>{html_of(B)}</article><article>{html_of(A)}</article></main></body>") == " ".join([*A, *B, *A])


def test_broken_and_odd():
    assert extract(None) == extract("") == extract("<html></html>") == ""
    assert extract("plain") == "plain" and extract("<p>cut <b") == "cut"
    assert extract("<div>5 < 6 &nbsp;&#233; x</div>") == "5 < 6 é x"
    assert extract("<p>one<p>two") == "one two"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert extract(deep) == "deep text"


def test_pages_against_a_plain_cut(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", source[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]*\Z", "", re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)\s*/?>", " ", body)))
        assert r.text == re.sub(r"\s+", " ", html.unescape(body)).strip() and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in main_text(odd).collect()] == [("", 0), ("", 0)] and main_text(odd.limit(0)).count() == 0

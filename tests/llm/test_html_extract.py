import html
import re

import pytest

from ledgerlens.llm import html_extract as x

ARTICLE = (
    '<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home {k}</a></li><li><a href="/b">B</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy {k}</div><article><h1>Head {k} &amp; more</h1><p><b>First\n {k}.<br>After<p>Second &lt;{k}&gt; x &mdash; y</p><aside>See also</aside>'
    '<form>Search<input></form><ul><li>point {k}</li><li>other</li></ul><section class="comments"><p>Reader says {k}</p></section></article><div class="sidebar">Side</div><footer>&copy; F {k}</footer></body></html>'
)
WANT = "Head {k} & more\nFirst {k}. After\nSecond <{k}> x — y\npoint {k}\nother"
PLAIN = '<body><div class="top"><a href=1>One</a></div><ul><li><a>l1</a></li><li><a>l2</a></li></ul><div class="t"><h2>Title {k}</h2><p>Body {k} text</p><p>More {k}</p></div><div class="z">Always the same</div></body>'


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")


def test_extract(spark):
    rows = [(k, f"https://u@A.example.com:80/{k}", ARTICLE.format(k=k)) for k in range(8)] + [(20 + k, f"http://plain.org/{k}", PLAIN.format(k=k)) for k in range(8)]
    rows += [(90, None, None), (91, "http://x.org", ""), (92, "junk", "only text &amp; more"), (0, "https://a.example.com/0", ARTICLE.format(k=0)), (None, "http://cut.org", "<article><p>cut off &am"), (93, "http://long.org", "<main><p>" + "w " * 200_000 + "</main>")]
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in x.extract(frame(spark, rows).repartition(3)).collect()))
    want = [(k, WANT.format(k=k)) for k in range(8)] + [(20 + k, f"Title {k}\nBody {k} text\nMore {k}") for k in range(8)]
    want += [(90, ""), (91, ""), (92, "only text & more"), (0, WANT.format(k=0)), (-1, "cut off &am"), (93, ("w " * 200_000).strip())]
    # one page alone cannot show which of its texts are fixed
    assert got == sorted((k, t, len(t)) for k, t in want)
    again = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in x.extract(frame(spark, rows), max_broadcast_bytes=0).collect()))
    assert again == got
    assert x.extract(frame(spark, rows).limit(0)).count() == 0


def test_wrapper_expression():
    pages = ["<body><h1>a</h1><p>x</p><p>y</p><i>k</i></body>", "<body><h1>b</h1><div>d</div><p>z</p></body>"]
    w = x.merge(*map(x.page_tree, pages))
    assert x.expression(w) == "<body>k<h1>#</><div>d</>?<p>#</>+</>".replace("<div>d</>?", "(<div>d</>)?").replace("<p>#</>+", "(<p>#</>)+")
    w = x.page_tree("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>")
    assert x.expression(w) == "<dl>(<dt>#</><dd>#</>)+</>"


def texts(pages):
    """The text of each page of one host, by page number."""
    wrapper = x.page_tree(pages[0])
    for page in pages[1:]:
        wrapper = x.merge(wrapper, x.page_tree(page))
    keep = x.decide(wrapper)
    return [x.main_text(page, keep) for page in pages]


def test_two_templates_on_a_host(spark):
    teasers = "<body><div>Top {k}</div><article><p>Teaser {k}</p></article></body>"
    story = '<body><ul><li><a>l1</a></li><li><a>l2</a></li></ul><div class="content"><h1>Story {k}</h1><p>Body {k}</p></div><div class="z">Always the same</div></body>'
    for url in ("http://two.org/{k}", None):
        rows = [(k, url and url.format(k=k), (story if k % 3 else teasers).format(k=k)) for k in range(12)] + [(12, url, "<main></main><p>beside an empty part</p>")]
        got = {r.page_id: r.text for r in x.extract(frame(spark, rows).repartition(3)).collect()}
        assert got == {k: f"Story {k}\nBody {k}" if k % 3 else f"Teaser {k}" for k in range(12)} | {12: "beside an empty part"}


def test_foreign_elements():
    for image in ('<svg class="i"/>', "<MATH />", "<svg><title>t</title><path d='/>'/></svg >", "<svg-icon></svg-icon>", "<svg>"):
        assert texts([f"<article><p>one {image} two</p><p>three</p></article>"]) == ["one two\nthree"], image


def test_slug_ids():
    page = (
        '<body><div id="search-box">Find {k}</div><section id="related-work"><a href=1>Off {k}</a></section><article><h2 id="search-algorithms">Head {k}</h2><section id="related-work"><p>Work {k}</p></section><div id="search-impact"><p>Impact {k}</p></div>'
        '<section id="menu"><h3 id="promotion">Food {k}</h3></section><section class="share">Share {k}</section><div id="comments-2">Says {k}</div><p>x</p><section id="newsletter">Join us</section><p>y {k}</p><section id="social"><a>Other {k}</a></section></article></body>'
    )
    # one page cannot show what is fixed
    for n in (1, 6):
        assert texts([page.format(k=k) for k in range(n)]) == [f"Head {k}\nWork {k}\nImpact {k}\nFood {k}\nx\n" + "Join us\n" * (n == 1) + f"y {k}" for k in range(n)]


def test_long_texts():
    notice = "All rights to this text are with its writers, and nobody may print it without asking them first. " * 2
    assert texts([f"<body><h2>Title {k}</h2><p>Body {k}</p><div>{notice}</div></body>" for k in range(6)]) == [f"Title {k}\nBody {k}" for k in range(6)]
    # a text that one page has and others leave empty is not fixed
    assert texts([f"<body><h2>Title {k}</h2><div>{notice * (k == 3)}</div></body>" for k in range(6)]) == [f"Title {k}" + f"\n{notice.strip()}" * (k == 3) for k in range(6)]


def test_copies_of_one_article():
    page = "<body><nav>Visit {k}</nav><h1>Title</h1><div>" + "Long words. " * 20 + "</div><ul><li>a</li><li>b</li></ul></body>"
    for n in (3, 4, 9):
        assert texts([page.format(k=k) for k in range(n)]) == ["Title\n" + ("Long words. " * 20).strip() + "\na\nb"] * n


def brute(page):
    """Independent reading of the test pages' one template."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    out = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in out if b)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in x.extract(pages).collect()}
    assert got == want


def test_left_open_and_deep(spark):
    assert texts(["<p title=\"x>first</p><p>second"]) == ["first\nsecond"]
    for n in (20_000, 100_000):
        for left in ("<a ", "<a '\"", "<svg>", "<svg ", "<div>", "<p", "<!--", "</", "<li><div>", '<p title="'):
            x.main_text(left * n, x.decide(x.page_tree(left * n + ">")))
    deep = "<nav>N{k}" * 150 + "<div>still menu" + "</div></nav>" * 150
    page = "<main>" + "<div>d{k}" * 5_000 + "<p>bottom {k}</p>tail" + "</div>" * 5_000 + deep + "<p>end</p></main>"
    rows = [(k, "http://deep.org", page.format(k=k)) for k in range(3)] + [(9, "http://left.org", "<article>" + "<a " * 100_000)]
    got = {r.page_id: r.text for r in x.extract(frame(spark, rows)).collect()}
    assert got[1] == "\n".join(["d1"] * 5_000 + ["bottom 1", "tail", "end"])


def test_the_wrapper_decides(spark):
    page = '<body><div class="top">{own}</div><div class="t"><p>Body {k}</p></div><div class="z">Always</div></body>'
    pages = [page.format(k=k, own="Mine" if k == 2 else "Ours") for k in range(6)]
    alone = [x.main_text(p, x.decide(x.page_tree(p))) for p in pages]
    assert alone[2] == "Mine\nBody 2\nAlways"  # one page shows nothing that is fixed
    rows = [(k, "http://one.org", p) for k, p in enumerate(pages)]
    for parts in (1, 2, 5):
        got = {r.page_id: r.text for r in x.extract(frame(spark, rows).repartition(parts)).collect()}
        assert got == {k: ("Mine" if k == 2 else "Ours") + f"\nBody {k}" for k in range(6)}
    assert x.wrappers(frame(spark, rows).repartition(5)).count() == 1


def test_class_words():
    page = '<article><p>a {k}</p><div class="related-work">W {k}</div><div class="social-history">S {k}</div><div class="cookie-notice">C {k}</div><div class="ad-slot-3">A {k}</div><div class="related-reads"><a>R {k}</a></div></article>'
    assert texts([page.format(k=k) for k in range(5)]) == [f"a {k}\nW {k}\nS {k}" for k in range(5)]

import html
import re

import pytest

from textbarge.llm import htmltext

PAGE = "<html><body><header class='site'><h1>Site</h1><nav><a href=x>a</a></nav></header><main><div class='notice'>We use cookies</div><article><header><h1>T</h1></header><p>Hello <b>wor</b>ld &amp; co<p>two &lt;b&gt;</p><ul><li>one<li>two</ul></article><section class='comments'><p>nice post by a reader, and a rather long text that goes on and on</p></section></main><aside>side</aside><form><p>sub</p></form><footer>f</footer></body></html>"


@pytest.mark.parametrize("page, text", [
    (PAGE, "T Hello world & co two <b> one two"),
    ("", ""), (None, ""), ("plain text only", "plain text only"), ("<div><div class=ad>x</div>", ""),
    ("<div id=menu><a>x</a></div><div class=content><p>Some text here that is long enough.</p><p>More.</p></div><div class='comment-list'><p>a comment from a reader</p></div><div id='cookie-banner'>c</div>", "Some text here that is long enough. More."),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<article><p>a&nbsp;&nbsp;b &copy; &am</p><p>x\n\n y</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><p>z", "a b © &am x y z"),
    ("<body><article><h1>Cut off</h1><p><b>bold<br><p>next</p><p>unfin", "Cut off bold next unfin"),
    ("<nav>menu</nav></div></p><article>t</article></body>", "t"),
])
def test_pages(page, text):
    assert (htmltext.extract(page) if page else "") == text


def test_deep_and_long_pages():
    assert htmltext.extract("<div>" * 20_000 + "deep") == "deep"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert htmltext.extract(f"<article><p>{long}</p></article>") == long


def test_table(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", PAGE, "t")]
    out = htmltext.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    want = htmltext.extract(PAGE)
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in out) == sorted([("1", "u", want, len(want)), ("2", "None", "", 0), ("None", "u", "", 0), ("1", "u", want, len(want))])
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_given_pages_hold_their_articles(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"<(br|/?p|/?h1)[^>]*>", "\0", inner)).split("\0")
        assert htmltext.extract(r["html"]) == " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks) if x)


def _sections(*counts, between="", n=200):
    blocks = [[f"Part {i} paragraph {j} ".ljust(n, "x") for j in range(k)] for i, k in enumerate(counts)]
    return between.join("<section>" + "".join(f"<p>{p}</p>" for p in b) + "</section>" for b in blocks), " ".join(p for b in blocks for p in b)


@pytest.mark.parametrize("counts", [(10, 10), (10, 3), (2, 9, 4), (5, 5, 5, 5)])
@pytest.mark.parametrize("page", ["<div class=post>{}</div>", "<div>{}</div><div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>", "<div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div>{}</div></div>"])
def test_sibling_sections_without_article(page, counts):
    blocks, want = _sections(*counts)
    assert htmltext.extract(f"<html><body>{page.format(blocks)}</body></html>") == want


def test_sibling_sections_keep_what_is_between():
    blocks, want = _sections(4, 4, between="<h2>Between</h2>")
    assert htmltext.extract(f"<div class=post>{blocks}</div>") == want.replace(" Part 1 paragraph 0", " Between Part 1 paragraph 0")


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "page-with-sidebar", "overflow-hidden", "content-with-comments", "share-enabled", "hidden", "widget", "sidebar layout"])
@pytest.mark.parametrize("page", ["<div class='{}'><h1>Title</h1><p>Some text of the article.</p></div><div class=sidebar><p>Aside text</p></div>", "<div id='{}'><article><p>Title</p><p>Some text of the article.</p></article></div><div class='ad banner'>Buy</div>"])
def test_wrapper_named_like_boilerplate(page, name):
    assert htmltext.extract(page.format(name)) == "Title Some text of the article."


def test_named_blocks_beside_the_article_go():
    text = "Some text of the article."
    for block in ("<div class='cookie-banner'>We use cookies on this site</div>", "<ol class=comments><li><article><p>" + "A reader's long comment. " * 9 + "</p></article></ol>", "<form><p>Mail address</p></form>"):
        assert htmltext.extract(f"<main><article><p>{text}</p></article>{block}</main>") == text
    assert htmltext.extract(f"<body><form action=x><div><p>{text}</p></div></form></body>") == text


@pytest.mark.parametrize("page, text", [
    ("<p>a</p><script>if (i<n) x(); // don't</script><p>b</p><p>it's c</p>", "a b it's c"),
    ("<p>a</p><script>x = '<!--'; y(\"</p>\")</SCRIPT ><p>b</p><style>a<b \"</style\n><p>c", "a b c"),
    ("<p title=5\" class=x>a</p><p>b</p><p class=\"y\">c</p>", "a b c"),
    ("<p>a<img alt=\"a\"b\">b</p><p>c</p>", "ab c"),
    ("<p>a<a href=foo?x=\"1>b</a></p><p>it's c</p>", "ab it's c"),
    ("<p>a<a href=\"x.html>b</a></p><p>c</p>", "ab c"),
    ("<p title = 'x > y'>a</p><p data-a=\"<p>\">b</p>", "a b"),
    ("<div title='the hidden class=ad truth'><p>a</p></div><p>b</p>", "a b"),
    ("<p>a</p><svg/><p>b</p><svg><svg><text>t</text></svg></svg><p>c</p>", "a b c"),
    ("<p>a</p><script>cut off <p>b", "a"),
])
def test_raw_elements_and_stray_quotes(page, text):
    assert htmltext.extract(f"<body>{page}") == text


def test_many_stray_quotes_are_read_in_one_pass():
    assert htmltext.extract("<p title=5\" b=c'>x</p>" * 20_000) == " ".join(["x"] * 20_000)
    assert htmltext.extract("<script>a<b '</script><p a=\"x>y</p>" * 2 + "z").endswith("z")


ARTICLE = " ".join(f"word{i}" for i in range(40))
OTHER = "Text of somebody else that goes on and on. " * 30


@pytest.mark.parametrize("name", ["comments", "comment-section", "user-comments", "comments__list", "sidebar", "site-sidebar", "left_sidebar", "site-footer", "footer", "related", "reply-list"])
@pytest.mark.parametrize("page", ["<div class=post><p>{0}</p></div><div class='{2}'><p>{1}</p></div>", "<div id='{2}'><p>{1}</p></div><div class=content><p>{0}</p></div>", "<div class='page has-sidebar'><p>{0}</p><div class='{2}'><p>{1}</p></div></div>"])
def test_parts_beside_the_article_go_whatever_their_size(page, name):
    assert htmltext.extract(f"<body>{page.format(ARTICLE, OTHER, name)}</body>") == ARTICLE


def test_parts_stay_where_they_are_all_there_is():
    for name in ("sidebar layout", "site-footer", "comments"):
        assert htmltext.extract(f"<body><p>Hi</p><div class='{name}'><p>{ARTICLE}</p><p>{ARTICLE}</p></div></body>").endswith(f"{ARTICLE} {ARTICLE}")


def test_title_and_lead_beside_the_body_stay():
    body = f"<div class=body>{f'<p>{ARTICLE}</p>' * 8}</div>"
    want = " ".join([ARTICLE] * 8)
    assert htmltext.extract(f"<body><div id=wrap><h1>Title</h1><p class=lead>The lead.</p>{body}<p>The end.</p></div></body>") == f"Title The lead. {want} The end."
    assert htmltext.extract(f"<body><div><h1>Title</h1><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{body}</div><div>Small print</div></body>") == f"Title {want}"
    assert htmltext.extract(f"<body><p>Small print</p>{body}</body>") == want


def test_formulas_stay():
    assert htmltext.extract("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>") == "so x=1 holds"

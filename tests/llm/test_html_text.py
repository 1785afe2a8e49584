import time
import tracemalloc

import pytest

from tablekeep.llm import html_text
from tablekeep.llm.html_text import main_text

FIRST = "A first paragraph, long enough to be one, with commas. And a second sentence."
SECOND = "The second one goes on for a while; it says more, and then it ends."


def page(body, head="<title>Title</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


ARTICLE = f"<h1>Heading</h1><p>{FIRST}</p><p>{SECOND}</p>"
TEXT = f"Heading\n{FIRST}\n{SECOND}"


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href=x>Home</a></li></ul></nav>{}<footer>&copy; all of it, reserved.</footer>",
        "<header><p>Welcome, to a site, of sites.</p></header>{}",
        "{}<aside><p>Related things, of all kinds, that one may read. Or not.</p></aside>",
        '<div class="cookie-notice">We use cookies, and that is, as you know, usual.</div>{}',
        '{}<div id="comments"><p>Nice text, I like it, really. Thanks!</p></div>',
        '{}<section class="post-comments"><div class=comment><p>Well, yes, no.</p></div></section>',
        '<div class="ad">Buy now, pay later, be happy. Today only!</div>{}',
        "{}<form><p>Subscribe, please, to the letter.</p><input><button>Go</button></form>",
        "{}<div role=navigation>Next, previous, up. Down.</div><div hidden>Not seen, ever.</div>",
        "<!-- a comment, not text --><noscript>No script, no fun.</noscript>{}<svg><text>x</text></svg>",
        '<ul class=links><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>{}',
        '<div class="sidebar-left"><p>Some words, at the side, about things.</p></div>{}',
    ],
)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
def test_only_the_article(around, wrap):
    assert main_text(page(around.format(wrap.format(ARTICLE)))) == TEXT


def test_space_references_and_breaks():
    source = page(f"<article><p>{FIRST}\n\t  &amp; &eacute;&#233;&#x41;&nbsp;x<br>y</p><p>  </p><p>{SECOND}</p></article>")
    assert main_text(source) == f"{FIRST} & ééA x y\n{SECOND}"


def test_unclosed_and_crossed_tags():
    source = page(f"<article><p><b>{FIRST}<br><p>{SECOND}<p>x<i>y</b>z</i></article><footer>no</footer>")
    assert main_text(source) == f"{FIRST}\n{SECOND}\nxyz"


def test_lists_tables_quotes():
    body = (
        f"<article><p>{FIRST}</p><ul><li>one<li>two</ul><blockquote>Said so.</blockquote>"
        f"<table><tr><td>a<td>b<tr><td>c</table><pre>x  y</pre></article>"
    )
    assert main_text(page(body)) == f"{FIRST}\none\ntwo\nSaid so.\na\nb\nc\nx y"


def test_article_without_an_element_among_links():
    links = "".join(f"<div class=x><a href={i}>Link number {i}</a></div>" for i in range(30))
    body = links + f"<div class=t><p>{FIRST}</p><p>{SECOND}</p><p>{FIRST}</p></div>" + links
    assert main_text(page(body)) == f"{FIRST}\n{SECOND}\n{FIRST}"


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("   ", ""),
        ("plain words", "plain words"),
        ("<", "<"),
        ("a < b", "a < b"),
        ("<p", ""),
        ("<!-- never ended <p>x", ""),
        ("<script>never ended <p>x", ""),
        ("<p title='a>b'>x</p>", "x"),
        ("</p></div>x", "x"),
        ("<b>" * 3000 + "deep" + "</b>" * 3000, "deep"),
    ],
)
def test_odd_sources(source, text):
    assert main_text(source) == text


def test_names():
    for name in ("ad", "ads-top", "site-header", "post-comments", "cookieNotice", "sidebar2", "widget_area"):
        assert html_text._names_part(name), name
    for name in ("has-sidebar", "content", "article-body", "heading", "download", "post-text", "no-comments", "p1"):
        assert not html_text._names_part(name), name


@pytest.mark.parametrize(
    "attributes",
    [
        'title="A hidden gem"',
        'data-hidden="false"',
        'data-id="search"',
        "data-class='sidebar' title='class=\"ad\"'",
        'cite="/hidden/x?id=review"',
        "cite=/hidden/x?id=review",
        'alt="" title="style=display:none role=search"',
    ],
)
def test_other_attributes_put_nothing_out(attributes):
    body = f"<article><p>{FIRST}</p><p {attributes}>{SECOND}</p></article>"
    assert main_text(page(body)) == f"{FIRST}\n{SECOND}"


@pytest.mark.parametrize("attributes", ["hidden", "x=1 HIDDEN=''", "aria-hidden = 'true'", "role=search"])
def test_attributes_put_out(attributes):
    body = f"<article><p>{FIRST}</p><p {attributes}>{SECOND}</p></article>"
    assert main_text(page(body)) == FIRST


LONG = "This is prose, and it goes on; there is more of it, which is usual, and then it ends. " * 4


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
@pytest.mark.parametrize(
    "poor",
    [
        "".join(f"<div class=tab>Tab {i}</div>" for i in range(8)),
        "<div class=tabs><ul>" + "".join(f"<li>Tab {i}</li>" for i in range(8)) + "</ul></div>",
    ],
)
def test_path_ratios_decide_in_articles_too(wrap, poor):
    prose = "".join(f"<p>{LONG}</p>" for _ in range(10))
    text = "\n".join([LONG.strip()] * 10)
    for body in (f"<div class=text>{prose}</div>{poor}", f"{poor}<div class=text>{prose}</div>"):
        assert main_text(page(wrap.format(body))) == text


def test_an_article_raises_only():
    prose = "".join(f"<p>{LONG * 3}</p>" for _ in range(5))
    teasers = "".join("<article><p>A short teaser, for you.</p></article>" for _ in range(3))
    assert LONG.strip() in main_text(page(f"<div class=text>{prose}</div>{teasers}"))
    outside = f"<p>{FIRST}</p>"
    assert main_text(page(f"{outside}<article><p>{LONG}</p><p>{LONG}</p></article>")) == "\n".join([LONG.strip()] * 2)


def test_items_beside_prose_stay():
    items = "<ul><li>Eggs</li><li>Flour</li></ul><div class=wide><table><tr><td>1<td>2</table></div>"
    text = f"{LONG.strip()}\nEggs\nFlour\n1\n2\n{LONG.strip()}"
    assert main_text(page(f"<main><p>{LONG}</p>{items}<p>{LONG}</p></main>")) == text


@pytest.mark.parametrize(
    "part,text",
    [
        (f"<h2 id=search-engines>Search engines</h2><p>{LONG}</p>", f"Search engines\n{LONG.strip()}"),
        (f"<section id=discussion><h2>Discussion</h2><p>{LONG}</p></section>", f"Discussion\n{LONG.strip()}"),
        (f"<section id=comments><h2>Comments</h2><p>{LONG}</p></section>", f"Comments\n{LONG.strip()}"),
        (f"<section id=related-work><p>{LONG}</p></section>", LONG.strip()),
        (f"<div class=review-body><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class=warning>{LONG}</div>", LONG.strip()),
        (f"<p id=copyright-law>Copyright law. {LONG}</p>", f"Copyright law. {LONG.strip()}"),
        (f"<p>Some <span class=comment>words</span> {LONG}</p>", f"Some words {LONG.strip()}"),
        ("<div class=warning>Mind it.</div>", None),
        ("<div class=notice>Parts of it are not up to date, sorry.</div>", None),
        (f"<div id=comments><h2>3 replies</h2><p>{LONG}</p><p>{LONG}</p></div>", None),
        (f"<div class=ad><p>{LONG}</p></div>", None),
        ("<ul class=share><li>Send<li>Print</ul>", None),
    ],
)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
def test_names_lower_scores(wrap, part, text):
    others = f"<p>{LONG}</p>" * 3
    expected = [LONG.strip()] * 3 + [text] * (text is not None) + [LONG.strip()] * 3
    assert main_text(page(wrap.format(others + part + others))) == "\n".join(expected)


WRAPS = [
    "<form id=aspnetForm method=post>{}</form>",
    "<fieldset>{}</fieldset>",
    "<label>{}</label>",
    "<dialog open>{}</dialog>",
    "<form><fieldset><div role=dialog>{}</div></fieldset></form>",
    "<div role=form>{}</div>",
]
SIDE = (
    "<nav><a href=x>Home</a></nav><div class=ad>Buy now, pay later, be happy. Today only!</div>"
    "<ul class=links><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
)


@pytest.mark.parametrize("form", WRAPS)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
def test_a_page_in_a_form_is_as_without(form, wrap):
    body = SIDE + wrap.format(ARTICLE + f"<p>{LONG}</p>")
    text = f"{TEXT}\n{LONG.strip()}"
    assert main_text(page(body)) == main_text(page(form.format(body))) == text
    assert main_text(page(SIDE + form.format(wrap.format(ARTICLE + f"<p>{LONG}</p>")))) == text


@pytest.mark.parametrize(
    "form",
    [
        "<form><label>Your name</label><input><p>We keep it, as the law asks.</p><button>Go</button></form>",
        "<fieldset><legend>Choose one, please.</legend><label>A</label><label>B</label></fieldset>",
        "<dialog>We use cookies, and that is, as you know, usual.</dialog>",
    ],
)
def test_forms_beside_or_in_an_article_go(form):
    for body in (f"<article>{ARTICLE}</article>{form}", f"<article>{ARTICLE}{form}<p>{LONG}</p></article>"):
        text = main_text(page(body))
        assert text == (f"{TEXT}\n{LONG.strip()}" if LONG in body else TEXT)


def test_the_foot_of_a_quotation_stays():
    quote = "<blockquote><p>So it is, and so it was.</p><footer>An author, 1900</footer></blockquote>"
    body = f"<article><p>{LONG}</p>{quote}<p>{LONG}</p><footer>Filed under things, of all kinds.</footer></article>"
    lines = [LONG.strip(), "So it is, and so it was.", "An author, 1900", LONG.strip()]
    assert main_text(page(body)) == "\n".join(lines)


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 200_000 + FIRST,
        "<div class=c id=comments>" * 100_000 + FIRST,
        "<form><fieldset>" * 100_000 + FIRST,
        "<b>" * 100_000 + f"<p>{FIRST}</p></i></u>" * 2000,
        "<ul><li>" * 100_000 + FIRST,
    ],
)
def test_deep_pages_take_little_memory_and_time(source):
    start, memory = time.process_time(), tracemalloc.start()
    text = main_text(source)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert set(text.split("\n")) == {FIRST} and memory is None
    assert most < 300e6 and time.process_time() - start < 60


def test_frame(spark):
    rows = [
        (1, "u", page(f"<article>{ARTICLE}</article>"), 5),
        (1, "u", page(f"<article>{ARTICLE}</article>"), 5),
        (None, None, None, None),
        (2, "v", "", 1),
        (3, "w", page("<article><p>" + "long text, very long. " * 20000 + "</p></article>"), 1),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [
        (0, "", 0), (1, "u", len(TEXT)), (1, "u", len(TEXT)), (2, "v", 0), (3, "w", 22 * 20000 - 1),
    ]
    assert {r.text for r in got if r.page_id == 1} == {TEXT}
    assert html_text.extract(df.limit(0)).collect() == []


def test_pages_of_the_tables(spark, data):
    """The text of a page is its article, block by block."""
    import html
    import re

    pages = spark.read.parquet(f"{data}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for row in html_text.extract(pages).collect():
        article = re.search("<article>(.*)</article>", sources[row.page_id], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>", "", article).replace("<br>", " "))
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert row.text.split("\n") == [b for b in blocks if b]

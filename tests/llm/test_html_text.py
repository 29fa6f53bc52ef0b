import pytest

from wardline.llm import html_text

LONG = "Some long text, with words and signs. It goes on, and on. " * 3
P = f"<p>{LONG}</p>"
TEXT = LONG.strip()


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (None, []), ("", []), ("<html><body></body></html>", []), ("just text", ["just text"]), ("<p>a<p>b", ["a", "b"]),
        (f"<nav><a>Home</a></nav><article><h1>T &amp; U</h1>{P}<p>Short.<br>x</p>{P}</article><footer>f, g.</footer>", ["T & U", TEXT, "Short. x", TEXT]),
        (f"<div id=menu><ul><li><a>Home</a><li>About</ul></div><div id=content><h2>T</h2>{P}<p>S.<table><tr><td>c1<td>c2</table>{P}</div><div class=sidebar>{P}</div>", ["T", TEXT, "S.", "c1", "c2", TEXT]),
        (f"<header><h1>Site</h1></header><main>{P}<div class='cookie-notice'>We use cookies.</div>{P}</main><section id='comments'>{P}</section>", [TEXT, TEXT]),
        (f"<article><form>{P}</form><script>var t='</p>';</script><style>p{{}}</style>{P}<!-- {P} --></article>", [TEXT]),
        (f"<body><h1>Head</h1>{P}<p>x</p><h2>Sub</h2>{P}<div><a>link</a></div>", ["Head", TEXT, "x", "Sub", TEXT]),
        ("<p>&lt;tag&gt; &#x41;&nbsp;b&copy;  c\n d", ["<tag> A b© c d"]), ("a < b <3", ["a < b <3"]),
        (f"<article><p><b>{LONG}<br><p>next</article>", [TEXT, "next"]), (f"<script>never closed {P}", []), (f"<article>{P}<p hidden>no</p></article>", [TEXT]),
    ],
)
def test_pages(page, blocks):
    assert html_text.main_blocks(page) == blocks


@pytest.mark.parametrize(
    "wrapper", ["content has-sidebar", "no-sidebar", "no-comments", "post legal", "related-work", "page_with_widgets", "layout sidebar-right"]
)
def test_a_wrapper_of_the_article_is_not_boilerplate(wrapper):
    page = f"<nav><a>Home</a></nav><div class='{wrapper}'><div id=text><h1>T</h1>{P}<p>A<span class=share>Share</span>B</p>{P}</div></div><div class=sidebar>{P}</div>"
    assert html_text.main_blocks(page)[-3:] == [TEXT, "AB", TEXT]


def test_a_page_of_named_elements_only_has_text():
    assert html_text.main_blocks(f"<div class=notice>{P}</div><div class=alert>{P}</div>") == [TEXT, TEXT]
    assert html_text.main_blocks(f"<main>{P}<section class=related-work>{P}</section>{P}</main>") == [TEXT] * 3


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<body><main><section>{P * 8}</section><section><h2>S</h2>{P * 2}<p>x</p></section></main></body>", [TEXT] * 8 + ["S", TEXT, TEXT, "x"]),
        (f"<body><section>{P * 8}</section><section><h2>S</h2>{P * 2}<ul><li>x</ul></section><p>y</body>", [TEXT] * 8 + ["S", TEXT, TEXT, "x"]),
        (f"<article><h1>T</h1><div>By N</div><div class=body>{P * 4}</div><div>End</div></article>", ["T", "By N", *[TEXT] * 4, "End"]),
        (f"<div><a>Site</a></div><div><h1><b>T</b></h1><div>By N</div><div class=body>{P * 4}</div></div>", ["T", "By N", *[TEXT] * 4]),
        (f"<body><h1>Site</h1><div>Links</div><h1>T</h1><p>Lead.</p><div>{P * 4}</div></body>", ["T", "Lead.", *[TEXT] * 4]),
    ],
)
def test_nothing_of_the_article_is_dropped(page, blocks):
    assert html_text.main_blocks(page) == blocks


def test_short_paragraphs_count_like_their_neighbours():
    page = "<nav>" + "<a>link</a>" * 30 + "</nav><article>" + P * 3 + "<p>Er.</p>" * 5 + "</article>"
    assert html_text.main_blocks(page) == [TEXT] * 3 + ["Er."] * 5


def test_tables(table):
    rows = [(1, None), (2, ""), (2, f"<article>{P}</article>"), (None, "<p>x" + "y" * 200_000), (2, f"<article>{P}</article>")]
    got = html_text.extract(table(rows, "page_id long, html string"), ["page_id", "value"])
    assert got.columns == ["page_id", "value", "text"]
    assert sorted(len(r.text) for r in got.collect()) == [0, 0, len(TEXT), len(TEXT), 200_001]
    assert html_text.extract(table([], "page_id long, html string"), ["page_id"]).collect() == []


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<nav>Home</nav><div style='overflow:hidden'><h1>T</h1>{P}{P}</div><p>x", ["T", TEXT, TEXT]),
        (f"<article>{P}<p>One <a title='a hidden gem'>link</a> more.</p>{P}</article>", [TEXT, "One link more.", TEXT]),
        (f"<article>{P}<section data-id='menu' data-class=\"sidebar\" data-hidden>{P}</section></article>", [TEXT, TEXT]),
        (f"<body><form action=x><input name=q><article><h1>T</h1>{P}{P}</article><button>Go</button></form></body>", ["T", TEXT, TEXT]),
        (f"<article>{P}{P}<form><p>Search, here.</p></form></article>", [TEXT, TEXT]),
        (f"<article><h1>T</h1>{P}</article><section id=comments>{P * 9}</section>", ["T", TEXT]),
        (f"<article><h1>T</h1>{P}<div class='x comment-list'>{P * 9}</div></article>", ["T", TEXT]),
        (f"<div class=comments>{P}</div>", [TEXT]),
        (f"<article class='a' class='menu' hidden=false>{P}</article>", [TEXT]),
        (f'<article>{P}<p class="a>b" id=\'c>d\'>In.</p></article>', [TEXT, "In."]),
        (f'<article>{P}<p>It is <b class="x>5 and</b> more.</p></article>', [TEXT, "It is 5 and more."]),
    ],
)
def test_attributes_forms_and_comments(page, blocks):
    assert html_text.main_blocks(page) == blocks


@pytest.mark.parametrize(
    "page", ["<a " * 350_000, "<a \"" * 250_000, "<a '" * 250_000 + ">", "<div>" * 10_000 + "x" + "</div>" * 10_000, "<p><b>" * 150_000, "</x>" * 250_000,
             "<div>" * 10_000 + "</span><td><li>" * 20_000, "<!--" * 250_000, "<script" * 150_000, "<ul><li>" * 20_000, "<style>" * 150_000,
             "<div>x" * 20_000, "<div class=menu>x" * 20_000, "<body>" + "<div>" * 9_000 + "<p>x</p>" * 20_000])
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.process_time()
    html_text.main_blocks(page)
    assert time.process_time() - start < 4

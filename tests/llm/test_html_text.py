import time

import pytest

from likeness.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>About</aside>
<article class="post"><h1>Ti&eacute;tle</h1><p>One <b>bold</b>
 text &amp; more<br>end<p>Two</p><div class="ad">Buy</div><form><input>Mail <button>Send</button></form>
<ul><li>a<li>b</ul><blockquote>Quote</blockquote><!-- <p>no</p> -->tail
<section class="comments"><h2>Comments</h2><article><p>reader</p></article></section></article>
<div id="sidebar">side</div><footer>&copy; me</footer></body></html>"""


def test_article_blocks_only():
    assert h.main_text(PAGE).split("\n\n") == [
        "Tiétle", "One bold text & more end", "Two", "a", "b", "Quote", "tail",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><p>x<script>1<2</script></article>", "x"),
        ("<article><p><b>t.<br><p>second</article>", "t.\n\nsecond"),
        ("<article>a < b <p>c", "a < b\n\nc"),
        ("</div></p><article>x</article></article>", "x"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<body><div class='menu'>m</div><p>body&nbsp; text</p></body>", "body text"),
        ("<article><header><h1>H</h1></header><p>x</article>", "H\n\nx"),
        ("<script>never closed <p>x", ""),
        ("<!-- never closed <p>x", ""),
        ("<article><table><tr><td>1<td>2<tr><th>3</table></article>", "1\n\n2\n\n3"),
        ("<article>" + "<div>" * 3000 + "deep" + "</article>", "deep"),
        ("<article><p hidden>no</p><p class='shadow'>yes</p></article>", "yes"),
        ("<article><h2>Related</h2><p>x</p></article>", "Related\n\nx"),
    ],
)
def test_small_pages(page, text):
    assert h.main_text(page) == text


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for host in ("a.example", "B.example"):
        for i in range(8):
            body = f"<div>Welcome to {host}</div><p>story {host} {i}</p><p>{'shared' if i < 3 else i}</p><div>Bye</div>"
            rows.append((len(rows), f"https://user@{host}:80/x/{i}", body))
    # Copies of one page are one page: their blocks do not become template.
    rows += [(100 + i, "http://copies.example/", "<div>all of it</div><p>same</p>") for i in range(9)]
    rows += [(200, None, None), (201, "no address", "<article><p>x</p></article>"), (200, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as key")


@pytest.mark.parametrize("sent", [h.SENT_HASHES, 0])
def test_templates_of_a_host_go(pages, sent):
    found = {}
    for r in h.extract(pages, sent=sent).collect():
        found.setdefault(r.page_id, []).append(r.text)
    assert len(found[200]) == 2 and found[200] == ["", ""]
    assert found[201] == ["x"]
    for i in range(16):
        host = ("a.example", "B.example")[i // 8]
        assert found[i] == [f"story {host} {i % 8}\n\n{'shared' if i % 8 < 3 else i % 8}"]
    assert all(found[100 + i] == ["all of it\n\nsame"] for i in range(9))


def test_copied_articles_and_rare_headings_stay(spark):
    rows = []
    # Five near copies of one article, each under its own menu and with its own date.
    story = "<h2>The heading</h2><p>The first long paragraph of it.</p><p>The second long paragraph of it.</p>"
    for i in range(5):
        page = f"<div>menu {i}</div><div>{story}<p>The third long paragraph of it.</p></div><p>on day {i}</p>"
        rows.append((i, "http://copies.example/", page))
    # A heading on six of 200 pages, a line on all.
    for i in range(200):
        body = f"{'<h2>Results</h2>' if i < 6 else ''}<p>own words {i}</p><p>other words {i}</p><div>On all pages</div>"
        rows.append((100 + i, "http://large.example/", body))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text.split("\n\n") for r in h.extract(pages).collect()}
    for i in range(5):
        assert found[i] == [
            f"menu {i}", "The heading", *[f"The {n} long paragraph of it." for n in ("first", "second", "third")], f"on day {i}",
        ]
    for i in range(200):
        assert found[100 + i] == [*(["Results"] if i < 6 else []), f"own words {i}", f"other words {i}"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert h.extract(none).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<a '" * 60_000, "<a \"'" * 60_000, "<b>" * 60_000 + "<p>" * 30_000, "<script/>" * 60_000, "<main>" * 30_000, "<header>" * 30_000 + "<h1>x"],
)
def test_broken_pages_take_time_in_proportion(page):
    def seconds(part):
        start = time.process_time()
        h.subtrees(part)
        h.main_text(part)
        return time.process_time() - start

    assert seconds(page) < 10 * seconds(page[: len(page) // 4]) + 1


def test_quotes_and_tags_that_never_end():
    assert h.main_text("a < b <a 'x <p>one</p> <b>two") == "a < b <a 'x\n\none\n\ntwo"
    assert h.main_text("<p title='a>b'>in</p><p title=\"it's\">out") == "in\n\nout"

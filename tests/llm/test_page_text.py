import pytest

from frameledger.llm.page_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu, one, two, three.</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies, a lot of them, on every page. Accept all of them now.</div>
<main><article><header><h2>A &amp; B</h2></header><p>First &lt;b&gt; <b>bold</b>,
  text&nbsp;of some length, with commas, and stops. More words follow here.</p><p><b>Second, unclosed one.<br><p>Third one, that is long enough. It has stops.</p>
<div class="ad">Buy this, now. Cheap, good, and long text of an advert.</div><ul><li>Item one, fine.<li>Item two.</ul>
<form>Name: <input> Send, please.</form></article>
<section id="comments"><div class="comment"><p>I think, as a reader, that this is a fine article. Well done, all.</p></div></section></main>
<aside>Related, links. And more, of them.</aside><footer>&copy; Site, all rights. Reserved.</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert main_text(PAGE).split("\n") == ["A & B", "First <b> bold, text of some length, with commas, and stops. More words follow here.", "Second, unclosed one.",
                                           "Third one, that is long enough. It has stops.", "Item one, fine.", "Item two."]


def test_page_without_article_element():
    page = "<body><div class='menu'>" + "<a href=x>Link</a> " * 9 + "</div><div class='post'>" + "".join(f"<p>Paragraph {i}, of the text, is long enough. It ends here.</p>" for i in range(5)) + "</div><div>Imprint</div></body>"
    assert main_text(page).split("\n") == [f"Paragraph {i}, of the text, is long enough. It ends here." for i in range(5)]


def test_content_beside_a_large_body_element_stays():
    prose = "Some words, that make a sentence. "
    body = "<div class=body>" + f"<p>{prose * 9}</p>" * 11 + "</div>"
    whole = [(prose * 9).strip()] * 11
    lead, end = f"Lead: {prose * 8}".strip(), f"Closing: {prose * 8}".strip()
    assert main_text(f"<article><h1>Heading</h1><p>{lead}</p>{body}</article>").split("\n") == ["Heading", lead, *whole]
    assert main_text(f"<article><h1>Heading</h1>{body}</article>").split("\n") == ["Heading", *whole]
    assert main_text(f"<div id=a>{body}<p>{end}</p></div><div class=menu>Home</div>").split("\n") == [*whole, end]
    assert main_text(f"<article><section><h2>One</h2><p>{lead}</p></section><section><h2>Two</h2>{body}</section></article>").split("\n") == ["One", lead, "Two", *whole]


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!--", "<script>x", "</p></div>", "<nav>a</nav>", "\x00"])
def test_pages_without_text(page):
    assert main_text(page).replace("\x00", "").strip("<") == ""


def test_truncated_page_and_plain_text():
    assert main_text("<article><p>One, two. Three &amp four &am") == "One, two. Three & four &am"
    assert main_text("just text") == "just text"
    assert main_text("<div>" * 3000 + "<p>deep, text.</p>") == "deep, text."
    assert main_text("<p>" + "x <b>y " * 30_000).startswith("x y x y")


def test_articles_of_the_table(spark, small):
    rows = extract(spark.read.parquet(f"{small}/pages.parquet")).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        assert r.n_chars == len(r.text) > 0 and "href" not in r.text and "©" not in r.text
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert all(line.split()[0].replace("&", "&amp;") in article for line in r.text.split("\n"))


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a, b.</p>", "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" + "word, " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.n_chars) for r in extract(pages).collect() if r.url)
    assert got == [(0, "u", 5), (2, "u", 0), (2, "u", 0), (3, "u", 299_999)]
    assert [r.text for r in extract(pages).where("url is null").collect()] == [""]
    assert extract(pages.limit(0)).count() == 0


PROSE = [f"Paragraph {k} of the article, with commas, clauses and a full stop, runs on for a good while so that it counts as text." for k in range(5)]


@pytest.mark.parametrize("opening, closing", [('<div class="content has-sidebar">', "</div>"), ('<body class="comments-open"><article>', "</article></body>"), ('<article class="post comment-status-open">', "</article>"),
                                              ('<div id="page-header-fixed">', "</div>"), ('<div class="search-result">', "</div>")])
def test_names_that_only_hold_a_word_drop_no_article(opening, closing):
    page = f"<html><nav>Home About</nav>{opening}{''.join(f'<p>{p}</p>' for p in PROSE)}{closing}<div class='sidebar'>Links here</div></html>"
    assert main_text(page) == "\n".join(PROSE)


def test_whole_names_and_small_parts_still_go():
    page = f"<main>{''.join(f'<p>{p}</p>' for p in PROSE)}<div class='comments'><p>{PROSE[0]} I agree.</p></div><div class='article-sidebar'><p>Read this too, and that, and more.</p></div></main>"
    assert main_text(page) == "\n".join(PROSE)

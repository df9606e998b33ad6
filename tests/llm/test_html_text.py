import html
import re

from brute import SMALL

from usagelens.llm.html_text import extract_text, main_text
from usagelens.llm.queries import op3_html_extraction


def plain(page):
    """The article of the test pages, read off their fixed frame."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not body:
        return ""
    parts = re.split(r"</?(?:p|h1)>", body[1])
    lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_whole_table_equals_its_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op3_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "A sentence, long enough to count, with commas, goes on for a while and then some more words follow it. "


def test_containers_without_an_article():
    page = f"""<html><head><title>T</title></head><body class="has-sidebar"><div id="header">Site</div>
    <div class="sidebar"><p>{LONG * 3}</p></div><div class="content"><h2>Head &amp; more</h2><p>{LONG}<p>Second
    paragraph &#8212; {LONG}<ul><li>one<li>two</ul><div class="cookie-notice">We use cookies</div>
    <form><p>{LONG}</p></form><table><tr><td>cell</table></div>
    <div class="links"><a href="/x">{LONG * 4}</a></div><div class="comments"><p>{LONG * 5}</p></div><!-- x </body>"""
    flat = LONG.strip()
    assert main_text(page).split("\n") == ["Head & more", flat, f"Second paragraph — {flat}", "one", "two", "cell"]


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<p></p><script>x") == ""
    assert main_text("just < text &lt; here") == "just < text < here"
    assert main_text("<article><p>a<p>b</article>") == "a\nb"
    assert main_text("<main><header><h1>Title</h1></header><p>x</p></main>") == "Title\nx"
    assert main_text("<p>" * 20_000 + "deep") == "deep"
    assert main_text("<div>" * 5_000 + "<p>deep</p>") == "deep"


def test_odd_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (2, "u", "", "t"), (3, "u", "<p>" + "y z " * 200_000, "t"), (1, None, None, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.n_chars for r in extract_text(pages).collect()))
    assert got == [0, 0, 0, 1, 799_999]
    assert extract_text(pages.limit(0)).count() == 0


def test_siblings_of_whatever_length_without_an_article():
    flat = LONG.strip()
    page = f"""<body><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>bare <b>text</b>, short
    <div><p>Short section.</p></div><a href="/a">one link</a> <a href="/b">another link</a><div><a href="/c">{LONG}</a> more</div></body>"""
    assert main_text(page).split("\n") == ["Title", flat, flat, flat, "bare text, short", "Short section."]
    assert main_text(f"<body><h2><a href='/t'>Title</a></h2><div><div><p>{LONG}</p><p>{LONG}</p></div></div></body>").split("\n") == ["Title", flat, flat]


def test_scores_decide_within_and_across_articles():
    flat = LONG.strip()
    links = f"<ul><li><a href='/x'>{LONG}</a></li><li><a href='/y'>{LONG}</a></li></ul>"
    one, two = f"<article><h2>One</h2><p>{LONG}</p>{links}</article>", f"<article><h2>Two</h2><p>{LONG}</p><p>{LONG}</p></article>"
    want = ["One", flat, "Two", flat, flat]
    assert main_text(f"<body>{one}{two}{links}</body>").split("\n") == want
    assert main_text(f"<main><div>{one}</div><div>{two}</div></main>").split("\n") == want
    assert main_text("<article>a</article><article>b</article>") == "a\nb"
    assert main_text(f"<article><p>{LONG}</p><p>Source: <a href='/s'>{LONG}</a></p></article>").split("\n") == [flat, f"Source: {flat}"]


def test_notices_and_reader_comments_beside_the_article():
    flat = LONG.strip()
    article = f"<article><h1>T</h1><p>{LONG}</p></article>"
    for name in ("copyright", "legal", "gdpr", "tagline", "site-header", "cookie-notice", "share-buttons", "related posts", "Legal-Info", "comment-list"):
        for inner in ("Some words that say little", f"<p>{LONG * 3}</p>"):
            assert main_text(f"<body>{article}<div class='{name}'>{inner}</div></body>").split("\n") == ["T", flat], name
    assert main_text(f"<body>{article}<section id='discussion'><div><p>{LONG * 9}</p></div></section></body>").split("\n") == ["T", flat]
    assert main_text(f"<body>{article}<div>All rights of an unnamed notice</div><p>© 2024 Someone, somewhere</p></body>").split("\n") == ["T", flat]


def test_names_do_not_cut_the_article():
    flat = LONG.strip()
    page = f"""<article><p>{LONG}</p><p class="share-price">Price</p><div class="related-work"><p>{LONG}</p></div><section id="discussion"><h2>Discussion</h2>
    <p>{LONG}</p></section><p>Ask <label>your doctor</label> first</p><p class="notice">Noticed</p><div class="ad-slot">Buy now</div><div class="comments"><p>{LONG}</p></div></article>"""
    assert main_text(page).split("\n") == [flat, "Price", flat, "Discussion", flat, "Ask your doctor first", "Noticed"]


def test_cited_links_stay_and_link_boxes_go():
    flat = LONG.strip()
    cited = "<ul><li><a href='/a'>First source, cited</a></li><li><a href='/b'>Second source</a></li></ul>"
    both = ["First source, cited", "Second source"]
    assert main_text(f"<article><p>{LONG}</p>{cited}<p>{LONG}</p></article>").split("\n") == [flat, *both, flat]
    assert main_text(f"<article><p>{LONG}</p><p>These are:</p>{cited}</article>").split("\n") == [flat, "These are:", *both]
    assert main_text(f"<article><p>{LONG}</p><h2>References</h2>{cited}</article>").split("\n") == [flat, "References", *both]
    assert main_text(f"<article><p>{LONG}</p>{cited}</article>").split("\n") == [flat]
    assert main_text(f"<article><p>{LONG}</p><div>{cited}</div><p>{LONG}</p></article>").split("\n") == [flat, flat]


def test_parts_of_one_story_in_several_wrappers():
    flat = LONG.strip()
    part = lambda n, name="part": f"<div class='{name}'><div class='text'><p>{n} {LONG}</p><p>{LONG}</p></div></div>"
    page = f"<body><h1>T</h1>{part(1)}<div class='ad'><p>{LONG}</p></div>{part(2)}<div><ul><li><a href='/x'>{LONG}</a></li></ul></div>{part(3)}</body>"
    assert main_text(page).split("\n") == ["T", *[x for n in (1, 2, 3) for x in (f"{n} {flat}", flat)]]


#: Pages without an article element, and the text that a reader would take from them.
LABELLED = [
    (f"<body><div id=nav><a href=/>Home</a> <a href=/n>News</a></div><div id=content><h1>Rain</h1><p>{LONG}</p><p>{LONG}</p></div><div id=footer>Imprint</div></body>", ["Rain", 1, 1]),
    (f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table></body>", [1, 1]),
    (f"<body><div class=post><h2>Post</h2><p>{LONG}</p><blockquote>Quoted, said they.</blockquote><pre>a  b</pre><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div></body>",
     ["Post", 1, "Quoted, said they.", "a b", 1]),
    (f"<body><p>{LONG}</p><p>{LONG}</p><ul><li><a href=/a>Other story</a></li><li><a href=/b>One more story</a></li></ul></body>", [1, 1]),
    (f"<body><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG}</p></section><section class=related><p>{LONG}</p></section></body>", ["One", 1, "Two", 1]),
    (f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short end.</p></div></div><form><p>{LONG * 4}</p></form></body>", [1, 1, "Short end."]),
    (f"<body><div class=wrap><header><h1>Site</h1></header><div class=text>{LONG}<br>{LONG}</div></div></body>", [2]),
    (f"<body><dl><dt>Term</dt><dd>{LONG}</dd><dt>Other</dt><dd>{LONG}</dd></dl><div role=navigation>{LONG}</div></body>", ["Term", 1, "Other", 1]),
    (f"<body><div hidden><p>{LONG * 3}</p></div><div><p>{LONG}</p><div class=newsletter><p>Subscribe, please, to get more of this.</p></div><p>{LONG}</p></div></body>", [1, 1]),
    ("<body><div>Too short for points</div></body>", ["Too short for points"]),
]


def test_labelled_pages_without_an_article():
    flat = LONG.strip()
    for page, want in LABELLED:
        lines = [x if isinstance(x, str) else " ".join([flat] * x) for x in want]
        assert main_text(page).split("\n") == lines, page


def test_whole_table_without_article_elements(spark):
    """The table's pages with a plain div in the article's place give the same text by their scores alone."""
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    plainer = [re.sub(r"<(/?)article>", r"<\1div>", p or "") for p in pages]
    same = sum(main_text(a) == main_text(b) for a, b in zip(pages, plainer, strict=True))
    print("pages with the same text without their article element", same, "of", len(pages))
    assert same == len(pages)

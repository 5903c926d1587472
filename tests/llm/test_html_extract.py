import html
import re

from quillspark.llm.html_extract import Page, host_paths, main_text, op4_html_extraction, page_text, page_votes

ARTICLE = "".join(f"<p>Paragraph {k} of the article, with enough words to count as text.</p>" for k in range(4))
BODY = "\n".join(f"Paragraph {k} of the article, with enough words to count as text." for k in range(4))


def test_leaves_out_what_is_not_the_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body class="page sidebar-left">
    <header id=top><a href=/>Site</a><h2>Site name</h2></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies, please accept them all now.</div>
    <main><article class="post-12"><header><h1>Title &amp; more</h1><p>by someone</p></header>{ARTICLE}<form><label>Mail</label><input></form>
    <div class=ad>Buy this now, buy this now, buy this now.</div><aside>Related: other things</aside><!-- <p>gone</p> --><noscript>no script</noscript></article>
    <section id="comments"><p>{'A very long reader comment. ' * 40}</p></section></main>
    <div class="sidebar"><p>{'Sidebar text that is long. ' * 20}</p></div><footer>&copy; Site</footer></body></html>"""
    assert page_text(page, None) == "Title & more\n" + BODY
    path = page_votes(page)[0][0]
    assert path == "/body.page.sidebar-left/main/article.post-#"
    assert page_text(page, path) == "Title & more\n" + BODY


def test_white_space_references_and_broken_markup():
    page = "<body><div><p>a\n\t b&nbsp;&nbsp;c<br>d <b>e<p>f &lt;g&gt; &#233; &#x1F600;</div></span></p>tail <i>of</i> it"
    assert Page(page).text_below(1) == "a b c d e\nf <g> é 😀\ntail of it"
    assert page_text("<article><p>x < y and a<b></article>", None).startswith("x < y and a")
    assert page_text("<article><p>open <script>never closed", None) == "open"
    assert page_text("just text", None) == "just text" and page_text("", None) == "" and page_text("<p></p>", None) == ""
    assert page_text("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", None) == "one\ntwo\nx\ny"
    assert page_text("<article hidden><p>no</p></article><article><p>yes</p></article>", None) == "yes"


def test_consensus_helps_pages_that_look_unlike(spark):
    usual = "<body><div class='main col-{}'>" + ARTICLE + "</div><div class=extra><p>Short.</p></div></body>"
    odd = "<body><div class='main col-9'><p>Brief news.</p></div><div class=extra><p>" + "A long box of other things. " * 30 + "</p></div></body>"
    rows = [(k, f"https://www.Site.example/{k}", usual.format(k)) for k in range(5)] + [(9, "http://www.site.example:80/x", odd)]
    rows += [(20, None, usual.format(1)), (21, "nonsense", None), (21, "nonsense", None), (None, "http://b.example/", "")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, path string, text string")
    assert {r.host: r.path for r in host_paths(pages).collect()}["www.site.example"] == "/body/div.col-#.main"
    got = [tuple(r) for r in main_text(pages).collect()]
    assert (9, "http://www.site.example:80/x", "Brief news.", 11) in got
    assert sum(r[2] == BODY for r in got) == 6 and got.count((21, "nonsense", "", 0)) == 2 and (None, "http://b.example/", "", 0) in got
    assert main_text(pages.limit(0)).count() == 0


def test_very_long_page():
    page = "<body><article>" + "<p>word word.</p>" * 30_000 + "</article>" + "<div>" * 3000
    assert page_text(page, None).count("\n") == 29_999


def test_op4_equals_the_articles(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in op4_html_extraction(spark, small).collect():
        article = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_title_and_second_part_beside_the_largest_container_stay():
    teaser = "<div class=more><p><a href=x>Another text of this site</a></p></div>"
    inner = f"<h1>Title</h1><p>Lead.</p><div class=entry-content>{ARTICLE}</div><div class=part><p>Second part.</p></div>{teaser}"
    want = "Title\nLead.\n" + BODY + "\nSecond part."
    for page in (f"<body><article class=post>{inner}</article><div><p>Other.</p></div></body>", f"<body><main>{inner}</main></body>",
                 f"<body><div class=post>{inner}</div></body>", f"<body><main><h1>Title</h1><article><p>Lead.</p>{inner[inner.index('<div'):]}</article></main></body>"):
        path = next(p for p in Page(page).paths if p.endswith("entry-content"))
        assert page_text(page, path) == want and page_text(page, None) == want
    listed = f"<body><main><article><p>One.</p></article><article><div class=text>{ARTICLE}</div></article></main></body>"
    assert page_text(listed, None) == BODY

import re
from html import unescape

from linklens.llm.html_extract import main_text, op7_html_extract

PAGES = "page_id long, url string, html string"
LONG = "Some words that go on, and on, for a while so that the paragraph counts as text."


def test_article_without_boilerplate():
    html = f"""<html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
    <body><header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div id="cookie-notice">We use cookies, {LONG}</div><div class="ad">Buy, {LONG}</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>First<br>line,
      of   text.<br><p>Second &lt;b&gt; &eacute;</p><p>x</p><ul><li>one<li>two</ul>
      <form><p>{LONG}</p><input value="q"></form><aside>{LONG}</aside>
      <table><tr><td>a<td>b</table><blockquote>Quote</blockquote>tail <span class="share">Share</span>
      <div class="comments"><p>{LONG}</p></div></article>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; {LONG}</footer></body></html>"""
    assert main_text(html).split("\n\n") == [
        "Head & line", "First line, of text.", "Second <b> é", "x", "one", "two", "a", "b", "Quote", "tail"]


def test_container_without_article_element():
    menu = "".join(f"<li><a href=/{i}>entry number {i}, long enough</a></li>" for i in range(30))
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(5))
    html = f"<body><div><ul>{menu}</ul></div><div class='content-with-sidebar'><h1>T</h1>{body}</div></body>"
    assert main_text(html).split("\n\n") == ["T"] + [f"{LONG} {i}" for i in range(5)]
    sib = f"<body><div id=a>{body}</div><p>{LONG} end</p><div><a href=x>{LONG}</a></div></body>"
    assert main_text(sib).split("\n\n")[-1] == f"{LONG} end"


def test_text_outside_the_best_container():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(5))
    texts = [f"{LONG} {i}" for i in range(5)]
    menu = "<div><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div>"
    html = f"""<body>{menu}<h1>Title</h1><div>A short lead</div><div class=content>{body}</div><pre>x = 1</pre>
        <blockquote>Quote</blockquote><ul><li>one<li>two</ul>{menu}<div class=sidebar>Side</div>bare
        <footer>Foot</footer></body>"""
    assert main_text(html).split("\n\n") == [
        "Title", "A short lead", *texts, "x = 1", "Quote", "one", "two", "bare"]
    part = f"<section><div><h2>Part</h2>{body}<ul><li><a href=x>Source</a></ul></div></section>"
    assert main_text(f"<body>{menu}<div>{part}{part}</div>{menu}</body>").split("\n\n") == 2 * [
        "Part", *texts, "Source"]
    assert main_text(f"<body><h1>Site</h1><article>{body}</article></body>").split("\n\n") == texts


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article><p>cut of") == "cut of"
    assert main_text("<article><p>a</p><p cla") == "a"
    assert main_text("<article><p>a &#x41; &unknown; &amp;amp; < 5</p><!-- x") == "a A &unknown; &amp; < 5"
    assert main_text("<script>never closed <p>x</p>") == ""
    assert main_text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"
    assert len(main_text("<article>" + "<p>word " * 200_000)) > 1_000_000


def test_given_pages_equal_their_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in op7_html_extract(pages).collect()}
    for r in pages.collect():
        art = (r["html"] or "").partition("<article>")[2].partition("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"<br>|</?b>", " ", p)).split())
                 for p in re.split(r"</?(?:p|h1)>", art)]
        want = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_table_cases(spark):
    rows = [(1, None, None), (None, "u", "<p>a"), (1, None, None), (2, "u", "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in op7_html_extract(df).collect()) == [
        (0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert op7_html_extract(spark.createDataFrame([], PAGES)).count() == 0

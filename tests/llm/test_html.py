import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html

PROSE = "A first paragraph, with commas, and quite a lot of text to be read by someone."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("plain &lt;b&gt; text", "plain <b> text"),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T&eacute;te</h1><p>{PROSE}<p>Second&nbsp;one\n  spans <b>bold</b>lines.</article><footer>Foot, foot, foot, and foot again, at length.</footer>", f"Téte\n{PROSE}\nSecond one spans boldlines."),
        (f"<body class='has-sidebar'><div class=content><h2>Title</h2><div><p>{PROSE}</p><p>{PROSE}</p></div></div><div id=comments><p>{PROSE * 4}</p></div><div class=cookie-notice>{PROSE}</div>", f"Title\n{PROSE}\n{PROSE}"),
        ("<main><form><p>x, y</p></form><p>a<br>b</p><pre> x\n y </pre><aside>no</aside></main>", "a b\nx y"),
        ("<article><h1>T</h1><p>cut off in the mid", "T\ncut off in the mid"),
        ("<article><p>whole</p><p class='a", "whole"),
        ("<article><p>one<script>var a = '</p><p>no</p>';</script> two</p><style>p{}</style></article>", "one two"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><p><b>one<br><p>two</b></p></article>", "one\ntwo"),
        ("<article><p>a &amp &#x41; &am</p></article>", "a & A &am"),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


def test_deep_and_long_pages():
    assert html.extract("<div>" * 20_000 + PROSE + "</div>" * 20_000) == PROSE
    assert html.extract("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>") == "\n".join([PROSE] * 5000)


def test_query(spark, table, sf):
    rows = html.op7_html(spark, sf).collect()
    assert len(rows) == table("pages").count()
    assert all(r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "&copy;" not in r["text"] for r in rows)


def test_null_columns(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(r["t"] for r in df.select(html.main_text("html").alias("t")).na.fill("").collect()) == ["", "x"]


@pytest.mark.parametrize("mark", ["class='content has-sidebar'", "id='header-and-content'", "class='layout has-sidebar'", "class='toc-page with-share'"])
def test_marked_wrappers_keep_the_page(mark):
    inner = f"<h2>Title</h2><p>{PROSE}</p><p>{PROSE}</p>"
    rest = f"<div class=sidebar><p>{PROSE[:40]}</p></div>"
    assert html.extract(f"<body><div id=menu><a href=x>Menu</a></div><div {mark}>{inner}</div><div class=footer><p>Foot</p></div></body>") == f"Title\n{PROSE}\n{PROSE}"
    assert html.extract(f"<body><div {mark}><div>{inner}</div>{rest}</div></body>") == f"Title\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("mark", ["class=post-comments", "class=comments", "class=page-header"])
def test_marked_parts_are_dropped(mark):
    assert html.extract(f"<body><div><p>{PROSE}</p><p>{PROSE}</p></div><div {mark}><p>{PROSE}</p></div></body>") == f"{PROSE}\n{PROSE}"


#: Pages whose main text is marked by hand: what stands between the two signs, of each block.
MARKED = [
    # A blog: wrappers named after what they stand beside, comments in articles, teasers in an aside.
    f"""<body class="single has-sidebar"><div id="page" class="site no-ads"><header class="site-header"><a href=/>Home</a><p>Slogan of the site, quite long, with commas, and more.</p></header>
    <div class="layout with-sidebar"><main><article class="post hentry comments-open"><h1>«Title»</h1><p>«{PROSE}»</p><ul><li>«first, point»</li><li>«second <a href=x>point</a> with more words»</li></ul><p>«{PROSE}»</p>
    <div class="share-buttons"><a href=a>Share</a></div></article><section class="comments"><article class="comment-body"><p>{PROSE} {PROSE}</p></article><article class="comment"><p>{PROSE}</p></article></section></main>
    <aside class="related"><article><h3>Another</h3><p>{PROSE}</p></article></aside></div><footer><p>{PROSE}</p></footer></div></body>""",
    # Tables for layout, no article, a form around everything.
    f"""<body><form action=x><table><tr><td><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></td><td><h2>«Heading»</h2><p>«{PROSE * 2}»</p><p>«{PROSE} {PROSE}»</p><blockquote>«A quote»</blockquote></td></tr></table><input value=x></form></body>""",
    # Prose in divs, an advert and a notice between them, an unclassed menu.
    f"""<div id=wrap><ul><li><a href=a>News</a><li><a href=b>Sport</a></ul><div id=story><div>«{PROSE}»</div><div class=ad-box>{PROSE}</div><div>«{PROSE}»</div><div class="cookie notice">We use cookies, many, and partners, too.</div><h3>«Middle»</h3><div>«{PROSE}»</div></div></div>""",
    # A short article beside a longer comment section.
    f"""<main><article><h1>«News»</h1><p>«{PROSE}»</p></article><div id=disqus_thread><p>{PROSE * 3}</p><p>{PROSE * 3}</p></div></main>""",
    # The article's wrapper is named after a part of it.
    f"""<div class="header-and-content"><h1>«T»</h1><p>«{PROSE}»</p><p>«{PROSE}»</p><div class=newsletter><p>Sign up, it is free, and weekly.</p></div></div><div class=footer><p>{PROSE}</p></div>""",
]


@pytest.mark.parametrize("page", MARKED)
def test_pages_marked_by_hand(page):
    expected = "\n".join(" ".join(re.sub(r"<[^>]*>", "", m).split()) for m in re.findall("«(.*?)»", page, re.DOTALL))
    assert html.extract(page.replace("«", "").replace("»", "")) == expected


@pytest.mark.parametrize(
    "names, bad",
    [("has-sidebar", False), ("no-share", False), ("post comments-open", False), ("sidebar-left", True), ("page-header", True), ("related posts", True), ("content", False), ("with_ads main", False), ("toc", True), ("adserver", False)],
)
def test_names(names, bad):
    assert html.marks_of(names)[0] is bad


def test_empty_repeated_and_clashing(spark, tmp_path):
    """Whole tables: none, the same page twice, null ids, and columns named like the results."""
    page = f"<article><p>{PROSE}</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2**60 + 1, "v", "<p>5 <")], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))
    df.write.parquet(str(tmp_path / "a/pages.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "b/pages.parquet"))
    rows = [tuple(r) for r in html.op7_html(spark, str(tmp_path / "a")).collect()]
    assert sorted(rows, key=str) == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2**60 + 1, "v", "5 <", 3)], key=str)
    assert html.op7_html(spark, str(tmp_path / "b")).collect() == []

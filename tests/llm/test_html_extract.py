import html
import re

from tracewell.llm.html_extract import extract, main_text


def test_article_of_every_page(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(d).collect()}
    for p in d.collect():
        a, z = p.html.find("<article>"), p.html.find("</article>")
        z = z if z >= 0 else p.html.find("<footer") if "<footer" in p.html else len(p.html)
        want = re.sub(r"\s+", "", html.unescape(re.sub(r"<[^>]*>", "", p.html[a:z])))
        assert re.sub(r"\s+", "", got[p.page_id].text) == want
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_without_semantic_elements():
    page = '<body><div id="menu"><a href=x>Home</a></div><div class="content"><h2>Tit&eacute;</h2><p>Hello,  <b>wor</b>ld. This is long, with marks.<p>x</div><div class="comments"><p>Nice post, I like it very much indeed.</div><div class="links"><a href=1>a link here</a></div></body>'
    assert main_text(page) == "Tité\nHello, world. This is long, with marks.\nx"


def test_small_containers_inside_content_stay():
    long = "".join(f"<p>{'Some words, of a text. ' * 20}{i}</p>" for i in range(10))
    inner = "<section><h2>Note</h2>One short sentence.</section><table><tr><td>a cell</td><td><a href=x>linked</a></td></tr></table>"
    for page in (f'<body><div class="text">{long}{inner}</div><div class="links"><a href=1>elsewhere</a></div></body>', f"<article>{long}{inner}</article>"):
        got = main_text(page).split("\n")
        assert len(got) == 14 and got[10:] == ["Note", "One short sentence.", "a cell", "linked"]


def test_what_goes():
    inside = "<article><h1>T</h1><p>Text one, two.</p><aside>side</aside><form>f</form><script>s</script><style>c</style><!-- n --><div class='ad'>a</div><p>End.</p></article>"
    assert main_text(f"<header>h</header>{inside}<footer>f</footer><div class=comments>c, c. c</div>") == "T\nText one, two.\nEnd."


def test_text_beside_an_article_is_kept_whole():
    assert main_text("<article><p>a &lt;b&gt; &amp; c&nbsp;d</p><p>\n e\t f </p></article>") == "a <b> & c d\ne f"


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "plain text, no tags."), (4, "u", "plain text, no tags."), (None, "u", "<article>cut off <p>here"), (5, "u", "<div>" * 3000 + "deep, text." + "</div>" * 3000)]
    d = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in extract(d).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, ""), (4, "plain text, no tags."), (4, "plain text, no tags."), (None, "cut off\nhere"), (5, "deep, text.")], key=str)
    assert extract(d.limit(0)).count() == 0


PROSE = "<p>Text one, two and three; it goes on. And on, with words.</p>" * 6


def test_names_alone_decide_nothing():
    for page in (
        f'<div class="elementor-widget"><h1>T</h1>{PROSE}</div>',
        f"<form action=x><h1>T</h1>{PROSE}<input></form>",
        f'<div title="the hidden truth"><h1>T</h1>{PROSE}</div>',
        f'<article><div class="entry-header"><h1>T</h1></div>{PROSE}</article>',
        f'<body class="has-sidebar"><div class="no-comments"><h1>T</h1>{PROSE}</div></body>',
    ):
        assert len(main_text(page).split("\n")) == 7, page
    assert main_text(f'<article>{PROSE}<section class="related-work"><h2>R</h2>{PROSE}</section></article>').count("\n") == 12


def test_longer_names_that_hold_a_word_of_boilerplate():
    """Ten equal paragraphs of an article, six or three of them in a section of such a name."""
    p = "<p>Text one, two and three; it goes on. And on, with words.</p>"
    for name in ("promotion-guide", "notice-period", "menu-recipes", "comment-letter", "banner-history", "respond-section", "copyright-law", "subscribe-model"):
        for n in (6,) if name == "respond-section" else (6, 3):  # a place for replies if it is small
            page = f'<body><nav><a href=x>Home</a></nav><article>{p * (10 - n)}<section class="{name}">{p * n}</section></article><footer>f</footer></body>'
            assert main_text(page).count("Text one") == 10, (name, n)
    for name in ("ad", "ads-box", "advert_3", "comments", "comment-list", "cookie-notice", "newsletter-signup"):
        assert main_text(f'<article>{p * 9}<div class="{name}"><p>Something else, of a line.</p></div></article>').count("\n") == 8, name


def test_text_of_elements_that_seldom_hold_any():
    kept = f"<article>{PROSE}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p><label>A label</label> here</p><noscript><p>Shown without scripts.</p></noscript></article>"
    assert main_text(f"<body><noscript>Please allow scripts.</noscript>{kept}</body>").split("\n")[6:] == ["Let x=2 be.", "A label here", "Shown without scripts."]
    assert main_text(f"<article>{PROSE}<form><label>Mail</label><input></form></article>").count("\n") == 5


def test_ratios_decide_without_article_or_names():
    links = "".join(f"<div><a href=/{i}>Some other page, number {i}</a></div>" for i in range(30))
    page = f"<body><div>{links}</div><div><div><h1>T</h1>{PROSE}</div></div><div>short line</div></body>"
    assert main_text(page) == "\n".join(["T"] + ["Text one, two and three; it goes on. And on, with words."] * 6)
    beside = f"<body><div><p>{'A lead, in its own place; long enough. ' * 4}</p></div><div>{PROSE}{PROSE}</div></body>"
    assert main_text(beside).startswith("A lead, ") and main_text(beside).count("\n") == 12
    assert main_text(f"<body><p>{'Direct text, of the body. ' * 6}</p><div>{PROSE}</div></body>").count("\n") == 6


def test_pages_of_the_table_without_their_article(spark):
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert main_text(p.html.replace("article>", "div>")) == main_text(p.html)


def test_long_and_deep_pages_take_seconds():
    import time

    began = time.monotonic()
    for page in ("<div>" * 100_000 + "a", "<b>" * 100_000 + "a", "<svg/>" * 100_000 + "a", "<p><b>" * 50_000 + "a", "</x>" * 100_000 + "a", '<a ="' * 100_001 + ">a", "<p>a, b.</p>" * 100_000):
        assert main_text(page)[:1] in ("a", "")
    assert main_text("<div>x, y" * 100_000).count("\n") > 20_000
    assert time.monotonic() - began < 60

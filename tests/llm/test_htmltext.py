"""Main text of pages, and templates counted per host."""

import pytest

from tracemill.llm import htmltext

FRAME = '<html><head><title>T</title><style>p{{}}</style></head><body><div id="top"><p>Welcome to the site</p></div>{body}<footer>&copy; x</footer></body></html>'


def text_of(page):
    return htmltext.main_text(page, set())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>A</h1><p>one\n two<p>three&nbsp;four</article>", "A\none two\nthree four"),
        ("<article><p><b>x<br><p>y</p></article>", "x\ny"),
        ("<body><nav><a>m</a></nav><p>t</p><form>f</form><script>if (a<b) {'</p>'}</script><aside>s</aside></body>", "t"),
        ('<article><p>a</p><div class="ad box">no</div><section id="comments"><p>c</p></section><p>b</p></article>', "a\nb"),
        ("<main><p>a</p></main><p>b</p>", "a"),
        ('<div class="cookie-notice">c</div><p>kept <i>all</i> of<i>it</i></p>', "kept all ofit"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table></article>", "a\nb\nc d"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut <b", "cut"),
        ("<article><p>cut &amp", "cut &"),
        ("<article><!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
        ("<article><p title=\"a>b\">q</p><p style='display:none'>h</p></article>", "q"),
        ('<article class="teaser"><p>s</p></article><article><p>a longer one</p></article>', "a longer one"),
        ('<article><header><h1>Head</h1></header><p>t</p><footer>f</footer></article>', "Head\nt"),
        ("&#65;&#x42;&eacute;<br>c", "ABé c"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content-sidebar-wrap'><article><p>a story</p></article></div><div class='sidebar'>s</div>", "a story"),
        ("<div id='page' class='with-sidebar'><p>a story without article</p></div><div class='menu'>m</div>", "a story without article"),
        ("<article class='post comments-open'><p>a story</p><div class='share-box'>x</div></article><article><p>b</p></article>", "a story"),
        ("<div class='no-sidebar'><main><p>a</p></main></div>", "a"),
        ("<div class='widget'><div itemprop='articleBody'>a</div><p>outside</p></div>", "a"),
        ("<article><div class='social-wrap'><p>all of the story</p></div><p>end</p></article>", "all of the story\nend"),
        ("<article><p>short</p><section id='comments'><p>a much longer comment on it</p></section></article>", "short"),
        ("<main><p>post</p><ol id='comments'><li><article class='comment'>a longer comment</article></ol></main>", "post"),
        ("<article><p>post</p></article><div id='comments' class='comments-area'><article class='comment-body'>a longer comment</article></div>", "post"),
        ("<article><div class='content-sidebar-wrap'><p>story</p></div></article><div>a long list of other things</div>", "story"),
        ("<div class='site-nav-wrap'><article><p>post</p><div id='comments'>a longer comment</div></article></div>", "post"),
        ("<div class='side-widget'><main>a story</main></div><article>teaser</article>", "a story"),
        ("<article><p>post</p><div class='related'><a>other</a> <a>stories of ours</a></div></article>", "post"),
        ("<article><p>story</p><div class='share-price-table'><table><tr><td>1</td></tr></table></div><div class='share-box'><p>x</p></div></article>", "story\n1"),
        ("<article><p>a story</p><div class='social-distancing'><p>rules</p></div><div class='related-posts-2'><p>x</p></div></article>", "a story\nrules"),
        ("<article><p>a story</p><div class='price comments'><p>x</p></div><div class='ad-price'><a>x</a></div></article>", "a story"),
        ("<nav>much text in the menu of this page</nav><div class='has-widget'><p>story</p></div><div class='ad'>ad</div>", "story"),
    ],
)
def test_layout_words_do_not_remove_the_article(page, text):
    assert text_of(page) == text


def test_recurring_subtrees_go_and_passages_stay(spark):
    shared = "<p>A passage that many articles share.</p>"
    pages = []
    for i in range(30):
        box = '<div class="k7"><p>Read our other stories</p></div>'
        pages.append((i, f"http://a.example/{i}", FRAME.format(body=f"<div><article><p>Story number {i} with a text of its own.</p>{shared}{box}</article></div>")))
    for i in range(30, 60):
        pages.append((i, f"https://b.example:80/{i}", FRAME.format(body="<div><p>The same story under every address.</p><p>Again.</p></div>")))
    for i in range(60, 80):
        pages.append((i, f"http://c.example/{i}", FRAME.format(body=f"<div><p>Page {i} has no article element but much text of its own.</p></div>")))
    pages += [(80, None, None), (81, "no url", "<p>x</p>"), (82, "http://d.example/1", FRAME.format(body="<p>Alone on its host</p>")), pages[0]]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS subtree")
    got = {r["page_id"]: r for r in htmltext.extract(table).collect()}
    assert htmltext.extract(table).count() == len(pages)
    assert got[3]["text"] == "Story number 3 with a text of its own.\nA passage that many articles share."
    assert got[40]["text"].endswith("The same story under every address.\nAgain.")
    assert got[60]["text"] == "Page 60 has no article element but much text of its own."
    assert got[80]["text"] == "" and got[80]["n_chars"] == 0 and got[81]["text"] == "x"
    assert got[82]["text"] == "Welcome to the site\nAlone on its host"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_pages_without_article_keep_shared_passages_and_copies(spark):
    shared = "<p>A passage that all of these stories quote, word by word.</p>"
    body = '<div id="menu2"><p>Our pages</p></div><div class="c">{}</div><div class="f1">Seen {} times</div>'
    story = '<p>The one story of this host.</p><div class="k"><p>Its second part.</p></div><p>Its end.</p>'
    pages = [(i, f"http://a.example/{i}", FRAME.format(body=body.format(f"<p>Story {i}, with a text that is its own.</p>{shared}", i))) for i in range(10)]
    pages += [(i, f"http://b.example/{i}", FRAME.format(body=body.format(story, i))) for i in range(10, 20)]
    flat = "<h1>One</h1><p>The story stands in the body.</p><p>It goes on.</p><div class='f1'>Seen {} times</div>"
    pages += [(i, f"http://c.example/{i}", f"<body>{flat.format(i)}</body>") for i in range(20, 30)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == f"Story {i}, with a text that is its own.\nA passage that all of these stories quote, word by word.\nSeen {i} times"
    for i in range(10, 20):
        assert "The one story of this host.\nIts second part.\nIts end." in got[i]
    for i in range(20, 30):
        assert got[i].startswith("One\nThe story stands in the body.\nIt goes on.")


def test_templates_of_small_hosts(spark):
    """On a host of few articles a subtree on half of them, at least three, is a template."""
    notice = '<div class="k7"><p>Read our other stories</p></div>'
    page = "<article><p>Story {} with a text that is long and its own.</p>{}</article>"
    noticed = {"a": (4, 4), "b": (2, 2), "c": (9, 4), "d": (6, 3)}  # articles of the host, and how many show the notice
    rows = [(100 * n + i, f"http://{h}.example/{i}", page.format(i, notice if i < shown else "")) for n, (h, (count, shown)) in enumerate(noticed.items()) for i in range(count)]
    rows += [(1000 + i, f"http://e.example/{i}", page.format(1, notice)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    with_notice = {i for i, text in got.items() if "Read our" in text}
    assert with_notice == {100, 101, 200, 201, 202, 203, *range(1000, 1009)}


def test_shared_blocks_of_any_tag_stay(spark):
    """Passages in div and section blocks stay on hosts of few articles; a box with a name of its own goes."""
    quote = "A passage that the four stories of this host quote, word by word, from one another."
    shapes = [
        "<article><div>Story {0} has its own text here.</div><div>{1}</div><div class='k7'>Read more</div></article>",
        "<article><p>Story {0} has its own text here.</p><section><p>{1}</p></section><div class='k7'><p>Read more</p></div></article>",
        "<article><div class=t>Story {0} has its own text here.</div><div class=t>{1}</div><div class=t>{0} ends.</div><div class='k7'><div>Read more</div></div></article>",
        "<body><div id=c><div class=t>Story {0} has its own text here.</div><div class=t>{1}</div><div class=t>{0} ends.</div></div></body>",
    ]
    rows = [(10 * n + i, f"http://h{n}.example/{i}", shape.format(i, quote)) for n, shape in enumerate(shapes) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, text in got.items():
        n, i = divmod(page, 10)
        assert text == f"Story {i} has its own text here.\n{quote}" + (f"\n{i} ends." if n > 1 else "")


def test_parts_of_an_article_are_one_core():
    root = htmltext.parse("<body><div id=m><p>menu</p></div><div id=c><section><p>a long first part of it</p></section><section><p>part two</p></section></div></body>")
    htmltext.measure(root)
    assert htmltext.find_core(htmltext.find_article(root), root).attributes == {"id": "c"}


def test_empty_table(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_deep_and_long_pages():
    assert text_of("<div>" * 20000 + "x") == "x"
    assert text_of("<p>" + "word " * 50000) == " ".join(["word"] * 50000)
    assert text_of('<p a="' * 3000 + "x") is not None

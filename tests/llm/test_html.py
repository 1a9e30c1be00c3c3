"""Extraction of main text from small pages."""

import time
from random import Random

import pytest

from tillsight.llm import html


def page(title, *paragraphs, shared="Read our terms before you go on.", head=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body>{head}"
            f"<header>Site</header><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='cookie-notice'>Cookies!</div>"
            f"<div class=ad>Buy</div><article><h1>{title}</h1>{body}<p>{shared}</p></article><aside>Side</aside><form><input>Send</form>"
            f"<section id='comments'><p>Nice.</p></section><footer>&copy; host</footer></body></html>")


def test_one_page():
    text = " ".join(t for _, t in html.page_blocks(page("A &amp; B", "First <b>bo</b>ld&nbsp;one", "x<br>y\n z &lt;i&gt;"), None))
    assert text == "A & B First bold one x y z <i> Read our terms before you go on."


def test_without_article_and_broken_markup():
    assert [t for _, t in html.page_blocks("<div><p>one<p>two <b>three</div> a < b <!-- no --> <menu>m</menu>end", None)] == [
        "one", "two three", "a < b", "end"]
    assert html.page_blocks("", None) == []
    assert html.page_blocks("<script>never closed", None) == []
    assert [t for _, t in html.page_blocks("<div>" * 3000 + "deep", None)] in ([], ["deep"])


def _tree(slots, at=0):
    return [(key, _tree(slots, child)) for key, child in slots.children[at].items()]


def _plain_matching(one, two):
    """Simple tree matching as it is written in books: a table over all pairs of children, by recursion."""
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, (key, below) in enumerate(one):
        for j, (other, below_other) in enumerate(two):
            pair = 1 + _plain_matching(below, below_other) if key == other else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + pair)
    return best[-1][-1]


def test_matching_equals_the_plain_one():
    random = Random(7)
    for _ in range(400):
        pages = []
        for _ in range(2):
            slots = html.Slots()
            for _ in range(random.randrange(14)):
                slots.add(random.randrange(len(slots.keys)), random.choice("abcd"))
            pages.append(slots)
        size, matched = html.matching(*pages)
        assert size == _plain_matching(_tree(pages[0]), _tree(pages[1])) == len(matched) - 1
        for own, other in matched.items():
            assert pages[0].keys[own] == pages[1].keys[other]
            assert not own or matched[pages[0].parents[own]] == pages[1].parents[other]
        read = html.Slots.read(pages[0].text())
        assert (read.keys, read.parents, read.children) == (pages[0].keys, pages[0].parents, pages[0].children)


def test_template_of_a_host_is_left_out(spark):
    rows = [(k, f"http://www.a.com:80/{k}", page(f"Title {k}", f"Own text number {k}.", "More.")) for k in range(6)]
    # Copies of one page say nothing about a template.
    rows += [(10 + k, "https://copies.org/x", page("Same", "Same text.")) for k in range(5)]
    rows += [(20, None, page("T", "No host.")), (21, "http://b.com", None), (22, "http://b.com", ""), (None, "http://c.com/", page("C", "c")),
             (23, "http://long.com", page("L", "word " * 50_000)), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {}
    for r in html.extract(frame).collect():
        assert r["n_chars"] == len(r["text"])
        found.setdefault(r["page_id"], []).append(r["text"])
    for k in range(6):
        assert set(found[k]) == {f"Title {k} Own text number {k}."}
    assert len(found[0]) == 2
    assert all(found[10 + k] == ["Same Same text. Read our terms before you go on."] for k in range(5))
    assert found[20] == ["T No host. Read our terms before you go on."]
    assert found[21] == found[22] == [""] and len(found[23][0]) > 200_000
    assert found[None] == ["C c Read our terms before you go on."]
    assert html.extract(frame.limit(0)).count() == 0


def test_names_of_parts():
    body = ("<body class='has-sidebar nav-open'><div id='site-header'>Head</div><div class='wrap with-sidebar'><div class='entry-header'>Own</div>"
            "<p class='lead'>Text</p><p style='display: none'>no</p><p hidden>no</p><div class='post-comments'>no</div>"
            "<div role='complementary'>no</div><article class='comment'>no</article><div class='ad-slot'>no</div></div></body>")
    assert [t for _, t in html.page_blocks(body, None)] == ["Own", "Text"]


def test_deep_pages_keep_all_text():
    for tag in ("div", "font", "a name=x"):
        page = "<p>first</p>" + f"<{tag}>" * 3000 + "deep<p>last</p>"
        assert " ".join(t for _, t in html.page_blocks(page, None)) == "first deep last"
        assert " ".join(t for _, t in html.page_blocks(page, html.Slots.of(html.main_nodes(html.parse(page))))) == "first deep last"
    assert html.page_blocks("x" + "<div>" * 500 + "<article>own</article>", None) == [(0, "own")]


def test_elements_named_like_drawings():
    text = lambda page: " ".join(t for _, t in html.page_blocks(page, None))
    for between in ("<svg-icon></svg-icon>", "<title-bar></title-bar>", "<svg class='a>b' />", "<svg/>", "<math />", "<svg><text>no</text></svg>",
                    "<SVG width=1><path d='M0'/></SVG >", "<script>no</script>", "<math><mi>no</mi></math>"):
        assert text(f"<p>a</p>{between}<p>rest</p>") == "a rest"


def text_of(page):
    return " ".join(t for _, t in html.page_blocks(page, None))


def test_quotes_follow_the_standard():
    assert text_of("<p><a href=x'y>z</a>'s</p>") == "z's"
    assert text_of('<p title="foo>first</p><p>second</p>') == "first second"
    assert text_of("<p>a</p><p title='x>y'>b</p><img alt=\"1 > 0\"><p>c") == "a b c"
    assert text_of('<p>a</p><p title="x>b</p><p title="y">c</p>"') == 'a c "'
    # Read with its quotes the second tag has no end: from there on quotes do not count.
    assert text_of('<p>a</p><p title="x>b</p><p class="') == "a b"
    assert text_of("<p>a</p><p class=") == "a"
    assert text_of("a <!> b <!--> c <!-- > --> d </> e </3> f < g <") == "a b c d e f < g <"
    assert text_of("<p data-id='nav' data-class='ad'>kept</p><div data-id='comments'>kept</div>") == "kept kept"


@pytest.mark.parametrize("page", [
    "<a href=\"" * 110_000, "<svg \"" * 160_000, "<a b='>" * 140_000, "<p><div>" + "<font>" * 60_000 + "<h1></h1>" * 60_000,
    "<div>" * 100_000 + "</b>" * 100_000, "<svg>" * 200_000, "<!--" * 250_000, "<li>" + "<ul><li>" * 60_000, "<script>" * 120_000,
    "<div class=" + "a" * 1_000_000 + ">x", "".join(f"<i class={'ab'[k % 2] * (k % 999 + 1)}>" for k in range(2000)) + "x"])
def test_time_grows_with_the_page(page):
    start = time.perf_counter()
    html.page_blocks(page, html.Slots.of(html.main_nodes(html.parse(page))))
    assert time.perf_counter() - start < 8


def test_names_inside_the_article_do_not_remove_text():
    page = ("<article><h1>T</h1><p class='alert'>one</p><div class='text-widget'>two</div><div id='search-engines'>three</div><p class='ad'>four</p>"
            "<li class=comments>five</li><div class='share-price-table'>six</div></article>")
    assert text_of(page) == "T one two three four five six"
    assert text_of("<div class='content-sidebar'><h1>T</h1><p>own</p></div><div class='kommentare'>no</div><div class='cookie-banner'>no</div>") == "T own"
    assert text_of("<div><p>" + "main text " * 30 + "</p></div><article><p>teaser</p></article>") == "main text " * 30 + "teaser"


def test_drawings_end_at_blocks():
    assert text_of("<p>a</p><svg><path d=x><p>b</p>") == "a b"
    assert text_of("<p>a</p><svg><foreignObject><div>no</div></foreignObject></svg><p>b</p>") == "a b"


def test_grouping_is_alike_for_long_pages(spark):
    """A shared line is found in pages with one paragraph and in pages with hundreds, at any depth."""
    def shared(k):
        return ("<div>" * 60 + "<article><h1>T</h1>" + "".join(f"<p>own {k} {i}</p><h2>part {k} {i}</h2>" for i in range((k + 1) ** 3)) + "<p>shared line</p></article>")
    rows = [(k, f"http://h.org/{k}", shared(k)) for k in range(6)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r["page_id"]
        assert r["text"] == " ".join(f"own {k} {i} part {k} {i}" for i in range((k + 1) ** 3))

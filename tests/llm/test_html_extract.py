import pytest

from trolley.llm import html_extract as H

SITE = "<nav><a>Home</a></nav><div>Welcome to the site</div>{}<div>Terms of use</div><footer>f</footer>"
ROWS = [(1, "http://a.example/n/1", SITE.format("<p>First &amp; story</p>")), (2, "http://a.example/n/2", SITE.format("<p>Second\n story</p>")),
        (3, "http://b.example/x", SITE.format("<p>Alone</p>")), (4, None, "<p>No url</p>"), (5, "http://a.example/z", None), (6, "u", ""),
        (7, "http://a.example/q/1", "<article><h1>T</h1><p>Kept</article><p>out"), (8, "http://a.example/q/2", "<article><h1>T</h1><p>Kept</article>"),
        (None, "http://c.example/", "<p>x"), (1, "http://a.example/n/1", SITE.format("<p>First &amp; story</p>"))]


def test_differencing_and_markup(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'t' as text", "'l' as lines", "1 as main")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(pages).collect()), key=repr)
    text = {1: "First & story", 2: "Second story", 3: "Welcome to the site\nAlone\nTerms of use", 4: "No url", 5: "", 6: "", 7: "T\nKept\nout", 8: "T\nKept", None: "x"}
    assert got == sorted(((i, text[i], len(text[i])) for i, _, _ in ROWS), key=repr)


def test_edges_of_ranges_do_not_matter(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/d{i % 7}/p{i:03d}", SITE.format(f"<p>story {i}</p>")) for i in range(60)],
                                  "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        got = {r.page_id: r.text for r in H.extract(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: f"story {i}" for i in range(60)}


@pytest.mark.parametrize("html,lines", [
    ("<script>var a='<p>no</p>'</script><style>p{}</style>a<br>b", ["a b"]),
    ("<div class='cookie-notice'>c</div><aside>s</aside><form>f</form><p>t", ["t"]),
    ("<nav>m<article><p>x</article>", ["x"]),
    ("<article><p><b>one<br><p>two</p><div id=comments><p>c</p></div></article>", ["one", "two"]),
    ("<!-- <p>no</p> --><p title='a>b'>q &#233;&nbsp;r", ["q é r"]),
    ("a < b", ["a < b"]),
    ("<article><p>adds and sidebars</p><ul><li>1<li>2</ul></article>", ["adds and sidebars", "1", "2"]),
])
def test_lines(html, lines):
    assert [t for t, _ in H.lines_of(html)] == lines


def test_shared_lines_are_a_longest_common_subsequence():
    import random
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = H.shared_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in got)


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_marks_are_whole_words_of_real_attributes():
    lines = lambda page: [t for t, _ in H.lines_of(page)]
    for kept in ('<div class="entry comments-open"><p>kept', '<section data-id="share-results">kept', '<div class="search-engine-history">kept',
                 '<p title="the hidden gem">kept</p>', '<div class="content with-sidebar">kept', '<P ID=results>kept'):
        assert lines(f"<article>{kept}</article>") == ["kept"] == lines(kept), kept
    for gone in ('<div class="ad">x', '<div id=cookie-banner>x', '<div class="box main-nav">x', "<p hidden>x", '<p style="display: none">x',
                 '<div role="navigation">x', '<div class="comment-list">x'):
        assert lines(f"<article>{gone}</article>") == [], gone
    assert lines('<p>a > b < c <b x="<i>">d</b> <!-- no --> <ScRipt>z</i></sCript>e') == ["a > b < c d e"]


def test_hostile_pages_take_linear_time():
    import time
    t = time.time()
    for page in ("<div>" * 60_000 + "</span>" * 60_000, '<a b="x' * 60_000, "<a " * 60_000, '<a b="x' * 60_000 + ">", "<p '" * 60_000 + ">",
                 "<span><main>" + "</span>" * 60_000, "<!--" * 60_000, "<script>" * 60_000, "<" * 200_000):
        H.lines_of(page)
    assert time.time() - t < 60
    t = time.time()
    assert len(H.shared_lines([1] * 4000 + [2], [3] + [1] * 3000)) == 3000
    assert time.time() - t < 60


def test_alignment_by_halving_equals_chaining():
    import random

    import numpy as np
    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in range(2))
        x, y = H._halved(np.array(a, np.int64), np.array(b, np.int64)), H._chained(a, b)
        assert len(x) == len(y) == len(H.shared_lines(a, b)) and x == sorted(x)
        rest = iter(b)
        assert all(a[i] in rest for i in x)


def test_differencing_decides_outside_the_article(spark):
    page = "<body><p>Site slogan</p><p>Own lead {0}</p><article><p>Teaser</p></article><p>Main text {0}</p><p>All rights</p></body>"
    rows = [(i, f"http://a.org/p/{i}", page.format(i)) for i in range(4)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own lead {i}\nTeaser\nMain text {i}" for i in range(4)}

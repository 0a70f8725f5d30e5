import html
import itertools
import random
import re
import time

import pytest
from conftest import SF
from odd import plain

from topicloom.llm import html_text as ht
from topicloom.llm.registry import QUERIES


def test_query_against_the_articles(spark):
    pages = plain(spark.read.parquet(f"{SF}/pages.parquet")).set_index("page_id")
    got = plain(QUERIES["op7_html_text"](spark, SF)).set_index("page_id")
    assert len(got) == len(pages)
    for i, page in pages.html.items():
        article = re.sub("</?b>", "", re.search("<article>(.*?)</article>", page, re.S).group(1))
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", article)).split())
        assert got.text[i] == want and got.n_chars[i] == len(want) and got.url[i] == pages.url[i]


LONG = "This is the story, told at length, in sentences that nobody would put into a menu. " * 4


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<nav><a href=x>a</a></nav>", ""), ("no tags at all", "no tags at all"),
    ("<p>a &lt; b &amp; <i>c</i>d<p>x&nbsp;y &unknown; &am", "a < b & cd x y &unknown; &am"),
    (f"<body><header>Site</header><main><h1>T</h1><p>{LONG}</p><aside>side</aside></main><footer>f</footer>",
     f"T {LONG.strip()}"),
    (f"<div id=cookie-notice>We use cookies. {LONG}</div><div class=post><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><p>{LONG}</p><div class='ad-box'><p>{LONG}</p></div><p>End.</p></article>", f"{LONG.strip()} End."),
    (f"<article><p>{LONG}</p></article><section class=comments><p>{LONG}</p></section>", LONG.strip()),
    (f"<article><p>{LONG}</p><form><label>Name</label><input></form></article>", LONG.strip()),
    (f"<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p>", LONG.strip()),
    ("<article><p>one<br>two<table><tr><td>a<td>b</table><p>c</article>", "one two a b c"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><p>broken <b>bold<p>next</i></article>", "broken bold next"),
])
def test_pages(page, text):
    assert ht.main_text(page) == text


STORY = LONG.strip()
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>"
LAYOUTS = [
    # no head or body tags, and tags left open
    (f"<!doctype html><title>T</title>{MENU}<article><p>{LONG}</article>", STORY),
    (f"<html><head><meta charset=utf-8><title>T</title><link href=x>{MENU}<p>{LONG}", STORY),
    (f"<html><head><title>T<body>{MENU}<article><p>{LONG}</article></html>", STORY),
    (f"<head><title>The <p> tag</title></head><body><p>{LONG}</p>", STORY),
    (f"<head><title>T</title>{STORY}", STORY),
    # forms around the page and forms in it
    (f"<form id=aspnet><input type=hidden name=s><input name=q>{MENU}<div><h1>News</h1><p>{LONG}<p>{LONG}</div></form>",
     f"News {STORY} {STORY}"),
    (f"<form><article><p>{LONG}</article></form>", STORY),
    (f"<article><p>{LONG}</article><form><p>Write to us, we answer at once.</p><input><textarea></textarea></form>", STORY),
    # compound names
    (f"<div class='content has-sidebar'><p>{LONG}</div><div class=sidebar><p>{LONG}</div>", STORY),
    (f"<article class='post tags-foo share'><p>{LONG}</article><div class=share>Share this.</div>", STORY),
    (f"<div class='layout sidebar-right'><article><p>{LONG}</article></div><div class=footer-text>{LONG}</div>", STORY),
    (f"<div class=page-with-comments><h1>Head</h1><p>{LONG}</div>", f"Head {STORY}"),
    (f"<main><article><header class=entry-header><h1>Head</h1></header><p>{LONG}<footer>Filed</footer></article></main>",
     f"Head {STORY}"),
    # readers' comments as articles
    (f"<main><article><p>{LONG}</article><ol class=comment-list><li><article class=comment-body><p>{LONG}</article></ol>",
     STORY),
    (f"<article><p>{LONG}</article><div id=comments><article><p>{LONG} {LONG}</article></div>", STORY),
    # plain elements only: the neighbours decide for short blocks
    (f"<body><div><div>Head line</div><div>By A. B</div><div>{LONG}</div></div><div><a href=a>One</a> <a href=b>Two</a></div>",
     f"Head line By A. B {STORY}"),
    (f"<table><tr><td><a href=a>One</a><br><a href=b>Two</a><td><h2>Head</h2><p>{LONG}</table>", f"Head {STORY}"),
    (f"<main>{MENU}<p>{LONG}<p><a href=x>A linked line in the text</a><p>{LONG}</main><div class=ads>Buy.</div>",
     f"{STORY} A linked line in the text {STORY}"),
    (f"<nav><ul><li>open menu<main><p>{LONG}</main>", STORY),
]


@pytest.mark.parametrize("page,text", LAYOUTS)
def test_layouts(page, text):
    assert ht.main_text(page) == text


def test_cut_changes_labels():
    changed = total = 0
    for page, _ in LAYOUTS:
        _, cut, alone = ht.labels(page)
        changed += sum(a != b for a, b in zip(cut, alone))
        total += len(cut)
    assert changed >= 2, (changed, total)


@pytest.mark.parametrize("page", ["<div>x" * 20000 + "</b>" * 20000, "<p><b>x" * 20000, "<b>" * 20000 + "</p>" * 20000,
                                  "<div class='a ad'><a>x</a>" * 20000])
def test_long_pages_in_linear_time(page):
    start = time.process_time()
    ht.main_text(page)
    assert time.process_time() - start < 20


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        net = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]

        def cost(side):
            return (sum(max(0, x) for x, s in zip(net, side) if not s) + sum(max(0, -x) for x, s in zip(net, side) if s)
                    + sum(w for a, b, w in edges if side[a] != side[b]))

        best = min(cost(side) for side in itertools.product((False, True), repeat=n))
        assert cost(ht.minimum_cut(net, edges)) == pytest.approx(best)


def test_neighbours_decide_for_the_undecided():
    assert ht.minimum_cut([4.0, -0.3, 4.0], [(0, 1, 0.5), (1, 2, 0.5)]) == [True, True, True]
    assert ht.minimum_cut([4.0, -3.0, 4.0], [(0, 1, 0.5), (1, 2, 0.5)]) == [True, False, True]


def test_columns_pass_and_empty_table(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>", "x"), (1, "<p>a b</p>", "x"), (None, None, None)],
                               "page_id long, html string, n_chars string")
    rows = plain(ht.add_text(df, into="main"))
    assert list(rows.columns) == ["page_id", "html", "n_chars", "main"] and sorted(rows.main) == ["", "a b", "a b"]
    assert ht.add_text(df.limit(0)).count() == 0

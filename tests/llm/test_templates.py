"""Template deduction: whole articles, no boilerplate, broken markup, and a brute-force version on small hosts."""

import time
from collections import Counter

import pytest

from ledgerspark.llm import templates

MENU = '<nav><a href="/">Home</a></nav><div class="site-header">The site</div><p>Welcome to the site</p>'
END = '<div class="box"><p>Same on all pages</p><p>and this</p></div><footer>Low</footer>'


def host_pages(spark, body, n=6, host="c.example"):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{MENU}{body.replace('{0}', str(i))}{END}</body></html>") for i in range(n)]
    return {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_no_article_is_lost_to_a_class_name(spark):
    rows = []
    names = ["container has-sidebar", "search-engines", "related-work", "social-policy", "notice", "comments", "menu ad"]
    for h, name in enumerate(names):
        body = f'<div class="{name}"><div class="story"><h1>Head {{0}}</h1><p>A story of some length {{0}}</p></div></div><div class="sidebar">Side {{0}}</div>'
        rows += [(100 * h + i, f"http://h{h}.example/{i}", f"<html><body>{MENU}{body.replace('{0}', str(i))}{END}</body></html>") for i in range(6)]
    found = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {r[0]: f"Head {r[0] % 100}\nA story of some length {r[0] % 100}" for r in rows}


def test_headings_that_all_pages_share_stay(spark):
    body = '<div class="recipe"><h1>Cake {0}</h1><p>About the cake {0}</p><h2>Ingredients</h2><ul><li>flour {0}</li></ul><h2>Method</h2><p>Stir it well {0}</p><p>More from us</p></div>'
    assert host_pages(spark, body)[2] == "Cake 2\nAbout the cake 2\nIngredients\nflour 2\nMethod\nStir it well 2"
    body = '<div class="recipe"><section><h2>Ingredients</h2><ul><li>much flour {0}</li></ul></section><section><h2>Method</h2><p>Stir it well {0}</p></section><div class="x">Same</div></div>'
    assert host_pages(spark, body)[3] == "Ingredients\nmuch flour 3\nMethod\nStir it well 3"


def test_marked_elements_of_any_kind_go(spark):
    body = '<div class="story"><h1>Head {0}</h1><p class="advert">Buy item {0} now</p><p>A long story, part one {0} <span class="share">Share {0}</span>goes on</p><div style="display: none">Secret {0}</div><p hidden>Old {0}</p><ul><li id="promo">P {0}<li>item {0}</ul><p>A long story, part two {0}</p></div>'
    assert host_pages(spark, body)[4] == "Head 4\nA long story, part one 4 goes on\nitem 4\nA long story, part two 4"


def test_disordered_texts_are_no_template(spark):
    """Tags in another order on each page are not the template, but what pages fill in; the fixed texts around them are."""
    tags = ["alpha tag", "beta tag", "gamma tag", "delta tag"]
    rows = []
    for i in range(8):
        own = tags[i % 4 :] + tags[: i % 4]
        own = own[::-1] if i % 3 == 0 else own
        rows.append((i, f"http://t.example/{i}", f"<html><body>{MENU}<div class='story'><p>Story of page {i}</p>{''.join(f'<p>{t}</p>' for t in own)}<p>End of story {i}</p></div>{END}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = templates.templates(pages).withColumnRenamed("host", "_host")
    found = templates.nested(pages.selectExpr("'t.example' AS _host", "html AS _html").join(known, "_host")).collect()
    page = templates.read(rows[0][2])
    place = dict(zip(*[known.first()[c] for c in ("tokens", "classes")]))
    texts = {text: place.get(page.tokens[b]) for b, (_, text) in enumerate(page.blocks)}
    assert texts["alpha tag"] in found[0].wrong or texts["alpha tag"] is None
    assert {r.page_id: r.text for r in templates.extracted(pages).collect()}[1] == "\n".join(["Story of page 1", *tags[1:], tags[0], "End of story 1"])


CASES = {
    "<p title=it's>Hello</p><p>don't stop</p>": "Hello\ndon't stop",
    "<p>a<![CDATA[x]]>b</p><div": "ab",
    "<!--><p>x</p><!-- a --!><p>y<script>if(a<b)</script>z</p><style>p": "x\nyz",
    "<form><p>all</p><p>in form</p></form>": "all\nin form",
    "<ul><li>a<li>b<p>c<li>d</ul>": "a\nb\nc\nd",
    "a < b & c &amp; d": "a < b & c & d",
    "<a href=x>l</a> t <b>u</p>": "l t u",
    "</ p>t<? x>v</>w": "tvw",
    "<textarea><p>no</textarea>yes": "yes",
    '<p a="1>2" b=\'<p>\'>in</p>': "in",
    "<p>one<br>two &nbsp; three</p>": "one\ntwo three",
    "<p>x<span class=ad>y<p>z": "x\nz",
    "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_markup_is_read_as_browsers_do(source):
    assert templates.article(source, set(), None, set()) == CASES[source]


@pytest.mark.parametrize(
    "source",
    ["<div>" * 25_000 + "x", "<![CDATA[" * 12_000, "<!--" * 25_000, "<p a='" * 20_000, "<div>" * 5000 + "</span></p>" * 20_000, "<li>" * 30_000, "<p><div>" + "<pre>" * 20_000,
     "<p>" + "x<span class=ad>a</span>" * 20_000, "<" * 100_000, "<script>" * 20_000, "<p " + "=/ " * 40_000, "<div class=ad>x" * 5000],
)
def test_broken_pages_take_linear_time(source):
    start = time.process_time()
    templates.article(source, set(), None, set())
    assert time.process_time() - start < 3


def test_templates_agree_with_a_brute_force_deduction(spark):
    """Occurrence vectors written out in full: classes of tokens whose counts agree on every page."""
    body = '<div class="story"><h1>Head {0}</h1><p>Text {0}</p><h2>Fixed</h2><p>More {0}</p></div>'
    sources = [f"<html><body>{MENU}{body.replace('{0}', str(i))}{END if i % 2 else ''}</body></html>" for i in range(7)]
    rows = [(i, f"http://B.example:80/{i}", s) for i, s in enumerate(sources)] + [(7, "http://other.example/", sources[0]), (8, None, None)]
    found = {r.host: dict(zip(r.tokens, r.classes)) for r in templates.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    counts = [Counter(templates.read(s).sequence) for s in sources]
    vectors = {}
    for token in set().union(*counts):
        vectors.setdefault(tuple(c[token] for c in counts), set()).add(token)
    wanted = [t for v, t in vectors.items() if len(t) >= 3 and sum(map(bool, v)) >= 4]
    assert set(found) == {"b.example"}
    by_class = {}
    for token, c in found["b.example"].items():
        by_class.setdefault(c, set()).add(token)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, wanted))


def test_crossing_classes_are_told():
    page = templates.Page(sequence=[1, 2, 10, 3, 11, 20, 21, 12])
    told = {c: crosses for c, _, crosses in templates.class_orders(page, {1: 1, 2: 1, 3: 1, 10: 2, 11: 2, 12: 2, 20: 3, 21: 3})}
    assert told == {1: False, 2: True, 3: False}


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text int, tokens string, main long"
    assert templates.extracted(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "<p>x</p>", 1, "t", 2), (1, None, "<p>x</p>", 1, "t", 2), (None, "http://a/", None, 1, "t", 2), (3, "no address", "", 1, "t", 2)]
    found = templates.extracted(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in found) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (3, "", 0)]

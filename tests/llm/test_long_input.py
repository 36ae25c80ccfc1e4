"""Damaged and very long pages and names end in time, and what lies beside them is judged as before."""

import time

import pytest

from closebook.llm import htmltext, urlfilter
from closebook.llm.queries import QUERIES  # noqa: F401

SIZE = 400_000
DAMAGED = ["<div ", "<a>", "<div>", "<a href>x</b>", "<!", "<script>", "</scrip", '<a href="', "<a><h1></h1>", "<p '", "<ul><li>", "<", "<!--", "<td><tr>"]


@pytest.mark.parametrize("part", DAMAGED)
def test_parsing_is_linear(part):
    began = time.time()
    htmltext.parse("<p>begin</p>" + part * (SIZE // len(part)))
    assert time.time() - began < 10


def test_a_tag_ends_at_the_next_one():
    tree = htmltext.parse('<div class="x" <p>one <b>two</b></p><p title="a < b > c">three</p></div><a href="open>four</a>')
    texts = [htmltext.own_text(n) for n in htmltext.below(tree)]
    assert "one two" in texts and "three" in texts
    closing = htmltext.parse("<ul><li>a<li>b<b>c</ul>d<p>e<p>f<table><tr><td>g<td>h</table>i")
    got = [(n.tag, htmltext.own_text(n)) for n in htmltext.below(closing)]
    assert [x for x in got if x[0] in ("li", "p", "td")] == [("li", "a"), ("li", "bc"), ("p", "e"), ("p", "f"), ("td", "g"), ("td", "h")]


def test_formulas_stay_in_their_block():
    assert [htmltext.own_text(n) for n in htmltext.below(htmltext.parse("<p>a <math><mi>x</mi><mo>+</mo></math> b</p>"))] == ["", "a x+ b"]


def test_damaged_pages_do_not_hold_up_others(spark):
    good = "<html><body><nav><a>home</a></nav><article><p>The text number {0} of this page is long enough to stay here.</p></article></body></html>"
    pages = [(i, f"https://h.example/{i}", good.format(i)) for i in range(6)] + [(6 + i, f"https://h.example/x{i}", part * (20_000 // len(part))) for i, part in enumerate(DAMAGED)]
    began = time.time()
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(f"number {i} of" in got[i] for i in range(6)) and time.time() - began < 120


def test_long_names_are_split(spark):
    words = {"cheap": 5, "pills": 5, "news": 9, "daily": 4, "x" * 30: 3}
    name = ("cheappills" + "newsdaily" + "x" * 30) * 400
    total = sum(words.values())
    table = spark.createDataFrame([(w, float(n)) for w, n in words.items()], "word string, n double")
    names = spark.createDataFrame([(name,), ("newsdaily",), ("x" * 30,), ("q" * 50_000,), ("",)], "name string")
    began = time.time()
    got = {r.name: r.words for r in urlfilter.segmented(names, table, float(total)).collect()}
    assert got[name] == ["cheap", "pills", "news", "daily", "x" * 30] * 400 and got["newsdaily"] == ["news", "daily"] and got["x" * 30] == ["x" * 30]
    assert "".join(got["q" * 50_000]) == "q" * 50_000 and got[""] == [] and time.time() - began < 60


def test_a_long_url_among_others(spark):
    rows = [(i, f"https://news-daily{i}.example/a/b") for i in range(20)] + [(20, "https://" + "ab" * 10_000 + ".example/" + "casino" * 3000), (21, None), (22, "https://casino-poker.example/en/")]
    began = time.time()
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 23 and got[0] == "allow" and time.time() - began < 120

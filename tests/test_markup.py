"""The JVM page reader against a reader that works event by event, on made-up tag soup."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import markup
from ruleweave.operators.documents import html_blocks
from slow_reader import read_blocks

PIECES = [
    "<p>", "</p>", "<P class='a>b'>", "<li>", "</li>", "<ul>", "</ul>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<td/>", "<tbody>",
    "<h1>", "</h1>", "<h3 id=x>", "</h3>", "<b>", "</b>", "<br>", "<br/>", "<div>", "</div>", "<body>", "</body>", "<span title=\"1 > 0\">", "</span>", "</nope>",
    "<noscript>", "</noscript>", "<svg>", "</svg>", "<script>if (a<b) {'</p>'}</script>", "<style>p > b {}</style>", "<!-- <p>hidden</p> -->", "<!DOCTYPE html>",
    "one", " two ", "three &amp; four", "&nbsp;", " \n\t ", "five­ six", "&lt;p&gt;", "&copy;", "Ж", "a", " b ", "x &unknown; y", "&#1046;",
]


def read(spark, pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    got = {i: [] for i in range(len(pages))}
    for row in html_blocks(frame, "id", "html").orderBy("id", "line_no").collect():
        got[row.id].append((row.kind, row.level, row.line))
    return got


def test_soup_reads_as_event_by_event(spark):
    random.seed(11)
    pages = ["".join(random.choices(PIECES, k=random.randint(1, 60))) for _ in range(400)]
    pages += ["<html><head><title>t</title></head><body>" + page + "</body></html>" for page in pages[:100]]
    got = read(spark, pages)
    for i, page in enumerate(pages):
        assert got[i] == read_blocks(page), page


@pytest.mark.parametrize(
    "page,lines",
    [
        (None, []), ("", []), ("no block", []), ("<p>a < b and 1<2</p>", ["a < b and 1<2"]), ("<p>open <i>and", ["open and"]),
        ("<p>one<p>two</p>three", ["one two three", "two"]), ("<p>x <a href='y", ["x"]), ("<p>x<!-- never closed <p>y</p>", ["x"]),
        ("<table><tr><th>A<td>B</table>", ["| A B |", "| --- |"]), ("<tr><td> </td><td></td></tr>", []),
        ("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>c</td></tr></table>", ["| a in | c |", "| in |"]),
        ("<p>out</p><body><p>in</p></body><p>after</p>", ["in"]), ("<p>it's <b title='x\"y'>bold</b></p>", ["it's bold"]),
        ("<template><body><p>no</p></body></template><p>yes</p>", ["yes"]), ("<h2>H</h2><h5>no</h5><li>i</li>", ["## H", "- i"]),
        ("<script src=x/><p>not text", []), ("<script/><p>text", ["text"]), ("</p></td>x<td>y</td>", []),
    ],
)
def test_cases(spark, page, lines):
    assert [line for _, _, line in read(spark, [page])[0]] == lines


def test_a_long_page_costs_in_proportion(spark):
    def page(n):
        return "<body>" + "".join(f"<table><tr><th>k{i}</th><td>v <b>x</b></td></tr></table><p>text {i}</p>" for i in range(n))

    def seconds(n):
        frame = spark.createDataFrame([(1, page(n))], "id long, html string").repartition(1)
        started = time.perf_counter()
        assert frame.select(F.size(markup.page_blocks("html"))).first()[0] == 3 * n
        return time.perf_counter() - started

    seconds(200)
    small, large = seconds(1000), seconds(8000)
    assert large < 8 * 3 * max(small, 0.3), (small, large)


def test_deep_pages(spark):
    page = "<div>" * 3000 + "<p>in" + "</p>" + "<li>" * 200 + "x"
    got = read(spark, [page])[0]
    assert got[0] == ("paragraph", 0, "in") and got[1:] == [("item", 0, "- x")] * 200

import pytest

from ruleweave.llm import html_main

NAV = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "y") for row in rows], "page_id long, url string, html string, token string, host string")


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p", ""), ("plain &lt;b&gt; &amp; text", "plain <b> & text"),
    (f"<body>{NAV}<article><h1>T</h1><p>one <b>two</b><br>three&nbsp;four<p>five</article><footer>f</footer>", "T\none two three four\nfive"),
    ("<main><p>a</p><div class='comments'><p>bad</p></div><aside>no</aside><form>q<input></form><p>b</main><p>out", "a\nb"),
    ("<article><p>a &copy; b<script>'</p>'</script><style>p{}</style><!-- <p>x --><ul><li>x<li>y</ul>tail</article>", "a © b\nx\ny\ntail"),
    ("<div class=menu>m</div><div id=content><h2>T</h2><p>long enough text here</p></div><div class='cookie-notice'>ok?</div>", "T\nlong enough text here"),
    ("<article><p title='a > b'>x</p><p>1 < 2 & 3</article>", "x\n1 < 2 & 3"),
    ("<article><p>cut off <b>here", "cut off here"),
])
def test_main_text(spark, html, text):
    rows = [(1, "https://h.example/1", html), (1, "https://h.example/1", html), (None, None, html)]
    got = html_main.extract(frame(spark, rows)).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "None"] and {r.text for r in got} == {text}


def test_template_finds_the_slot_without_names(spark):
    page = "<body><div class=k1><p>short links here</p></div><div class=k2><h2>{0}</h2><p>{1}</p></div><div class=k3>about</div>"
    rows = [(i, f"http://x.example:80/{i}?a#b", page.format(f"Head {i}", f"body number {i} " * (1 if i == 7 else 30))) for i in range(12)]
    rows.append((99, "http://other.example/", ""))
    got = {r.page_id: r.text for r in html_main.extract(frame(spark, rows)).collect()}
    assert got[3] == "Head 3\n" + " ".join(["body number 3"] * 30)
    assert got[7] == "Head 7\nbody number 7" and got[99] == ""


def test_classes_nest():
    top = {"pages": 4, "members": [{"token": 1, "parent": 0, "chars": 9}, {"token": 2, "parent": 1, "chars": 5}]}
    loose = {"pages": 3, "members": [{"token": 7, "parent": 6, "chars": 1}]}
    nested = {"pages": 2, "members": [{"token": 3, "parent": 2, "chars": 4}]}
    assert html_main.nest([nested, loose, top]) == {1: 9, 2: 5, 3: 4}
    assert html_main.nest(None) == {}


def test_no_pages(spark):
    assert html_main.extract(frame(spark, [])).count() == 0


@pytest.mark.parametrize("open_,close", [
    ("<div class='overflow-hidden'>", "</div>"), ("<body class='no-sidebar'><div class='content-sidebar-wrap no-sidebar'>", "</div>"),
    ("<div id=x class='post with-comments'>", "</div>"), ("<form id=aspnetForm>", "</form>"), ("<div class=modal><form role=search>", "</form></div>"),
])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_keep_their_text(open_, close, tag):
    html = f"{open_}<div class='menu main-menu'>m</div><{tag}><p>body of the page</p><div class='cookie-notice'>ok?</div></{tag}><aside><article>teaser</article></aside>{close}"
    assert html_main.main_text(html, {}) == "body of the page"


def test_teaser_in_a_sidebar_is_no_article():
    html = "<div class=sidebar><article>teaser</article></div><div><p>a page without an article element</p></div>"
    assert html_main.main_text(html, {}) == "a page without an article element"


def test_form_around_a_page_without_article():
    html = "<a href=#c>Skip</a><form id=aspnetForm><div class=menu>m</div><div id=c><p>body of the page</p></div></form>"
    assert "body of the page" in html_main.main_text(html, {}).split("\n")
    assert html_main.main_text("<div><p>body of the page</p></div><form>your name</form>", {}) == "body of the page"


def test_texts_that_stay_the_same_are_template(spark):
    page = "<body><article id=post-{0} class='tag-t{0}'><h1>Head {0}</h1><div>Share this story</div><div>{1}</div><p>Filed by us</p></article>"
    rows = [(i, f"http://x.example/{i}", page.format(i, f"body number {i} " * 5)) for i in range(8)]
    rows += [(50 + i, f"http://few.example/{i}", page.format(i, "same")) for i in range(2)]
    rows += [(70 + i, f"http://copy.example/{i}", "<article><p>copy</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in html_main.extract(frame(spark, rows)).collect()}
    assert got[3] == "Head 3\n" + " ".join(["body number 3"] * 5)
    assert got[51] == "Head 1\nShare this story\nsame\nFiled by us"  # two pages tell nothing
    assert got[70] == "copy"


def test_short_slots_that_vary_stay(spark):
    page = "<body><div class=a>About our firm</div><div class=b>Head {0}</div><div class=c><p>Lead {0}</p></div><div class=d>{1}</div><div class=e>End {0}</div>"
    rows = [(i, f"http://x.example/{i}", page.format(i, f"body number {i} " * 50)) for i in range(8)]
    got = {r.page_id: r.text for r in html_main.extract(frame(spark, rows)).collect()}
    assert got[5] == "Head 5\nLead 5\n" + " ".join(["body number 5"] * 50) + "\nEnd 5"

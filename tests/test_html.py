"""Selectors and fields on hand-written pages."""

from __future__ import annotations

import random
import time
from dataclasses import replace
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import html as H
from shelfmark.operators.html import Selector


def field(spark, html, column):
    pages = spark.createDataFrame([(0, "https://a.es/p", html)], "page_id bigint, url string, html string")
    return H.with_tokens(pages).select(column.alias("x")).first()[0]


def check(spark, cases, column):
    """All cases of (html, value) in one job."""
    data = [(i, "https://a.es/p", html) for i, (html, _) in enumerate(cases)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = H.with_tokens(pages).select("page_id", column.alias("x")).orderBy("page_id").collect()
    wrong = [(html, r.x, want) for (html, want), r in zip(cases, got, strict=True) if r.x != want]
    assert wrong == []


def frame(spark, *htmls):
    data = [(i, f"https://a.es/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(data, "page_id bigint, url string, html string")


def test_elements(spark, rows):
    html = "<!doctype html><p class='a'>x &amp; <b>y</b> < 2<br/><!-- <i> --><script src=\"s\">a<p></script></P>"
    got = [tuple(r)[1:] for r in H.elements(frame(spark, html)).orderBy("pos").collect()]
    assert got == [
        (0, "comment", None, None, None),
        (1, "open", "p", "class='a'", None),
        (2, "text", None, None, "x & "),
        (3, "open", "b", "", None),
        (4, "text", None, None, "y"),
        (5, "close", "b", None, None),
        (6, "text", None, None, " < 2"),
        (7, "open", "br", "/", None),
        (8, "comment", None, None, None),
        (9, "raw", "script", 'src="s"', "a<p>"),
        (10, "close", "p", None, None),
    ]


def test_page_title(spark):
    cases = [
        ('<meta property="og:title" content="A">', "A"),
        ("<META content='A &amp; B' Property='og:title'/>", "A & B"),
        ("<meta property=og:title content=A>", "A"),
        ('<meta property="og:title" content=" A "><h1 class="h1 page-title">B</h1>', " A "),  # as it stands
        ('<meta property="og:title" content=""><h1 class="h1 page-title">B</h1>', "B"),
        ('<meta property="og:title"><h1 class="h1 page-title">B</h1>', "B"),
        # the first one counts, even when it is empty
        ('<meta property="og:title" content=""><meta property="og:title" content="A">', None),
        ('<meta property="og:title2" content="A">', None),
        ('<meta data-x=\' property="og:title"\' content="A">', None),
        ('<!-- <meta property="og:title" content="A"> -->', None),
        ('<script>"<meta property=og:title content=A>"</script>', None),
        ('<meta property="og:title" content="a > b">', "a > b"),
        # pieces are stripped and joined without a space
        ('<h1 class="h1 page-title"> a <b> b </b> c </h1>', "abc"),
        ('<h1 class="page-title">B</h1>', None),  # the selector names the whole class attribute
        ('<h1 class=" h1   page-title ">B</h1>', "B"),
        ('<h1 class="h1 page-title"></h1><h1 class="h1 page-title">B</h1>', None),  # first wins
        ('<h1 class="h1 page-title">B', "B"),  # never closed
        ("", None),
    ]
    check(spark, cases, H.page_title())


def test_page_title_without_og(spark):
    html = '<meta property="og:title" content="A"><h1 class="h1 page-title">B</h1>'
    assert field(spark, html, H.page_title(H.Rules(use_og_title=False))) == "B"


def test_page_title_v1(spark):
    cases = [
        ('<meta property="og:title" content=" A ">', "A"),
        ('<h1 class="anything"> B <i>c</i></h1>', "B c"),  # the class is not looked at
        ("<h1></h1><h1>B</h1>", None),
        ('<meta property="og:title" content="  "><h1>B</h1>', None),
    ]
    check(spark, cases, H.page_title_v1())


def test_page_image(spark):
    cases = [
        ('<meta property="og:image" content=" /a.jpg ">', "/a.jpg"),
        ('<meta property="og:image" content=" "><img class="zoomContainer x" src="/b.jpg?a=1&amp;b">', "/b.jpg?a=1&b"),
        ('<img src="/c.jpg"><img class="other" src="/d.jpg">', None),
        ('<img class="zoomContainer">', None),
    ]
    check(spark, cases, H.page_image())


def test_page_image_v1(spark):
    css = H.IMAGE_CLASS_V1
    assert field(spark, f'<img class="{css}" src=" /a.jpg ">', H.page_image_v1()) == "/a.jpg"
    # the class is a rule of the job, not fixed
    assert field(spark, '<img class="mine" src="/a.jpg">', H.page_image_v1(H.RulesV1(image_class="mine"))) == "/a.jpg"


RULES = H.Rules(descriptions=(Selector("div", "short"), Selector("p", "long")))


def test_page_description(spark):
    cases = [
        ('<meta property="og:description" content=" d ">', "d"),
        ('<div class="short"> a <div>b</div> c </div> d', "a b c"),  # nested tags of the same name
        ('<div class="short"> </div><p class="long">x</p>', "x"),  # empty: next selector
        ('<div class="short"></div><div class="short">y</div>', None),  # only the first of a selector
        ('<div class="short"/>no<p class="long">x</p>', "x"),
        ('<div class="short">a<style>b</style><!-- c --><script>d</script>&nbsp;e</div>', "a\xa0e"),
    ]
    check(spark, cases, H.page_description(RULES))


def test_page_description_v1(spark):
    html = '<div class="product-description"></div><div class="product-details">x</div>'
    assert field(spark, html, H.page_description_v1()) == ""  # first match wins even if empty
    assert field(spark, html, H.page_description_v1(H.RulesV1(ignore_description=True))) is None


def test_page_price_text(spark):
    cases = [
        ('<p class="price">1 €</p>2', "1 €"),
        ('<p class="price">1 €<p>2', "1 €"),  # a paragraph ends where the next begins
        ('<p class="price"> </p><p class="price">3</p>', None),
        ('<span class="price">1</span>', None),
    ]
    check(spark, cases, H.page_price_text())


def test_page_price_text_skips_empty_selectors(spark):
    rules = H.Rules(prices=(Selector("p", "price"), Selector("b", "price")))
    assert field(spark, '<b class="price">2</b><p class="price"></p>', H.page_price_text(rules)) == "2"


def test_page_price_text_v1(spark):
    cases = [
        ('<span class="amount">0,00€</span><div class="price">3,00€</div>', "3,00€"),
        ('<span class="amount">0 €</span><div class="price">3,00€</div>', "0 €"),  # not in the list
        ('<div class="price">3</div><p class="price">2</p>', "2"),  # order of the selectors
    ]
    check(spark, cases, H.page_price_text_v1())


def test_script_price(spark):
    assert field(spark, '<script>_amtm_tm_product_ = {"price":12.5}</script>', H.script_price()) == "12.5"
    # only the first script that has the mark is looked at
    html = '<script>_amtm_tm_product_</script><script>_amtm_tm_product_ "price":1</script>'
    assert field(spark, html, H.script_price()) is None


def test_is_js_heavy(spark):
    cases = [
        ("<div v-model=x>", True),
        ("<script src=a></script>" * 5, False),
        ("<script src=a></script>" * 6, True),
        ("<script>" + "x" * 20000 + "</script>", False),
        ("<script>" + "x" * 20000 + "</script><script>y</script>", True),
        ('<script src="">' + "x" * 20001 + "</script>", True),  # an empty source is no source
    ]
    got = H.is_js_heavy(frame(spark, *[html for html, _ in cases])).orderBy("page_id").collect()
    assert [r.js_heavy for r in got] == [heavy for _, heavy in cases]


def test_links(spark):
    html = (
        "<A HREF='/a?x=1&amp;y=2'>1</a><a>no</a><a href>empty</a><abbr href=/no></abbr>"
        '<!-- <a href="/no"> --><script>"<a href=/no>"</script><a title="a>b" href=/c/>'
    )
    assert [(r.pos, r.href) for r in H.extract_links(frame(spark, html)).orderBy("pos").collect()] == [
        (0, "/a?x=1&y=2"),
        (1, ""),
        (2, "/c/"),
    ]


def test_html_title(spark):
    df = frame(
        spark,
        "<!-- <title>no</title> --><script>'<title>no</title>'</script><TITLE lang=es>a &lt; b</TITLE>",
        "<title></title>",
        "<p>none</p>" + "<" * 50_000,
    )
    assert [r[0] for r in df.orderBy("page_id").select(H.html_title(F.col("html"))).collect()] == ["a < b", None, None]


def test_page_text(spark):
    html = (
        "<body>\n<nav>n<nav>m</nav>o</nav><h1>T</h1><p>a\n b<br>c</p>"
        "<footer><p>f</p></footer><script>s</script><div>d <a href=x>e</a></div></nav>z</body>"
    )
    df = frame(spark, html, "a<nav>never closed <p>x", None, "<header><nav>n</header><p>x</p><footer/>y")
    got = [r.text for r in H.page_text(df).orderBy("page_id").collect()]
    assert got == ["T\n\na b\nc\n\nd e\n\nz", "a", None, "x\n\ny"]


def test_strict_og(spark):
    all_three = "".join(f'<meta property="og:{n}" content=" {n} ">' for n in ("title", "image", "description"))
    got = H.strict_og(frame(spark, all_three, all_three[:40])).collect()
    assert [tuple(r)[2:] for r in got] == [("title", "image", "description")]


def test_sentinels_only_at_the_end(spark):
    fields = H.extract_fields(frame(spark, "<p>nothing</p>"))
    assert tuple(fields.select("title", "image", "description", "price").first()) == (None,) * 4
    shown = H.with_sentinels(fields.select("title", "image", "description", "price")).first()
    assert tuple(shown) == ("Title not found", "Image not found", "Description not found", "Price not found")


def test_status_pages_have_only_a_title(spark):
    pages = frame(spark, '<meta property="og:title" content="A"><p class="price">1</p>').withColumn("status", F.lit(404))
    got = H.extract_fields(pages).first()
    assert (got.title, got.price) == ("Status code: 404", None)


def test_prices_follow_the_rules_of_the_job(spark):
    rules = replace(H.Rules(), prices=())
    assert H.extract_fields(frame(spark, '<p class="price">1</p>'), rules).first().price is None


def test_broken_pages_cost_no_stack(spark):
    broken = [
        "<a " + 'x="1" ' * 50_000 + ">t",
        "<a " * 50_000,
        "<!--" * 50_000,
        "<" * 100_000,
        "<p class='price'>" * 5_000,
        "&" * 100_000,
    ]
    for fields in (H.extract_fields(frame(spark, *broken)), H.extract_fields_v1(frame(spark, *broken))):
        fields.write.format("noop").mode("overwrite").save()  # every column of every row
    assert H.extract_links(frame(spark, *broken)).count() == 0


class Tree(HTMLParser):
    """A plain reading of HTML with a stack: text of the first element of each tag and class."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.open, self.found = [], [], {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in H.VOID_TAGS:
            return
        css = dict(attrs).get("class")
        self.stack.append((tag, css))
        if css and (tag, css) not in self.found:
            self.found[tag, css] = ""
            self.open.append((len(self.stack), tag, css))

    def handle_startendtag(self, tag, attrs):
        css = dict(attrs).get("class")
        if css:
            self.found.setdefault((tag, css), "")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
            self.open = [o for o in self.open if o[0] <= len(self.stack)]

    def handle_data(self, data):
        for _, tag, css in self.open:
            self.found[tag, css] += data


def test_elements_end_where_a_stack_ends_them(spark):
    rnd = random.Random(4)
    tags = ["div", "span", "b"]
    parts = [f"<{t}>" for t in tags] + [f"</{t}>" for t in tags] * 2 + ["</i>", "<br>", "<b/>", "x", "y", "z"]
    htmls = []
    for _ in range(400):
        some = rnd.choices(parts, k=rnd.randint(0, 14))
        for t in tags:
            some.insert(rnd.randint(0, len(some)), f"<{t} class=c>")
        htmls.append("".join(some))
    columns = [
        H.first_by_class((Selector(t, "c"),), first_match_wins=True, lenient=False).alias(t) for t in tags
    ]
    got = H.with_tokens(frame(spark, *htmls)).select("page_id", *columns).orderBy("page_id").collect()
    wrong = []
    for html, r in zip(htmls, got, strict=True):
        want = tuple(Tree(html).found.get((t, "c")) for t in tags)
        if tuple(r)[1:] != want:
            wrong.append((html, tuple(r)[1:], want))
    assert wrong == []


def test_lenient_paragraphs(spark):
    cases = [
        ('<div><p class="price">1</div>2', "1"),  # the end of what is around it
        ('<p class="price">1</div>2</p>3', "12"),  # no div is open: passed over
        ('<p class="price">1<h2>2</h2>', "1"),
        ('<p class="price">1<b>2<p>3', "12"),  # bold text ends with the paragraph
        ('<p class="price">1<em>2<p>3</p></em>4</p>5', "1234"),  # other text holds it open
        ('<p class="price">1<hr>2', "1"),
        ('<div><p class="price">1<span>2</div>3', "12"),
        ('<p class="price">1<em><div>2</em>3</div>4</em></p>5', "1234"),  # an end tag does not leave a div
    ]
    check(spark, cases, H.page_price_text())


def broken(n):
    """A page of each kind of token that does not close, with ``n`` beginnings of another inside."""
    return {
        "double quotes": "<a " + '="<a "' * n,
        "single quotes": "<a " + "='<a '" * n,
        "end tags": "</a " + '="</a "' * n,
        "scripts": "<script " + '="<script "' * n,
        "open scripts": "<script>" + "</script " * n,
        "titles": "<title " + '="<title "' * n,
        "comments": "<!--" * n,
        "declarations": "<!x " * n,
        "bare": "<a <b " * n,
        "last quote": "<a " + "=x" * n + '="',
    }


READERS = {
    "elements": lambda pages: H.elements(pages),
    "extract_links": lambda pages: H.extract_links(pages),
    "script_stats": lambda pages: H.script_stats(pages),
    "html_title": lambda pages: pages.select(H.html_title(F.col("html")).alias("t")),
}


@pytest.mark.parametrize("name", READERS)
def test_cost_grows_with_the_length_of_a_page(spark, name):
    def seconds(html):
        pages = frame(spark, html)
        READERS[name](pages).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        READERS[name](pages).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    small, large = broken(10_000), broken(40_000)
    for kind in small:
        before, after = seconds(small[kind]), seconds(large[kind])
        # sixteen times as long if what was read is read again; some tenths of a second are the job itself
        assert after < 6 * before + 1.0, (kind, before, after)


def test_what_an_unclosed_tag_takes(spark):
    cases = {
        '<a x="1 <b>2" <i>t</i>': ["a", "i", None, "i"],  # the quoted value belongs to the tag that did not close
        "<a href=x <b>t</b>": ["a", "b", None, "b"],
        "<p <p>t": ["p", "p", None],
        "a < b <i>c": [None, "i", None],
        "<script x <b>": ["script", "b"],
    }
    got = H.elements(frame(spark, *cases)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t"))
    found = {r.page_id: [x.tag for x in r.t] for r in got.collect()}
    assert [found[k] for k in sorted(found)] == list(cases.values())
    titles = {'<a x="<title>no</title>" <title>yes</title>': "yes", "<title <title>t</title>": "t", "<title x": None}
    read = frame(spark, *titles).orderBy("page_id").select(H.html_title(F.col("html")).alias("t")).collect()
    assert [r.t for r in read] == list(titles.values())
    links = {'<a x="<a href=no>" <a href=yes>': ["yes"], "<script <a href=in>": ["in"], "<a href=x": []}
    pages = frame(spark, *links)
    for page, want in zip(sorted(r.page_id for r in pages.select("page_id").collect()), links.values(), strict=True):
        assert [r.href for r in H.extract_links(pages.filter(F.col("page_id") == page)).collect()] == want


def test_titles_from_a_scan_are_those_of_the_tokens(spark):
    pages = [
        '<meta property="og:title" content="A &amp; B">',
        '<!-- <meta property="og:title" content="no"> --><META content=one property=og:title />',
        '<div x="<meta property=og:title content=no>"><meta property="og:title" content=""><h1 class="h1 page-title">tag</h1>',
        '<script>"<meta property=og:title content=no>"</script><h1 class="h1 page-title"> a <b>b</b></h1>',
        '<meta property="og:image" content="i"><metas property="og:title"><meta property="og:title" content="1"><meta property="og:title" content="2">',
        '<a x="<meta property=og:title content=in>" <meta property=og:title content=out>',
        '<meta property="og:title" content="open"',
        *broken(50).values(),
        None,
        "",
    ]
    whole = {r.page_id: r.title for r in H.extract_fields(frame(spark, *pages)).collect()}
    assert {r.page_id: r.title for r in H.extract_titles(frame(spark, *pages)).collect()} == whole
    assert [whole[k] for k in range(7)] == ["A & B", "one", "tag", "ab", "1", "out", "open"]
    both = H.with_tokens(frame(spark, *pages).withColumn("kept", F.col("html"))).select("metas", H.page_metas(F.col("kept")).alias("scan"))
    assert all(r.metas == r.scan for r in both.collect())

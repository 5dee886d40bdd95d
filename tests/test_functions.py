"""Text, URL and price columns: literal cases and comparison with Python on many inputs."""

from __future__ import annotations

import random
import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from shelfmark.functions import price as P
from shelfmark.functions import text as T
from shelfmark.functions import urls as U


def applied(spark, values, function):
    """``function`` of a column over the values, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_price_eur(spark):
    cases = [
        ("12,5 €", "12.50€"),
        ("1.234,56 €", "1.234,56 €"),
        ("€7", "7.00€"),
        ("7d", "7d"),
        ("NaN", "NaN"),
        ("gratis", "gratis"),
        ("-3,5", "-3.50€"),
        (".5", "0.50€"),
        (None, None),
    ]
    assert applied(spark, [c[0] for c in cases], P.price_eur) == [c[1] for c in cases]


NOTICE = "7,95€ El precio original era: 7,95€.5,50€El precio actual es: 5,50€"


def test_price_current(spark):
    cases = [
        (NOTICE + ".", NOTICE + "."),
        (NOTICE, "5,50€"),
        ("7,95€ El precio original era: 9,00€", "7,95€"),
        ("1234.5", "1,234,50€"),
        ("12.5", "12,50€"),
        (None, None),
    ]
    assert applied(spark, [c[0] for c in cases], P.price_current) == [c[1] for c in cases]


def test_price_last(spark):
    cases = [(NOTICE + ".", "5,50€"), ("1.234,56€", "234,56€"), ("gratis", "gratis"), (" 5,50€ ", "5,50€"), (None, None)]
    assert applied(spark, [c[0] for c in cases], P.price_last) == [c[1] for c in cases]


def test_price_amount_reads_thousands(spark):
    got = applied(spark, ["1.234,56 €", "12,5 €", "1.234", "x"], P.price_amount)
    assert [None if g is None else str(g) for g in got] == ["1234.56", "12.50", "1.23", None]


def test_title_head(spark):
    cases = [
        ("Velas archivos - Tienda", "Velas archivos"),
        ("A | B | C", "A"),
        ("A-B", "A-B"),
        ("", None),
        (None, None),
    ]
    assert applied(spark, [c[0] for c in cases], T.title_head) == [c[1] for c in cases]


def test_strip_is_pythons(spark):
    values = ["", " a ", "\n\t a b \r\n", " x ", "　", "a\x1c", " " * 500 + "b" + " " * 500 + "c", "\x0b\x0c"]
    assert applied(spark, values, T.strip) == [v.strip() for v in values]


def test_strip_of_long_white_space_is_quick(spark):
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 2_000_000), F.lit("b")).alias("v"))
    assert df.select(F.length(T.strip(F.col("v")))).first()[0] == 2_000_002


def test_decode_references(spark):
    values = ["a &amp; b", "&lt;b&gt;", "&eacute;&ntilde;&euro;", "&#233;&#xE9;&#x1F600;", "&amp;lt;", "&nope; & &x", "&#0;&#xD800;&#9999999;"]
    want = ["a & b", "<b>", "éñ€", "éé😀", "&lt;", "&nope; & &x", "&#0;&#xD800;&#9999999;"]
    assert applied(spark, values, T.decode_references) == want


# The rewrite rules for page text in their plain form.
PLAIN_RULES = [
    (r"!\[\]([^)]*\))", "", 0),
    (r"\[.*\s.*\]([^)]*\))", "", 0),
    (r"\[\s*\]\([^)]*\)", "", 0),
    (r"\[!\]\([^)]*\)", "", 0),
    (r"\[\s*!\[.*\s.*\]([^)]*\))\s*\]\([^)]*\)", "", 0),
    (r"(\w)-\n(\w)", r"\1\2", 0),
    (r"(?<!\n)\n(?!\n)", " ", 0),
    (r"\n\s*\n", "\n", 0),
    (r"\s*!\s*$", "", re.MULTILINE),
    (r"\s+!", " ", 0),
    (r"~", "", 0),
    (r"!\[.*\s.*\]([^)]*\))", "", 0),
    (r"\[.*\s.*\]([^)]*\))", "", 0),
    (r"\[.*?\]\(.*?\)!\[.*?\]\(.*?\)", "", 0),
    (r"\[.*?\]\(.*?\)", "", 0),
]


def plainly_cleaned(text):
    for pattern, replacement, flags in PLAIN_RULES:
        text = re.sub(pattern, replacement, text, flags=flags)
    return text


def test_clean_text_equals_the_plain_rules(spark):
    rnd = random.Random(7)
    parts = ["[", "]", "(", ")", "!", "![", "](", "\n", "\n\n", " ", "a", "b-", "~", "é", "[ ]", "x y", "[!](u)", "\t"]
    values = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(6000)]
    values += ["".join(rnd.choices(["[", "]", ")", " ", "\n", "!", "("], k=rnd.randint(4, 16))) for _ in range(6000)]
    got = applied(spark, values, T.clean_text)
    wrong = [(v, g, plainly_cleaned(v)) for v, g in zip(values, got, strict=True) if g != plainly_cleaned(v)]
    assert wrong == []


def test_clean_text_of_many_open_brackets_is_quick(spark):
    df = spark.range(1).select(F.repeat(F.lit("[a b "), 20_000).alias("v"))
    assert df.select(F.length(T.clean_text(F.col("v")))).first()[0] == 100_000


def test_url_parts_are_those_of_urlparse(spark):
    values = [
        "https://www.a.es:8080/x/y?q=1&r=/s#f#g",
        "http://a.es",
        "HTTP://A.es/?",
        "/only/path?x",
        "//host/p",
        "mailto:a@b.c",
        "",
        "https://a.es/with space?q=ü#é",
        "https://user@a.es/p",
    ]
    got = applied(spark, values, U.url_parts)
    for v, g in zip(values, got, strict=True):
        p = urlparse(v)
        assert tuple(g) == (p.scheme, p.netloc, p.path, p.query, p.fragment), v


def test_site_key_and_same_site(spark):
    assert applied(spark, ["https://www.a.es/x"], U.site_key) == ["a.es"]
    pairs = [("https://www.a.es", "https://a.es"), ("https://a.es:1/", "https://a.es/"), ("https://a.es/x", "http://a.es")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(U.same_site(F.col("a"), F.col("b"))).collect()] == [False, False, True]


def test_is_html_page(spark):
    values = ["https://a.es/F.PDF", "https://a.es/x.tar.gz", "https://a.es/x.html", "https://a.es/x.pdf?y=1", "https://a.es/x.pdf;v=1", "https://a.es/x?f=a.pdf", "https://a.es/"]
    assert applied(spark, values, U.is_html_page) == [False, False, True, False, False, True, True]


def test_video_embed(spark):
    link = "https://www.youtube.com/watch?v=abc"
    assert applied(spark, [link], U.video_id) == ["abc"]
    assert applied(spark, [link], U.video_embed) == ["https://www.youtube.com/embed/abc"]


def test_resolve_url_is_urljoin(spark):
    rnd = random.Random(3)
    steps = ["..", ".", "a", "b.c", "é", "", "x y"]
    refs = ["", "#f", "?q=1", "//h.es/p", "http://o.es/../z", "mailto:x@y.z", "javascript:void(0)", "/", ".", "..", "\n /a "]
    for _ in range(600):
        path = "/".join(rnd.choices(steps, k=rnd.randint(1, 6)))
        refs.append(rnd.choice(["", "/"]) + path + rnd.choice(["", "/", "?q=/../x", "#f/.."]))
    # a path that begins with two slashes names a host; empty steps before a host are no use here
    refs = [r for r in refs if not r.startswith("//") or r.startswith("//h")]
    for base in ["https://s.es/", "https://s.es", "https://s.es/d/e/page?x=1#g", "https://s.es:81/d/e/"]:
        got = applied(spark, refs, lambda c, b=base: U.resolve_url(b, c))
        wrong = [(base, r, g, urljoin(base, r)) for r, g in zip(refs, got, strict=True) if g.rstrip() != urljoin(base, r).rstrip()]
        assert wrong == []

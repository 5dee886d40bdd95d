"""Batches, prompts, replies, keywords, videos."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import selection as L


def test_parse_selection(spark):
    cases = [
        ('["u1", "u2"]', ["u1", "u2"]),
        ("['u1']", ["u1"]),
        (" ['u1', \"u2\",] \n", ["u1", "u2"]),
        ("[]", []),
        ("['it\\'s']", ["it's"]),
        ('["a]b", "c,d"]', ["a]b", "c,d"]),
        ("not a list", None),
        ('{"a":1}', None),
        ('["u1"] and more', None),
        ('["u1"], ["u2"]', None),
        ('Here: ["u1"]', None),
        ('```\n["u1"]\n```', None),
        ('["u1"', None),
        ("", None),
        (None, None),
    ]
    data = [(i, 1, reply) for i, (reply, _) in enumerate(cases)]
    df = spark.createDataFrame(data, "batch_id bigint, attempt int, reply string")
    got = L.parse_selection(df).orderBy("batch_id").collect()
    assert [r.urls for r in got] == [urls for _, urls in cases]


def test_first_valid_attempt(spark, rows):
    replies = [
        (0, 1, '["a"]'),
        (0, 2, '["b"]'),
        (1, 1, "no"),
        (1, 3, '["c", "c"]'),
        (2, 1, "no"),
        (2, 4, '["d"]'),
        (3, 1, "[]"),
        (3, 2, '["e"]'),
    ]
    responses = spark.createDataFrame(replies, "batch_id bigint, attempt int, reply string")
    batches = spark.range(5).withColumnRenamed("id", "batch_id")
    three = L.first_valid_attempt(batches, responses, L.MAX_ATTEMPTS)  # a fourth attempt is not made
    assert {r.batch_id: r.urls for r in three.collect()} == {0: ["a"], 1: ["c", "c"], 2: [], 3: [], 4: []}
    assert rows(L.selected_urls(three)) == [("a",), ("c",), ("c",)]
    every = L.first_valid_attempt(batches, responses)
    assert {r.batch_id: r.urls for r in every.collect()} == {0: ["a"], 1: ["c", "c"], 2: ["d"], 3: [], 4: []}


def test_batches_and_prompts(spark):
    titles = spark.range(65).select(
        F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit('t "1"').alias("title")
    )
    batches = L.make_batches(titles, 30)
    assert [tuple(r) for r in batches.groupBy("batch_id").count().orderBy("batch_id").collect()] == [(0, 30), (1, 30), (2, 5)]
    prompts = L.selection_prompts(batches, L.ShopProfile(sells="lamps", product_titles=("Lamp X",))).orderBy("batch_id")
    last = prompts.collect()[-1].prompt
    assert "lamps" in last
    assert "Lamp X" in last
    assert "Preguntas Frecuentes" in last
    listed = ",".join(f'{{"url":"u{i}","title":"t \\"1\\""}}' for i in range(60, 65))
    assert last.endswith(f"\n\n[{listed}]")


def test_rule_select(spark):
    cases = [
        ("Contacto", False),
        (" contacto - Tienda", False),
        ("Preguntas Frecuentes", False),
        ("Política de devolución", False),
        ("Sudaderas Comfy", False),
        ("CAMISETA AZUL", True),
        ("Contactor eléctrico", True),
        (None, True),
    ]
    df = spark.createDataFrame([(i, title) for i, (title, _) in enumerate(cases)], "i int, title string")
    kept = {r.i for r in L.rule_select(df).collect()}
    assert kept == {i for i, (_, wanted) in enumerate(cases) if wanted}


def test_rule_select_takes_titles_as_written(spark):
    shop = L.ShopProfile(info_titles=("Who are we? (about)", "C++"), category_titles=())
    titles = ["Who are we? (about)", "Who are w about", "Learn C++ now", "C", "Kite"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    assert sorted(r.title for r in L.rule_select(df, shop).collect()) == ["C", "Kite", "Who are w about"]
    assert L.rule_select(df, L.ShopProfile(info_titles=(), category_titles=())).count() == 5


def test_keyword_prompts(spark):
    df = spark.createDataFrame([("T {description}", None)], "title string, description string")
    product = L.keyword_prompts(df).first().prompt
    assert product.startswith("Product: T {description}\nPage text: \n")
    assert "Kit Camper" in L.keyword_prompts(df, L.VIDEO_TEMPLATE).first().prompt


@pytest.mark.parametrize(
    ("reply", "has_price", "price", "keywords"),
    [
        ("9,95€, k1, k2, k3, k4", True, "9,95€", ["k1", "k2", "k3", "k4"]),
        ("1.234,50 €,k1", True, "1.234,50 €", ["k1"]),
        ("k1, k2", True, None, ["k1", "k2"]),
        ("Jumpy, Expert,Vivaro , Proace, Fifth", False, None, ["Jumpy", "Expert", "Vivaro", "Proace", "Fifth"]),
        ("Batería", False, None, ["Batería"]),
    ],
)
def test_parse_keywords(spark, reply, has_price, price, keywords):
    got = L.parse_keywords(spark.createDataFrame([("k", reply)], "key string, reply string"), has_price).first()
    assert (got.price, got.keywords) == (price, keywords)


def test_banned_keywords(spark):
    df = spark.createDataFrame([(["Jumpy", "kit camper", "Kit Camper X", "Jumpy"],)], "keywords array<string>")
    assert L.banned_keywords(df).first().keywords == ["Jumpy", "Kit Camper X", "Jumpy"]


def test_video_catalog(spark, rows):
    links = spark.createDataFrame([("https://www.youtube.com/watch?v=a",), ("https://www.youtube.com/watch?v=b",)], "value string")
    metadata = spark.createDataFrame([("a", "T")], "video_id string, title string")
    replies = spark.createDataFrame([("a", " k1, k2\n"), ("b", "x")], "key string, reply string")
    got = L.video_catalog(links, metadata, replies)
    assert got.columns == ["Link", "Iframe Link", "Title", "Keywords"]
    assert rows(got) == [("https://www.youtube.com/watch?v=a", "https://www.youtube.com/embed/a", "T", "k1, k2")]

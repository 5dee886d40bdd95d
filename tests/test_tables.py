"""Deduplication, joins, catalogue, order and counts."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import dedup as D
from shelfmark.operators import order as O
from shelfmark.operators import stats as A
from shelfmark.operators import urls as UF
from shelfmark.session import cut, cut_by, empty_table, run_folder

TITLES = "url string, title string, ord bigint"


def test_dedupe_first_keeps_rows_without_a_key(spark, rows):
    data = [("u0", "a", 0), ("u1", "b", 1), ("u2", "a", 2), ("u3", None, 3), ("u4", None, 4), ("u4", None, 4)]
    got = rows(D.dedupe_first(spark.createDataFrame(data, TITLES), "title", ["ord"]))
    assert got == [("u3", None, 3), ("u4", None, 4), ("u4", None, 4), ("u0", "a", 0), ("u1", "b", 1)] or got == sorted(
        [data[0], data[1], *data[3:]], key=str
    )
    assert len(got) == 5
    assert rows(D.dedupe_first(spark.createDataFrame(data, TITLES), "title", ["ord"], keep_null=False)) == [
        data[0],
        data[1],
    ]


def test_dedupe_first_twice_is_once_and_does_not_depend_on_partitions(spark, rows):
    rnd = random.Random(1)
    # a third of the rows have one title
    data = [(f"u{i}", "hot" if i % 3 == 0 else rnd.choice("abcde") * rnd.randint(1, 3), i) for i in range(3000)]
    want = {}
    for r in data:
        want.setdefault(r[1], r)
    for partitions in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = spark.createDataFrame(data, TITLES).repartition(partitions * 2)
        once = D.dedupe_first(df, "title", ["ord"])
        assert sorted(map(tuple, once.collect())) == sorted(want.values())
        assert rows(D.dedupe_first(once, "title", ["ord"])) == rows(once)
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_failed_rows_go_out(spark, rows):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "url string")
    assert rows(D.drop_failed(df)) == [("a",), ("b",)]


def test_absent_keeps_repeats_and_nulls(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "title string")
    known = spark.createDataFrame([("b",), ("b",), (None,)], "title string")
    assert rows(D.exclude_processed_titles(df, known)) == [(None,), ("a",), ("a",)]
    catalog = known.withColumnRenamed("title", "name")
    assert rows(D.titles_missing_from_catalog(df, catalog)) == [("a",), ("a",)]


def test_exclude_links_and_needle(spark, rows):
    df = spark.createDataFrame([("https://a.es/x?utm=1",), ("https://a.es/utm",), ("https://a.es/z",)], "url string")
    ignore = spark.createDataFrame([("https://a.es/z",), ("https://a.es/",)], "value string")
    assert UF.exclude_links(df, ignore).count() == 2
    assert UF.exclude_containing(df, "utm", "query").count() == 2
    assert UF.exclude_containing(df, "utm").count() == 1
    assert UF.exclude_containing(df, "").count() == 3  # every text contains the empty one
    assert UF.only_same_site(df, "https://www.a.es/").count() == 0


def test_missing_titles_and_their_status(spark, rows):
    read = spark.createDataFrame([("u0", "a"), ("u1", "a"), ("u2", None)], "url string, title string")
    kept = read.filter("url = 'u0'")
    assert rows(D.with_missing_titles(read, kept)) == [
        ("u0", "a"),
        ("u1", "Title not found"),
        ("u2", "Title not found"),
    ]
    assert [r[2] for r in rows(D.with_missing_titles(read, kept, read))] == ["kept", "duplicate", "missing"]


def test_combine_records_last_value_first_place(spark, rows):
    schema = "name string, record string, ord bigint"
    a = spark.createDataFrame([("n1", "x", 0)], schema)
    b = spark.createDataFrame([("n2", "y", 0), ("n1", "z", 1)], schema)
    assert rows(D.combine_records(a, b)) == [("n1", "z", 0, 0), ("n2", "y", 1, 0)]


def test_combine_catalogs_takes_the_first_and_all_columns(spark, rows):
    a = spark.createDataFrame([("n", 1, 0)], "name string, x int, ord int")
    b = spark.createDataFrame([("n", "y", 0), ("m", "z", 1)], "name string, y string, ord int")
    assert rows(D.combine_catalogs(a, b, ["ord"]).select("name", "x", "y")) == [("m", None, "z"), ("n", 1, None)]


def products(spark, *names):
    data = [(n, f"d{i}", "1", f"u{i}", f"i{i}") for i, n in enumerate(names)]
    return spark.createDataFrame(data, "title string, description string, price string, url string, image string")


def test_upsert(spark, rows):
    existing = products(spark, "A").withColumn("description", F.lit("old"))
    new = products(spark, " A ", "B", None, "B", "\nC")
    for unique in (False, True):
        got = C.upsert_catalog(existing, new, ["url"], existing_is_unique=unique)
        assert got.columns == C.CATALOG_COLUMNS
        assert rows(got.select("name", "description", "url", "keywords")) == [
            ("A", "old", "u0", "A"),
            ("B", "d1", "u1", "B"),
            ("C", "d4", "u4", "C"),
        ]
        again = C.upsert_catalog(got, new, ["url"], existing_is_unique=unique)
        assert rows(again) == rows(got)  # twice is once
        assert C.total_products(again).first()[0] == 3


def test_upsert_into_nothing(spark):
    empty = empty_table(spark, C.CATALOG_SCHEMA)
    assert C.upsert_catalog(empty, products(spark, "A", "A"), ["url"]).count() == 1


def test_sort_puts_missing_names_last(spark):
    df = spark.createDataFrame([(None, 1), ("b", 1), ("a", 2), ("a", 1)], "name string, x int")
    assert [tuple(r) for r in C.sort_by_name(df).collect()] == [("a", 1), ("a", 2), ("b", 1), (None, 1)]


def test_require_price_and_available_columns(spark):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "name string, price string")
    assert C.require_price(df).count() == 1
    assert C.require_price(df, allow_no_price=True).count() == 2
    assert C.select_available(df.withColumn("other", F.lit(1)).select("other", "price", "name")).columns == ["name", "price"]


def test_row_index_is_the_sorted_position(spark):
    rnd = random.Random(5)
    keys = [(rnd.randint(0, 40), i) for i in range(5000)]
    rnd.shuffle(keys)
    df = spark.createDataFrame(keys, "k int, i int").repartition(7)
    got = {(r.k, r.i): r.idx for r in O.row_index(df, ["k", "i"]).collect()}
    assert got == {key: n for n, key in enumerate(sorted(keys))}
    assert O.row_index(df.filter("k < 0"), ["k", "i"]).count() == 0


def test_a_run_folder_is_removed(spark):
    with run_folder(spark) as folder:
        assert cut(spark.range(3)).count() == 3
        assert cut_by(spark.range(3), "id").count() == 3
        assert len(list(Path(folder).iterdir())) == 2
    assert not Path(folder).exists()
    assert cut(spark.range(3)).count() == 3


def test_limits(spark):
    df = spark.range(1000)
    assert [r.id for r in O.last_n(df, 5, ["id"]).collect()] == [999, 998, 997, 996, 995]
    assert sorted(r.id for r in O.take_until(df, 7, ["id"]).collect()) == list(range(7))
    assert O.take_until(df, 0, ["id"]).count() == 0
    assert O.last_n(df, 2000, ["id"]).count() == 1000
    assert sorted(r.id for r in O.take_until(df, 600, ["id"]).collect()) == list(range(600))


def test_batch_running_stats(spark):
    schema = "crawl_id string, batch_id bigint, n_urls bigint, seconds double"
    data = [("c", 0, 50, 2.0), ("c", 1, 50, 4.0), ("c", 2, 50, 6.0), ("d", 5, 1, 0.5)]
    for block in (1, 2, 100):
        got = A.batch_running_stats(spark.createDataFrame(data, schema), block).orderBy("crawl_id", "batch_id").collect()
        assert [tuple(r)[2:] for r in got] == [(1, 50, 2.0), (2, 100, 3.0), (3, 150, 4.0), (1, 1, 0.5)]


def test_stage_counts(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    assert rows(A.stage_counts(x=df, y=df.limit(0))) == [("x", 3, 2), ("y", 0, 0)]

"""Streams: same result as a batch, restart, replay, target."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import html as H
from shelfmark.plans.shop import shop_pages
from shelfmark.session import empty_table
from shelfmark.streaming import pages as R
from shelfmark.operators.catalog import CATALOG_SCHEMA, upsert_catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return shop_pages(spark, SF).filter("page_id < 60").cache()


def products(batch):
    return H.extract_fields(batch).filter("title is not null")


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_stream_equals_batch_after_a_restart(spark, pages, tmp_path):
    source, target, state = (f"{tmp_path}/{n}" for n in ("pages", "catalog", "state"))

    def start():
        return R.stream_upsert(R.stream_pages(spark, source, 2), products, target, state, ("page_id",))

    def catalog():
        return R.read_stream_catalog(spark, target)

    assert catalog().count() == 0
    pages.filter("page_id < 30").repartition(3).write.parquet(source)
    first = R.run_until_target(start, catalog, 1)
    pages.filter("page_id >= 30").repartition(2).write.mode("append").parquet(source)
    pages.filter("page_id < 10").write.mode("append").parquet(source)  # seen before
    held = R.run_until_target(start, catalog, 1_000_000)
    assert held > first
    batch = upsert_catalog(empty_table(spark, CATALOG_SCHEMA), products(pages), ["page_id"])
    assert names(catalog()) == names(batch)
    assert R.run_until_target(start, catalog, 1_000_000) == held  # nothing new
    R.compact(spark, target, f"{tmp_path}/compact")
    compacted = spark.read.parquet(f"{tmp_path}/compact")
    assert names(compacted) == names(batch)
    # on top of what was compacted, the same pages add nothing
    R.upsert_batch(products(pages), 0, f"{tmp_path}/next", ("page_id",), compacted)
    assert R.read_stream_catalog(spark, f"{tmp_path}/next").count() == 0


def test_two_streams_share_a_folder(spark, pages, tmp_path):
    target = f"{tmp_path}/catalog"
    for n, part in enumerate(("page_id < 30", "page_id >= 20")):
        pages.filter(part).write.parquet(f"{tmp_path}/pages{n}")
        source = R.stream_pages(spark, f"{tmp_path}/pages{n}")
        R.stream_upsert(source, products, target, f"{tmp_path}/state{n}", ("page_id",)).awaitTermination()
    batch = upsert_catalog(empty_table(spark, CATALOG_SCHEMA), products(pages), ["page_id"])
    assert names(R.read_stream_catalog(spark, target)) == names(batch)


def test_a_stream_ends_with_the_batch_that_meets_its_target(spark, pages, tmp_path):
    source, folder = f"{tmp_path}/pages", f"{tmp_path}/catalog"
    for n in range(4):  # a batch for each file
        pages.filter(f"page_id div 15 = {n}").coalesce(1).write.mode("append").parquet(source)

    def start(target):
        stream = R.stream_pages(spark, source, 1)
        return lambda: R.stream_upsert(stream, products, folder, f"{tmp_path}/state", ("page_id",), target=target)

    def catalog():
        return R.read_stream_catalog(spark, folder)

    first = R.run_until_target(start(2), catalog, 2)
    assert first >= 2
    assert {r.batch for r in catalog().select("batch").collect()} == {0}
    assert R.run_until_target(start(2), catalog, 2) == first
    every = R.run_until_target(start(None), catalog, 1_000_000)
    assert names(catalog()) == names(upsert_catalog(empty_table(spark, CATALOG_SCHEMA), products(pages), ["page_id"]))
    assert every > first


def test_target_met_starts_nothing(spark, tmp_path):
    def start():
        raise AssertionError("not needed")

    assert R.run_until_target(start, lambda: spark.range(5), 5) == 5


def test_a_batch_run_again_changes_nothing(spark, pages, tmp_path):
    folder = f"{tmp_path}/catalog"
    R.upsert_batch(products(pages.filter("page_id < 20")), 0, folder, ("page_id",))
    R.upsert_batch(products(pages.filter("page_id < 40")), 1, folder, ("page_id",))
    once = names(R.read_stream_catalog(spark, folder))
    R.upsert_batch(products(pages.filter("page_id < 40")), 1, folder, ("page_id",))
    assert names(R.read_stream_catalog(spark, folder)) == once
    assert len(once) == len(set(once))


def test_dedupe_within_the_watermark(spark, tmp_path):
    data = spark.range(20).select(
        F.concat(F.lit("u"), F.col("id") % 7).alias("url"), F.timestamp_seconds(F.col("id") * 60).alias("fetched")
    )
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    query = (
        R.stream_dedupe(stream, "url", "fetched", "1 hour")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [f"u{i}" for i in range(7)]

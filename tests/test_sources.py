"""What is written comes back; text formats to the byte."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import dedup as D
from shelfmark.session import checkpoint_dir, cut
from shelfmark.sources import readers as R
from shelfmark.sources import writers as W

CATALOG = [("B", 'd "q",\nx', "1,00€", "u1", "i1", "B"), ("A", None, None, "u0", None, "A")]


def catalog(spark):
    return spark.createDataFrame(CATALOG, C.CATALOG_SCHEMA)


def text_of(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_read_pages_keeps_what_loaded(spark, tmp_path, rows):
    data = [(0, "u0", "h", 200, "text/html; charset=x"), (1, "u1", "h", 404, "text/html"), (2, "u2", "h", 200, "image/png")]
    schema = "page_id bigint, url string, html string, status int, content_type string"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/p")
    assert rows(R.read_pages(spark, f"{tmp_path}/p").select("page_id")) == [(0,)]
    assert R.read_pages(spark, f"{tmp_path}/p", loaded_only=False).count() == 3
    spark.read.parquet(f"{tmp_path}/p").select("page_id", "url", "html").write.parquet(f"{tmp_path}/q")
    assert R.read_pages(spark, f"{tmp_path}/q").count() == 3  # nothing says how they loaded


def test_lines(spark, tmp_path, rows):
    (tmp_path / "l.txt").write_text(" a \n\nb \n")
    assert rows(R.read_lines(spark, f"{tmp_path}/l.txt")) == [("",), ("a",), ("b",)]
    assert rows(R.read_lines(spark, f"{tmp_path}/l.txt", drop_empty=True)) == [("a",), ("b",)]


def test_catalog_round_trip(spark, tmp_path, rows):
    for fmt in ("parquet", "csv"):
        folder = f"{tmp_path}/{fmt}"
        W.write_catalog(catalog(spark), folder, fmt)
        W.write_catalog(catalog(spark), folder, fmt)  # replaces
        assert rows(R.read_catalog(spark, folder, fmt)) == rows(catalog(spark))
    files = sorted(Path(f"{tmp_path}/csv").glob("part-*"))
    assert "".join(f.read_text().split("\n", 1)[1] for f in files).startswith("A,")  # in order of name


def test_text_formats(spark, tmp_path):
    df = catalog(spark).filter("name = 'B'")
    plain = 'B\nPrecio: 1,00€\n\nd "q",\nx\n\nInformación extraída de [B](u1)\n\n-------\n\n'
    assert W.to_product_text(df).first()[0] == plain
    W.write_product_text(df, f"{tmp_path}/t")
    assert text_of(f"{tmp_path}/t") == plain
    W.write_product_text(df.union(df).coalesce(1), f"{tmp_path}/i", "iva")
    one = 'B\nPrecio: 1,00€ (IVA incluido)\n\nd "q",\nx\n\nInformación extraída de [B](u1)\n\n-------\n'
    assert text_of(f"{tmp_path}/i") == one + "\n" + one + "\n"
    missing = W.to_product_text(catalog(spark).filter("name = 'A'")).first()[0]
    assert "Precio: Price not found\n\nDescription not found" in missing


def test_records_of_text_files_merge(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("n1\nold\n-------\n\nn2\nx\n-------\n")
    (tmp_path / "b.txt").write_text("\nn1 \nnew\n-------\n  \n-------\n")
    a = R.read_product_records(spark, f"{tmp_path}/a.txt")
    b = R.read_product_records(spark, f"{tmp_path}/b.txt")
    assert rows(a.select("name")) == [("n1",), ("n2",)]
    assert rows(b.select("name")) == [("n1",)]
    merged = D.combine_records(a, b).orderBy("source", "ord").collect()
    assert [(r.name, r.record.strip().split("\n")[-1]) for r in merged] == [("n1", "new"), ("n2", "x")]


def test_log_is_appended_and_read_back_as_columns(spark, tmp_path, rows):
    log = spark.createDataFrame([("u0", "a: b"), ("u1", "Title not found")], "url string, title string")
    W.append_processed_log(log.filter("url = 'u0'"), f"{tmp_path}/log")
    W.append_processed_log(log.filter("url = 'u1'"), f"{tmp_path}/log")
    held = spark.read.parquet(f"{tmp_path}/log")
    assert rows(held) == rows(log)
    assert rows(W.log_lines(held)) == [("Title not found: u1",), ("a: b: u0",)]
    assert rows(W.logged_titles(held)) == [("a: b",)]
    assert D.exclude_processed_urls(log, held).count() == 0


def test_run_numbers(spark, rows):
    runs = spark.createDataFrame([("a", 1, "{}"), ("a", 3, "{}"), ("b", 1, "{}")], W.RUNS_SCHEMA)
    assert rows(W.next_execution(runs)) == [("a", 4), ("b", 2)]
    assert rows(W.next_execution(runs, fixed=True)) == [("a", 3), ("b", 1)]
    assert W.execution_number(runs, "new", fixed=True) == 0
    assert W.execution_number(runs, "new") == 1
    assert W.execution_number(runs, "a", fixed=True) == 3
    row = W.run_config_row(spark, "a", 4, {"limit": 10, "tags": ["x"], "og": True})
    assert (row.first().site, row.first().execution) == ("a", 4)
    assert json.loads(row.first().config_json) == {"limit": 10, "og": True, "tags": ["x"]}


def test_run_output_replaces_its_own_run_only(spark, tmp_path, rows):
    for execution, df in [(1, spark.range(3)), (2, spark.range(5)), (1, spark.range(1))]:
        W.write_run_output(df, f"{tmp_path}/r", "a.es", execution)
    assert rows(spark.read.parquet(f"{tmp_path}/r").groupBy("execution").count()) == [(1, 1), (2, 5)]


def test_url_list(spark, tmp_path, rows):
    W.write_url_list(spark.createDataFrame([("u1",), ("u0",)], "url string"), f"{tmp_path}/u")
    assert rows(R.read_lines(spark, f"{tmp_path}/u")) == [("u0",), ("u1",)]


def test_checkpoint_dir_is_the_clusters(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    folder = checkpoint_dir(spark)
    assert folder == checkpoint_dir(spark)
    if given:
        assert folder == given.rstrip("/")
    table = cut(spark.range(3))
    assert table.count() == 3
    assert folder in table.inputFiles()[0]


def test_reading_takes_only_the_columns_asked_for(spark, tmp_path):
    W.write_catalog(catalog(spark), f"{tmp_path}/c")
    held = R.read_catalog(spark, f"{tmp_path}/c").select("url").filter(F.col("url") == "u1")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
    assert "EqualTo(url,u1)" in plan

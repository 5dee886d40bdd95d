"""The registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import fresh_folder, table
from . import bpe, embeddings, exact, licenses, lines, merkle, mixing, quality, secrets, simhash, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The tokenizer file of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.summary(warc.read(spark, folder))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mix": op1_mix,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_embeddings": op4_embeddings,
    "op5_warc": op5_warc,
    "op6_lines": op6_lines,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_merkle": op11_merkle,
    "op12_exact": op12_exact,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_mix": mixing.ORACLE,
    "op2_licenses": licenses.oracle(),
    "op4_embeddings": embeddings.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_lines": lines.ORACLE,
    "op8_secrets": secrets.oracle(),
    "op11_merkle": merkle.oracle(),
    "op12_exact": exact.ORACLE,
}

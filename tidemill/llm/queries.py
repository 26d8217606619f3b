"""The registered queries of the operators, one opN_<name> each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspolytope, htmltext, licenses, mixing, quality, sentencepieces, simhash, suffixdedup, telephony, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), digests=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.search(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.round_trip(table(spark, sf_dir, "documents"), to=16000)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_suffix_dedup, op3_mixing, op4_quality, op5_cross_polytope, op6_html, op7_sentencepiece, op8_telephony, op9_licenses, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.report_sql(), "op9_licenses": licenses.scan_sql()}

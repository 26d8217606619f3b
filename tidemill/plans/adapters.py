"""The driver's tables in the shape of postings, subscriptions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
SUBSCRIPTIONS = [
    ("u1", "SUB#ring", "ring", "ring", "", True, 1),
    ("u1", "SUB#red widget", "Red Widget", "red widget", "Brand#1", True, 2),
    ("u1", "SUB#bolt", "bolt", "bolt", "", False, 3),
    ("u2", "SUB#anvil, blue", "anvil, blue", "anvil, blue", "brand#2", True, 1),
    ("u2", "SUB#gear", "GEAR", "gear", "", True, 2),
    ("u3", "PROFILE", "", "", "", True, 1),
    ("u3", "SUB#small", "small", "small", "", True, 2),
    ("u4", "SUB# ", " ", " ", "", True, 1),
]
SUB_SCHEMA = "user_id string, sk string, keyword_raw string, keyword_normalized string, location_filter string, is_active boolean, sub_ord int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, SUB_SCHEMA)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw postings: the first line is the title, source and language stand for company and place."""
    minute = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("company"), F.col("lang").alias("location"), F.lit("").alias("salary_raw"),
        F.col("text").alias("description"), F.lit("").alias("requirements"), F.lit("").alias("job_type_raw"), "source",
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("https://example.org/"), "doc_id")).alias("source_url"), F.lit("").alias("posted_at_raw"), minute.alias("scraped_at"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as searchable postings."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 28).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"), F.col("p_name").alias("title_normalized"), F.col("p_brand").alias("company"), F.col("p_brand").alias("location"),
        F.col("p_brand").alias("location_normalized"), F.concat(F.lit("$"), F.col("p_size").cast("string")).alias("salary_raw"), F.array(F.lower("p_type")).alias("tags"), F.lower("p_type").alias("source"),
        F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("source_url"), day.alias("posted_at"), F.lit("").alias("scraped_at"),
        F.lit("").alias("description"), F.lit("").alias("requirements"), (F.col("p_size") * 1000).cast("long").alias("salary_max"),
    )


def salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as salary texts of many forms."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = (
        F.when(n == 1, F.format_string("%d - %d triệu", q, q + 5)).when(n == 2, F.format_string("$%d", F.col("l_extendedprice").cast("int"))).when(n == 3, F.lit("Thỏa thuận"))
        .when(n == 4, F.format_string("Trên %d,500 USD", q)).when(n == 5, F.format_string("%d.000.000 VNĐ", q)).when(n == 6, F.format_string("%d - 90 tr, thưởng", q)).otherwise("")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("salary_raw"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as posting dates of many forms, seen from the ship date."""
    n, day = F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp")
    text = (
        F.when(n == 1, F.format_string("%d days ago", F.col("l_quantity").cast("int"))).when(n == 2, F.date_format(day, "dd/MM/yyyy")).when(n == 3, F.date_format(day, "yyyy-MM-dd"))
        .when(n == 4, F.format_string("%d ngày trước", F.col("l_quantity").cast("int"))).when(n == 5, F.lit("Vừa xong")).when(n == 6, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("yesterday")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("posted_at_raw"), day.alias("base"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", "props")

"""Row shapes of postings, subscriptions and reports."""

from __future__ import annotations

from pyspark.sql import types as T

# The boards that a posting may come from, and the kinds of jobs.
SOURCES = ["jooble", "careerlink", "timviecnhanh", "vieclam24h", "mywork", "itviec", "careerviet", "timviec365", "ybox"]
JOB_TYPES = ["full_time", "part_time", "contract", "internship", "remote", "freelance", "unknown"]

TEXTS = ["title", "company", "location", "salary_raw", "description", "requirements", "job_type_raw", "source", "source_url", "posted_at_raw"]
RAW = T.StructType([T.StructField(n, T.StringType()) for n in TEXTS] + [T.StructField("scraped_at", T.TimestampType())])
#: A queue message: the raw posting as JSON, with the time as ISO text.
MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in [*TEXTS, "scraped_at"]] + [T.StructField("_corrupt", T.StringType())])
SUBSCRIPTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("user_id", "sk", "keyword_raw", "keyword_normalized", "location_filter")]
    + [T.StructField("salary_min_filter", T.LongType()), T.StructField("is_active", T.BooleanType()), T.StructField("created_at", T.StringType()), T.StructField("last_matched_at", T.StringType()), T.StructField("match_count", T.IntegerType())]
)
USER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("user_id", "sk", "username", "first_name")]
    + [T.StructField("is_active", T.BooleanType()), T.StructField("created_at", T.StringType()), T.StructField("last_notified_at", T.StringType())]
)
API_PAGE = "struct<jobs: array<struct<title: string, location: string, snippet: string, salary: string, type: string, link: string, company: string, updated: string>>, totalCount: bigint>"
ADS_PAGE = "struct<Ads: struct<edges: array<struct<post: struct<title: string, summary: string, slug: string, publisher: struct<fullName: string, username: string>, publishedAt: string, acceptedAt: string>>>>>"

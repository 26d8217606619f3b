"""JSON sources: API pages, embedded JSON, queue messages; and all sources together."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from . import boards


# The API's address, the place that is asked for, and its fields.
API, API_PLACE = "https://jooble.org/api", "Vietnam"
API_FIELDS = {"title": "title", "company": "company", "location": "location", "salary": "salary_raw", "snippet": "description", "type": "job_type_raw", "link": "source_url", "updated": "posted_at_raw"}


def api_page(body: str) -> list[dict[str, str]]:
    """Titled postings of one answer of the API; a body that is no JSON object is a ValueError."""
    answer = json.loads(body)
    if not isinstance(answer, dict):
        raise ValueError("the answer is no object")
    jobs = [{v: "" if job.get(k) is None else str(job[k]) for k, v in API_FIELDS.items()} for job in answer.get("jobs") or [] if isinstance(job, dict)]
    return [job | {"title": job["title"].strip()} for job in jobs if job["title"].strip()]


def api_postings(pages: DataFrame, body: str = "body", source: str = "jooble") -> DataFrame:
    """Rows of an API's pages (a JSON text each); untitled ones are left out."""
    job = F.explode(F.from_json(body, schema.API_PAGE)["jobs"]).alias("j")
    rows = pages.select(job).select(*[F.coalesce(F.col(f"j.{k}"), F.lit("")).alias(v) for k, v in API_FIELDS.items()], F.lit(source).alias("source"))
    return rows.withColumn("title", text.strip(F.col("title"))).where("title != ''")


def embedded_json(html: Column, variable: str = "INITIAL_ADS") -> Column:
    """The JSON object in the script that sets a variable, from its first to its last brace."""
    script = F.regexp_extract(html, rf"(?s)<script[^>]*>((?:(?!</script>).)*?{variable}(?:(?!</script>).)*)</script>", 1)
    return F.nullif(F.regexp_extract(script, r"(?s)(\{.*\})", 1), F.lit(""))


def ads(pages: DataFrame, html: str = "html", keyword: str = "") -> DataFrame:
    """Posts of pages with embedded JSON whose title or summary holds the keyword."""
    post = pages.select(F.explode(F.from_json(embedded_json(F.col(html)), schema.ADS_PAGE)["Ads"]["edges"]).alias("e")).select("e.post.*")
    word = F.lower(F.trim(F.lit(keyword)))
    held = F.contains(F.lower(F.coalesce("title", F.lit(""))), word) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), word)
    title = text.strip(F.col("title"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    low, bracket = F.lower(title), F.regexp_extract(title, r"^\[([^\]]+)\]", 1)
    place = F.when(bracket != "", text.strip(bracket)).when(low.rlike("hcm|hồ chí minh|sài gòn"), "Hồ Chí Minh").when(low.rlike("hn|hà nội"), "Hà Nội").otherwise("Việt Nam")
    labelled = F.regexp_extract(title, r"(?iu)(?:lương|thu nhập)[:\s]*([0-9\s\-.,trTriệu]+(?:\+/)?(?:\s*tháng)?)", 1)
    millions = F.regexp_extract(title, r"(?iu)([0-9\s\-.,tr]+tr(?:iệu)?(?:/tháng)?)", 1)
    salary = F.coalesce(F.nullif(text.strip(labelled), F.lit("")), F.nullif(text.strip(millions), F.lit("")), F.lit("Thỏa thuận"))
    return post.where(held & (title != "") & (F.coalesce("slug", F.lit("")) != "")).select(
        title.alias("title"), F.coalesce(empty("publisher.fullName"), empty("publisher.username"), F.lit("Ybox Employer")).alias("company"), place.alias("location"), salary.alias("salary_raw"),
        text.strip(F.coalesce("summary", F.lit(""))).alias("description"), F.lit("ybox").alias("source"), F.concat(F.lit("https://ybox.vn/tuyen-dung/"), "slug").alias("source_url"),
        F.coalesce(empty("publishedAt"), empty("acceptedAt"), F.lit("")).alias("posted_at_raw"),
    )


def consume(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(raw rows, quarantine) of JSON queue messages. Bad JSON, no title or an unknown source is quarantined."""
    rows = messages.select(F.col(value).alias("__value"), F.from_json(value, schema.MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("__value", "r.*")
    good = F.col("_corrupt").isNull() & F.col("title").isNotNull() & F.col("source").isin(*schema.SOURCES)
    good = F.coalesce(good, F.lit(False))
    raw = rows.where(good).select(*[F.coalesce(n, F.lit("")).alias(n) for n in schema.TEXTS], F.coalesce(F.try_to_timestamp("scraped_at"), F.current_timestamp()).alias("scraped_at"))
    return raw, rows.where(~good).select(F.col("__value").alias(value))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def registry(api_key: str | None = None) -> list[str]:
    """Sources that a scan visits; the API only with a key, aliases never."""
    return (["jooble"] if api_key else []) + [b for b in boards.BOARDS if b not in boards.ALIASES]

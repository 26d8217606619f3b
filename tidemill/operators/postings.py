"""From raw postings to stored ones: validation, quality reports, transformation, identity, upsert, expiry."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, parse, text
from ..schema import TEXTS

MIN_TITLE, TEXT_LIMIT, KEEP_DAYS = 3, 2000, 60


def filled(raw: DataFrame) -> DataFrame:
    """Missing and null text columns as empty texts; title and company trimmed."""
    for name in TEXTS:
        raw = raw.withColumn(name, F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit(""))
    return raw.withColumn("title", text.strip(F.col("title"))).withColumn("company", text.strip(F.col("company")))


def blank(name: str) -> Column:
    return text.strip(F.coalesce(F.col(name), F.lit(""))) == ""


def missing(name: str) -> Column:
    """Null or empty; white space counts as a value, but for titles and companies, which are trimmed."""
    return blank(name) if name in ("title", "company") else F.coalesce(F.col(name), F.lit("")) == ""


def issues(raw: DataFrame) -> DataFrame:
    """Adds is_valid and issues. Only a blank title makes a row invalid; a titled one may get warnings."""
    short = F.length(text.strip(F.col("title"))) < MIN_TITLE
    warned = F.array_compact(F.array(F.when(short, "WARNING: title too short"), F.when(missing("company"), "WARNING: missing company"), F.when(missing("source_url"), "WARNING: missing url")))
    return raw.withColumn("is_valid", ~blank("title")).withColumn("issues", F.when(blank("title"), F.array(F.lit("CRITICAL: missing title"))).otherwise(warned))


def valid(raw: DataFrame) -> DataFrame:
    return raw.where(~blank("title"))


def processed_issues(jobs: DataFrame) -> DataFrame:
    """The same for transformed rows: a title and an id are needed; salaries are looked at where both are given."""
    no_title, no_id = F.coalesce(F.col("title_normalized"), F.lit("")) == "", F.coalesce(F.col("job_id"), F.lit("")) == ""
    both = (F.coalesce(F.col("salary_min"), F.lit(0)) != 0) & (F.coalesce(F.col("salary_max"), F.lit(0)) != 0)
    found = F.array(
        F.when(no_title, "CRITICAL: missing normalized title"), F.when(no_id, "CRITICAL: missing id"), F.when(F.coalesce(F.col("source_url"), F.lit("")) == "", "WARNING: missing url"),
        F.when(both & (F.col("salary_min") > F.col("salary_max")), "WARNING: salary range reversed"), F.when(both & (F.col("salary_min") < 0), "WARNING: negative salary"),
    )
    return jobs.withColumn("is_valid", ~(no_title | no_id)).withColumn("issues", F.array_compact(found))


def quality(raw: DataFrame, *by: str) -> DataFrame:
    """Counters and ratios over all rows, or per group; one pass, with partial aggregation.

    A row without a title is not looked at further: its company and address don't count as missing, its
    location and salary do.
    ``warnings`` stays 0, as in the original report; ``warning_count`` counts valid rows with a warning.
    """
    count = lambda c: F.count_if(c).cast("long")
    rows = issues(raw)
    titled = F.lower(text.strip(F.coalesce(F.col("title"), F.lit(""))))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total"), count(F.col("is_valid")).alias("passed"), count(~F.col("is_valid")).alias("failed"), F.lit(0).cast("long").alias("warnings"),
        count(blank("title")).alias("missing_title"), count(F.col("is_valid") & missing("company")).alias("missing_company"), count(missing("location")).alias("missing_location"),
        count(missing("salary_raw")).alias("missing_salary"), count(F.col("is_valid") & missing("source_url")).alias("missing_url"),
        count(F.col("is_valid") & (F.length(text.strip(F.col("title"))) < MIN_TITLE)).alias("title_too_short"),
        (F.count("*") - F.count_distinct(titled)).alias("duplicate_titles"), count(F.col("is_valid") & (F.size("issues") > 0)).alias("warning_count"),
    )
    gaps = sum((F.col(f"missing_{n}") for n in ("company", "location", "salary", "url")), F.col("missing_title"))
    rate = lambda a, b: F.bround(F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0)), 1)
    return out.withColumn("pass_rate", rate(F.col("passed"), F.col("total"))).withColumn("completeness", rate(5 * F.col("total") - gaps, 5 * F.col("total")))


def source_summary(raw: DataFrame) -> DataFrame:
    """scraped, valid and pass rate per source, and the total under a null source."""
    out = raw.rollup("source").agg(F.count("*").alias("scraped"), F.count_if(~blank("title")).cast("long").alias("valid"))
    return out.withColumn("pass_rate", F.bround(F.coalesce(F.try_divide(F.col("valid") * 100.0, F.col("scraped")), F.lit(0.0)), 1))


def etl_summary(raw: DataFrame) -> DataFrame:
    """raw, transformed and loaded rows of a batch: all, those whose salary can be read, and those of their own title and company. One pass."""
    good = ~parse.salary(F.col("salary_raw"))["bad"]
    rows = filled(raw).select(good.alias("good"), identity.cross_source_id(text.composed(text.normalize_text(F.col("title"))), F.col("company")).alias("id"))
    return rows.agg(F.count("*").alias("raw"), F.count_if("good").alias("transformed"), F.count_distinct(F.when(F.col("good"), F.col("id"))).alias("loaded"))


def transform(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Raw rows to postings, one projection; rows whose salary can't be read go. Titles come out in normal form C."""
    out = filled(raw).select("*", text.composed(text.normalize_text(F.col("title"))).alias("title_normalized"), parse.salary(F.col("salary_raw"), strict).alias("__salary"), parse.posted_at(F.col("posted_at_raw"), F.col("scraped_at"), strict).alias("__posted"))
    out = out.where(~F.col("__salary.bad"))
    return out.select(
        identity.posting_id(F.col("title_normalized"), F.col("company"), F.col("source")).alias("job_id"), "title", "title_normalized", "company", "location",
        parse.location(F.col("location")).alias("location_normalized"), "salary_raw", F.col("__salary.low").alias("salary_min"), F.col("__salary.high").alias("salary_max"),
        "description", "requirements", parse.job_type(F.col("job_type_raw"), F.col("title"), F.col("description")).alias("job_type"),
        parse.tags(F.col("title"), F.col("description"), F.col("requirements")).alias("tags"), "source", "source_url",
        F.col("__posted.ts").alias("posted_at"), F.col("__posted.naive").alias("posted_at_is_naive"), "scraped_at", F.lit(True).alias("is_new"),
    )


def stored(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The stored form: long texts cut, times as ISO text, the source and day as a sort key, a time to live."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    short = lambda c: F.substring(c, 1, TEXT_LIMIT)
    return jobs.select(
        "job_id", F.concat_ws("#", "source", F.date_format("scraped_at", "yyyy-MM-dd")).alias("source_posted"), "title", "title_normalized", "company", "location", "location_normalized",
        "salary_raw", "salary_min", "salary_max", short(F.col("description")).alias("description"), short(F.col("requirements")).alias("requirements"), "job_type", "tags", "source", "source_url",
        iso(F.col("posted_at")).alias("posted_at"), iso(F.col("scraped_at")).alias("scraped_at"), "is_new", (F.unix_timestamp(as_of) + KEEP_DAYS * 86400).alias("ttl"),
    )


def live(items: DataFrame, as_of: Column) -> DataFrame:
    """Rows that haven't expired."""
    return items.where(F.col("ttl") > F.unix_timestamp(as_of))


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in order; the survivor is always the same one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedup(jobs: DataFrame, order: list[Column], cross_source: bool = True) -> DataFrame:
    """First posting of each title and company (and source, unless ``cross_source``) within a batch."""
    key = identity.cross_source_id(F.col("title_normalized"), F.col("company")) if cross_source else identity.posting_id(F.col("title_normalized"), F.col("company"), F.col("source"))
    return first_wins(jobs, [key], order)


def new_only(rows: DataFrame, existing: DataFrame, key: str = "job_id") -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def known_only(rows: DataFrame, existing: DataFrame, key: str = "job_id") -> DataFrame:
    return rows.join(existing.select(key).distinct(), key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: str = "job_id", order: list[Column] | None = None) -> DataFrame:
    """Whole rows replaced by key; of new rows with one key the last in order stays."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = [F.col("__new").desc(), *[c.desc() for c in order or []]]
    return first_wins(both, [F.col(key)], last).drop("__new")


#: Parts that a store is cut into by its key; an upsert rewrites only the parts that the new rows touch.
STORE_PARTS = 64
#: Versions that stay readable behind the newest one.
KEPT_VERSIONS = 2


def _files(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, uri: str) -> list[str]:
    files, path = _files(spark, uri)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:12]) for n in _names(spark, f"{path}/_versions") if re.fullmatch(r"\d{12}\.json", n)]


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/_versions/{version:012d}.json", wholetext=True).first()[0])


def save_upsert(path: str, new: DataFrame, key: str = "job_id", order: list[Column] | None = None, batch: int | None = None, parts: int = STORE_PARTS) -> int:
    """Upsert into a Parquet store; returns the rows of ``new`` that count (0 for a ``batch`` that is in it already).

    The store is cut into parts by a hash of the key; only parts that new rows fall into are written anew,
    into a folder of this version. A version is a manifest: the folder of each part and the batch it ends
    with. Manifests are only ever added, each under its own number by one rename, and the newest one
    counts, so a crash at any point leaves the version before it whole, and readers never see half of one.
    Of two writers at once the second rename fails. Folders that the last ``KEPT_VERSIONS`` manifests don't
    name go afterwards; older readers should be done by then.
    """
    spark = new.sparkSession
    seen = _versions(spark, path)
    last = _manifest(spark, path, seen[-1]) if seen else {"parts": parts, "folders": {}, "batch": None}
    if batch is not None and last["batch"] is not None and batch <= last["batch"]:
        return 0
    parts, number = last["parts"], (seen[-1] + 1 if seen else 1)
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    new.withColumn("__part", part).write.parquet(staged)  # read twice below
    new = spark.read.parquet(staged)
    counts = {r[0]: r[1] for r in new.groupBy("__part").count().collect()}  # at most ``parts`` rows
    old = [f for k, f in last["folders"].items() if int(k) in counts]
    rows = new.drop("__part")
    existing = spark.read.parquet(*[f"{path}/{f}" for f in old]) if old else rows.limit(0)
    merged = upsert(existing, rows, key, order).withColumn("__part", part)
    folder = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
    merged.repartition("__part").write.partitionBy("__part").parquet(f"{path}/{folder}")
    folders = last["folders"] | {str(k): f"{folder}/__part={k}" for k in counts}
    _publish(spark, f"{path}/_versions", number, {"parts": parts, "folders": folders, "batch": last["batch"] if batch is None else batch})
    files, old_staged = _files(spark, f"{path}/_staged")
    files.delete(old_staged, True)
    _vacuum(spark, path)
    return sum(counts.values())


def _publish(spark: SparkSession, folder: str, number: int, manifest: dict) -> None:
    """Write a manifest under a temporary name, then give it its number; the number must be free."""
    files, final = _files(spark, f"{folder}/{number:012d}.json")
    _, temporary = _files(spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(final) or not files.rename(temporary, final):
        raise FileExistsError(f"another writer published version {number} first")


def _vacuum(spark: SparkSession, path: str) -> None:
    """Delete manifests older than the kept ones, and the part folders that none of the kept ones names."""
    seen = _versions(spark, path)
    kept = seen[-1 - KEPT_VERSIONS :]
    named = {f for v in kept for f in _manifest(spark, path, v)["folders"].values()}
    for version in seen[: -1 - KEPT_VERSIONS]:
        files, old = _files(spark, f"{path}/_versions/{version:012d}.json")
        files.delete(old, False)
    for folder in _names(spark, f"{path}/data"):
        if int(folder[:12]) < kept[0]:
            parts = [n for n in _names(spark, f"{path}/data/{folder}") if n.startswith("__part=")]
            live = [n for n in parts if f"data/{folder}/{n}" in named]
            for n in [""] if not live else [n for n in parts if n not in live]:
                files, old = _files(spark, f"{path}/data/{folder}/{n}".rstrip("/"))
                files.delete(old, True)


def load_store(path: str, spark: SparkSession, source: str | None = None) -> DataFrame | None:
    """The newest whole version of a store, of one source if given; None where there is none."""
    seen = _versions(spark, path)
    if not seen:
        return None
    folders = _manifest(spark, path, seen[-1])["folders"]
    rows = spark.read.parquet(*[f"{path}/{f}" for f in folders.values()]) if folders else None
    return rows if rows is None or source is None else rows.where(F.col("source") == source)


def existing_ids(items: DataFrame, source: str | None = None, key: str = "job_id") -> DataFrame:
    """Ids that a store holds, each once, of one source if given; only the id column (and the source) is read."""
    return (items if source is None else items.where(F.col("source") == source)).select(key).distinct()


def new_since(items: DataFrame, since: Column, ts: str = "scraped_at") -> DataFrame:
    """Rows gathered at ``since`` or later."""
    return items.where(F.col(ts) >= since)


def _under(path: str, batch: int | None) -> tuple[str, str]:
    """Where rows of a batch go: its own folder, written over if the batch comes again; without one, the common folder."""
    return (path, "append") if batch is None else (f"{path}/batch={batch}", "overwrite")


def write_raw_lake(raw: DataFrame, path: str, batch: int | None = None) -> None:
    """Raw rows as JSON under (batch,) source and day."""
    path, mode = _under(path, batch)
    raw.withColumn("dt", F.date_format("scraped_at", "yyyy-MM-dd")).write.mode(mode).partitionBy("source", "dt").json(path)


def write_processed_lake(items: DataFrame, path: str, as_of: Column, form: str = "parquet", batch: int | None = None) -> None:
    """Stored rows under (batch and) the day of the run, Parquet or JSON."""
    path, mode = _under(path, batch)
    items.withColumn("dt", F.date_format(as_of, "yyyy-MM-dd")).write.mode(mode).partitionBy("dt").format(form).save(path)


def messages(raw: DataFrame) -> DataFrame:
    """Rows as JSON queue messages, nulls kept."""
    return raw.select(F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"}).alias("value"))


#: Messages that a queue takes at once.
CHUNK = 10


def write_queue(raw: DataFrame, path: str, batch: int | None = None) -> None:
    """The queue as a folder: text files of at most ``CHUNK`` JSON messages, one a line, as ``ingest`` reads them."""
    path, mode = _under(path, batch)
    messages(raw).write.mode(mode).option("maxRecordsPerFile", CHUNK).text(path)

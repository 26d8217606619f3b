"""Streaming ingestion: queue messages to stored postings, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import postings
from ..sources import feeds


def etl(raw: DataFrame, order: list[Column]) -> DataFrame:
    """Transform, then keep the first of each posting; what is first depends on where batches are cut."""
    return postings.dedup(postings.transform(raw), order)


def etl_batch(store: str, quarantine: str | None = None, lake: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: consume, transform, dedup, upsert.

    A batch that comes again changes nothing: the store knows the batch it ends with, and lake and
    quarantine rows stand in a folder of their batch, which is written over.
    """

    def run(batch: DataFrame, number: int) -> None:
        raw, bad = feeds.consume(batch)
        jobs = etl(postings.valid(raw), [F.col("scraped_at"), F.col("job_id"), F.col("source_url")])
        if lake:
            postings.write_processed_lake(postings.stored(jobs, F.current_timestamp()), lake, F.current_timestamp(), batch=number)
        if quarantine:
            bad.write.mode("overwrite").json(f"{quarantine}/batch={number}")
        postings.save_upsert(store, jobs, order=[F.col("scraped_at"), F.col("source_url")], batch=number)

    return run


def publish(sources: dict[str, DataFrame], queue: str, lake: str | None = None, run: int | None = None) -> dict[str, dict]:
    """Send each source's rows to the queue (and the raw lake) as soon as that source is read.

    Sources go one after the other, so that what one gave is safe before the next is asked. A source that
    fails is reported and stops nothing. Returns {source: scraped, valid and pass_rate, or error}.
    """
    out: dict[str, dict] = {}
    for name, rows in sources.items():
        try:
            report = postings.quality(rows).select(F.col("total").alias("scraped"), F.col("passed").alias("valid"), "pass_rate").first().asDict()
            good = postings.valid(rows)
            postings.write_queue(good, f"{queue}/source={name}", run)
            if lake:
                postings.write_raw_lake(good, f"{lake}/source={name}", run)
            out[name] = report
        except PySparkException as e:
            out[name] = {"error": str(e).splitlines()[0]}
    return out


def ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str, files: int = 10, every: str | None = None, quarantine: str | None = None, lake: str | None = None) -> StreamingQuery:
    """Read text files of JSON lines as a queue. ``every`` is a processing interval; without it all is done at once."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(inbox)
    writer = lines.writeStream.foreachBatch(etl_batch(store, quarantine, lake)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window and key, for batches and streams; rows later than ``late`` are dropped from streams."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Activity sessions of a key: start, end and events."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

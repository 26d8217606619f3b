"""Structured log records: rows as JSON lines, and a scan of such lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a record may hold besides its own fields.
EXTRAS = {"source": "string", "job_count": "long", "duration_ms": "long", "error_type": "string"}
RECORD = "timestamp string, level string, logger string, message string, module string, function string, line long, " + ", ".join(f"{k} {v}" for k, v in EXTRAS.items()) + ", exception struct<type: string, message: string>, _corrupt string"


def records(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row with time, level, logger, message and those extras that the row has and that aren't null."""
    own = {"timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "level": F.coalesce("level", F.lit("INFO"))}
    own |= {n: F.coalesce(n, F.lit("")) for n in ("logger", "message")}
    rest = [n for n in ("module", "function", "line", *EXTRAS, "exception") if n in rows.columns]
    return rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in own.items()], *rest)).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """Append the rows' records to a folder of text files."""
    records(rows).write.mode("append").text(path)


def scan(lines: DataFrame, value: str = "value", level: str | None = None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Records of JSON lines, of one level and from a time on if asked, the first ``limit`` of them; lines that are no records are left out."""
    out = lines.select(F.from_json(value, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    out = out.where(F.col("_corrupt").isNull() & F.col("message").isNotNull()).drop("_corrupt").withColumn("timestamp", F.try_to_timestamp("timestamp"))
    if level is not None:
        out = out.where(F.col("level") == level)
    if since is not None:
        out = out.where(F.col("timestamp") >= since)
    return out if limit is None else out.orderBy("timestamp", "message").limit(limit)

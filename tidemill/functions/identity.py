"""Content identity: 16 hexadecimal digits of a SHA-256 over normalised fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def content_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def posting_id(title_normalized: Column, company: Column, source: Column) -> Column:
    """One id per title, company and board."""
    return content_hash(title_normalized, strip(F.lower(F.coalesce(company, F.lit("")))), source)


def cross_source_id(title_normalized: Column, company: Column) -> Column:
    """The same for all boards together."""
    return content_hash(title_normalized, strip(F.lower(F.coalesce(company, F.lit("")))))

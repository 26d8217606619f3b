"""Boards and the API as a Spark data source: ``spark.read.format("postings")``.

A partition is one source with all its keywords, as a source must not be asked more often than its delay
allows; the reader waits between requests, tries again on passing faults, goes to the next keyword at an
empty page, and ends quietly where a source fails.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as schema_of
from . import boards, feeds

RETRY_ON = {429, 500, 502, 503, 504}


class BoardPartition(InputPartition):
    def __init__(self, board: str, keywords: list[str]):
        self.board, self.keywords = board, keywords


def fetch(url: str, tries: int = 3, backoff: float = 1.0, timeout: float = 15.0, body: dict | None = None) -> str:
    """The page's text, of a POST with a JSON ``body`` if there is one; tries again on 429, 5xx and broken connections."""
    headers = {"User-Agent": "Mozilla/5.0"} | ({"Content-Type": "application/json"} if body is not None else {})
    data = None if body is None else json.dumps(body).encode()
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_ON or attempt + 1 == tries:
                raise
        except OSError:
            if attempt + 1 == tries:
                raise
        time.sleep(backoff * 2**attempt)
    raise ValueError("at least one try is needed")


class PostingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.key = options.get("api_key", "")
        self.boards = [b for b in options.get("boards", ",".join(feeds.registry(self.key))).split(",") if b]
        self.keywords = [k for k in options.get("keywords", "").split(",") if k]
        self.pages, self.delay = int(options.get("pages", 5)), float(options.get("delay", 2.0))
        self.base = options.get("base")  # another address for all boards, such as a folder of saved pages
        self.api = options.get("api", feeds.API)
        self.tries = int(options.get("tries", 3))
        unknown = [b for b in self.boards if b not in boards.BOARDS and b not in boards.ALIASES and b != "jooble"]
        if unknown:
            raise ValueError(f"unknown boards: {', '.join(unknown)}")

    def partitions(self) -> list[BoardPartition]:
        return [BoardPartition(b, self.keywords) for b in self.boards] if self.keywords else []

    def page(self, board: str, keyword: str, number: int) -> list[dict]:
        """Postings of one page."""
        word = quote(keyword, safe="")
        if board == "jooble":
            body = {"keywords": keyword, "location": feeds.API_PLACE, "page": str(number)}
            return feeds.api_page(fetch(f"{self.api}/{self.key}", self.tries, body=body))
        found = boards.BOARDS[board]
        return list(boards.postings(board, fetch(f"{self.base}/{board}/{word}/{number}.html" if self.base else found.base + found.url(word, number), self.tries)))

    def read(self, partition: BoardPartition) -> Iterator[tuple]:
        board, asked = partition.board, False
        if board in boards.ALIASES or (board == "jooble" and not self.key):
            return
        most = min(self.pages, boards.BOARDS[board].pages) if board in boards.BOARDS else self.pages
        for keyword in partition.keywords:
            for number in range(1, most + 1):
                if asked:
                    time.sleep(self.delay)
                asked = True
                try:
                    found = self.page(board, keyword, number)
                except (OSError, ValueError):  # a keyword that fails gives what it gave so far
                    break
                if not found:
                    break
                now = datetime.now(timezone.utc)
                for fields in found:
                    yield tuple(board if n == "source" else fields.get(n, "") for n in schema_of.TEXTS) + (now,)


class PostingSource(DataSource):
    """Options: boards, keywords (comma-separated), pages, delay, tries, base, api_key, api."""

    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self):
        return schema_of.RAW

    def reader(self, schema) -> PostingReader:
        return PostingReader(self.options)

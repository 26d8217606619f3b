"""Chat: updates as a stream source ``spark.readStream.format("chat")``, and a sink that sends and edits messages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions import text
from .web import fetch

API = "https://api.telegram.org"
UPDATE = "update_id long, user_id string, text string, username string, first_name string"


class UpdateReader(SimpleDataSourceStreamReader):
    """Asks for what comes from the offset on; the next offset is the last update's number plus one."""

    def __init__(self, options: dict):
        self.url, self.wait, self.tries = f"{options.get('api', API)}/bot{options.get('token', '')}/getUpdates", options.get("wait", "20"), int(options.get("tries", 3))

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def ask(self, start: int) -> list[dict]:
        answer = json.loads(fetch(f"{self.url}?{urlencode({'offset': start, 'timeout': self.wait})}", self.tries, timeout=float(self.wait) + 5))
        return [u for u in answer.get("result") or [] if u["update_id"] >= start]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            found = self.ask(start["offset"])
        except (OSError, ValueError):  # nothing now; the next batch asks again
            found = []
        end = max((u["update_id"] + 1 for u in found), default=start["offset"])
        return iter([row(u) for u in found]), {"offset": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row(u) for u in self.ask(start["offset"]) if u["update_id"] < end["offset"]])


def row(update: dict) -> tuple:
    """An update as a row; one without a message has no user and no text."""
    message = update.get("message") or {}
    chat, sender = message.get("chat") or {}, message.get("from") or {}
    return update["update_id"], str(chat["id"]) if "id" in chat else None, message.get("text", ""), sender.get("username", ""), sender.get("first_name", "")


class ChatSource(DataSource):
    """Options: token, api, wait (seconds that the server may hold an empty answer back), tries."""

    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> str:
        return UPDATE

    def simpleStreamReader(self, schema) -> UpdateReader:
        return UpdateReader(self.options)


def send(messages: DataFrame, token: str, api: str = API, tries: int = 1) -> DataFrame:
    """(the rows' columns, ok): each row's message sent to its user_id, or put in place of message_id if the row has one.

    What is refused with markup goes again without: a new message as plain text with its escapes undone, an
    edit as it is. A null user or message is not sent, and not ok. Rows are sent when the result is
    computed, each time it is: write it once.
    """
    url = f"{api}/bot{token}"
    rows = messages.withColumn("__plain", text.unescape_markup(F.col("message")))

    def post(kind: str, body: dict) -> bool:
        try:
            fetch(f"{url}/{kind}", tries, body=body | {"disable_web_page_preview": True}, timeout=10)
        except OSError:
            return False
        return True

    def one(user: str | None, message: str | None, plain: str | None, number: int | None) -> bool:
        if user is None or message is None:
            return False
        if number is None:
            return post("sendMessage", {"chat_id": user, "text": message, "parse_mode": "MarkdownV2"}) or post("sendMessage", {"chat_id": user, "text": plain})
        body = {"chat_id": user, "message_id": number, "text": message}
        return post("editMessageText", body | {"parse_mode": "MarkdownV2"}) or post("editMessageText", body)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = lambda n: batch.column(names.index(n)).to_pylist() if n in names else [None] * batch.num_rows  # noqa: E731, B023
            ok = [one(*r) for r in zip(column("user_id"), column("message"), column("__plain"), column("message_id"))]
            kept = [n for n in names if n != "__plain"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(ok, pa.bool_())], names=[*kept, "ok"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    return rows.mapInArrow(work, f"{out}, ok boolean")

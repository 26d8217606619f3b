"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id; each task rolls gzip files by compressed size and writes them under
temporary names of its attempt. A manifest names the files of the attempts that counted; the commit moves
exactly those to their final names and then writes the manifest beside them. Headers and digests are made
anew from the payload; of records with equal payloads one is the response and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_dir, join_unique, make_dir, work_dir

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: object) -> str:
    """A header value on one line."""
    return "" if value is None else " ".join(str(value).split())


def record(key: int | None, url: str | None, payload: bytes, sha: str, owner: int | None, revisit: bool, date: str, content: str) -> bytes:
    """One WARC/1.1 record with its headers; a revisit holds no payload."""
    ident = lambda k: f"<urn:uuid:{uuid.uuid5(SPACE, f'{k}:{sha}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ident(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Key: {'' if key is None else key}", f"X-Payload-Length: {len(payload)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ident(owner)}", f"X-Refers-To-Key: {'' if owner is None else owner}"]
        block = http
    else:
        block = http + payload
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    """One gzip member without a time or name, so that equal records give equal bytes."""
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


class Roller:
    """Writes gzip members to files under ``folder``, beginning a new one once ``limit`` bytes are reached."""

    def __init__(self, folder: str, shard: int, attempt: str, limit: int):
        self.filesystem, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.limit = shard, attempt, limit
        self.out, self.done, self.number = None, [], 0

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.temporary = f"_temporary/{self.shard:06d}-{self.number:05d}-{self.attempt}"
            self.out = self.filesystem.open_output_stream(f"{self.folder}/{self.temporary}", compression=None, buffer_size=1 << 20)
            self.size = self.records = 0
            self.sha = hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"part-{self.shard:06d}-{self.number:05d}.warc.gz", self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def write(df: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = 256 << 20, shards: int | None = None, level: int = 6, date: str = DATE, content: str = "text/html; charset=utf-8") -> DataFrame:
    """Write a record per row to ``folder`` (a URI) and commit; returns the manifest.

    Of records whose payloads are equal and have at least ``min_bytes`` bytes, that with the largest key
    is the response and the others are revisits of it; smaller payloads are all responses. A null payload
    is an empty one; a null key is smaller than any other and stays null; rows that repeat key and payload
    give one response or revisit first and then revisits; a null URL leaves the header out. A folder that
    has a manifest already is refused: archives are written once, under a folder of their own. Other
    columns are not read. An empty table gives no file and an empty manifest. The same rows give the same
    records in the same order; payloads cross the network once, in the range sort.
    """
    spark = df.sparkSession
    filesystem, path = pafs.FileSystem.from_uri(folder)
    if filesystem.get_file_info(f"{path}/_manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive already")
    rows = df.select(F.col(key_col).cast("long").alias("k"), F.col(url_col).cast("string").alias("u"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("b"))
    rows = rows.withColumn("d", F.sha1("b"))
    keys = cut(rows.select("k", "d", (F.octet_length("b") >= min_bytes).alias("large")), "digests")
    known = keys.where("large").select("k", "d")
    many = cut(known.groupBy("d").agg(F.max("k").alias("o"), F.count("*").alias("n")).where("n > 1"), "shared")
    # A mark for each key of a shared payload meets its record in the range sort, instead of a join that moves payloads.
    marks = join_unique(known, many, "d", "n").select("k", "d", "o").distinct()
    empty = F.lit(None)
    union = rows.select("k", "d", F.lit(1).alias("z"), "u", "b", empty.cast("long").alias("o")).unionByName(marks.select("k", "d", F.lit(0).alias("z"), empty.cast("string").alias("u"), empty.cast("binary").alias("b"), "o"))
    places = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    make_dir(f"{folder}/_temporary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        roller = Roller(folder, context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", roll_bytes)
        mark, owner, answered = None, None, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for k, d, z, u, b, o in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    if z == 0:
                        mark, owner = (k, d), o
                        continue
                    shared = mark == (k, d)
                    revisit = shared and (k != owner or mark in answered)
                    if shared and k == owner:
                        answered = {mark}
                    sha = base64.b32encode(bytes.fromhex(d)).decode()
                    roller.add(packed(record(k, u, b, sha, owner if shared else None, revisit, date, content), level))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*roller.done)], names=["file", "temporary", "records", "bytes", "sha256"])

    starts = F.array(*[F.lit(k) for k in cuts(keys, places)]).cast("array<bigint>")
    shard = F.size(F.filter(starts, lambda s: s <= F.coalesce("k", F.lit(-(1 << 63)))))
    dealt = union.withColumn("shard", shard).repartitionById(places, "shard").drop("shard").sortWithinPartitions("k", "d", "z")
    return commit(spark, dealt.mapInArrow(work, "file string, temporary string, records long, bytes long, sha256 string"), folder)


def cuts(keys: DataFrame, places: int, sample: int = 50_000) -> list[int]:
    """First keys of all shards but the first: ranks of a sample that follows from the keys' hashes, so that reruns cut alike."""
    known = keys.where("k is not null")
    some = known.where(F.pmod(F.xxhash64("k"), F.lit(max(1, known.count() // sample))) == 0)
    found = np.sort(some.select("k").toArrow().column("k").to_numpy())  # about ``sample`` numbers
    at = np.arange(1, places) * len(found) // places
    return np.unique(found[at]).tolist() if len(found) else []


def commit(spark: SparkSession, staged: DataFrame, folder: str) -> DataFrame:
    """Move the files of the attempts that counted to their final names; the manifest comes last."""
    staged = cut(staged, "manifest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist()):
                if filesystem.get_file_info(f"{path}/{temporary}").type != pafs.FileType.NotFound:  # else moved by an earlier attempt
                    filesystem.move(f"{path}/{temporary}", f"{path}/{name}")
            yield batch

    names = ["file", "records", "bytes", "sha256"]
    staged.mapInArrow(work, staged.schema).select(*names).write.parquet(f"{folder}/_manifest")
    drop_dir(f"{folder}/_temporary", spark)
    return spark.read.parquet(f"{folder}/_manifest")


def parse(source, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members."""
    rest, unpack, text = b"", None, []
    while True:
        chunk = rest or source.read(size)
        rest = b""
        if not chunk:
            break
        if unpack is None:
            unpack, text = zlib.decompressobj(31), []
        text.append(unpack.decompress(chunk))
        if unpack.eof:
            rest, unpack = unpack.unused_data, None
            whole = b"".join(text)
            head, _, body = whole.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield headers, body[: int(headers["Content-Length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files that the manifest names, checked against its block digest.

    Returns (key, url, record_type, payload_bytes, payload_digest, refers_to, payload): for a response,
    length and digest are those of the payload read; for a revisit, those its headers state, and the
    payload is null. Files are dealt out one by one, streamed, never held whole.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file")
    names = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        fields = [n.split()[0] for n in names.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=fields)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with filesystem.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for head, block in parse(source):
                        if digest(block) != head["WARC-Block-Digest"][5:]:
                            raise ValueError(f"{name}: block digest of {head['WARC-Record-ID']} is wrong")
                        key = int(head["X-Key"]) if head["X-Key"] else None
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            rows.append((key, head.get("WARC-Target-URI"), "response", len(payload), digest(payload), None, payload))
                            held += len(payload)
                        else:
                            refers = head["X-Refers-To-Key"]
                            rows.append((key, head.get("WARC-Target-URI"), "revisit", int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], int(refers) if refers else None, None))
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    count = max(1, manifest.count())
    return manifest.repartition(min(count, 100_000), "file").mapInArrow(work, names)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to a new folder under the shared one and read the archives back."""
    folder = work_dir(df.sparkSession, "warc")
    write(df, folder, **options)
    return read(df.sparkSession, folder)


def report_sql(table: str = "pages") -> str:
    """The digests and record types of all rows as DuckDB SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = f"list_transform(range(8), lambda i: list_transform(range(4), lambda j: substr('{letters}', 1 + ((CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT) >> (15 - 5 * j)) & 31)::INT, 1)))"
    return f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {table}),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS o FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(flatten({part}), '') AS payload_digest,
       CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = o THEN NULL ELSE o END AS refers_to
FROM owned"""

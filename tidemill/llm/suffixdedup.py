"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

Every ``length``-byte string is looked for in documents with a smaller id. The bytes are held in blocks,
files in the shared folder. Sorting all suffixes would move many times the input, so an exact filter goes
first: of the short substrings (k-mers) in a string that with the least hash is its anchor; equal strings
have equal anchors, so only strings whose anchor occurs in two documents matter. Two sorts follow, each by
common-prefix-aware merges: blocks sort their strings, front-code them and deal them out by range; each
range merges its runs with a loser tree that carries common prefix lengths.

1. Suffixes from the anchors on (each followed by the bytes before it, as far as strings with this anchor
   reach). Equal ones settle all strings around an anchor at once.
2. The strings that stay open: those that end within the prefix their suffix shares with another one,
   and whose hash two documents have.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import byte_column, cut, drop_dir, get_file, make_dir, put_file, tidy, work_dir

NONE = -(1 << 63)
CHUNK = 1 << 18
RANDOM = np.random.default_rng(20240101)
BYTE = RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIDE = "block string, part int, least binary, reach binary"


class Shape:
    """Lengths that follow from the string length: ``span`` k-mers of ``k`` bytes lie in a string."""

    def __init__(self, length: int):
        if not 12 <= length <= 160:
            raise ValueError("strings of 12 to 160 bytes")
        self.length = length
        self.span = 1 << ((2 * length // 3).bit_length() - 1)
        self.k = length - self.span + 1
        # a suffix from the anchor, the bytes before it backwards, and both lengths
        self.width = length + self.span - 1 + 4

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the k bytes from each place on."""
        h, size, step = BYTE[data], 1, 0
        while 2 * size <= self.k:
            h = h[:-size] * ODD[step] + h[size:]
            size, step = 2 * size, step + 1
        if size < self.k:
            d = self.k - size
            h = h[:-d] * ODD[14] + h[d:]
        h = h ^ (h >> np.uint64(32))
        h *= ODD[15]
        return h ^ (h >> np.uint64(29))

    def least(self, h: np.ndarray) -> np.ndarray:
        """Least hash in the string from each place on."""
        size = 1
        while size < self.span:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        return h


class Block:
    """The documents of one block file, end to end."""

    def __init__(self, uri: str):
        self.batch = pa.ipc.open_file(pa.BufferReader(get_file(uri))).read_all().combine_chunks().to_batches()
        self.batch = self.batch[0] if self.batch else None
        self.offsets, self.data = byte_column(self.batch.column(1)) if self.batch else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
        self.ids = self.batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False) if self.batch else np.zeros(0, np.int64)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1

    def runs(self, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, anchor, hash) of runs of strings with one anchor; strings never cross documents."""
        n = len(self.data) - shape.length + 1
        starts, ends = self.offsets[:-1], self.offsets[1:] - shape.length  # the last start in a document
        long = ends >= starts
        starts, ends = starts[long], ends[long]
        out = []
        if n > 0 and len(starts):
            flips = np.zeros(n + 1, np.int8)
            flips[starts] += 1
            flips[ends + 1] -= 1
            inside = 0
            for at in range(0, n, CHUNK):
                to = min(n, at + CHUNK)
                valid = np.cumsum(flips[at:to], dtype=np.int32) + inside
                inside = int(valid[-1])
                valid = valid > 0
                if valid.any():
                    h = shape.hashes(self.data[at : to + shape.length - 1])
                    m = shape.least(h)
                    same = m[1:] == m[:-1]
                    new, stop = valid.copy(), valid.copy()
                    new[1:] &= ~(same & valid[:-1])
                    stop[:-1] &= ~(same & valid[1:])
                    first = np.flatnonzero(new)
                    out += anchored(first, np.flatnonzero(stop), m[first], h, at, shape.span)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first, last, anchor, value = (np.concatenate(x) for x in zip(*out))
        value ^= value >> np.uint64(32)  # least hashes lie low: spread again, one to one, so that buckets are alike
        return first, last, anchor, value * ODD[13]


def anchored(first: np.ndarray, last: np.ndarray, value: np.ndarray, h: np.ndarray, at: int, span: int) -> list[tuple]:
    """Runs of one least hash, cut where its leftmost place changes: (first, last, anchor, hash)."""
    out = []
    step = np.arange(span)
    while len(first):
        anchor = first + (h[first[:, None] + step] == value[:, None]).argmax(1)
        out.append((first + at, np.minimum(last, anchor) + at, anchor + at, value))
        more = last > anchor
        first, last, value = anchor[more] + 1, last[more], value[more]
    return out


def write_blocks(df: DataFrame, id_col: str, text_col: str, keep: list[str], folder: str, block_bytes: int) -> DataFrame:
    """(block, rows, bytes) of block files written from the rows as they lie; files of lost attempts stay unread."""
    for name in ("", "/anchor", "/gone", "/open", "/string"):
        make_dir(folder + name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        attempt = uuid.uuid4().hex[:8]

        def flush() -> pa.RecordBatch:
            name = f"{TaskContext.get().partitionId():06d}-{number:05d}-{attempt}"
            table = pa.Table.from_batches(held).combine_chunks()
            out = io.BytesIO()
            with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as file:
                file.write_table(table)
            put_file(f"{folder}/{name}.block", out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.num_rows], pa.int64()), pa.array([size], pa.int64())], names=["block", "rows", "bytes"])

        for batch in batches:
            fields = batch.schema
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            total = np.cumsum(sizes)
            while at < batch.num_rows:
                done = total[at - 1] if at else 0
                to = int(np.searchsorted(total, done + block_bytes - size, side="left")) + 1
                to = min(max(to, at + 1), batch.num_rows)
                held.append(pa.RecordBatch.from_arrays([c.cast(pa.large_binary()) if k == 1 else c for k, c in enumerate(batch.slice(at, to - at).columns)], names=fields.names))
                size += int(total[to - 1] - done)
                at = to
                if size >= block_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("__text"), *[F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)])
    return cut(rows.mapInArrow(work, "block string, rows long, bytes long"), "blocks")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Rows with one value of the first column, in a sorted partition."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = row[batch.schema.names[0]]
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def per_key(df: DataFrame, key: str, places: int, work: Callable, schema: str, *order: str) -> DataFrame:
    """Apply ``work(key, rows)``, which yields record batches, where all rows of a key meet; a numbered part has its own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in grouped(batches):
            yield from work(value, rows)
        tidy()

    columns = [key, *[c for c in df.columns if c != key]]
    rows = df.select(*columns)
    dealt = rows.repartitionById(places, F.col(key)) if key == "part" else rows.repartition(places, key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def batches_of(rows: Iterable[tuple], **kinds: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about a MB: both sides hold a batch whole, outside the heap."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= 1 << 20:
            yield batch(**{name: (values, kind) for (name, kind), values in zip(kinds.items(), zip(*held))})
            held, size = [], 0
    if held:
        yield batch(**{name: (values, kind) for (name, kind), values in zip(kinds.items(), zip(*held))})


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    raw = out.getvalue()
    return len(raw).to_bytes(8) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8]), codec="zstd", asbytes=True)
    with np.load(io.BytesIO(raw)) as found:
        return dict(found)


def places(first: np.ndarray, last: np.ndarray, anchor: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs as small numbers, which compress well."""
    out = {"step": np.diff(first, prepend=0).astype(np.int32), "size": (last - first).astype(np.uint8)}
    return out | ({"to": (anchor - first).astype(np.uint8)} if anchor is not None else {})


def placed(state: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    first = np.cumsum(state["step"], dtype=np.int64)
    return first, first + state["size"], first + state["to"] if "to" in state else None


class Job:
    """The steps over blocks; each runs on executors and reads and writes only files of the shared folder."""

    def __init__(self, folder: str, length: int, buckets: int, keep: int, characters: bool = False):
        self.folder, self.shape, self.buckets, self.keep, self.characters = folder, Shape(length), buckets, keep, characters

    def block(self, name: str) -> Block:
        return Block(f"{self.folder}/{name}.block")

    # The filter: which k-mers are anchors in two documents?

    def distinct(self, value: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of a block, ascending, whether each has two documents in it, and each row's place among them."""
        if not len(value):
            return value, np.zeros(0, bool), np.zeros(0, np.int32)
        order = np.argsort(value)
        value, ids = value[order], ids[order]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        place = np.empty(len(value), np.int32)
        place[order] = np.cumsum(new) - 1
        new = np.flatnonzero(new)
        return value[new], np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new), place

    def bounds(self, value: np.ndarray) -> np.ndarray:
        edges = np.array([(k << 64) // self.buckets for k in range(1, self.buckets)], np.uint64)
        return np.concatenate(([0], np.searchsorted(value, edges), [len(value)])).astype(np.int64)

    def send_hashes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name in rows.column(0).to_pylist():
                block = self.block(name)
                first, _, _, value = block.runs(self.shape)
                yield from self.dealt(name, *self.distinct(value, block.ids[block.documents(first)])[:2])

    def dealt(self, name: str, value: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = self.bounds(value)
        rows = ((k, name, value[a:b].tobytes(), np.packbits(many[a:b]).tobytes()) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a)
        return batches_of(rows, part=pa.int32(), block=pa.string(), hashes=pa.binary(), many=pa.binary())

    def common(self, value: np.ndarray, rows: list[dict]) -> np.ndarray:
        """Which of a block's distinct hashes two documents have."""
        at = self.bounds(value)
        out = np.zeros(len(value), bool)
        for r in rows:
            a, b = at[r["part"]], at[r["part"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=b - a)
        return out

    def common_hashes(self, part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(h)) for r, h in zip(rows, hashes)]).astype(bool)
        value = np.concatenate(hashes)
        order = np.argsort(value)
        ranked = value[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        group = np.cumsum(new) - 1
        common = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0)
        flags = np.empty(len(value), bool)
        flags[order] = common[group]
        ends = np.cumsum([len(h) for h in hashes])
        out = ((r["block"], part, np.packbits(flags[end - len(h) : end]).tobytes()) for r, end, h in zip(rows, ends, hashes) if flags[end - len(h) : end].any())
        yield from batches_of(out, block=pa.string(), part=pa.int32(), flags=pa.binary())

    # A sort: distinct strings of a block, then runs by range, then merges, then what each block gets back.

    def local(self, name: str, kind: str, keys: np.ndarray, ids: np.ndarray, samples: int, **state: np.ndarray) -> pa.RecordBatch:
        """Keep the block's distinct strings in order: for each string its group, for each group its smallest id."""
        order = suffixes.sort_rows(keys)
        new = np.ones(len(keys), bool)
        for at in range(1, len(keys), 20_000):
            ranked = keys[order[at - 1 : at + 20_000]]
            new[at : at + 20_000] = (ranked[1:] != ranked[:-1]).any(1)
        group = np.empty(len(keys), np.int32)
        group[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], starts) if len(keys) else ids
        put_file(f"{self.folder}/{kind}/{name}", pack(group=group, least=least, one=order[starts].astype(np.int32), **state))
        some = keys[order[starts[sampled(name, len(starts), samples)]]]
        return batch(block=([name], pa.string()), count=([len(starts)], pa.int64()), sample=([some.tobytes()], pa.binary()))

    def send_runs(self, kind: str, width: int, cuts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block's front-coded run, cut at the ranges' first strings."""
        for rows in batches:
            for name in rows.column(0).to_pylist():
                state = unpack(get_file(f"{self.folder}/{kind}/{name}"))
                least, one = state["least"], state["one"]
                if not len(one):
                    continue
                block = self.block(name)
                if kind == "anchor":
                    keys = self.anchor_keys(block, *(x[one] for x in placed(state)))
                else:
                    keys = self.string_keys(block, state["place"][one].astype(np.int64))
                at = np.concatenate(([0], suffixes.places(keys, cuts), [len(keys)]))
                out = ((k, name, *suffixes.front_code(keys[a:b]), least[a:b].tobytes()) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a)
                yield from batches_of(out, part=pa.int32(), block=pa.string(), lengths=pa.binary(), tails=pa.binary(), ids=pa.binary())

    def merge(self, width: int, part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """For every string its smallest id over all blocks, and the longest prefix it shares with another string.

        Strings at a range's edges may have neighbours beyond it and count as sharing all.
        """
        run, share = suffixes.merge([(r["lengths"], r["tails"]) for r in rows], width)
        order = np.argsort(run, kind="stable")
        ids = np.empty(len(run), np.int64)
        ids[order] = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        new = share < width
        new[0] = True
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        least = np.minimum.reduceat(ids, starts)[group]
        reach = share[starts]
        reach[:-1] = np.maximum(reach[:-1], reach[1:])
        reach[0] = reach[-1] = width
        least, reach = least[order], reach[group][order].astype(np.uint8)
        ends = np.cumsum([len(r["lengths"]) for r in rows])
        out = ((r["block"], part, least[at:end].tobytes(), reach[at:end].tobytes()) for r, at, end in zip(rows, [0, *ends], ends))
        yield from batches_of(out, block=pa.string(), part=pa.int32(), least=pa.binary(), reach=pa.binary())

    # What blocks do with the answers.

    def anchors(self, samples: int, name: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Suffixes at the anchors that the filter left."""
        block = self.block(name)
        first, last, anchor, hashes = block.runs(self.shape)
        value, _, place = self.distinct(hashes, first)
        hit = self.common(value, rows)[place]
        first, last, anchor = first[hit], last[hit], anchor[hit]
        yield self.local(name, "anchor", self.anchor_keys(block, first, last, anchor), block.ids[block.documents(first)], samples, **places(first, last, anchor))

    def anchor_keys(self, block: Block, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        length, before = self.shape.length, self.shape.span - 1
        keys = np.zeros((len(first), self.shape.width), np.uint8)
        right, left = last + length - anchor, anchor - first
        size = len(block.data)
        for at in range(0, len(first), 20_000):
            part = slice(at, at + 20_000)
            on = np.arange(length) < right[part, None]
            keys[part, :length] = np.where(on, block.data[np.minimum(anchor[part, None] + np.arange(length), size - 1)], 0)
            on = np.arange(before) < left[part, None]
            keys[part, length : length + before] = np.where(on, block.data[np.maximum(anchor[part, None] - 1 - np.arange(before), 0)], 0)
        keys[:, -4], keys[:, -3] = left >> 8, left & 255
        keys[:, -2], keys[:, -1] = right >> 8, right & 255
        return keys

    def answers(self, state: dict[str, np.ndarray], rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted((r for r in rows if r["part"] >= 0), key=lambda r: r["part"])
        least = np.concatenate([np.frombuffer(r["least"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        reach = np.concatenate([np.frombuffer(r["reach"], np.uint8) for r in rows]) if rows else np.zeros(0, np.uint8)
        return least[state["group"]], reach[state["group"]].astype(np.int64)

    def string_keys(self, block: Block, place: np.ndarray) -> np.ndarray:
        keys = np.empty((len(place), self.shape.length), np.uint8)
        for at in range(0, len(place), 50_000):
            keys[at : at + 50_000] = block.data[place[at : at + 50_000, None] + np.arange(self.shape.length)]
        return keys

    def open_strings(self, name: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Settle what the first sort shows; of the strings it leaves open, hashes go out."""
        block = self.block(name)
        state = unpack(get_file(f"{self.folder}/anchor/{name}"))
        first, last, anchor = placed(state)
        least, reach = self.answers(state, rows)
        ids = block.ids[block.documents(first)]
        gone = least < ids
        put_file(f"{self.folder}/gone/{name}", pack(**places(first[gone], last[gone])))
        # A string that ends beyond what its suffix shares with any other suffix has no equal.
        last = np.minimum(last, anchor + reach - self.shape.length)
        open_ = (last >= first) & ~gone
        first, last, ids = first[open_], last[open_], ids[open_]
        put_file(f"{self.folder}/open/{name}", pack(**places(first, last)))
        yield from self.dealt(name, *self.open_hashes(block, first, last)[1:3])

    def open_hashes(self, block: Block, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place of every string of the runs, distinct hashes, whether two documents have them, which a place has)."""
        count = last - first + 1
        place = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return place, *self.distinct(self.string_hashes(block, place), block.ids[block.documents(place)])

    def string_hashes(self, block: Block, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.uint64)
        for at in range(0, len(place), 20_000):
            part = BYTE[block.data[place[at : at + 20_000, None] + np.arange(self.shape.length)]]
            out[at : at + 20_000] = (part * POWERS[: self.shape.length]).sum(1)
        out ^= out >> np.uint64(32)
        return out * ODD[15]

    def strings(self, samples: int, name: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """The open strings whose hash two documents have."""
        block = self.block(name)
        first, last, _ = placed(unpack(get_file(f"{self.folder}/open/{name}")))
        place, value, _, at = self.open_hashes(block, first, last)
        place = place[self.common(value, rows)[at]]
        yield self.local(name, "string", self.string_keys(block, place), block.ids[block.documents(place)], samples, place=place.astype(np.uint32))

    def finish(self, give_kept: bool, name: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Every document of the block with what is left of it."""
        block = self.block(name)
        length = self.shape.length
        edges = np.zeros(len(block.data) + 1, np.int32)
        marks = {r["part"] for r in rows}
        if -2 in marks:
            first, last, _ = placed(unpack(get_file(f"{self.folder}/gone/{name}")))
            np.add.at(edges, first, 1)
            np.add.at(edges, last + length, -1)
        if -1 in marks:
            state = unpack(get_file(f"{self.folder}/string/{name}"))
            if len(state["place"]):
                least, _ = self.answers(state, rows)
                place = state["place"].astype(np.int64)
                place = place[least < block.ids[block.documents(place)]]
                np.add.at(edges, place, 1)
                np.add.at(edges, place + length, -1)
        removed = np.cumsum(edges[:-1], out=edges[:-1]) > 0
        offsets = block.offsets

        def counted(marks: np.ndarray) -> np.ndarray:
            """How many marks each document has."""
            edges[0] = 0
            np.cumsum(marks, out=edges[1:])
            return (edges[offsets[1:]] - edges[offsets[:-1]]).astype(np.int64)

        n_removed = counted(removed)
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[starts] = removed[starts]  # runs end with their document
        n_spans = counted(begins)
        del edges, begins
        raw, kept = block.data.tobytes(), ~removed
        if self.characters and len(kept):
            opens = (block.data & 0xC0) != 0x80
            opens[starts] = True  # characters end with their document
            first = np.flatnonzero(opens[:-1] & ~opens[1:])  # of characters of several bytes
            after = np.flatnonzero(~opens & np.append(opens[1:], True)) + 1
            if len(first):
                size = after - first
                whole = np.logical_and.reduceat(np.append(kept, True), np.stack((first, after), axis=1).ravel())[::2]
                kept[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(whole, size)
        sizes = np.diff(offsets)
        for at in range(0, len(sizes), 2000):
            to = min(len(sizes), at + 2000)
            left = [raw[a:b] if not gone_ else block.data[a:b][kept[a:b]].tobytes() for a, b, gone_ in zip(offsets[at:to].tolist(), offsets[at + 1 : to + 1].tolist(), n_removed[at:to].tolist())]
            columns = {"__id": block.batch.column(0).slice(at, to - at)} | {f"__keep{k}": block.batch.column(2 + k).slice(at, to - at) for k in range(self.keep)}
            columns |= {"n_bytes": pa.array(sizes[at:to]), "n_removed": pa.array(n_removed[at:to]), "n_spans": pa.array(n_spans[at:to])}
            columns["kept"] = pa.array(left, pa.binary()) if give_kept else pa.array([hashlib.sha256(x).hexdigest() for x in left])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: Sample strings that the driver gets at most.
SAMPLED = 400_000


def sampled(name: str, count: int, samples: int) -> np.ndarray:
    """Places of a block's samples: one at random in each of ``samples`` equal shares. Were they the same in all blocks, and
    blocks are alike, samples would lie in bunches, and what lies between two bunches would be one range."""
    size = min(samples, count)
    return ((np.arange(size) + np.random.default_rng(zlib.crc32(name.encode())).random(size)) * count / max(1, size)).astype(int)


def splits(found: DataFrame, width: int, ranges: int, samples: int, count: int) -> np.ndarray:
    """First strings of all ranges but the first, from samples of the blocks, each of which stands for its share of the
    block's strings; of some blocks if there are very many."""
    some = found if count * samples <= SAMPLED else found.where(F.pmod(F.xxhash64("block"), F.lit(-(-count * samples // SAMPLED))) == 0)
    rows = [r for r in some.select("count", "sample").collect() if r[1]]
    if not rows:
        return np.zeros((0, width), np.uint8)
    some = [np.frombuffer(r[1], np.uint8).reshape(-1, width) for r in rows]
    weight = np.concatenate([np.full(len(s), r[0] / len(s)) for r, s in zip(rows, some)])
    some = np.concatenate(some)
    order = suffixes.sort_rows(some)
    some, weight = some[order], np.cumsum(weight[order])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    picked = some[np.minimum(at, len(some) - 1)]
    return picked[np.concatenate(([True], (picked[1:] != picked[:-1]).any(1)))] if len(picked) else picked


def block_size(total: int, base: int) -> int:
    """Bytes of a block: ``base``, growing with the root of the input beyond 64 GB, up to eight times that."""
    return int(base * min(8.0, max(1.0, (total / (64 << 30)) ** 0.5)))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep: list[str] | None = None, digests: bool = False, characters: bool = False, block_bytes: int | None = None, base: int = 8 << 20, range_strings: int = 250_000) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns (id, [``keep`` columns], n_bytes, n_removed, n_spans, kept binary), or with ``digests``
    kept_sha256 for kept. With ``characters``, what a span leaves of a UTF-8 character at its edges is not
    kept either; the counts stay those of the spans. Texts count as UTF-8 bytes; strings never cross documents and are judged on
    the input. A null or empty text has no bytes. A null id counts as smaller than any other; rows that
    repeat an id never remove each other's bytes. One row out per row in; columns other than ``keep`` are
    not read, and their names may be any; an empty table gives no rows. Ids are whole numbers.

    No size is assumed for a group: a block sends each distinct string once, however often it occurs, and
    ranges are cut so that they hold about ``range_strings`` strings. The driver gets the counts, and at most
    ``SAMPLED`` sample strings. ``block_bytes`` follows from the input's size and ``base`` (see
    ``block_size``): larger blocks take more memory, smaller ones more time.
    """
    spark = df.sparkSession
    keep = keep or []
    kind = df.schema[id_col].dataType.simpleString()
    folder = work_dir(spark, "suffixes")
    if block_bytes is None:
        block_bytes = block_size(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), base)
    blocks = write_blocks(df, id_col, text_col, keep, folder, block_bytes)
    count, size = blocks.agg(F.count("*"), F.sum("bytes")).first()
    count, least = max(1, count), int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = max(count, least)
    job = Job(folder, length, max(least, (size or 0) // (16 << 20)), len(keep), characters)
    shape = job.shape
    hashed, flagged = "part int, block string, hashes binary, many binary", "block string, part int, flags binary"
    columns = "block string, count long, sample binary"
    none = F.lit(None).cast("binary")

    def marks(found: DataFrame, mark: int) -> DataFrame:
        return found.select("block", F.lit(mark).alias("part"), none.alias("least"), none.alias("reach"))

    def sort(found: DataFrame, name: str, width: int) -> DataFrame:
        """What each block of ``found`` learns of its strings."""
        total = found.agg(F.sum("count")).first()[0] or 0
        ranges = max(1, min(-(-total // 10_000), max(least, total // range_strings)))
        cuts = splits(found, width, ranges, samples, count)
        runs = found.select("block").repartition(places, "block").mapInArrow(partial(job.send_runs, name, width, cuts), "part int, block string, lengths binary, tails binary, ids binary")
        return per_key(runs, "part", ranges, partial(job.merge, width), SIDE, "block").unionByName(marks(found, -1))

    def filtered(sent: DataFrame, again: Callable, name: str) -> DataFrame:
        """Blocks with a hash that two documents have, after ``again`` kept and sorted those strings."""
        common = per_key(sent, "part", job.buckets, job.common_hashes, flagged, "block")
        return cut(per_key(common, "block", places, again, columns, "part"), name)

    samples = max(4, -(-40 * max(least, 64) // count))
    first = filtered(blocks.select("block").repartition(places, "block").mapInArrow(job.send_hashes, hashed), partial(job.anchors, samples), "anchors")
    second = filtered(per_key(sort(first, "anchor", shape.width), "block", places, job.open_strings, hashed, "part"), partial(job.strings, samples), "strings")
    drop_dir(f"{folder}/anchor", spark)  # all they told is in the strings
    drop_dir(f"{folder}/open", spark)
    last = sort(second, "string", length).unionByName(marks(first, -2)).unionByName(marks(blocks, -3))
    kept_kinds = "".join(f"__keep{k} {df.schema[c].dataType.simpleString()}, " for k, c in enumerate(keep))
    schema = f"__id long, {kept_kinds}n_bytes long, n_removed long, n_spans long, kept {'string' if digests else 'binary'}"
    out = per_key(last, "block", places, partial(job.finish, not digests), schema, "part")
    return out.select(F.col("__id").cast(kind).alias(id_col), *[F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256" if digests else "kept"))

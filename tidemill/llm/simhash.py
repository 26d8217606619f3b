"""SimHash near-duplicates through pigeonhole blocks.

Fingerprints are cut into blocks so that two of them within the radius agree on at least ``agree``
blocks; every choice of that many blocks is a key. Distinct fingerprints with a common key meet in one
place, are compared by Hamming distance there, and pass on a spanning forest of their links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, cut, join_unique, tidy
from .components import components

SEED = 42


def shingles(text: bytes, words: int) -> bytes:
    """XXH64 digests, 8 bytes each, of the text's word shingles, repeats included; of all words if they are too few."""
    parts = text.lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not parts:
        return b""
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends)])


def majority(raw: bytes) -> int:
    """Bits set in over half of the digests."""
    if not raw:
        return 0
    count = np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for at in range(0, len(bits), 200_000):
        count += np.unpackbits(bits[at : at + 200_000], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(bits)).tobytes())


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bits set in over half the XXH64 hashes of the text's word shingles, repeats included."""
    return majority(shingles(text, words))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) of every whole text: the fingerprint's 64 bits as a signed integer. Null text: 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_column(batch.column(1))
            raw, offsets = data.tobytes(), offsets.tolist()
            found = np.array([fingerprint(raw[a:b], words) for a, b in zip(offsets, offsets[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])
        tidy()

    return df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, fp long")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the values (uint64, distinct) at most ``radius`` bits apart.

    A search from each value against those not reached yet: values of one cluster leave after one look.
    """
    links = []
    rest = values
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                stack += list(found)
                rest = rest[~near]
    return links


#: Values that a key holds on average, beyond which more blocks make longer keys.
OCCUPANCY = 8


def blocks_for(count: int, radius: int) -> int:
    """The fewest blocks, two more than differing bits at least, whose keys, by their bits, hold ``OCCUPANCY`` of so many values on average."""
    blocks = radius + 2
    while blocks < 64 and count > OCCUPANCY * 2 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def near_links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, split: int = 16384) -> DataFrame:
    """(a, b): links that connect all ``fp`` values at most ``radius`` bits apart.

    Keys: each choice of ``blocks - radius`` of the blocks, with the bits they hold. The number of values
    says how many blocks there are (see ``blocks_for``), so that keys stay small as values grow in number. A key with more than
    ``split`` values is dealt into parts, and each two parts meet in a task of their own, so that no task
    holds an unbounded group and no pair is left out.
    """
    values = distinct.count()
    blocks = blocks_for(values, radius) if blocks is None else blocks
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    bounds = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(k).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.inline(keys))
    large = rows.groupBy("t", "k").count().where(F.col("count") > split)
    if large.isEmpty():
        dealt = rows.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    else:
        large = large.select("t", "k", F.ceil(F.col("count") / split).cast("int").alias("n"))
        rows = rows.join(large, ["t", "k"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = rows.select("fp", "t", "k", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.Table.from_batches(parts)
        order = [got.column(n).to_numpy() for n in ("t", "k", "p", "q")]
        fp = got.column("fp").to_numpy().view(np.uint64)
        at = np.lexsort(order[::-1])
        fp, order = fp[at], [x[at] for x in order]
        new = np.zeros(len(fp), bool)
        new[0] = True
        for x in order:
            new[1:] |= x[1:] != x[:-1]
        starts = np.append(np.flatnonzero(new), len(fp))
        size = np.diff(starts)
        out = []
        two = starts[:-1][size == 2]  # most groups
        close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out += zip(fp[close].tolist(), fp[close + 1].tolist())
        for k in np.flatnonzero(size > 2):
            out += forest(fp[starts[k] : starts[k + 1]], radius)
        if out:
            both = np.array(list(dict.fromkeys(out)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    places = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), values * len(masks) // 2_000_000)
    return dealt.select("fp", "t", "k", "p", "q").repartition(places, "t", "k", "p", "q").mapInArrow(work, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Fingerprint every whole text and give each row its group of near-duplicates.

    Returns (id, fingerprint: 16 lowercase hex digits, component_id: the smallest id reachable over
    fingerprints at most ``radius`` bits apart, itself included). Null and empty texts have fingerprint
    0 and link like any other; repeated rows repeat; a null id never becomes a component_id unless all
    ids of its group are null. Other columns are not read; an empty table gives no rows. Copies meet
    once, as one fingerprint: only distinct fingerprints are compared.
    """
    marked = cut(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("__n")), "classes")
    groups = components(near_links(classes.select("fp"), radius, blocks))
    named = groups.join(classes, groups.node == classes.fp).select("fp", "root", "first")
    roots = named.groupBy("root").agg(F.min("first").alias("component"))
    linked = named.join(roots, "root").select("fp", "component")
    merged = cut(classes.join(linked, "fp", "left").select("fp", "__n", F.coalesce("component", "first").alias("component_id")), "linked")
    out = join_unique(marked, merged, "fp", "__n")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

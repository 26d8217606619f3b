"""Approximate nearest neighbours by cross-polytope hashing.

A fast Hadamard pseudo-rotation (random signs, Walsh-Hadamard transform, three times) turns a unit vector;
its hash is the nearest signed axis. A table's buckets are the hashes of as many rotations as the number
of rows asks for, so that buckets stay small however many rows there are. Every row is hashed once; a
query probes the buckets nearest to it in every table, rows and probes of a bucket meet by equality, and
the candidates found there are ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two wide)."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        step *= 2
    return x.reshape(n, width)


class Tables:
    """Random signs of every rotation, from a seed; no data is looked at, so there is nothing to fit.

    A table is ``hashes`` rotations; its buckets are numbered from 0 to (2 * width) ** hashes - 1.
    """

    def __init__(self, dim: int, tables: int, hashes: int, seed: int):
        self.dim, self.tables, self.hashes = dim, tables, hashes
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables * hashes, 3, self.width))

    def turned(self, unit: np.ndarray, rotation: int) -> np.ndarray:
        x = np.zeros((len(unit), self.width), np.float32)
        x[:, : self.dim] = unit
        for signs in self.signs[rotation]:
            x = hadamard(x * signs) / np.float32(self.width**0.5)
        return x

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Each row's bucket in each table, the table's number included: table + tables * bucket."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for k in range(self.hashes):
                x = self.turned(unit, t * self.hashes + k)
                axis = np.abs(x).argmax(1)
                out[:, t] = out[:, t] * 2 * self.width + axis + self.width * (x[np.arange(len(x)), axis] < 0)
        return out * self.tables + np.arange(self.tables)

    def probes(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` buckets nearest to each row in each table: rows x tables x count.

        Nearness adds up over a table's rotations: how much shorter the row's part along the axis is than along the nearest one,
        squared. The best of some rotations come from the best of fewer, so only ``count`` are held.
        """
        n = len(unit)
        out = np.full((n, self.tables, count), -1, np.int64)
        for t in range(self.tables):
            code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
            for k in range(self.hashes):
                x = self.turned(unit, t * self.hashes + k)
                both = np.concatenate((x, -x), axis=1)
                axis = np.argsort(-both, axis=1, kind="stable")[:, : min(count, 2 * self.width)]
                part = np.take_along_axis(both, axis, 1)
                cost = (cost[:, :, None] + ((part[:, :1] - part) ** 2)[:, None]).reshape(n, -1)
                code = (code[:, :, None] * 2 * self.width + axis[:, None]).reshape(n, -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :count]
                cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            out[:, t, : code.shape[1]] = code * self.tables + t
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: no nulls, no zero vectors, finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


#: Average rows of a bucket beyond which tables get one more rotation.
OCCUPANCY = 64


def hashes_for(rows: int, width: int) -> int:
    """Rotations of a table: the fewest by which buckets hold ``OCCUPANCY`` of the rows on average."""
    m = 1
    while rows > OCCUPANCY * (2 * width) ** m:
        m += 1
    return m


def search(
    df: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = 32, probes: int | None = None, at_once: int = 4, split: int = 16384, block: int = 4096, seed: int = 11
) -> DataFrame:
    """Each query's ``k`` nearest found rows by Euclidean distance on the original vectors.

    ``queries`` are rows of the same columns (default: ids divisible by 100); a query's own id is no
    candidate. Returns (query_id, rank from 1, vec_id, score), nearest first, ties to the smaller id; fewer
    rows only where the table has fewer candidates: queries that their buckets give less are compared with
    all rows, ``block`` of them at once. Vectors that are null, zero, or hold null or non-finite components
    take no part; of rows that repeat id and vector one stays. Vectors of another length than the query's
    are no candidates. Other columns are not read; an empty table gives no rows.

    Every row is hashed once into all tables. ``at_once`` tables at a time, rows and probes are dealt by
    bucket, buckets of more than ``split`` rows in parts that each probe visits; tasks pass on the best of
    what meets there. Rows ranked for a query are bounded by tables, probes and bucket size, not by the
    table. Equal vectors count once: of each, only the ``k`` + 1 smallest ids can be among the nearest.
    """
    spark = df.sparkSession
    work = Scratch(spark, "search")
    rows = vectors(df, id_col, vector_col)
    if queries is None:
        queries = df.where(F.col(id_col) % 100 == 0)
    asked = work.save(vectors(queries, id_col, vector_col).dropDuplicates(["id", "v"]), "queries")
    ids = F.array_sort(F.collect_set("id"))
    # Salted first, so that ids of one common vector never meet in one task before all but k + 1 of a salt are gone.
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("s"), "id").agg(F.lit(1)).select("v", "s", "id")
    few = Window.partitionBy("v", "s").orderBy("id")
    salted = salted.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    index = work.save(salted.groupBy("v").agg(F.slice(ids, 1, k + 1).alias("ids")), "index")
    found = []

    def dims(of: DataFrame) -> list[tuple[int, int]]:
        return sorted(tuple(r) for r in of.groupBy(F.size("v")).count().collect())

    def best(parts: list[DataFrame], name: str) -> DataFrame:
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        place = Window.partitionBy("query_id").orderBy("score", "vec_id")
        every = every.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        return work.save(every.select("query_id", "rank", "vec_id", "score"), name)

    counted = dict(dims(index))
    for dim, number in dims(asked):
        if dim in counted:
            known = Tables(dim, tables, hashes_for(counted[dim], 1 << max(1, (dim - 1).bit_length())), seed)
            count = probes or max(8, known.width if known.hashes > 1 else known.width // 8)
            found += met(work, index.where(F.size("v") == dim), asked.where(F.size("v") == dim), known, min(count, (2 * known.width) ** known.hashes), (counted[dim], number), k, at_once, split)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = best(found, "first")
    enough = first.where(F.col("rank") == k).select("query_id")
    short = work.save(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short")
    rest = []
    for dim, number in dims(short):
        for turn in range(-(-number // block)):
            part = short.where(F.size("v") == dim).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(-(-number // block))) == turn)
            rest.append(work.save(compare_all(index.where(F.size("v") == dim), part.toPandas(), dim, k), f"all{dim}-{turn}"))
    return first.join(enough, "query_id", "left_semi").unionByName(best(rest, "rest")) if rest else first


def met(work: Scratch, base: DataFrame, asked: DataFrame, known: Tables, count: int, sizes: tuple[int, int], k: int, at_once: int, split: int) -> list[DataFrame]:
    """(query_id, vec_id, score) of the best rows that the buckets of each few tables give."""
    dim, tables = known.dim, known.tables

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = known.buckets(unit(matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), tables).cast(pa.list_(pa.int64()))], names=["v", "ids", "codes"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = known.probes(unit(matrix(batch.column(1))), count)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), tables * count).cast(pa.list_(pa.int64()))], names=["id", "v", "codes"])

    coded = work.save(base.select("v", "ids").mapInArrow(code, "v array<double>, ids array<long>, codes array<long>"), f"coded{dim}")
    aimed = work.save(asked.select("id", "v").mapInArrow(aim, "id long, v array<double>, codes array<long>"), f"aimed{dim}")
    hot = coded.select(F.explode("codes").alias("b")).groupBy("b").count().where(F.col("count") > split)
    hot = work.save(hot.select("b", F.ceil(F.col("count") / split).cast("int").alias("n")), f"hot{dim}")
    some_hot = not hot.isEmpty()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from ranked(pa.Table.from_batches(got).combine_chunks(), k)

    out = []
    places = max(int(work.spark.conf.get("spark.sql.shuffle.partitions")), at_once * (sizes[0] + sizes[1] * count) * (8 * dim + 40) >> 26)
    for at in range(0, tables, at_once):
        n = min(at_once, tables - at)
        held = coded.select("v", "ids", F.explode(F.slice("codes", at + 1, n)).alias("b")).withColumn("asks", F.lit(False))
        ask = aimed.select("v", F.array("id").alias("ids"), F.explode(F.slice("codes", at * count + 1, n * count)).alias("b")).where("b >= 0").withColumn("asks", F.lit(True))
        if some_hot:
            held = held.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.coalesce("n", F.lit(1))).cast("int")).drop("n")
            ask = ask.join(hot, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
        else:
            held, ask = held.withColumn("part", F.lit(0)), ask.withColumn("part", F.lit(0))
        both = held.unionByName(ask).select("b", "part", "asks", "ids", "v").repartition(places, "b", "part").sortWithinPartitions("b", "part", "asks")
        out.append(work.save(both.mapInArrow(rank, "query_id long, vec_id long, score double"), f"found{dim}-{at}"))
    return out


def ranked(rows: pa.Table, k: int, pairs: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query among sorted rows (bucket, part, asks, ids, v): rows of a bucket stand before its queries."""
    bucket, part, asks = (rows.column(n).to_numpy() for n in ("b", "part", "asks"))
    data, lists = matrix(rows.column("v").chunk(0)), rows.column("ids").chunk(0)
    offsets, every = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    least = every[offsets[:-1]]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    held = np.add.reduceat(~asks, start, dtype=np.int64)
    query = np.flatnonzero(asks)
    query = query[held[group[query]] > 0]
    counts = held[group[query]]
    total = np.cumsum(counts)
    found, at = [], 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs, side="right")))
        q, n = query[at:to], counts[at:to]
        asking = np.repeat(np.arange(len(q)), n)
        row = np.repeat(start[group[q]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        score = np.sqrt(((data[row] - data[q][asking]) ** 2).sum(1))
        order = np.lexsort((least[row], score, asking))
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        order = order[place <= k]  # one of them may be the query itself
        row, asking, score = row[order], asking[order], score[order]
        size = offsets[row + 1] - offsets[row]
        ids = every[np.repeat(offsets[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        own = np.repeat(least[q][asking], size)
        keep = ids != own
        found.append((own[keep], ids[keep], np.repeat(score, size)[keep]))
        at = to
    if found:
        own, ids, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids, score, own))
        own, ids, score = own[order], ids[order], score[order]
        fresh = np.append(True, (own[1:] != own[:-1]) | (ids[1:] != ids[:-1]))[: len(own)]  # probes may find a row again
        own, ids, score = own[fresh], ids[fresh], score[fresh]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        keep = place < k
        yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(ids[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def compare_all(index: DataFrame, asked, dim: int, k: int, index_rows: int = 65536) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best of each run of the index for one block of queries."""
    query_id = asked["id"].to_numpy().astype(np.int64)
    query = np.array(asked["v"].tolist(), np.float64).reshape(len(asked), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, index_rows):
            data, ids, out = matrix(batch.column(0)), batch.column(1).to_pylist(), []
            for own, x in zip(query_id.tolist(), query):
                score = np.sqrt(((data - x) ** 2).sum(1))
                near = np.flatnonzero(score <= np.partition(score, k)[k]) if len(score) > k + 1 else np.arange(len(score))
                out += [(own, i, s) for s, i in sorted((s, i) for s, n in zip(score[near].tolist(), near.tolist()) for i in ids[n] if i != own)[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return index.select("v", "ids").mapInArrow(run, "query_id long, vec_id long, score double")


def brute_force(ids: np.ndarray, data: np.ndarray, asked: np.ndarray, k: int = 10) -> dict[int, list[tuple[float, int]]]:
    """The exact answer on one machine, to measure recall."""
    out = {}
    for q in np.flatnonzero(np.isin(ids, asked)):
        score = np.sqrt(((data - data[q]) ** 2).sum(1))
        order = np.lexsort((ids, score))
        out[int(ids[q])] = [(float(score[j]), int(ids[j])) for j in order if ids[j] != ids[q]][:k]
    return out

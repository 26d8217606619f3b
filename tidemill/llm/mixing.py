"""Mixing sources to target weights with the cube method.

Each source gets a target share of all words. A document is taken the whole number of times that the
source's rate holds, and once more with the rate's fractional part as inclusion probability. The flight
phase moves these probabilities along the null space of the balancing constraints (words and documents)
until at most as many stay fractional as there are constraints; flights run per group of a source, then
on what the groups leave, until one small landing problem a source remains. There the largest documents
are decided first, constraints dropped one by one, and what that is off by moves the probabilities of
smaller ones. Each step keeps expectations, so that a document's chance stays the fraction it began with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
EPSILON = 1e-9
#: Part of a source's words beyond which a document is decided before the flights.
GIANT = 0.02
#: Units of all sizes that a group keeps for the flight after its own, so that the last one has small ones to land with.
HELD = 12

def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds running sums, before each row in a total order, of whole numbers: no task holds more than a range of rows.

    ``sums`` are new columns and what they sum. Rows are dealt by range and written with their range's
    number; ranges' own sums, a row each, are added up apart.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), name)
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, over: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")).over(over), F.lit(0))
    parts = ranged.groupBy("__part").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(f"__{n}") for n, c in sums.items()])
    parts = parts.select(F.col("__part").alias("__p"), *[total(f"__{n}", before).alias(f"__{n}") for n in sums])  # at most ``count`` rows
    rows = ranged.select("*", *[total(c, within).alias(f"__own_{n}") for n, c in sums.items()]).join(F.broadcast(parts), F.col("__part") == F.col("__p"))
    return rows.select(*df.columns, *[(F.col(f"__own_{n}") + F.col(f"__{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(source, source_size, target, n): each source's share of all words, stopped at ``most`` times its size.

    Sources in code point order, null last, weigh 1, 2, .., ``cycle``, repeating. The excess over a stop is
    shared again by weight: with sources ordered by stop over weight, the level of the rest is the first
    that its own source does not stop. All sums are of whole numbers, so that reruns agree to the last bit.
    """
    name = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.lit(1).cast("long").alias("one"))
    per = in_order(per, [name], {"place": "one"}, "sources").withColumn("w", (F.col("place") % cycle + 1).cast("long"))
    per = cut(per.select("source", "source_size", "n", "w", (F.col("source_size") * most).alias("stop"), (F.col("source_size") * most / F.col("w")).alias("r")), "sources")
    total = per.agg(F.sum("source_size"), F.sum("w")).first()
    whole, weight = F.lit(total[0] or 0).cast("decimal(38,0)"), F.lit(total[1] or 0).cast("decimal(38,0)")
    steps = in_order(per, [F.col("r"), name], {"stops": "stop", "weights": "w"}, "steps")
    steps = steps.withColumn("l", (whole - F.col("stops")).cast("double") / (weight - F.col("weights")).cast("double"))
    level = steps.where("l <= r").agg(F.min(F.struct("r", "l"))["l"]).first()[0]
    share = F.lit(level if level is not None else 0.0) * F.col("w")
    return per.select("source", "source_size", F.least(share, F.col("stop").cast("double")).alias("target"), "n")


def flight(p: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase, in place; ``rows`` (constraints, units) keep their products with p.

    A window of one unit more than constraints moves along its null vector until a unit is decided; the
    next unit then takes its place.
    """
    m = len(rows)
    alive = [int(k) for k in np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON))]
    alive.reverse()
    window: list[int] = []
    uniform = iter(random.random(len(alive) + m + 1).tolist())
    scale = np.abs(rows).max(axis=1) if rows.size else np.ones(m)
    unit = (rows / np.where(scale > 0, scale, 1)[:, None]).T.tolist()
    value = p.tolist()
    while True:
        while alive and len(window) <= m:
            window.append(alive.pop())
        if len(window) <= m:
            break
        u = null_vector([unit[k] for k in window])
        up = down = np.inf
        for x, k in zip(u, window):
            v = value[k]
            if x > 0:
                up, down = min(up, (1 - v) / x), min(down, v / x)
            elif x < 0:
                up, down = min(up, -v / x), min(down, (v - 1) / x)
        step = up if next(uniform) * (up + down) < down else -down
        left = []
        for x, k in zip(u, window):
            v = value[k] + step * x
            if v < EPSILON:
                value[k] = 0.0
            elif v > 1 - EPSILON:
                value[k] = 1.0
            else:
                value[k] = v
                left.append(k)
        if len(left) == len(window):  # rounding kept all of them: decide the closest
            k = min(left, key=lambda j: min(value[j], 1 - value[j]))
            value[k] = float(round(value[k]))
            left.remove(k)
        window = left
    p[:] = value
    return p


def null_vector(columns: list[list[float]]) -> list[float]:
    """A vector u, not zero, with sum of u[k] * columns[k] = 0; one more column than constraints."""
    if len(columns) == 3 and len(columns[0]) == 2:
        (a, d), (b, e), (c, f) = columns
        u = [b * f - c * e, c * d - a * f, a * e - b * d]
        top = max(abs(x) for x in u)
        if top > 1e-12:
            return [x / top for x in u]
    matrix = np.array(columns).T
    return np.linalg.svd(matrix)[2][-1].tolist()


def landing(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """All units decided, with the chances ``p`` (in place): those of over half the largest open size at a time.

    A flight that balances words and documents leaves at most two of them, one that balances words at most
    one, and a draw decides that. What words are then off by moves the others' probabilities, by as much of
    each one's distance to 0 and 1 either way; where they have no room for the worst of both outcomes they
    move in part, so that expectations stay.
    """
    while True:
        open_ = np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON))
        if not len(open_):
            p[:] = np.round(p)
            return p
        open_ = open_[np.argsort(-size[open_], kind="stable")]
        head = max(3, int(np.count_nonzero(size[open_] > size[open_[0]] / 2)))
        head, rest = open_[:head], open_[head:]
        now = flight(p[head], np.stack([size[head], np.ones(len(head))]), random)
        now = flight(now, size[head][None], random)
        off = worst = 0.0
        for k in np.flatnonzero((now > EPSILON) & (now < 1 - EPSILON)):
            worst += size[head[k]] * max(now[k], 1 - now[k])
            taken = float(random.random() < now[k])
            off += size[head[k]] * (taken - now[k])
            now[k] = taken
        p[head] = np.round(now)
        if len(rest) and off:
            room = np.minimum(p[rest], 1 - p[rest])
            p[rest] -= room * off / max(float(room @ size[rest]), worst)


def nearest(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Largest first, each unit goes where the words taken so far come nearest to those expected."""
    off, out = 0.0, np.zeros(len(p))
    for k in np.argsort(-size, kind="stable"):
        out[k] = abs(off + (1 - p[k]) * size[k]) < abs(off - p[k] * size[k])
        off += (out[k] - p[k]) * size[k]
    return out


def seeded(seed: int, *parts: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *parts)).encode()).digest()[:8]))


def around_giants(rows: DataFrame, seed: int) -> DataFrame:
    """Decide documents with over a ``GIANT`` part of their source first; the others' probability makes up for it.

    A source has fewer than 1 / ``GIANT`` of them. They fly and land by themselves, and the others, which all
    begin with one probability, get what keeps the source's words, so that chances stay. Where the others
    are too few for that, coming near the target goes before chances: the giants are taken as ``nearest``
    says.
    """

    def group(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(ordered(table)))
        size, was = table.column("size").to_numpy().astype(float), table.column("p").to_numpy()
        room = (table.column("source_size")[0].as_py() - size.sum()) * np.minimum(was, 1 - was).min()
        p = landing(was.copy(), size, seeded(seed, "giants", table.column("g")[0].as_py())) if 2 * size.max() <= room else nearest(was, size)
        off = float((p - was) @ size)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p)).append_column("off", pa.array([off] * len(p)))

    giant = F.col("size") > GIANT * F.col("source_size")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    giants = cut(rows.where(giant).groupBy("g").applyInArrow(group, f"{schema}, off double"), "giants")
    small = rows.where(~giant)
    rest = small.groupBy("g").agg(F.sum("size").alias("__rest"))
    change = giants.groupBy("g").agg(F.max("off").alias("__off")).join(rest, "g").select(F.col("g").alias("__g"), F.coalesce(F.try_divide("__off", "__rest"), F.lit(0.0)).alias("__change"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - F.coalesce("__change", F.lit(0.0))))
    return small.join(change, small.g == F.col("__g"), "left").withColumn("p", moved).select(*rows.columns).unionByName(giants.drop("off"))


def ordered(table: pa.Table) -> np.ndarray:
    """Largest first, then by id and hash: an order that doesn't depend on where rows come from."""
    return np.lexsort((table.column("h").to_numpy(), table.column("i").fill_null(-(1 << 63)).to_numpy(), -table.column("size").to_numpy()))


def fly(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One flight for each (g, c) group of rows (g, c, i, size, p); the last one lands."""

    def group(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(ordered(table)))
        size, p = table.column("size").to_numpy().astype(float), table.column("p").to_numpy().copy()
        random = seeded(seed, level, table.column("g")[0].as_py(), table.column("c")[0].as_py())
        if last:
            p = landing(p, size, random)
        else:
            free = np.ones(len(p), bool)
            free[np.linspace(0, len(p) - 1, HELD).astype(int)] = False
            p[free] = flight(p[free], np.stack([size[free], np.ones(free.sum())]), random)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return rows.groupBy("g", "c").applyInArrow(group, rows.schema)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, most: int = 3, group: int = 2000, seed: int = 7) -> DataFrame:
    """How often the mix takes each row.

    Returns (id, size, source_size, target, taken): size is the number of words of the whole text (null:
    0), taken the words the mix takes (size times copies, copies at most ``most``). A null source is a
    source of its own, last in order. Sources without words have target 0 and take nothing. Null and
    repeated ids keep their rows, each decided by itself. Reruns agree: groups, orders and random numbers
    follow from the rows and ``seed``. Other columns are not read; an empty table gives no rows. A hot
    source is dealt into groups of about ``group`` rows; no task holds more than one. Chances are those of
    the source's rate, unless a few documents are most of their source (see ``around_giants``).
    """
    rows = df.select(F.col(id_col).alias("i"), words(text_col).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    rows = cut(rows, "sizes")
    return copies(rows, targets(rows, cycle, most), group, seed).select(F.col("i").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def copies(rows: DataFrame, shares: DataFrame, group: int, seed: int) -> DataFrame:
    """Rows (i, size, source, h) with source_size, target and copies."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = cut(shares.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + EPSILON).cast("long")), "shares")
    deal = F.ceil(F.col("n") / group).cast("long")
    known = shares.select(F.col("source").alias("s"), F.xxhash64("source").alias("g"), "source_size", "target", "base", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)).alias("p"), deal.alias("groups"))
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    joined = joined.withColumn("c", F.pmod(F.xxhash64("h", F.lit(1)), F.col("groups")))
    joined = around_giants(cut(joined, "deal"), seed)
    # A source's last group gets what all before it leave, so every group but one flies without landing.
    groups = shares.agg(F.max(deal)).first()[0] or 1
    now, level, done = joined, 0, None
    while True:
        last = groups == 1
        now = cut(fly(now, level, last, seed), "flight")
        if last:
            return now.withColumn("copies", F.col("base") + F.round("p").cast("long")) if done is None else done.unionByName(now).withColumn("copies", F.col("base") + F.round("p").cast("long"))
        settled = (F.col("p") < EPSILON) | (F.col("p") > 1 - EPSILON)
        part = now.where(settled)
        done = part if done is None else done.unionByName(part)
        fan = max(2, group // (2 + HELD))  # rows that each group leaves at most
        now = now.where(~settled).withColumn("c", F.floor(F.col("c") / fan).cast("long"))
        groups, level = -(-groups // fan), level + 1


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, most: int = 3, group: int = 2000, seed: int = 7) -> DataFrame:
    """The rows themselves, each as often as ``mix`` takes it. Of rows that repeat an id and text, each comes as often as one of them."""
    rows = cut(df.select(F.col(id_col).alias("i"), words(text_col).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")), "sizes")
    taken = copies(rows, targets(rows, cycle, most), group, seed).groupBy(F.col("i").alias("__i"), F.col("h").alias("__h")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    taken = small(cut(taken, "taken"))
    same = F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("__h"))
    joined = df.join(taken, same).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])

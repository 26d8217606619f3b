"""Quality classifier with supervised subword embeddings.

Words and character n-grams are hashed to learned vectors, averaged per document; a softmax layer gives
the classes. Vectors and layer are trained by stochastic gradient descent in numpy. As both are linear,
scoring needs one learned number a hash bucket: its vector times the difference of the two class rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import tidy

SPACES = np.zeros(128, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
#: A document's mean counts as many buckets of a zero vector besides its own, so that short texts lean to the bias.
PRIOR = 50


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def subwords(points: np.ndarray, bits: int, grams: tuple[int, ...]) -> np.ndarray:
    """Bucket of every word, repetition and n-gram of a text (code points with a space before and after).

    N-grams may begin or end at a word's edge, which counts as one character, but never span words.
    """
    space = (points < 128) & SPACES[np.minimum(points, 127)]
    value = np.where(space, np.uint32(1), points + np.uint32(2)).astype(np.uint64)
    found = []
    inner = np.flatnonzero(~space)
    if not len(inner):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    place = np.zeros(len(points), np.int64)
    place[starts] = starts
    place = np.arange(len(points)) - np.maximum.accumulate(place)
    turned = value * (MIX ^ (STEP << (place & 31).astype(np.uint64)))
    turned[space] = 0
    word = np.add.reduceat(turned, starts) ^ (ends - starts).astype(np.uint64)
    found.append(hashed(word, bits))
    # Word pairs count where a word comes again at once, or after one or two others.
    for back in (1, 2, 3):
        again = np.count_nonzero(word[back:] == word[:-back])
        found.append(np.full(again, back, np.int64))
    gaps = np.cumsum(space)
    run = value.copy()
    length = 1
    for n in sorted(grams):
        while length < n:
            run = run[:-1] * STEP + value[length:]
            length += 1
        if len(run) <= 0:
            break
        # no space strictly inside, and not a space alone at both ends of nothing
        within = gaps[n - 2 : len(points) - 1] - gaps[: len(run)] if n > 2 else np.zeros(len(run), np.int64)
        found.append(hashed((run ^ np.uint64(n))[within == 0], bits))
    return np.concatenate(found)


@dataclass
class Model:
    """Learned numbers: per bucket, and the bias; documents score the softmax of their mean."""

    weight: np.ndarray
    bias: float
    bits: int
    grams: tuple[int, ...]

    def score(self, text: str | None) -> float:
        points = code_points(f" {text or ''} ")
        buckets = subwords(points, self.bits, self.grams)
        logit = self.bias + float(self.weight[buckets].sum()) / (len(buckets) + PRIOR)
        return float(1 / (1 + np.exp(-logit)))


def train(texts: list[str], labels: list[int], bits: int = 18, grams: tuple[int, ...] = (3, 4), size: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 1) -> Model:
    """Fit vectors and softmax layer by stochastic gradient descent, one document a step, classes weighed alike."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (1 << bits, size)).astype(np.float32)
    layer = np.zeros((2, size), np.float32)
    bias = np.array([0, 1], np.float32)  # fixed: texts too short to tell keep label 1
    bags = []
    for text in texts:
        found, count = np.unique(subwords(code_points(f" {text or ''} "), bits, grams), return_counts=True)
        bags.append((found.astype(np.int32), (count / (count.sum() + PRIOR)).astype(np.float32)))
    labels = np.asarray(labels, np.int64)
    per = np.bincount(labels, minlength=2)
    weigh = len(labels) / np.maximum(2 * per, 1)
    total, seen = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in random.permutation(len(bags)):
            found, share = bags[k]
            pace = np.float32(rate * (1 - seen / total))
            seen += 1
            rows = vectors[found]
            hidden = share @ rows if len(found) else np.zeros(size, np.float32)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            slope = (p * np.float32(pace * weigh[labels[k]])).astype(np.float32)
            back = slope @ layer
            layer -= np.outer(slope, hidden)
            if len(found):
                vectors[found] = rows - (share * np.float32(len(found) ** 0.5))[:, None] * back
    turn = layer[1] - layer[0]
    return Model((vectors @ turn).astype(np.float64), float(bias[1] - bias[0]), bits, grams)


def held_out(column: str) -> Column:
    """True where crc32 of the id's text leaves remainder 1 by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 4000, class_bytes: int = 64 << 20, **options) -> Model:
    """Train on at most ``per_class`` labelled documents and ``class_bytes`` bytes of each class, never on held-out ones.

    Both bound the sample, which the driver holds: the rows with the smallest hashes of their ids, passing
    over those that would go beyond the bytes. Labels that are null, other than 0 and 1, or differ between
    rows of one id are left out, as are ids without a text; of texts of one id the least in order counts.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").where(~held_out("__id"))
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = known.where("__y = 0").orderBy(*order).limit(per_class).unionByName(known.where("__y = 1").orderBy(*order).limit(per_class))
    ids = [(r[0], r[1]) for r in picked.select("__id", "__y").collect()]
    if not ids:
        return Model(np.zeros(1 << options.get("bits", 18)), 0.0, options.get("bits", 18), options.get("grams", (3, 4)))
    kind = labels.schema[id_col].dataType.simpleString()
    of = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))

    def texts_of(some: list[tuple], *columns: Column) -> list[Row]:
        few = df.sparkSession.createDataFrame(some, f"__id {kind}, __y int")  # 2 * per_class short rows at most
        return of.join(F.broadcast(few), "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t")).select("__id", "__y", *columns).collect()

    sizes = {r[0]: r[2] for r in texts_of(ids, F.octet_length("__t"))}
    left, kept = [class_bytes, class_bytes], []
    for i, y in ids:
        size = sizes.get(i) or 0
        if i in sizes and size <= left[y]:
            left[y] -= size
            kept.append((i, y))
    if not kept:
        return Model(np.zeros(1 << options.get("bits", 18)), 0.0, options.get("bits", 18), options.get("grams", (3, 4)))
    texts = texts_of(kept, F.col("__t"))
    texts.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    model = train([r[2] or "" for r in texts], [r[1] for r in texts], **options)
    del texts
    tidy()  # the driver lives on for later stages
    return model


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: (id, held_out, score, predicted).

    score is the probability of label 1; predicted is 1 from 0.5 on. Null and empty texts get the bias's
    score. A null id is not held out. Repeated rows repeat; other columns are not read; an empty table
    gives no rows. A narrow map; the model has a fixed size (``bits``) and goes out by broadcast.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            scores = np.array([known.score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])
        tidy()

    rows = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all their columns as they are, whose whole text the model gives label 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            yield batch.filter(pa.array([known.score(t) >= 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))
        tidy()

    return df.mapInArrow(work, df.schema)

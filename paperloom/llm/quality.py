"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Each pair sets a good document against a bad one; the chance that the good one wins is
sigmoid(s(good) - s(bad)), so the loss depends on feature differences alone.  Every labelled good
document meets every labelled bad one.  Scores are additive over features cut in quantile bins.  The
threshold is the score quantile over all labelled rows that leaves the share of bad documents below
it; scores are mapped to (0, 1) so that it lies at ``CUT``.

All pairs.  A row's part in the gradient hangs on its own score and the other class's scores alone.  A pass
counts, by class and ``LEVELS`` levels of the score, the rows and the features they have; a level stands for
its rows at their mean score.  That is all that the gradient over all pairs takes, and it adds up over tasks.

Scale.  One pass over the documents makes their features, 96 bytes each, which meet their labels in a
shuffle; one pass scores all documents where they are read; no shuffle of texts, no broadcast.  Edges,
gradients and the threshold are sums of whole numbers over all labelled rows, so they don't depend on how
rows are dealt; quantiles are found bit by bit.  The driver gets the sums (a fixed size), and up to
``HELD_ROWS`` labelled rows' bins (24 bytes each), over which it then makes the passes itself; with more rows
the executors make them.

Defined results.  Labels that are null or contradict each other for one id are not used, nor null
ids; of two texts under one id one counts.  A null text scores as an empty one, a very long one as a
whole; rows equal in text score alike.  Without a good and a bad example every score is ``CUT``.  An
empty table gives an empty result; all columns pass through, an own ``score`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, position

#: Score from which a document is predicted to be good.
CUT = 0.7
BINS = 10
#: Levels of the score in a pass, and what a weight is a multiple of.
LEVELS, UNIT = 256, 2.0**-20
#: Labelled rows whose bins the driver holds at most, and rows of one task beyond.
HELD_ROWS, ROWS_A_TASK = 250_000, 50_000

_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t",
    "break": b"\n\r\x0b\x0c",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+=@^~<>\\/_`",
    "bracket": b"()[]{}",
    "quote": b"'\"",
}
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
for _i, _chars in enumerate(_GROUPS.values()):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
N_FEATURES = N_CLASSES + 11


def features(text: str) -> np.ndarray:
    """Shares of byte classes, and figures on words and lines, of a whole text."""
    data = text.encode("utf-8", "replace")
    out = np.zeros(N_FEATURES)
    if not data:
        return out
    out[:N_CLASSES] = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=N_CLASSES) / len(data)
    words = data.split()
    n = len(words)
    if n:
        counts = Counter(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        top = counts.most_common(1)[0][1]
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[N_CLASSES:] = (
            np.log(n),
            len(counts) / n,
            top / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            lengths.mean(),
            lengths.std(),
            np.mean(lengths <= 3),
            np.log1p(lengths.max()),
            1 - len(set(lines)) / max(1, len(lines)),
            np.log(n / max(1, len(lines))),
            len(counts) / n**0.8,
        )
    return out


@dataclass
class Ranker:
    """Additive score over binned features, and the map of scores to (0, 1)."""

    edges: np.ndarray  # N_FEATURES x (BINS - 1)
    weights: np.ndarray  # N_FEATURES * BINS
    threshold: float
    scale: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Rows of column numbers, one for each feature."""
        return places(self.edges, x) + np.arange(x.shape[1]) * BINS

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.raw(x) - self.threshold) / self.scale, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def weighted_quantiles(x: np.ndarray, weight: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The smallest values up to which the weights reach these shares of their sum."""
    order = np.argsort(x, kind="stable")
    reached = np.cumsum(weight[order])
    return x[order][np.minimum(np.searchsorted(reached, shares * reached[-1] - 1e-9), len(x) - 1)]


def pair_gradient(winners: np.ndarray, losers: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the mean of -log P(winner beats loser), P = sigmoid(s(winner) - s(loser)); rows of column numbers."""
    miss = 1 / (1 + np.exp(np.clip(w[winners].sum(axis=1) - w[losers].sum(axis=1), -30, 30)))  # 1 - P
    gain = np.bincount(winners.ravel(), np.repeat(miss, winners.shape[1]), len(w)) - np.bincount(losers.ravel(), np.repeat(miss, losers.shape[1]), len(w))
    return -gain / len(winners)


@dataclass
class Rows:
    """Labelled rows, at hand or as a table (y, x): whether each is good, and its numbers."""

    held: tuple[np.ndarray, np.ndarray] | DataFrame
    kind: np.dtype

    def total(self, count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of ``count(numbers, good)``, an array of whole numbers, over all rows; None without rows."""
        if not isinstance(self.held, DataFrame):
            x, good = self.held
            return sum((count(x[i : i + 10_000], good[i : i + 10_000]) for i in range(0, len(x), 10_000)), 0) if len(x) else None
        kind = self.kind

        def run(batches):
            total, shape = 0, None
            for batch in batches:
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind).reshape(batch.num_rows, -1)
                    total = total + count(x, np.asarray(batch.column(0)) == 1)
                    shape = total.shape
            if shape is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([list(shape)], pa.list_(pa.int64())), pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=["part", "shape", "cells"])

        def sum_of(cells) -> np.ndarray:
            total = 0
            for value in cells:
                total = total + np.frombuffer(value.as_py(), dtype=np.int64)
            return total

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"part": table.column("part").slice(0, 1), "shape": table.column("shape").slice(0, 1), "cells": pa.array([sum_of(table.column("cells")).tobytes()], pa.binary())})

        schema = "part long, shape array<long>, cells binary"
        n, tables = self.held.rdd.getNumPartitions(), self.held.mapInArrow(run, schema)
        while n > 16:
            n = -(-n // 16)
            tables = tables.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInArrow(add, schema)
        got = tables.toArrow()
        return sum_of(got.column("cells")).reshape(got.column("shape")[0].as_py()) if got.num_rows else None


def places(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bin of each feature of each row."""
    x = x.astype(np.float32)
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1)


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits in the order of these floats."""
    bits = np.ascontiguousarray(x, dtype=np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def floats(keys: np.ndarray) -> np.ndarray:
    """The floats that ``ordered`` has made these of."""
    keys = keys.astype(np.uint32)
    return np.where(keys >> 31, keys & np.uint32((1 << 31) - 1), ~keys).view(np.float32)


def smallest_reaching(rows: Rows, keys: Callable[[np.ndarray], np.ndarray], weights: tuple[int, int], goals: list[int], columns: int) -> np.ndarray:
    """columns x goals: the smallest key of a column up to which the rows' weights, (good, bad), reach each goal.

    Eight bits a pass, so any number of rows makes sums of one size.
    """
    found = np.zeros((columns, len(goals)), dtype=np.int64)
    left = np.tile(np.array(goals, dtype=np.int64), (columns, 1))
    for shift in (24, 16, 8, 0):

        def count(x: np.ndarray, good: np.ndarray, shift=shift, found=found) -> np.ndarray:
            k, out = keys(x).astype(np.int64), np.zeros((columns, len(goals), 2, 256), dtype=np.int64)
            digit = (k >> shift & 255) + 256 * ~good[:, None]
            for j in range(columns):
                above = k[:, j] >> shift + 8
                for q in range(len(goals)):
                    if q and found[j, q] == found[j, q - 1]:
                        out[j, q] = out[j, q - 1]
                    else:
                        out[j, q] = np.bincount(digit[above == found[j, q], j], minlength=512).reshape(2, 256)
            return out

        total = rows.total(count)
        reached = np.cumsum(weights[0] * total[:, :, 0] + weights[1] * total[:, :, 1], axis=2)
        digit = np.argmax(reached >= left[:, :, None], axis=2)
        left -= np.where(digit > 0, np.take_along_axis(reached, np.maximum(digit - 1, 0)[:, :, None], axis=2)[:, :, 0], 0)
        found = found * 256 + digit
    return found


def points(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of rows of bins in units, exact."""
    return np.rint(w / UNIT).astype(np.int64)[at + np.arange(at.shape[1]) * BINS].sum(axis=1)


def tally(at: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
    """class (good, bad) x level of the score x column: how many rows have it."""
    by_bin = np.rint(w / UNIT).astype(np.int64).reshape(-1, BINS)
    low, high = by_bin.min(axis=1).sum(), by_bin.max(axis=1).sum()
    level = (points(at, w) - low) * LEVELS // (high - low + 1) + LEVELS * ~good
    cells = level[:, None] * len(w) + at + np.arange(at.shape[1]) * BINS
    return np.bincount(cells.ravel(), minlength=2 * LEVELS * len(w)).reshape(2, LEVELS, len(w))


def all_pairs_gradient(counted: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``pair_gradient`` of all pairs of a good and a bad row, from their tally."""
    n = counted[:, :, :BINS].sum(axis=2)
    (good, bad), (n_good, n_bad) = ((c[k > 0].astype(np.float64) for c, k in zip(counted, n, strict=True)), (k[k > 0] for k in n))
    gap = (good @ w / n_good)[:, None] - (bad @ w / n_bad)[None, :]
    miss = 1 / (1 + np.exp(np.clip(gap, -30, 30)))
    return -((miss @ n_bad) @ good - (n_good @ miss) @ bad) / (float(n_good.sum()) * float(n_bad.sum()))


def fit(x: np.ndarray, good: np.ndarray) -> Ranker | None:
    """Learns from rows at hand; None without both kinds."""
    edges = edges_of(rows := Rows((x, good), np.dtype(np.float32)))
    return None if edges is None else learn(Rows((places(edges, x), good), rows.kind), edges)


def edges_of(rows: Rows) -> np.ndarray | None:
    """Bounds of the features' bins: quantiles of two parts good rows to one part bad ones, whatever their numbers."""
    sizes = rows.total(lambda x, good: np.array([good.sum(), (~good).sum(), x.shape[1] * len(x)]))
    if sizes is None or not sizes[0] or not sizes[1]:
        return None
    a, b, columns = int(sizes[0]), int(sizes[1]), int(sizes[2] // (sizes[0] + sizes[1]))
    goals = [-(-k * 3 * a * b // BINS) for k in range(1, BINS)]
    return floats(smallest_reaching(rows, ordered, (2 * b, a), goals, columns))


def learn(rows: Rows, edges: np.ndarray, passes: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Ranker:
    """Learns from rows of bins: each pass takes all pairs."""
    w = np.zeros(edges.shape[0] * BINS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, passes + 1):
        g = decay * w + all_pairs_gradient(rows.total(lambda at, good, w=w: tally(at, good, w)), w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = np.rint(w / UNIT) * UNIT
    # the last score at the share of bad rows and the next one: half way between them
    a, b = (int(k) for k in rows.total(lambda at, good: np.array([good.sum(), (~good).sum()])))
    last, after = (int(k) - (1 << 31) for k in smallest_reaching(rows, lambda at: (points(at, w) + (1 << 31))[:, None], (1, 1), [b, b + 1], 1)[0])
    spread = rows.total(lambda at, good: np.abs(2 * points(at, w) - last - after).sum(keepdims=True))
    return Ranker(edges, w, (last + after) * UNIT / 2, max(float(spread[0]) / (a + b) * UNIT / 8, 1e-6))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(y, x) of every id with one label of 0 or 1: its text's features."""

    def run(batches):
        for batch in batches:
            x = [features(t.as_py() or "").astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["_id", "x"])

    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y"))
    clean = clean.where((F.col("y") == F.col("_y")) & F.col("y").isin(0, 1)).select("doc_id", F.col("y").cast("int").alias("y"))
    # features first: what is shuffled is narrow; an id's rows count once
    found = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "text").mapInArrow(run, "_id long, x binary").groupBy("_id").agg(F.min("x").alias("x"))
    return found.join(clean, F.col("_id") == F.col("doc_id")).select("y", "x")


def train(docs: DataFrame, labels: DataFrame, usable: Column, held_rows: int = HELD_ROWS) -> Ranker | None:
    """Learns from all labelled rows; ``held_rows``: up to so many are sent to the driver."""
    bound_batches(docs.sparkSession)
    t = Scratch(docs.sparkSession, "quality")
    table = t.write(training_rows(docs, labels, "quality", usable), "features")
    n = table.count()
    try:
        edges = edges_of(Rows(table, np.dtype(np.float32)))
        if edges is None:
            return None

        def run(batches):
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in places(edges, x).astype(np.uint8)], pa.binary())], names=["y", "x"])

        binned = table.mapInArrow(run, "y int, x binary")
        if n <= held_rows:
            got = binned.toArrow()
            at = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.uint8).reshape(-1, N_FEATURES)
            return learn(Rows((at, np.asarray(got.column("y")) == 1), np.dtype(np.uint8)), edges)
        return learn(Rows(t.write(binned, "bins", n, ROWS_A_TASK), np.dtype(np.uint8)), edges)
    finally:
        t.drop("features", "bins")


def score_documents(docs: DataFrame, model: Ranker | None, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    bound_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != column.lower()]
    source = docs.select(*[docs[c] for c in columns])
    schema = T.StructType([*source.schema.fields, T.StructField(column, T.DoubleType(), False)])
    where = position(columns, "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(t.as_py() or "") for t in part.column(where)]).reshape(-1, N_FEATURES)
                score = np.full(part.num_rows, CUT) if model is None else model.score(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)

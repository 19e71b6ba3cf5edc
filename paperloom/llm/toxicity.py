"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and a hash sample of all documents, labelled or not (U), train a linear
classifier under the risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss; where the bracket falls below zero the step climbs back instead (the
non-negative correction).  No label but "toxic" is read.  The class prior comes from P and U alone: U
holds at least the toxic share of what P holds, so a feature's share in U over its share in P bounds
the prior from above, and features that toxic texts alone have bound it closely.

A text is the set of its words, each with its beginnings of 4 to 6 letters, so inflected and unseen
forms of a word share evidence; of scripts that write no spaces, pairs of neighbouring characters.
Only features that P shows clearly more often than U are kept, so long clean texts don't gather noise.

Scale.  One narrow pass finds the training rows (at most ``max_rows`` of P and twice that of U, by
hash order); one pass scores all documents where they are read.  Rows that repeat count once, so the
bound is one of rows.  Features are counted on the executors; what the driver gets is the at most
``MAX_FEATURES`` kept ones and each row's share of those.

Defined results.  Null labels and ids give no example; an id with two labels counts as toxic if one
says so, of two texts under a toxic id one counts.  A null text scores as an empty one, a very long one
by all its words; rows equal in text score alike.  Without toxic examples every score is the least
prior.  An empty table gives an empty result; all columns pass through, an own ``score`` is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, position

_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‚‘’¿¡…–—"
_SPACE = 1 << 24
PREFIXES = (4, 5, 6)
#: Kept features at most, the most frequent in P first.
MAX_FEATURES = 100_000
#: The least prior, and the one without any example.
LEAST_PRIOR, MOST_PRIOR = 1e-4, 0.9
#: Thai, Lao, Burmese, Khmer, kana, Han: scripts whose words nothing separates.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _feature(kind: str, value: str) -> int:
    return zlib.crc32((kind + value).encode("utf-8", "replace")) % _SPACE


def word_features(token: str) -> tuple[int, ...]:
    """Hashed features of a token: the word itself and its beginnings, or its pairs of characters."""
    word = token.strip(_STRIP).lower()
    if _UNSPACED.search(word):
        return tuple({_feature("c", word[i : i + 2]) for i in range(max(1, len(word) - 1))})
    if len(word) < 3:  # hardly a word of its own meaning
        return ()
    return (_feature("w", word), *(_feature("p", word[:k]) for k in PREFIXES if len(word) > k))


def text_features(text: str) -> np.ndarray:
    found: set[int] = set()
    for token in set(text.split()):
        found.update(word_features(token))
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def __post_init__(self):
        self.memo: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        memo, weights = self.memo, self.weights
        found: set[int] = set()
        for token in set(text.split()):
            own = memo.get(token)
            if own is None:
                own = tuple(f for f in word_features(token) if f in weights)
                if len(memo) > 300_000:
                    memo.clear()
                if len(token) <= 64:
                    memo[token] = own
            if own:
                found.update(own)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _logits(rows: np.ndarray, columns: np.ndarray, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    return np.bincount(rows, w[columns], n) + bias


def telling(count_p, n_p: int, count_u, n_u: int, lift: float, root: Callable):
    """Whether P shows a feature clearly more often than U: one standard deviation less counts."""
    return (count_p >= max(3, 0.001 * n_p)) & ((count_p - root(count_p)) / n_p >= lift * (count_u + 0.5) / n_u)


def lift_of(prior: float) -> float:
    """How much more often: what toxic texts alone have is in P 1 / prior times as often as in U at most."""
    return max(1.3, min(3.0, 0.6 / prior))


def risk(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float, w: np.ndarray, bias: float, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction that is descended (the bias last).

    Each side: row and feature number of its ones, and how many rows it has.
    """
    (rp, cp, n_p), (ru, cu, n_u) = positive, unlabelled
    zp, zu = _logits(rp, cp, n_p, w, bias), _logits(ru, cu, n_u, w, bias)
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    plus, minus, rest = -(1 - sp) * prior / n_p, -sp * prior / n_p, su / n_u
    gp, gu = (plus + minus, rest) if bracket >= 0 else (-gamma * minus, -gamma * rest)
    gradient = np.append(np.bincount(cp, gp[rp], len(w)) + np.bincount(cu, gu[ru], len(w)), gp.sum() + gu.sum())
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, bracket), gradient


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 100, rate: float = 0.05, decay: float = 3e-4) -> Model:
    """Trains on hashed feature sets."""
    prior = min(max(prior, LEAST_PRIOR), MOST_PRIOR)
    start = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Model({}, start)
    ids_p, count_p = np.unique(np.concatenate(positive), return_counts=True)
    ids_u, count_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    in_u = np.zeros(len(ids_p))
    at = np.searchsorted(ids_u, ids_p)
    hit = (at < len(ids_u)) & (ids_u[np.minimum(at, len(ids_u) - 1)] == ids_p) if len(ids_u) else np.zeros(len(ids_p), dtype=bool)
    in_u[hit] = count_u[at[hit]]
    keep = ids_p[telling(count_p, n_p, in_u, n_u, lift_of(prior), np.sqrt)]
    if not len(keep):
        return Model({}, start)

    def sparse(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        rows, columns = [], []
        for i, s in enumerate(sets):
            c = np.searchsorted(keep, s)
            ok = (c < len(keep)) & (keep[np.minimum(c, len(keep) - 1)] == s)
            columns.append(c[ok])
            rows.append(np.full(int(ok.sum()), i))
        return np.concatenate(rows), np.concatenate(columns), len(sets)

    sides = sparse(positive), sparse(unlabelled)
    w, bias = np.zeros(len(keep)), start
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for step in range(1, epochs + 1):
        g = risk(*sides, prior, w, bias)[1]
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        np.maximum(w, 0, out=w)  # kept features are evidence for toxicity, never against it
        bias -= move[-1]
    return Model({int(k): float(x) for k, x in zip(keep, w, strict=True) if x > 1e-6}, float(bias))


def prior_of(counts: DataFrame, n_p: int, n_u: int) -> float:
    """The least bound that a frequent feature gives, a standard deviation on the safe side."""
    bound = (F.col("u") + F.sqrt("u") + 1) / n_u / ((F.col("p") - F.sqrt("p")) / n_p)
    least = counts.where(F.col("p") >= max(4, 0.02 * n_p)).agg(F.min(bound)).first()[0]
    return min(max(least if least is not None else LEAST_PRIOR, LEAST_PRIOR), MOST_PRIOR)


def training_features(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int, t: Scratch) -> DataFrame:
    """(p, unit, x): a row for each text of P (1) and U (0), x its hashed features."""
    spark = docs.sparkSession
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull() & usable).select("doc_id").distinct()
    ids = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("_id")).collect()
    key = F.xxhash64("doc_id", "text")
    drawn = docs.where(usable).select(key.alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(2 * max_rows).collect()
    # both lists are bounded by max_rows
    of_p = F.broadcast(spark.createDataFrame(ids, "_id long"))
    of_u = F.broadcast(spark.createDataFrame(drawn, "_key long"))
    own = docs.select("doc_id", "text", key.alias("_own"))
    rows = own.join(of_p, F.col("doc_id") == F.col("_id"), "left").join(of_u, F.col("_own") == F.col("_key"), "left")
    rows = rows.where(F.col("_id").isNotNull() | F.col("_key").isNotNull()).select("_id", "_key", "text")

    def run(batches):
        for batch in batches:
            p, unit, x = [], [], []
            for i, k, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = text_features(value or "")
                for side, name in ((1, i), (0, k)):
                    if name is not None:
                        p.append(side)
                        unit.append(name)
                        x.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(unit, pa.int64()), pa.array(x, pa.list_(pa.int32()))], names=["p", "unit", "x"])

    found = rows.mapInArrow(run, "p int, unit long, x array<int>")
    return t.write(found.groupBy("p", "unit").agg(F.min("x").alias("x")), "features")


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 4000) -> Model:
    """P: ``max_rows`` toxic rows at most; U: ``2 * max_rows`` documents of any kind."""
    bound_batches(docs.sparkSession)
    t = Scratch(docs.sparkSession, "toxicity")
    rows = training_features(docs, labels, usable, max_rows, t)
    sizes = {r.p: r["count"] for r in rows.groupBy("p").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        t.drop("features")
        return fit([], [], 0.0)
    one = F.when(F.col("p") == 1, 1).otherwise(0)
    counts = rows.select("p", F.explode("x").alias("f")).groupBy("f").agg(F.sum(one).alias("p"), F.sum(1 - one).alias("u"))
    counts = t.write(counts.where(F.col("p") >= 3), "counts")
    prior = prior_of(counts, n_p, n_u)
    kept = counts.where(telling(F.col("p"), n_p, F.col("u"), n_u, lift_of(prior), F.sqrt)).orderBy(F.col("p").desc(), "f").limit(MAX_FEATURES).select("f").toArrow()
    kept = np.sort(kept.column("f").to_numpy(zero_copy_only=False).astype(np.int32))

    def run(batches):
        for batch in batches:
            x = [np.intersect1d(np.array(v.as_py(), dtype=np.int32), kept, assume_unique=True).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["p", "x"])

    got = rows.select("p", "x").mapInArrow(run, "p int, x binary").toArrow()
    t.drop("features", "counts")
    pairs = sorted(zip(got.column("p").to_pylist(), got.column("x").to_pylist(), strict=True))  # in no order that a rerun could change
    sets = {k: [np.frombuffer(x, dtype=np.int32) for p, x in pairs if p == k] for k in (0, 1)}
    return fit(sets[1], sets[0], prior)


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    bound_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != column.lower()]
    source = docs.select(*[docs[c] for c in columns])
    schema = T.StructType([*source.schema.fields, T.StructField(column, T.DoubleType(), False)])
    where = position(columns, "text")

    def run(batches):
        for batch in batches:
            score = [model.score(t.as_py() or "") for t in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)

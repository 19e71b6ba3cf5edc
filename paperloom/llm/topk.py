"""Exact top-k by inner product over an impact-ordered index, score at a time.

Index of a block: for each dimension the vectors' ids ordered by their component, cut in at most
``LEVELS`` segments of equal width; a segment stands for its quantised impact.  With a positive
query component the impact of a segment grows from the lowest component upwards, with a negative
one from the highest downwards, so every contribution is counted from zero (what that leaves out is the same for all vectors).

A query takes segments of all dimensions in descending impact |q_d| * level, and adds each
segment's impact to the vectors in it.  Impacts fall from round to round by the factor ``FALL``; after
each round a vector has a lower bound (the impacts taken) and an upper bound (plus the width of those
segments, plus the largest impact left in each dimension where the vector hasn't come up).  A vector
whose upper bound is below the k-th lower bound is proved to be no member.  The query stops as soon as
few are left, or after ``ROUNDS`` rounds: by then it costs less to score those left than to take the
weak segments, which are the longest.  All that are left are scored exactly, so the result never
depends on when it stops.

Exact scores.  Scaled components are whole numbers held as doubles, which lose none of their digits.
A product is taken in 64-bit integers where the sizes of its components bound it below 2**62, else
in Python's integers.  A score among the best that doesn't fit a long is an error, not another number.

Scale.  See ``blocks``: bounded memory, no vector pairs as rows.  Results are exact whatever the
blocks are.

Defined results.  A vector that is null, empty, or has null or non-finite components takes no
part; vectors of other lengths are no candidates.  A null id takes no part; of repeated query ids the
smallest vector asks, and rows with the query's id are no candidates; repeated candidates each count.
Equal scores rank by vec_id.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

SCALE = 256
#: Segments of a dimension at most; a block whose components span less has one for each value.
LEVELS = 1024
#: From round to round impacts fall by this factor, ``ROUNDS`` times.
FALL, ROUNDS = 0.4, 3
#: Share of a block's vectors that are scored exactly rather than pursued by the index.
FEW = 1 / 20
#: Products bounded below these lose no digit in doubles and in 64-bit integers.
EXACT, WIDE = float(1 << 53), float(1 << 62)


class ImpactIndex:
    def __init__(self, matrix: np.ndarray):
        """matrix: rows of whole numbers as doubles."""
        self.matrix = matrix
        self.largest = np.abs(matrix).max(axis=1)
        self.low, self.high = matrix.min(axis=0), matrix.max(axis=0)
        self.width = np.maximum(1.0, np.ceil((self.high - self.low + 1) / LEVELS))
        self.level = np.minimum((matrix - self.low) / self.width, LEVELS - 1).astype(np.int16)
        self.levels = int(self.level.max()) + 1
        order = np.argsort(self.level, axis=0, kind="stable")
        self.docs = np.ascontiguousarray(order.T)
        self.rank = np.ascontiguousarray(np.take_along_axis(self.level, order, axis=0).T).astype(np.float64)
        self.rank_down = self.levels - 1 - self.rank
        edges = np.arange(self.levels + 1)
        self.starts = np.stack([np.searchsorted(r, edges) for r in self.rank])

    def members(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Positions of all possible members of the top k; ``own`` marks excluded rows."""
        n, dims = self.matrix.shape
        weight = np.abs(q) * self.width  # impact of one level
        up = q >= 0
        low = np.zeros(n)
        seen = np.zeros(dims, dtype=np.int64)  # levels taken so far in each dimension, from its strong end
        top = float(weight.max()) * self.levels
        # a row's levels are at most as wide as the impact of one; the single-precision sum below errs by less than the rest
        slack = float(weight[self.width > 1].sum()) + 4e-6 * (1 + float(weight.sum()) * self.levels)
        found = np.flatnonzero(~own)
        for step in range(1, ROUNDS + 1):
            # a segment at distance i from the weak end has impact (i + 1) * weight
            left = np.ceil(np.minimum(FALL**step * top / np.maximum(weight, 1e-300), self.levels + 1.0)) - 1
            take = (self.levels - np.clip(left, 0, self.levels)).astype(np.int64)
            fresh = np.flatnonzero(take > seen)
            spans = [(self.levels - take[d], self.levels - seen[d]) if up[d] else (seen[d], take[d]) for d in fresh]
            spans = [slice(self.starts[d, x], self.starts[d, y]) for d, (x, y) in zip(fresh, spans, strict=True)]
            if spans:
                gains = [(self.rank if up[d] else self.rank_down)[d, span] for d, span in zip(fresh, spans, strict=True)]
                impact = np.concatenate(gains) * np.repeat(weight[fresh], [len(g) for g in gains])
                low += np.bincount(np.concatenate([self.docs[d, span] for d, span in zip(fresh, spans, strict=True)]), impact, n)
            seen = np.maximum(seen, take)
            high = low + slack
            # below the frontier a dimension can still give the impact of its next level
            rest = (self.levels - seen) * weight
            weak = (self.level < np.where(up, self.levels - seen, seen)).astype(np.float32)  # there; with a negative component all others are
            scale = max(float(rest.max()), 1e-300)
            high += scale * (weak @ (np.where(up, rest, -rest) / scale).astype(np.float32)) + rest[~up].sum()
            floor = np.where(own, -np.inf, low)
            bar = np.partition(floor, n - k)[n - k] if n > k else -np.inf
            found = np.flatnonzero((high >= bar) & ~own)
            if len(found) <= max(4 * k, n * FEW):
                break
        return found

    def scores(self, q: np.ndarray, at: np.ndarray) -> list[int] | np.ndarray:
        """Exact inner products of these rows."""
        most = self.largest[at] * max(1.0, np.abs(q).max()) * max(1, len(q))
        if not len(at) or most.max() < EXACT:  # sums of whole numbers that doubles hold
            return ((self.matrix @ q)[at] if 4 * len(at) > len(self.matrix) else self.matrix[at] @ q).astype(np.int64)
        wide = most >= WIDE
        if not wide.any():
            return self.matrix[at].astype(np.int64) @ q.astype(np.int64)
        whole = [int(x) for x in q]
        return [sum(int(x) * y for x, y in zip(self.matrix[i], whole, strict=True)) if w else int(self.matrix[i].astype(np.int64) @ q.astype(np.int64)) for i, w in zip(at, wide, strict=True)]


def best_of(scores: list[int] | np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k highest, ties to the smaller id."""
    if isinstance(scores, np.ndarray):
        keep = blocks.best(scores, ids, k)
        return ids[keep], scores[keep]
    ranked = sorted(zip([-s for s in scores], ids.tolist(), strict=True))[:k]
    for s, i in ranked:
        if not -(1 << 63) <= -s < 1 << 63:
            raise OverflowError(f"the score of vector {i} is {-s}, which no long can hold")
    return np.array([i for _, i in ranked], dtype=np.int64), np.array([-s for s, _ in ranked], dtype=np.int64)


def scaled(data: bytes, dim: int, scale: int) -> np.ndarray:
    out = np.floor(np.frombuffer(data, dtype=np.float64).reshape(-1, dim) * scale)
    if not np.isfinite(out).all():
        raise OverflowError("a component is too large to be scaled")
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each query."""
    rows = blocks.usable(vectors).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    candidates = blocks.pack(rows, blocks.CANDIDATES, "float64")
    queries = blocks.pack(blocks.query_rows(rows, every), blocks.QUERIES, "float64")

    def search(block, dim, ids, data, q_ids, q_data, cache):
        if cache.get("block") != block:
            cache.clear()
            cache.update(block=block, index=ImpactIndex(scaled(data, dim, scale)))
        index = cache["index"]
        out: tuple[list, list, list] = ([], [], [])
        for q_id, q in zip(q_ids, scaled(q_data, dim, scale), strict=True):
            at = index.members(q, k, ids == q_id)
            found, exact = best_of(index.scores(q, at), ids[at], k)
            for x, y in zip(out, (np.full(len(found), q_id), found, exact), strict=True):
                x.append(y)
        return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out)

    return blocks.nearest(candidates, queries, "long", search, k, every)

"""Vectors packed in blocks, and query blocks against candidate blocks.

A block is one row that holds up to a fixed number of vectors, so a task works on whole matrices
and its memory is bounded by one pair of blocks.  Tasks form a grid: candidate blocks are dealt over
its rows and copied along them, query blocks over its columns and copied along those, so with S tasks
and a query for every 50 vectors about 2 * sqrt(S / 50) times the vectors are shuffled.  Nothing is
broadcast, and no pair of vectors becomes a row: a pair of blocks is one row, and what leaves the
worker are the best few of each query in each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

CANDIDATES, QUERIES = 4096, 512
#: Bytes of an Arrow batch; a pair of blocks of 64 dimensions is about 2.5 MB.
BATCH_BYTES = 16 * 1024 * 1024


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: id and vector given, every component finite."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def pack(rows: DataFrame, most: int, dtype: str = "float32") -> DataFrame:
    """(id, v) -> block, dim, ids, data: vectors of equal length side by side.

    Rows are sorted within their partition and blocks named by partition and number, so a task that
    is run again after a loss makes the same blocks under the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        number = count()

        def block(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            values = [[f"{TaskContext.get().partitionId()}-{next(number)}"], [data.shape[1]], [ids.tobytes()], [data.tobytes()]]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["block", "dim", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype)
            starts = np.asarray(batch.column(1).offsets, dtype=np.int64)
            sizes, starts = np.diff(starts), starts[:-1] - starts[0]
            for dim in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == dim)
                more = ids[at], flat[starts[at][:, None] + np.arange(dim)]
                if dim in held:
                    more = tuple(np.concatenate(pair) for pair in zip(held.pop(dim), more, strict=True))
                while len(more[0]) >= most:
                    yield block(more[0][:most], more[1][:most])
                    more = more[0][most:], more[1][most:]
                if len(more[0]):
                    held[dim] = more
        for rest in held.values():
            yield block(*rest)

    return rows.sortWithinPartitions("id", "v").mapInArrow(run, "block string, dim int, ids binary, data binary")


def float_type(rows: DataFrame) -> str:
    """The vectors' own precision, as numpy names it."""
    return "float32" if rows.schema["v"].dataType.elementType.typeName() == "float" else "float64"


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; of repeated ids the smallest vector asks."""
    return rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))


def nearest(candidates: DataFrame, queries: DataFrame, score_type: str, search: Callable, k: int, every: int = 50) -> DataFrame:
    """The ``k`` best candidates of each query.

    candidates, queries: as ``pack`` gives them.  search(block, dim, ids, data, query ids, query
    data, cache) gives (query_id, vec_id, score) arrays: at most k a query, all that could be among
    the best k of that block.  ``cache`` keeps what it likes from one pair to the next.
    """
    spark = candidates.sparkSession
    bound_batches(spark, BATCH_BYTES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = min(tasks, math.ceil(math.sqrt(every * tasks)))  # rows of the grid
    across = max(1, tasks // down)

    def dealt(blocks: DataFrame, own: int, other: int, place: Callable) -> DataFrame:
        """Each block in its row or column, once for every column or row."""
        mine = F.pmod(F.xxhash64("block"), F.lit(own))
        return blocks.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))).withColumn("slot", place(mine, F.col("_other"))).drop("_other")

    left = dealt(candidates, down, across, lambda i, j: i * across + j).repartition(tasks, "slot", "dim")
    right = dealt(queries, across, down, lambda j, i: i * across + j)
    right = right.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("slot").alias("q_slot")).repartition(tasks, "q_slot", "q_dim")
    pairs = left.join(right.hint("merge"), (F.col("slot") == F.col("q_slot")) & (F.col("dim") == F.col("q_dim"))).select("block", "dim", "ids", "data", "q_ids", "q_data")

    def run(batches):
        cache: dict = {}
        kind = pa.int64() if score_type == "long" else pa.float64()
        for batch in batches:
            for i in range(batch.num_rows):
                block, dim, ids, data, q_ids, q_data = (c[i].as_py() for c in batch.columns)
                q, v, s = search(block, dim, np.frombuffer(ids, dtype=np.int64), data, np.frombuffer(q_ids, dtype=np.int64), q_data, cache)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]

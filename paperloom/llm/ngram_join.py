"""N-gram Jaccard self-join of documents, exact, with count-vector R-trees.

A document's set are the hashes of its distinct word shingles.  The hashes are counted in
``GROUPS`` groups; the counts are a point.  The overlap of two sets is at most the sum of the
coordinate-wise minima of their points, and the same holds for the corners of two boxes that
enclose points.  An R-tree over points, joined with itself, therefore gives every pair that can
reach the threshold; survivors are compared set by set.

Which points share a tree.  Two sets with similarity t or more share one of their first
(1 - t) * n + 1 shingles in any common order of shingles.  The order here is rare first, by counts
of all documents' shingles in a fixed table of ``CELLS`` cells; shingles of boilerplate come last
and lead no one to a tree.  Each shared leading shingle is a tree for each octave of set sizes, in
which a set stands for the octaves of the sizes that it can link with; equal trees are built once.

Groups of copies.  Equal sets become one vertex before anything else.  Near copies would make all
pairs of a group survive, so links are found in rounds: first each vertex is compared with one
leader, then components are formed, and the trees give only pairs between different components;
boxes that lie in one component are skipped whole.

Large trees.  A tree of more than ``LISTED`` members is range-sorted by component and size over all
tasks and cut in leaves of at most ``BLOCK`` members or ``BLOCK_BYTES``, so no task holds an unbounded
group.  Leaves' boxes are compared first; only two leaves whose boxes can hold a link of different
components meet, and what their points let through is compared there and then, so a large group
passes on links between components and not its pairs.  A leader's set goes once to every
``FOLLOWERS`` of its pairs.

Disk.  A table goes when what is made of it has been written; what stays is the narrow result.

Hashes have 64 bits, sets keep 48 of them for the comparison; a wrong count would need two
different shingles of the pair to share those.

Defined results.  Words are what ASCII white space separates, with A-Z lower-cased.  A text with
fewer words than a shingle is one shingle; a text without words, or null, has an empty set and is
linked with nothing.  A very long text is one set like others, its counts have 32 bits.  Rows equal
in text (repeated rows too) are always linked; a null id never becomes a component's id unless no
other is there.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches
from .components import connected_components
from .vocab import release

GROUPS = 64
CELL_BITS = 22
CELLS = 1 << CELL_BITS
#: Members of a tree that are listed in one row; larger ones are cut in leaves.
LISTED = 64
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: Pairs that share one copy of their leader's set.
FOLLOWERS = 64
LEAF, FAN = 16, 8
#: Pairs that one task compares, and pairs of leaves.
PAIRS_A_TASK, LEAVES_A_TASK = 25_000, 64
#: Narrow rows (ids, words of 64 ids) sent to all executors at most, so that sets are picked where they lie.
BROADCAST_ROWS = 1_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """text -> sorted distinct 64-bit hashes of its word shingles."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.hash = words, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.hash, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out = out * _MUL + h[j : j + n]
            out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(32)
        return np.unique(out)


def needed(n: int, num: int, den: int) -> int:
    """Smallest overlap with any set that reaches num/den."""
    return -(-num * n // den)


def pair_needed(total: np.ndarray | int, num: int, den: int):
    """Smallest overlap of two sets whose sizes add to ``total``."""
    return -(-num * total // (num + den))


def linked(inter: int, na: int, nb: int, num: int, den: int) -> bool:
    return den * inter >= num * (na + nb - inter)


# ---- corpus counts ---------------------------------------------------------------------------


def count_cells(docs: DataFrame, words: int) -> np.ndarray:
    """About log2 of how many documents' shingles fall in each cell: 4 MB, whatever the corpus.

    Tables of tasks are added in groups of 16, group after group, on the executors.
    """

    def squeeze(total: np.ndarray) -> pa.Array:
        import zstandard

        return pa.array([zstandard.compress(memoryview(total).cast("B"), 1)], pa.binary())

    def count(batches):
        total, shingle, one = np.zeros(CELLS, dtype=np.uint32), Shingler(words), np.uint32(1)
        for batch in batches:
            for value in batch.column(0):
                np.add.at(total, (shingle(value.as_py()) >> np.uint64(64 - CELL_BITS)).view(np.int64), one)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), squeeze(total)], names=["part", "cells"])
        del total
        release()

    def sum_of(values) -> np.ndarray:
        import zstandard

        total = np.zeros(CELLS, dtype=np.uint32)
        for value in values:
            total += np.frombuffer(zstandard.decompress(value), dtype=np.uint32)
        return total

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part").slice(0, 1), "cells": squeeze(sum_of(v.as_py() for v in table.column("cells")))})

    source = docs.select("text")
    n, tables = source.rdd.getNumPartitions(), source.mapInArrow(count, "part long, cells binary")
    while n > 1:
        n = -(-n // 16)
        tables = tables.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInArrow(add, "part long, cells binary")
    total = sum_of(row.cells for row in tables.collect())
    return np.minimum(255, np.rint(12 * np.log2(1.0 + total))).astype(np.uint8)


# ---- documents -> sets -----------------------------------------------------------------------


def text_hashes() -> list[Column]:
    """Two independent hashes of the text: with the id, what tells rows apart."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]


def describe(docs: DataFrame, cells: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """doc_id, h1, h2 (of the text), rid, digest (of the set), n, point, lead (leading shingles), members (48-bit hashes)."""
    table = docs.sparkSession.sparkContext.broadcast(cells)
    source = docs.select("doc_id", *text_hashes(), "text")
    own = [T.StructField("rid", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("point", T.BinaryType()), T.StructField("lead", T.ArrayType(T.LongType())), T.StructField("members", T.BinaryType())]
    schema = T.StructType([*source.schema.fields[:3], *own])

    def run(batches):
        shingle, cells, number = Shingler(words), table.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rid, digest, size, point, lead, members = [], [], [], [], [], []
                for value in part.column(3):
                    s = shingle(value.as_py())
                    n = len(s)
                    rid.append(number)
                    number += 1
                    size.append(n)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    point.append(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.uint32).tobytes())
                    take = n - needed(n, num, den) + 1 if n else 0
                    count = cells[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    lead.append(s[np.lexsort((s, count))[:take]].view(np.int64))
                    members.append((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(rid, pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(point, pa.binary()), pa.array(lead, pa.list_(pa.int64())), pa.array(members, pa.binary())],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def unpack(members: bytes) -> np.ndarray:
    """48-bit hashes, ascending."""
    raw = np.frombuffer(members, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


# ---- R-tree ----------------------------------------------------------------------------------


class CountTree:
    """R-tree over points, packed from points sorted by component, size and first coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes, labels))
        self.points, self.sizes, self.labels = points[self.order].astype(np.int32), sizes[self.order].astype(np.int64), labels[self.order]
        n = len(sizes)
        starts = np.arange(0, n, LEAF)
        top, low, high = np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        first, last = self.labels[starts], self.labels[np.minimum(starts + LEAF, n) - 1]  # sorted, so equal ends are pure
        self.levels = [(top, low, high, np.where(first == last, first, -1))]
        while len(self.levels[-1][0]) > 1:
            top, low, high, pure = self.levels[-1]
            starts = np.arange(0, len(top), FAN)
            lo, hi = np.minimum.reduceat(pure, starts), np.maximum.reduceat(pure, starts)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.where(lo == hi, lo, -1)))

    def pairs(self, other: CountTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in this, in other) of the pairs between different components that can reach the threshold.

        With ``other`` the tree itself, each pair comes once.
        """
        same = other is self
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            la, a, lb, b = stack.pop()
            top_a, low_a, high_a, pure_a = (x[a] for x in self.levels[la])
            top_b, low_b, high_b, pure_b = (x[b] for x in other.levels[lb])
            if pure_a == pure_b >= 0 or den * high_a < num * low_b or den * high_b < num * low_a:
                continue
            if np.minimum(top_a, top_b).sum() < pair_needed(low_a + low_b, num, den):
                continue
            if la == 0 and lb == 0:
                yield from self._leaves(other, a, b, same, num, den)
            elif la >= lb:
                below = range(a * FAN, min((a + 1) * FAN, len(self.levels[la - 1][0])))
                if same and la == lb and a == b:
                    stack += [(la - 1, x, lb - 1, y) for x in below for y in below if x <= y]
                else:
                    stack += [(la - 1, x, lb, b) for x in below]
            else:
                stack += [(la, a, lb - 1, y) for y in range(b * FAN, min((b + 1) * FAN, len(other.levels[lb - 1][0])))]

    def _leaves(self, other: CountTree, a: int, b: int, same: bool, num: int, den: int):
        i, j = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
        bound = np.minimum(self.points[i][:, None, :], other.points[j][None, :, :]).sum(axis=2)
        total = self.sizes[i][:, None] + other.sizes[j][None, :]
        ok = (bound >= pair_needed(total, num, den)) & (self.labels[i][:, None] != other.labels[j][None, :])
        if same and a == b:
            ok = np.triu(ok, 1)
        x, y = np.nonzero(ok)
        if len(x):
            yield self.order[x + i.start], other.order[y + j.start]


class Union:
    """Union-find over labels that a task has seen."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


# ---- links -----------------------------------------------------------------------------------


def sent(narrow: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if there are few rows; else the join shuffles."""
    return F.broadcast(narrow) if rows <= BROADCAST_ROWS else narrow


def pick(table: DataFrame, ids: DataFrame, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """Rows of ``table`` whose rid is among ``id`` of ``ids``, which are no more than ``rows``.

    A task numbers its rows in turn, so 64 ids that follow each other are one word of bits; rows are
    picked where they lie while the words are few enough to send.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    words = scratch.write(ids.groupBy(F.shiftright("id", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), name, rows)
    words = sent(words, words.count())
    here = F.getbit(F.col("_bits"), F.pmod("rid", F.lit(64))) == 1
    return table.join(words, F.shiftright("rid", 6) == F.col("_word")).where(here).select(*table.columns)


def beside_leader(table: DataFrame, pairs: DataFrame, payload: str, scratch: Scratch, name: str) -> DataFrame:
    """(a, salt, kind, rid, n, payload): each pair's b in a group with its a in front, groups together in a task.

    A leader of many pairs stands in front of several groups of about ``FOLLOWERS``, so neither its
    row nor a group's task grows with the number of its pairs.
    """
    n = pairs.count()
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("_salts"))
    follow = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_salts")).alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("_id"))
    lead = heads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("_id"))
    asked = scratch.write(follow.unionByName(lead), f"{name}-asked", 2 * n)
    rows = pick(table, asked.select(F.col("_id").alias("id")), scratch, name, 2 * n).select("rid", "n", payload)
    placed = rows.join(sent(asked, 2 * n), F.col("_id") == F.col("rid")).select("a", "salt", "kind", "rid", "n", payload)
    return placed.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")


def verify(sets: DataFrame, pairs: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Links among the pairs: all that it takes to join what they join.

    Pairs whose ends other links of the task have joined already are not compared.
    """

    def run(batches):
        front, size, joined = np.empty(0, dtype=np.uint64), 0, Union()
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                leader, _, kind, rid, n = (c[i].as_py() for c in batch.columns[:5])
                if kind == 0:
                    front, size = unpack(batch.column(5)[i].as_py()), n
                elif joined.find(leader) != joined.find(rid) and linked(overlap(front, unpack(batch.column(5)[i].as_py())), size, n, num, den):
                    joined.join(joined.find(leader), joined.find(rid))
                    a.append(leader)
                    b.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return beside_leader(sets, pairs, "members", scratch, name).mapInArrow(run, "a long, b long")


def bounded(points: DataFrame, pairs: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose points let them reach the threshold."""

    def run(batches):
        for (leader, _), rows in _groups(batches, 2):
            n = np.array([r[2] for r in rows], dtype=np.int64)
            point = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32).reshape(-1, GROUPS)
            total = n[0] + n[1:]
            ok = (den * n[1:] >= num * n[0]) & (den * n[0] >= num * n[1:]) & (np.minimum(point[0], point[1:]).sum(axis=1, dtype=np.int64) >= pair_needed(total, num, den))
            b = np.array([r[1] for r in rows[1:]], dtype=np.int64)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), leader, dtype=np.int64)), pa.array(b)], names=["a", "b"])

    return beside_leader(points, pairs, "point", scratch, name).mapInArrow(run, "a long, b long")


def _groups(batches, columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``columns`` values, from rows sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:columns] != key:
                if rows:
                    yield key, rows
                key, rows = row[:columns], []
            rows.append(row[columns:])
    if rows:
        yield key, rows


def _tree(rows: list[tuple]) -> CountTree:
    """rows: (rid, label, n, point, ...)."""
    points = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32).reshape(-1, GROUPS)
    return CountTree(points, np.array([r[2] for r in rows]), np.array([r[1] for r in rows], dtype=np.int64))


def small_tree_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """(tree, rid, label, n, point) sorted by tree -> surviving pairs."""

    def run(batches):
        for _, rows in _groups(batches, 1):
            tree = _tree(rows)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            for x, y in tree.pairs(tree, num, den):
                a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


_LEAF_FIELDS = "tree long, leaf string, low int, high int, pure long, top binary, rids array<long>, labels array<long>, sizes array<int>, points binary, sets array<binary>"


def leaves(members: DataFrame) -> DataFrame:
    """(tree, label, n, rid, point, members), sorted within partitions by the first four -> leaves of large trees."""

    def run(batches):
        def leaf(tree: int, rows: list[tuple]) -> pa.RecordBatch:
            labels, sizes, points = [r[0] for r in rows], [r[1] for r in rows], b"".join(r[3] for r in rows)
            top = np.frombuffer(points, dtype=np.uint32).reshape(-1, GROUPS).max(axis=0)
            values = [tree, f"{tree}:{rows[0][2]}", min(sizes), max(sizes), labels[0] if labels[0] == labels[-1] else -1, top.tobytes(), [r[2] for r in rows], labels, sizes, points, [r[4] for r in rows]]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
            names = [f.split()[0] for f in _LEAF_FIELDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        tree, rows, room = None, [], BLOCK_BYTES
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (row[0] != tree or len(rows) == BLOCK or room <= 0):
                    yield leaf(tree, rows)
                    rows, room = [], BLOCK_BYTES
                tree = row[0]
                rows.append(row[1:])
                room -= len(row[5])
        if rows:
            yield leaf(tree, rows)

    return members.mapInArrow(run, _LEAF_FIELDS)


def leaf_pairs(found: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) leaves of one tree whose boxes can hold a link between different components, a leaf with itself included.

    A tree's boxes are compared in one task: a box of 300 bytes stands for up to ``BLOCK`` members.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        low, high, pure = (np.asarray(table.column(c)).astype(np.int64) for c in ("low", "high", "pure"))
        top = np.frombuffer(b"".join(table.column("top").to_pylist()), dtype=np.uint32).reshape(-1, GROUPS)
        first, second = [], []
        for i in range(len(low)):
            j = np.arange(i, len(low))
            j = j[((pure[j] != pure[i]) | (pure[i] < 0)) & (den * high[i] >= num * low[j]) & (den * high[j] >= num * low[i])]
            for part in np.array_split(j, len(j) // 10_000 + 1):
                part = part[np.minimum(top[i], top[part]).sum(axis=1, dtype=np.int64) >= pair_needed(low[i] + low[part], num, den)]
                first.append(np.full(len(part), i))
                second.append(part)
        names = table.column("leaf")
        return pa.table({"a": names.take(pa.array(np.concatenate(first))), "b": names.take(pa.array(np.concatenate(second)))})

    return found.select("tree", "leaf", "low", "high", "pure", "top").groupBy("tree").applyInArrow(run, "a string, b string")


def leaf_links(found: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of the pairs of leaves.

    Survivors are compared here; once two components are joined in a task, no more of their pairs are.
    """
    held = ["rids", "labels", "sizes", "points", "sets"]
    left, right = (found.select(F.col("leaf").alias(f"_{x}"), *[F.col(c).alias(f"{x}_{c}") for c in held]) for x in "ab")
    joined = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))

    def run(batches):
        joined = Union()
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                sides = [row[2:7], row[7:]]
                trees = [_tree([(None, label, n, point) for label, n, point in zip(x[1], x[2], _split(x[3]), strict=True)]) for x in sides[: 1 if row[0] == row[1] else 2]]
                sets: list[dict[int, np.ndarray]] = [{}, {}]

                def members_of(side: int, i: int) -> np.ndarray:
                    if i not in sets[side]:
                        sets[side][i] = unpack(sides[side][4][i])  # noqa: B023
                    return sets[side][i]  # noqa: B023

                a, b = [], []
                for x, y in trees[0].pairs(trees[-1], num, den):
                    for p, q in zip(x.tolist(), y.tolist(), strict=True):
                        u, v = joined.find(sides[0][1][p]), joined.find(sides[1][1][q])
                        if u != v and linked(overlap(members_of(0, p), members_of(1, q)), sides[0][2][p], sides[1][2][q], num, den):
                            joined.join(u, v)
                            a.append(min(sides[0][0][p], sides[1][0][q]))
                            b.append(max(sides[0][0][p], sides[1][0][q]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ["a", "b", *[f"{x}_{c}" for x in "ab" for c in held]]
    return joined.select(*columns).mapInArrow(run, "a long, b long")


def _split(points: bytes) -> list[bytes]:
    return [points[i : i + 4 * GROUPS] for i in range(0, len(points), 4 * GROUPS)]


def relabel(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the component of ``rid`` (itself if it has no link)."""
    return table.join(labels.select(F.col("id").alias("_id"), F.col("label").alias("_label")), F.col("rid") == F.col("_id"), "left").withColumn("label", F.coalesce("_label", "rid")).drop("_id", "_label")


def _first(table: DataFrame) -> Column:
    """The smallest row by id (null last), then text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2"))


def classes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, h1, h2, n, first (none, doc_id, h1, h2 of its component's smallest row; null with an empty set) of each row."""
    bound_batches(docs.sparkSession)
    t = Scratch(docs.sparkSession, "join")
    table = t.write(describe(docs, count_cells(docs, words), words, num, den), "sets")
    full = table.where(F.col("n") > 0)

    n_docs = table.count()

    # one vertex for each distinct set
    vertex = t.write(full.groupBy("digest").agg(F.min("rid").alias("vid"), _first(full).alias("first")), "vertices", n_docs)
    chosen = pick(full, vertex.select(F.col("vid").alias("id")), t, "ids-leads", n_docs)
    points = full.select("rid", "n", "point")
    # only sets of like size can link: a lead counts for the octaves of size that its set can meet
    octave = lambda n: F.floor(F.log2(n)).cast("int")
    reach = F.sequence(octave(F.col("n")), octave(F.floor(F.col("n") * den / num)))
    leads = chosen.select("rid", "n", reach.alias("reach"), F.explode("lead").alias("lead")).select("rid", "n", "lead", F.explode("reach").alias("octave"))
    leads = leads.select("rid", "n", F.xxhash64("lead", "octave").alias("token"))
    n_leads = chosen.agg(F.sum(F.size("lead").cast("long") * F.size(reach))).first()[0] or 0
    # most leads stand alone: a bare count finds the others, and what more there is to know is asked of these few
    trees = leads.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    trees = t.write(trees.withColumnRenamed("token", "_token"), "trees", n_leads // 2)
    within = t.write(leads.join(trees.hint("merge"), F.col("token") == F.col("_token")).select("token", "rid", "n", "size"), "members", n_leads)
    n_within = within.count()
    t.drop("ids-leads", "trees")

    # a round against one leader: of the first members of its trees the one that a vertex shares most of them with
    ends = within.groupBy(F.col("token").alias("_token")).agg(F.min(F.struct("rid", "n")).alias("end"))
    ended = within.join(ends.hint("merge"), F.col("token") == F.col("_token"))
    fits = (F.col("end.rid") != F.col("rid")) & (den * F.col("end.n") >= num * F.col("n")) & (den * F.col("n") >= num * F.col("end.n"))
    led = ended.where(fits).groupBy(F.col("rid").alias("b"), F.col("end.rid").alias("a")).agg(F.count("*").alias("_shared"))
    stars = t.write(led.groupBy("b").agg(F.max_by("a", F.struct("_shared", -F.col("a"))).alias("a")).select("a", "b"), "stars", n_docs)
    tried = t.write(bounded(points, stars, num, den, t, "ids-stars"), "tried", stars.count(), PAIRS_A_TASK)
    links = t.write(verify(full, tried, num, den, t, "ids-tried"), "links", tried.count(), PAIRS_A_TASK)
    t.drop("stars", "ids-stars", "ids-stars-asked", "ids-tried", "ids-tried-asked")
    labels = connected_components(links, t, "labels")

    # trees between components
    mixed = relabel(within, labels)
    spread = mixed.groupBy("token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select(F.col("token").alias("_token"))
    spread = t.write(spread, "spread", n_within // 2)
    mixed = t.write(mixed.join(spread, F.col("token") == F.col("_token")).select("token", "rid", "n", "size", "label"), "mixed", n_within)
    t.drop("members", "spread")
    n_mixed = mixed.count()
    lists = mixed.where(F.col("size") <= LISTED).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("rid", "label", "n"))).alias("l"))

    def company(x):
        """Whether another component's set of a size that can reach the threshold is in the list."""
        return F.exists("l", lambda y: (y["label"] != x["label"]) & (den * y["n"] >= num * x["n"]) & (den * x["n"] >= num * y["n"]))

    lists = lists.select(F.filter("l", company).alias("l")).where(F.size("l") > 1).distinct()
    small = t.write(lists.select(F.xxhash64("l").alias("tree"), F.explode("l").alias("m")).select("tree", "m.rid", "m.label").distinct(), "small", n_mixed)
    n_small = small.count()
    place = pick(points, small.select(F.col("rid").alias("id")), t, "ids-small", n_small).withColumnRenamed("rid", "_rid")
    placed = place.join(sent(small, n_small), F.col("rid") == F.col("_rid")).select("tree", "rid", "label", "n", "point").repartition("tree").sortWithinPartitions("tree")
    both = F.array_sort(F.array("a", "b"))
    known = tried.select(both[0].alias("a"), both[1].alias("b"))
    pairs = t.write(small_tree_pairs(placed, num, den).distinct().join(known, ["a", "b"], "left_anti"), "pairs", n_small, PAIRS_A_TASK)
    t.drop("small", "ids-small", "tried")
    more = t.write(verify(full, pairs, num, den, t, "ids-pairs"), "more", pairs.count(), PAIRS_A_TASK)
    t.drop("pairs", "ids-pairs", "ids-pairs-asked")

    order = ["tree", "label", "n", "rid"]
    big = mixed.where(F.col("size") > LISTED).select(F.col("token").alias("tree"), "rid", "label")
    n_big = big.count()
    sets = pick(full, big.select(F.col("rid").alias("id")), t, "ids-big", n_big).select(F.col("rid").alias("_rid"), "n", "point", "members")
    big = sets.join(sent(big, n_big), F.col("rid") == F.col("_rid")).select(*order, "point", "members")
    cut = t.write(leaves(big.repartitionByRange(*order).sortWithinPartitions(*order)), "leaves", n_big, PAIRS_A_TASK)
    t.drop("mixed", "ids-big")
    met = t.write(leaf_pairs(cut, num, den), "leaf-pairs", cut.count())
    across = t.write(leaf_links(cut, met, num, den), "across", met.count(), LEAVES_A_TASK)
    t.drop("leaves", "leaf-pairs")
    more = more.unionByName(across)
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), t, "labels-2")

    of_vertex = relabel(vertex.withColumnRenamed("vid", "rid"), labels)
    smallest = of_vertex.groupBy(F.col("label").alias("_l")).agg(F.min("first").alias("smallest"))
    of_set = of_vertex.join(smallest, F.col("label") == F.col("_l")).select(F.col("digest").alias("_digest"), F.col("smallest").alias("first"))
    rows = ["doc_id", "h1", "h2", "n"]
    out = full.join(of_set, F.col("digest") == F.col("_digest")).select(*rows, "first")
    out = t.write(out.unionByName(table.where(F.col("n") == 0).select(*rows, F.lit(None).cast(out.schema["first"].dataType).alias("first"))), "result", n_docs)
    t.drop("sets", "vertices", "links", "more", "across")
    return out


def similar_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; links are Jaccard >= num / den."""
    found = classes(docs, words, num, den)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; columns unchanged.

    Ids only order rows (null last, then by a hash of the text): rows that share an id but not a text
    are told apart, and a component of rows without ids keeps one.  Rows with an empty set all stay.
    Of rows equal in id and text that stand for their component, one stays.
    """
    found, key = classes(docs, words, num, den), ["doc_id", "h1", "h2"]
    counted = found.groupBy(*key, "n", "first").agg(F.count("*").alias("rows"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    kept = counted.where((F.col("n") == 0) | own.eqNullSafe(F.col("first")))
    kept = kept.select(*[F.col(c).alias(f"__{c}") for c in key], ((F.col("n") > 0) & (F.col("rows") > 1)).alias("__again"))
    kept = Scratch(docs.sparkSession, "kept").write(kept, "rows")
    columns = [docs[c] for c in docs.columns]
    named = docs.select(*columns, docs["doc_id"].alias("__id"), *[h.alias(f"__own_{h_name}") for h, h_name in zip(text_hashes(), ("h1", "h2"), strict=True)])
    same = F.col("__id").eqNullSafe(F.col("__doc_id")) & (F.col("__own_h1") == F.col("__h1")) & (F.col("__own_h2") == F.col("__h2"))
    once = named.join(kept.where(~F.col("__again")), same, "left_semi").drop("__id", "__own_h1", "__own_h2")
    repeated = kept.where("__again")
    if repeated.isEmpty():
        return once
    again = named.join(repeated, same, "left_semi").dropDuplicates(["__id", "__own_h1", "__own_h2"])
    return once.unionByName(again.drop("__id", "__own_h1", "__own_h2"))

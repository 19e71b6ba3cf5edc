"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (levels of bit slots, each key placed at the
first level where it is alone) resolves a pre-token that is a vocabulary entry.  Tier 2: other
pre-tokens are merged by a heap of candidate pairs over a linked list of bytes, O(n log n) in the
pre-token's length.  Results of either tier stay in a bounded cache.

Scale.  No shuffle: each document is encoded where it is read.  Memory in a worker is the
vocabulary, the bounded cache and one slice of documents.  The vocabulary file is read on the
driver and broadcast; its size is fixed.

Defined results.  A null or empty text has no ids and decodes to no bytes; a very long text is cut
into pre-tokens bit by bit, a very long pre-token costs n log n.  Of equal ranks the leftmost merges
first.  Each row, repeated or with a null id, gives one row; an empty table gives none.  All other
columns of the input pass through unchanged, an own ``ids`` or ``decoded`` column is replaced.
Letters and digits are those that tiktoken knows, whatever version of Unicode ``regex`` has.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches
from .vocab import Memo, broadcast_file, ranks_of, release, splitter, unlike_letters

_MASK = (1 << 128) - 1
_MIX = 0x9E3779B97F4A7C15F39CC0605CEDC835
#: Documents handled at once in a worker.
SLICE = 256
#: Bytes of a generation of the cache by default; a worker keeps two of them at most.
CACHE_BYTES = 32 << 20


class PerfectHash:
    """Minimal perfect hash: n keys -> 0..n-1; other keys are told apart by comparing.

    Level after level, keys that are alone in their slot are placed there.  A level reads its slot
    from bits of a 128-bit hash of its own where there are enough, else from a rehash.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.digest = xxhash.xxh3_128_intdigest
        hashes = [self.digest(k) for k in keys]
        left, placed, shift, self.levels = list(range(len(keys))), 0, 0, []
        order: list[int] = []
        while left:
            if len(self.levels) > 200:
                raise ValueError("two keys share a hash")
            bits = max(1, (len(left) - 1).bit_length() + 1)
            if shift + bits > 128:
                hashes, shift = [h * _MIX & _MASK for h in hashes], 64
                self.levels.append((-1, 0, array("i")))
            mask = (1 << bits) - 1
            slots = [hashes[i] >> shift & mask for i in left]
            counts = np.bincount(slots, minlength=mask + 1)
            rank = np.full(mask + 1, -1, dtype=np.int32)
            rank[counts == 1] = placed + np.arange(int((counts == 1).sum()), dtype=np.int32)  # rank of the slot among all used ones
            alone = {int(rank[x]): i for i, x in zip(left, slots, strict=True) if counts[x] == 1}
            order += [alone[placed + n] for n in range(len(alone))]
            placed += len(alone)
            self.levels.append((shift, mask, array("i", rank.tobytes())))
            left = [i for i, x in zip(left, slots, strict=True) if counts[x] > 1]
            shift += bits
        self.order = order
        self.keys = [keys[i] for i in order]

    def find(self, key: bytes) -> int:
        """Index of the key, -1 if it is none of the keys."""
        h = self.digest(key)
        for shift, mask, rank in self.levels:
            if shift < 0:
                h = h * _MIX & _MASK
            elif (r := rank[h >> shift & mask]) >= 0:
                return r if self.keys[r] == key else -1
        return -1


class Encoder:
    """Encodes pre-tokens by one vocabulary."""

    def __init__(self, content: bytes, cache: int = CACHE_BYTES):
        ranks = ranks_of(content)
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.id_at = [ranks[k] for k in self.hash.keys]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.bits = max(ranks.values()).bit_length()
        self.merges: dict[int, int] = {}
        for key, rank in ranks.items():
            for i in range(1, len(key)):
                a, b = ranks.get(key[:i]), ranks.get(key[i:])
                if a is not None and b is not None:
                    self.merges[a << self.bits | b] = rank
        self.byte_pairs = [self.merges.get(a << self.bits | b, -1) for a in self.byte_ids for b in self.byte_ids]
        self.memo = Memo(self.packed, most=cache)

    def packed(self, piece: str) -> bytes:
        """Ids of a pre-token, 4 bytes each."""
        return array("i", self.encode_piece(piece)).tobytes()

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        at = self.hash.find(data)
        return [self.id_at[at]] if at >= 0 else self.merge(data)

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over a doubly linked list.

        ``merged[i]`` is the rank that i and its successor merge to, -1 if none.  A heap entry
        (rank, i) packed in one number, small for all but very long pre-tokens, is out of date
        when ``merged[i]`` is no longer its rank.
        """
        n, bits, get, first = len(data), self.bits, self.merges.get, self.byte_pairs
        shift = 13 if n < 8192 else 32
        mask = (1 << shift) - 1
        ids = [*map(self.byte_ids.__getitem__, data)]
        merged = [first[a << 8 | b] for a, b in zip(data, data[1:])]  # noqa: B905
        heap = [r << shift | i for i, r in enumerate(merged) if r >= 0]
        merged.append(-1)
        heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & mask
            rank = entry >> shift
            if merged[i] != rank:
                continue
            j = nxt[i]
            ids[i] = rank
            ids[j] = merged[j] = -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                merged[i] = r = get(rank << bits | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                merged[i] = -1
            h = prv[i]
            if h >= 0:
                merged[h] = r = get(ids[h] << bits | rank, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [x for x in ids if x >= 0]


class Decoder:
    """Turns ids into bytes; needs no more than the entries side by side."""

    def __init__(self, content: bytes):
        lines = [line.split() for line in content.splitlines() if line]
        entries = [b""] * (max(int(rank) for _, rank in lines) + 1)
        for entry, rank in lines:
            entries[int(rank)] = base64.b64decode(entry)
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in entries], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids -> all their bytes, and the length of each id's share."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - size), size)
        return self.flat[shift + np.arange(total)], ends


@lru_cache(maxsize=1)
def encoder_of(content: bytes, cache: int) -> Encoder:
    """A worker's encoder: its tables and cache serve all tasks that the worker runs."""
    encoder = Encoder(content, cache)
    ranks_of.cache_clear()
    return encoder


@lru_cache(maxsize=2)
def decoder_of(content: bytes) -> Decoder:
    return Decoder(content)


def _without(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c.lower() != name]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, cache: int = CACHE_BYTES, resident: bool = True) -> DataFrame:
    """Adds ``ids`` (array of int) to the columns ``keep`` (all by default).

    ``cache`` trades a worker's memory for time; unless ``resident`` a worker gives it back after each task.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "ids"]
    bound_batches(docs.sparkSession)
    file = broadcast_file(docs.sparkSession, path)
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("_encode"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    unlike = unlike_letters()

    def run(batches):
        look, split = encoder_of(file.value, cache).memo.__getitem__, splitter(pattern, unlike)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                packed, ends, at_id = [], [0], 0
                for value in part.column(part.num_columns - 1):
                    for pieces in split(value.as_py() or ""):
                        packed.append(b"".join(map(look, pieces)))
                        at_id += len(packed[-1]) // 4
                    ends.append(at_id)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[f.name for f in schema.fields])
        if not resident:
            del look
            encoder_of.cache_clear()
            release()

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (the bytes of ``ids``) to an encoded table."""
    keep = _without(encoded, "decoded")
    file = broadcast_file(encoded.sparkSession, path)
    source = encoded.select(*[encoded[c] for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType(), False)])
    where = [c.lower() for c in keep].index("ids")

    def run(batches):
        decoder = decoder_of(file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(where)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, ends = decoder.decode(ids)
                marks = np.concatenate([[0], ends])
                counts = np.array([len(x) for x in lists], dtype=np.int64)
                cuts = marks[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                decoded = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)

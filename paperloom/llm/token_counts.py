"""Token counts under a unigram model, by dynamic programming shared over a trie.

Distinct pre-tokens go into a byte trie.  Each trie node stands for a prefix and keeps the best
score of any segmentation of that prefix and its number of tokens; it is computed once, from the
nodes on its own path, when the node is made.  All pre-tokens with that prefix share it.  Where a
pre-token ends, its count is kept.

Model.  Pieces are the entries of a vocabulary file; the probability of a piece falls with its
rank by Zipf's law, p ~ 1 / (rank + OFFSET).  Scores are whole micro-nats, so that the best
segmentation is well defined: highest score, then fewest tokens.  All single bytes are pieces,
so each pre-token has a segmentation.

Scale.  No shuffle: a worker keeps one trie and starts a new one past ``MAX_NODES``, so memory is
bounded and only repeated work depends on the corpus.

Defined results.  Null and empty texts count 0 tokens; a very long text is cut into pre-tokens bit
by bit.  Of segmentations with equal scores the one with the fewest tokens counts.  Each row, repeated
or with a null id, gives one row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches
from .vocab import Memo, broadcast_file, ranks_of, splitter, unlike_letters

OFFSET = 2.7
MICRO = 1_000_000
MAX_NODES = 600_000


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Log probability of each piece in micro-nats."""
    norm = math.log(sum(1 / (r + OFFSET) for r in ranks.values()))
    return {k: -round(MICRO * (math.log(r + OFFSET) + norm)) for k, r in ranks.items()}


class TrieCounter:
    """count(bytes) -> tokens in the best segmentation."""

    def __init__(self, scores: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0], [0]

    def count(self, data: bytes) -> int:
        if len(self.score) + len(data) > self.max_nodes and len(self.score) > 1:
            self.clear()
        child, score, tokens, scores = self.child, self.score, self.tokens, self.scores
        path, node = [0], 0
        for i, byte in enumerate(data):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                best, fewest = None, 0
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    own = scores.get(data[j : i + 1])
                    if own is not None:
                        at = path[j]
                        total, n = score[at] + own, tokens[at] + 1
                        if best is None or total > best or total == best and n < fewest:
                            best, fewest = total, n
                node = child[key] = len(score)
                score.append(best)
                tokens.append(fewest)
            path.append(node)
        return tokens[node]


@lru_cache(maxsize=2)
def counter_of(content: bytes) -> Memo:
    trie = TrieCounter(unigram_scores(ranks_of(content)))
    return Memo(lambda piece: trie.count(piece.encode("utf-8")))


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each document's whole text."""
    bound_batches(docs.sparkSession)
    file = broadcast_file(docs.sparkSession, path)
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_pretokens", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    unlike = unlike_letters()

    def run(batches):
        look, split = counter_of(file.value).__getitem__, splitter(pattern, unlike)
        for batch in batches:
            pieces, tokens = [], []
            for value in batch.column(1):
                n = total = 0
                for part in split(value.as_py() or ""):
                    n += len(part)
                    total += sum(map(look, part))
                pieces.append(n)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import ngram_join
from paperloom.llm.common import Scratch
from paperloom.llm.components import connected_components

RNG = random.Random(9)
VOCAB = [f"w{i}" for i in range(400)]


def near(words, edits):
    out = list(words)
    for _ in range(edits):
        out[RNG.randrange(len(out))] = RNG.choice(VOCAB)
    return " ".join(out)


def corpus():
    texts = []
    for _ in range(12):
        base = [RNG.choice(VOCAB) for _ in range(RNG.choice([6, 40, 80]))]
        texts += [near(base, RNG.choice([0, 1, 1, 2, 3])) for _ in range(RNG.choice([1, 2, 6]))]
    base = [RNG.choice(VOCAB) for _ in range(120)]
    texts += [near(base, RNG.choice([1, 2, 3, 4])) for _ in range(60)]
    texts += ["Passage all share here now " + near([RNG.choice(VOCAB) for _ in range(50)], 0) for _ in range(20)]
    base = [RNG.choice(VOCAB) for _ in range(66)]
    texts += [" ".join(base[: 66 - i]) for i in range(0, 12, 2)]  # around a power of two
    texts += ["One  Two\tthree\nfour five six", "one two THREE four five six", "two words", "TWO words", "two", None, "", " \n ", "É one two", "é one two", "long " * 60_000]
    RNG.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num", "listed", "block"), [(3, 90, 64, 1024), (5, 80, 4, 8), (3, 60, 2, 5)])
def test_equals_brute_force(spark, documents, monkeypatch, k, num, listed, block):
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    got = ngram_join.similar_documents(documents(rows).repartition(3), k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, num, 100)
    assert len(got) == len(rows)


def test_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = ngram_join.similar_documents(documents(rows), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)


def test_one_of_each(spark, documents):
    rows = [(4, "a b c d e f g"), (2, "A b c d e f g"), (9, "x y z p q r"), (7, None), (8, ""), (None, "no id at all here now"), (9, "x y z p q r")]
    docs = documents([(i, t, "s", 5) for i, t in rows], ", N int")
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 2, 7, 8, 9]
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_goes_by_row_not_by_id(spark, documents):
    rows = [(1, "a b c d e f g"), (1, "totally other words than those before"), (None, "one two three four five"), (None, "ONE two three four five"), (None, "one two three four five"), (None, None), (None, None), (5, " "), (5, " "), (0, "one two three four five six seven eight nine ten"), (0, "")]
    out = [(r.doc_id, r.text) for r in ngram_join.one_of_each(documents(rows).repartition(4)).collect()]
    assert len(out) == 9
    assert {(1, "a b c d e f g"), (1, "totally other words than those before"), (0, ""), (0, rows[9][1])} <= set(out)
    assert out.count((None, None)) == 2 and out.count((5, " ")) == 2
    assert sum(i is None and t is not None for i, t in out) == 1


def test_all_rows_equal(spark, documents):
    got = ngram_join.similar_documents(documents([(i, "one text for all of the rows") for i in range(50)]), 3, 90, 100).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 50


@pytest.mark.parametrize("n", [1, 5, 16, 17, 300])
def test_tree_gives_every_reachable_pair(n):
    rng = np.random.default_rng(n)
    points = rng.poisson(3, (n, ngram_join.GROUPS)) + (rng.integers(0, 3, n)[:, None])
    labels = rng.integers(0, max(2, n // 3), n)
    sizes = points.sum(axis=1)
    tree = ngram_join.CountTree(points, sizes, labels)
    got = sorted(tuple(sorted((int(a), int(b)))) for x, y in tree.pairs(tree, 70, 100) for a, b in zip(x, y, strict=True))
    need = lambda i, j: np.minimum(points[i], points[j]).sum() >= ngram_join.pair_needed(int(sizes[i] + sizes[j]), 70, 100)
    assert got == sorted((i, j) for i in range(n) for j in range(i + 1, n) if labels[i] != labels[j] and need(i, j))


def test_points_of_very_large_sets(spark, documents, monkeypatch):
    """Groups of more than 65,535 shingles: one group stands for 64 such groups of a longer text."""
    monkeypatch.setattr(ngram_join, "GROUPS", 1)
    words = [f"v{i}" for i in range(90_000)]
    docs = documents([(1, " ".join(words)), (2, " ".join(words[:-5] + ["x"] * 5))])
    sets = ngram_join.describe(docs, np.zeros(ngram_join.CELLS, dtype=np.uint8), 3, 90, 100).collect()
    tree = ngram_join._tree([(r.rid, r.rid, r.n, r.point) for r in sets])
    assert len(list(tree.pairs(tree, 90, 100))) == 1
    assert {r.component_id for r in ngram_join.similar_documents(docs, 3, 90, 100).collect()} == {1}


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 900), (900, 700)], "a long, b long"))
    got = {r.id: r.label for r in connected_components(links, Scratch(spark, "test"), "a").collect()}
    assert all(got[i] == 0 for i in range(201)) and got[700] == got[900] == 500
    assert connected_components(links.limit(0), Scratch(spark, "test"), "b").count() == 0


def test_hashes_and_packing():
    s = ngram_join.Shingler(3)("a b c d e f a b c")
    assert len(s) == 6 and (np.diff(s.astype(object)) > 0).all()
    assert len(ngram_join.Shingler(3)("")) == 0 and len(ngram_join.Shingler(3)("a b")) == 1
    raw = (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    assert (ngram_join.unpack(raw) == s >> np.uint64(16)).all()
    assert ngram_join.overlap(np.array([1, 3, 5]), np.array([3, 4, 5, 9])) == 2

import math

import numpy as np
import pytest

from paperloom.llm import ann, blocks, topk

RNG = np.random.default_rng(3)


def vectors(spark, rows, kind="float"):
    """With a column that clashes with a result's."""
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, Score string")


def odd_rows():
    base = [(i, [float(x) for x in RNG.standard_normal(8).astype(np.float32)]) for i in range(160)]
    base += [(200 + i, base[7][1]) for i in range(30)]  # ties
    base += [(300, [0.0] * 8), (350, None), (400, [1.0, None] + [0.0] * 6), (450, [math.nan] * 8), (500, [math.inf] + [0.0] * 7), (550, []), (600, [1.0, 2.0]), (None, [1.0] * 8), (650, [2.0] * 8), (650, [3.0] * 8)]
    return base


def good(rows):
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]


def brute(rows, score, k=5):
    queries = {}
    for i, v in rows:
        if i % 50 == 0:
            queries[i] = v if i not in queries or list(v) < list(queries[i]) else queries[i]
    out = {}
    for q, v in queries.items():
        found = sorted((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_top_k(spark, monkeypatch):
    rows = odd_rows()
    whole = [(i, np.floor(256 * v).astype(np.int64)) for i, v in good(rows)]
    expected = {q: v for q, v in brute(whole, lambda a, b: int(a @ b)).items() if v}
    for size in (8192, 7):
        monkeypatch.setattr(blocks, "CANDIDATES", size)
        monkeypatch.setattr(blocks, "QUERIES", 2)
        assert grouped(topk.top_k(vectors(spark, rows).repartition(3)).collect()) == expected
    assert topk.top_k(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shape", [(1, 3), (5, 1), (300, 16), (2000, 4), (500, 64)])
def test_index_finds_all_members(shape):
    matrix = np.round(RNG.standard_normal(shape) * 60)
    index = topk.ImpactIndex(matrix)
    for _ in range(20):
        q = np.round(RNG.standard_normal(shape[1]) * 60)
        own = np.zeros(shape[0], dtype=bool)
        own[RNG.integers(shape[0])] = True
        at = index.members(q, 5, own)
        exact = index.scores(q, at)
        full = np.where(own, -(10**15), matrix @ q)
        best = np.sort(full)[::-1][: min(5, shape[0] - 1)]
        assert sorted(exact)[::-1][: len(best)] == list(best)
        assert (exact == full[at]).all()


def test_index_stops_on_proof_and_looks_between_rounds():
    """Few large components decide: most of the index is never taken."""
    matrix = np.round(RNG.exponential(2, (4000, 8)) ** 4)
    index = topk.ImpactIndex(matrix)
    q, own = np.array([900.0] + [1.0] * 7), np.zeros(4000, dtype=bool)
    assert len(index.members(q, 5, own)) <= 200


@pytest.mark.parametrize(("large", "dim"), [(1e7, 2), (8e6, 64), (3e9, 3)])
def test_large_components(spark, large, dim):
    rows = [(i, [float(x) for x in RNG.standard_normal(dim)]) for i in range(120)]
    rows += [(1001 + i, [large * (1 + i / 8)] + [1.0] * (dim - 1)) for i in range(4)] + [(2001, [-large] * dim), (2002, [large] * dim)]
    rows += [(2050, [1.0] + [0.0] * (dim - 1)), (3050, [200.0] * dim), (4050, [-100.0] * dim)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expected = brute(whole, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert expected[2050][0][0] == 1004 and expected[3050][0][0] == (2002 if dim == 64 else expected[3050][0][0])
    assert grouped(topk.top_k(vectors(spark, rows, "double")).collect()) == expected


def test_a_score_beyond_long_is_an_error(spark):
    rows = [(0, [4e15, 1.0]), (1, [4e15, 2.0])]
    with pytest.raises(Exception, match="no long can hold"):
        topk.top_k(vectors(spark, rows, "double")).collect()


def test_norms_beyond_doubles(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3e200, 3e200])]
    got = grouped(ann.neighbours(vectors(spark, rows, "double")).collect())
    assert [i for i, _ in got[0]] == [2, 1] and got[0][0][1] == pytest.approx(1) and got[0][1][1] == pytest.approx(0.5**0.5)


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in table.collect()]
    cosine = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    expected, got = brute(data, cosine), grouped(ann.neighbours(table).collect())
    by_id = dict(data)
    hits = sum(len({i for i, _ in expected[q]} & {i for i, _ in got[q]}) for q in expected)
    assert hits >= 0.98 * 5 * len(expected) and set(got) == set(expected)
    for q, found in got.items():
        assert len(found) == 5
        for i, s in found:
            assert abs(s - cosine(by_id[q], by_id[i])) < 1e-12


def test_approximate_search_on_odd_rows(spark):
    rows = odd_rows()
    rows_in = [(i, v) for i, v in good(rows) if (v != 0).any()]
    got = grouped(ann.neighbours(vectors(spark, rows).repartition(3)).collect())
    cosine = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    expected = {q: v for q, v in brute(rows_in, cosine).items() if v}
    assert set(got) == set(expected)
    same = sum(len({i for i, _ in expected[q]} & {i for i, _ in got[q]}) for q in expected)
    assert same >= 0.9 * sum(map(len, expected.values()))
    assert ann.neighbours(vectors(spark, rows).limit(0)).count() == 0


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])]
    assert {q: len(v) for q, v in grouped(topk.top_k(vectors(spark, rows)).collect()).items()} == {0: 2, 50: 2}
    assert {q: len(v) for q, v in grouped(ann.neighbours(vectors(spark, rows)).collect()).items()} == {0: 2, 50: 2}
    assert topk.top_k(vectors(spark, [(0, [1.0])])).count() == 0


def test_error_bound_holds():
    matrix = RNG.standard_normal((3000, 64))
    index = ann.BitIndex(matrix)
    q = RNG.standard_normal(64)
    guess, error = index.estimate(q)
    true = (matrix @ q) / np.linalg.norm(matrix, axis=1) / np.linalg.norm(q)
    assert (np.abs(guess - true) <= error).mean() > 0.99
    assert abs((guess - true).mean()) < 0.01

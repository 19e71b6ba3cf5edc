import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality, toxicity
from paperloom.llm.common import fold

TRICKY = [(9001, None), (9002, ""), (9003, "word " * 40_000), (None, "no id"), (9004, "\n\n  \t"), (9005, "same"), (9005, "same")]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        rank[score == v] = np.mean(np.flatnonzero(score[order] == v)) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * (len(y) - n1))


@pytest.mark.parametrize(("query", "label", "least"), [("op4_toxicity", "toxic", 0.93), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    from paperloom.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.queries()[query](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", label).toPandas()
    assert auc(held.score.values, held[label].values) > least
    assert (held.predicted == held[label]).mean() > least
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_unlabelled_rows_and_odd_texts(spark, documents):
    docs = documents([(i, f"fine words here number {i}" if i % 3 else f"bad zorkish thing {i}") for i in range(300)] + TRICKY, "")
    labels = labelled(spark, [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None), (777777, 1, 0)])
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score_documents(docs.withColumn("SCORE", F.lit("x")), model)
    assert got.columns == [*docs.columns, "score"] and got.count() == 300 + len(TRICKY)
    by_id = {r.doc_id: r.score for r in got.collect()}
    assert all(by_id[i] > 0.5 for i in range(0, 300, 3)) and all(by_id[i] < 0.5 for i in range(1, 300, 3))
    assert by_id[9001] == by_id[9002] < 0.5
    ranker = quality.train(docs, labels, F.lit(True))
    scores = quality.score_documents(docs, ranker)
    assert scores.count() == 300 + len(TRICKY) and scores.where("score is null").count() == 0
    assert sorted(r.score for r in scores.collect()) == sorted(r.score for r in quality.score_documents(docs, quality.train(docs.repartition(7), labels, F.lit(True))).collect())


def test_without_examples(spark, documents):
    docs, none = documents([(1, "a"), (2, None)]), labelled(spark, []).limit(0)
    assert quality.train(docs, none, F.lit(True)) is None
    assert {r.score for r in quality.score_documents(docs, None).collect()} == {quality.CUT}
    model = toxicity.train(docs, none, F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score_documents(docs, model).collect())
    assert quality.score_documents(docs.limit(0), None).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    docs = documents([(i, f"good text {i}" if i % 2 else f"!!! BAD {i}") for i in range(200)])
    usable = fold(F.col("doc_id"), 4) != 2
    labels = labelled(spark, [(i, i % 2, 0) for i in range(200)])
    turned = labels.withColumn("quality", F.when(usable, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.score_documents(docs, quality.train(docs, x, usable)).collect()) for x in (labels, turned))
    assert a == b


def test_non_negative_risk_ignores_noise():
    rng = np.random.default_rng(1)
    clean = [np.unique(rng.integers(0, 5000, 60)).astype(np.int32) for _ in range(400)]
    toxic = [np.unique(np.append(x, 9_000 + i % 3)).astype(np.int32) for i, x in enumerate(clean[:80])]
    model = toxicity.fit(toxic[:40], clean[200:] + toxic[40:60], 0.1)
    assert set(sorted(model.weights, key=model.weights.get)[-3:]) == {9000, 9001, 9002}
    logit = lambda x: model.bias + sum(model.weights.get(int(f), 0) for f in x)
    assert sum(logit(x) > 0 for x in toxic[60:]) == 20 and sum(logit(x) > 0 for x in clean[80:200]) <= 6


def test_pairs_alone_decide_scores():
    x = np.zeros((200, quality.N_FEATURES))
    x[:, 0] = np.linspace(0, 1, 200)
    model = quality.fit(x, np.arange(200) >= 50)
    assert ((model.score(x) >= quality.CUT) == (np.arange(200) >= 50)).mean() > 0.9


def test_risk_gradient_equals_differences():
    """Against the risk written out with loops, on both sides of the correction."""
    rng = np.random.default_rng(2)
    p, u = (rng.integers(0, 2, (n, 6)) for n in (9, 14))
    side = lambda x: (*np.nonzero(x), len(x))
    soft = lambda z: float(np.log1p(np.exp(z)))

    def parts(theta, prior):
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        return prior * sum(soft(-z) for z in zp) / 9, sum(soft(z) for z in zu) / 14 - prior * sum(soft(z) for z in zp) / 9

    seen = set()
    for _ in range(60):
        theta, prior = rng.normal(0, 2, 7), rng.uniform(0.05, 0.9)
        plus, bracket = parts(theta, prior)
        value, gradient = toxicity.risk(side(p), side(u), prior, theta[:-1], theta[-1])
        assert value == pytest.approx(plus + max(0, bracket))
        goal = (lambda t: sum(parts(t, prior))) if bracket >= 0 else (lambda t: -parts(t, prior)[1])  # noqa: B023
        naive = [(goal(theta + d) - goal(theta - d)) / 2e-5 for d in np.eye(7) * 1e-5]
        assert gradient == pytest.approx(naive, abs=1e-6)
        seen.add(bracket >= 0)
    assert seen == {True, False}


def test_pair_gradient_equals_differences():
    rng = np.random.default_rng(3)
    winners, losers, w = rng.integers(0, 12, (20, 3)), rng.integers(0, 12, (20, 3)), rng.normal(0, 1, 12)
    loss = lambda w: np.mean([np.log1p(np.exp(-(sum(w[a]) - sum(w[b])))) for a, b in zip(winners, losers, strict=True)])
    naive = [(loss(w + d) - loss(w - d)) / 2e-5 for d in np.eye(12) * 1e-5]
    assert quality.pair_gradient(winners, losers, w) == pytest.approx(naive, abs=1e-7)


def test_weighted_quantiles():
    x = np.array([5.0, 1.0, 3.0])
    assert quality.weighted_quantiles(x, np.array([1.0, 1.0, 2.0]), np.array([0.2, 0.5, 0.8, 1.0])).tolist() == [1.0, 3.0, 5.0, 5.0]


def test_unspaced_scripts_and_short_words():
    assert len(toxicity.word_features("毒言葉です")) == 4 and len(toxicity.word_features("毒")) == 1
    assert toxicity.word_features("ox") == () and len(toxicity.word_features("oxen")) == 1
    docs = [f"普通の文章{i}です" for i in range(40)]
    bad = [f"とても毒言葉{i}だ" for i in range(40)]
    sets = [[toxicity.text_features(t) for t in x] for x in (bad[:20], docs[:30] + bad[20:30])]
    model = toxicity.fit(sets[0], sets[1], 0.25)
    assert all(model.score(t) > 0.5 for t in bad[30:]) and all(model.score(t) < 0.5 for t in docs[30:])


def test_prior_comes_from_positives_and_unlabelled(spark, documents):
    """Turning every non-toxic label changes nothing; the bound is near the true share."""
    from paperloom.llm.common import Scratch

    docs = documents([(i, f"fine words here number {i}" if i % 5 else f"zorkish thing {i}") for i in range(600)] + [(7, "again")] * 50)
    labels = labelled(spark, [(i, 1, int(i % 5 == 0)) for i in range(0, 300)])
    a = toxicity.train(docs, labels, F.lit(True))
    b = toxicity.train(docs, labels.where("toxic = 1").unionByName(labelled(spark, [(1, None, None)])), F.lit(True))
    assert (a.weights, a.bias) == (b.weights, b.bias)
    rows = toxicity.training_features(docs, labels, F.lit(True), 4000, Scratch(spark, "test"))
    assert rows.where("p = 0").count() == 601 and rows.where("p = 1").count() == 60
    small = toxicity.training_features(docs, labels, F.lit(True), 20, Scratch(spark, "test"))
    assert small.where("p = 0").count() == 40 and small.where("p = 1").count() == 20


def test_empty_tables(spark, documents):
    docs, labels = documents([(1, "a")]).limit(0), labelled(spark, [(1, 1, 1)])
    assert toxicity.score_documents(docs, toxicity.train(docs, labels, F.lit(True))).count() == 0
    assert quality.train(docs, labels, F.lit(True)) is None


def test_quality_learns_from_every_labelled_row(spark, documents):
    """A kind of bad text that only the last bad ids in hash order have is known as bad; the executors learn the same as the driver."""
    ids = [r.id for r in spark.range(8600).orderBy(F.xxhash64("id"), "id").collect()]
    bad = set(ids[::2])
    rare = set([i for i in ids if i in bad][4000:])
    assert len(rare) == 300
    rows = [(i, f"fine words | | here | {i}" if i in rare else f"junk !!!! ??? {i}" if i in bad else f"fine words about something here {i}") for i in ids]
    docs, labels = documents(rows), labelled(spark, [(i, int(i not in bad), 0) for i in ids])
    model = quality.train(docs, labels, F.lit(True))
    x = np.array([quality.features(t) for _, t in rows])
    good = model.score(x) >= quality.CUT
    assert good[[i in rare for i, _ in rows]].sum() == 0
    assert (good == np.array([i not in bad for i, _ in rows])).mean() > 0.99
    apart = quality.train(docs, labels, F.lit(True), held_rows=0)
    assert (model.edges == apart.edges).all() and (model.weights == apart.weights).all() and (model.threshold, model.scale) == (apart.threshold, apart.scale)


def test_all_pairs_gradient_equals_that_of_the_pairs_written_out():
    rng = np.random.default_rng(5)
    at, good, w = rng.integers(0, quality.BINS, (150, 4)), rng.random(150) < 0.6, rng.normal(0, 1, 4 * quality.BINS)
    rows, i, j = at + np.arange(4) * quality.BINS, np.flatnonzero(good), np.flatnonzero(~good)
    plain = quality.pair_gradient(rows[np.repeat(i, len(j))], rows[np.tile(j, len(i))], w)
    assert quality.all_pairs_gradient(quality.tally(at, good, w), w) == pytest.approx(plain, abs=1e-3)


def test_edges_are_the_weighted_quantiles():
    rng = np.random.default_rng(6)
    x, good = rng.normal(0, 3, (333, 4)).astype(np.float32), rng.random(333) < 0.5
    edges = quality.edges_of(quality.Rows((x, good), np.dtype(np.float32)))
    weight = np.where(good, 2 / good.sum(), 1 / (~good).sum())
    assert all((edges[k] == quality.weighted_quantiles(x[:, k], weight, np.arange(1, 10) / 10)).all() for k in range(4))

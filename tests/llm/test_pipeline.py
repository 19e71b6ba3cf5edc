import public_tokenizers
import pytest
import tiktoken

from paperloom.llm import ngram_join, pii, quality
from paperloom.llm.vocab import ranks_of, read_file

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's result, by name."""
    from paperloom.llm.common import materialize

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, sf_dir), f"test-{name}")
    return out


def test_columns_stay(stages):
    for name in ("quality", "near_copies", "personal_data", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_clean_documents(spark, stages, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in stages["quality"].collect()}
    good = [r.doc_id in kept for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id in kept for r in labels.where("quality = 0").collect()]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def test_one_of_each_group(stages):
    docs = {r.doc_id: r.text for r in stages["quality"].collect()}
    sets = {i: set(ngram_join.Shingler(5)(t).tolist()) for i, t in docs.items()}
    kept = [r.doc_id for r in stages["near_copies"].collect()]
    assert len(kept) == len(set(kept))
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(similar(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if sets[a] and sets[b])
    reached, todo = set(kept), list(kept)
    while todo:
        x = todo.pop()
        new = {y for y in docs if y not in reached and sets[x] and sets[y] and similar(x, y)}
        reached |= new
        todo += new
    assert reached == set(docs)


def test_no_personal_data_left(stages):
    before = {r.doc_id: r.text for r in stages["near_copies"].collect()}
    for r in stages["personal_data"].collect():
        spans = pii.base_spans(before[r.doc_id])
        assert not any(before[r.doc_id][a:b] in r.text for kind, a, b in spans if kind == "email")
        if not spans:
            assert r.text == before[r.doc_id]


def test_mix_takes_rows_as_they_are(stages):
    before = {(r.doc_id, r.text) for r in stages["personal_data"].collect()}
    assert {(r.doc_id, r.text) for r in stages["mixing"].collect()} <= before
    assert stages["mixing"].count() > stages["personal_data"].count()


def test_encoding(stages):
    content = read_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(content), special_tokens={})
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    rows = stages["encoding"].collect()
    assert len(rows) == stages["mixing"].count()
    for r in rows:
        assert r.round_trip and r.ids == own.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, stages, sf_dir):
    key = lambda r: (r.doc_id, r.ids)
    assert sorted(map(key, pipeline.run(spark, sf_dir).collect())) == sorted(map(key, stages["encoding"].collect()))


def test_quality_cut_is_the_threshold():
    assert quality.CUT == 0.7


def odd_rows(documents):
    long = "word " * 30_000
    rows = [(None, None), (None, "no id here at all but words"), (1, ""), (1, "one id and two different texts, this one"), (1, "the other text under the same id"), (2, "repeated row of words a@b.co"), (2, "repeated row of words a@b.co"), (3, long), (4, " \n\t "), (5, None)]
    return documents([(i, t, None if i == 5 else "s", n, "x") for n, (i, t) in enumerate(rows)], ", Size int, BASE string"), rows


@pytest.mark.parametrize("at", range(4))
def test_stages_take_odd_rows(spark, documents, sf_dir, at):
    name, stage = pipeline.STAGES[at]
    docs, rows = odd_rows(documents)
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name == "quality":
        assert set(got) <= set(rows) and all(got.count(x) in (0, rows.count(x)) for x in rows)
    if name == "near_copies":
        assert sorted(got, key=repr) == sorted(set(rows), key=repr)
    if name == "personal_data":
        assert sorted(got, key=repr) == sorted(((i, t and t.replace("a@b.co", "[EMAIL]")) for i, t in rows), key=repr)
    if name == "mixing":
        assert set(got) <= set(rows) and {x for x in rows if not (x[1] or "").split()} <= set(got)


def test_encoding_takes_odd_rows(spark, documents, sf_dir):
    docs, rows = odd_rows(documents)
    stage = dict(pipeline.STAGES)["encoding"]
    out = stage(spark, docs, sf_dir).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    assert sorted(r.n_tokens == 0 for r in out) == sorted(not t for _, t in rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0

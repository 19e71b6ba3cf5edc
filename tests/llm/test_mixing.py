import hashlib
import re
from collections import defaultdict

import pytest

from paperloom.llm import mixing


def fill(sizes, weights, share, cap):
    """Resharing by weight until nothing is above its cap, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = {s: 0.0 for s in order}, share * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows, seed="mix-1"):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = fill(sizes, (5, 2, 1), 1.5, 2.0)
    out = []
    for source in sizes:
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        own = sorted((md5(f"{seed}:{i if i is not None else md5(t or '')}"), words(t), i) for i, t, s in rows if s == source)
        left = int(target[source] + 1e-6)
        taken = [0] * len(own)
        while left > 0 and sizes[source]:
            for n, (_, size, _) in enumerate(own):
                take = min(size, left)
                taken[n] += take
                left -= take
        out += [(i, size, sizes[source], taken[n]) for n, (_, size, i) in enumerate(own)]
    return sorted(out, key=repr), target


def corpus():
    rows = [(i, "w " * (1 + (i * 37) % 50), f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, "only few words", "tiny") for i in range(3)] + [(1100 + i, "x y z " * 40, None) for i in range(20)] + [(1200 + i, "y " * 9, "zz") for i in range(30)]
    rows += [(1300, None, "s0"), (1301, "", "s0"), (None, "a text without id", "s1"), (None, "another one", "s1"), (5, "w " * 4000, "s1"), (1302, "", "void"), (7, "w " * 10, "s1"), (7, "w " * 10, "s1")]
    return rows


def test_plan_equals_brute_force(spark, documents, monkeypatch):
    rows = corpus()
    expected, target = brute(rows)
    for bound in (20_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        got = mixing.plan_mix(documents([(*r, 1) for r in rows], ", TARGET int")).collect()
        assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got), key=repr) == expected
        for r in got:
            assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
            assert r.taken == r.epochs * r.size + r.cut


def test_sources_end_at_their_budget(spark, documents):
    got = mixing.plan_mix(documents(corpus())).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)


def test_mix_repeats_rows(spark, documents):
    docs = documents([(*r, 3) for r in corpus()], ", SIZE int")
    plan = mixing.plan_mix(docs)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    want = defaultdict(int)
    for r in plan.collect():
        want[r.doc_id, r.size] += 1 if r.size == 0 else r.epochs + int(2 * r.cut >= r.size)
    have = defaultdict(int)
    for r in mixed.collect():
        have[r.doc_id, words(r.text)] += 1
    assert have == {k: v for k, v in want.items() if v}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))


def test_empty_and_wordless(spark, documents):
    assert mixing.plan_mix(documents([(1, "a")]).limit(0)).count() == 0
    got = mixing.plan_mix(documents([(1, ""), (2, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
    assert mixing.mix_documents(documents([(1, ""), (2, None)])).count() == 2

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    double = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])]
    return sum(double) % 10 == 0


def brute(text):
    """The patterns as they are written, matched by the regular-expression engine."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and plain_luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="ab1290.@+-_ ()%é,\n4", max_size=60))
def test_linear_finders_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize(
    "text",
    ["a@b.c.d@e.f x@y", "1.2.3.4.5.6.7.8.9 256.1.1.1 1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 1234-567 +1 2 +123456789012345678", "0001.2.3.4", "x+1.2.3.4@d.e"],
)
def test_written_cases(text):
    assert pii.base_spans(text) == brute(text)


def test_random_cards():
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choice("0123456789- ") for _ in range(rng.randint(10, 40))) for _ in range(4))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "@" * 300_000):
        pii.base_spans(text)


def test_redact_merges_overlaps():
    assert pii.redact("abcdefghij", [(1, 3, "[A]"), (2, 5, "[B]"), (7, 8, "")]) == "a[A]fgij"
    assert pii.redact("abc", []) == "abc"
    assert pii.redact("abc", [(0, 3, "[X]")]) == "[X]"


def rows():
    """Two entities; 'zorblax' only ever stands beside the first one, 'mail' beside all."""
    out = []
    for i in range(12):
        out.append((i, f"note {i} mail zorblax joe@corp.com thanks alpha{chr(97 + i)}"))
    for i in range(12, 24):
        out.append((i, f"note mail eve{i % 3}@else.org thanks"))
    out += [(i, f"plain text mail thanks note number {i}") for i in range(24, 400)]
    out += [(900, None), (901, ""), (None, "lost joe@corp.com here"), (902, "é" * 200_000 + " a@b.co")]
    return out


def test_terms_that_reveal(spark, documents):
    docs = documents([(a, b, "s", 1) for a, b in rows()], ", BASE int")
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert len(got) == len(rows())
    text = dict(rows())[0]
    assert [(s.start, s.end) for s in got[0].terms] == [(text.index("zorblax"), text.index("zorblax") + 7)]
    assert got[30].terms == [] and got[900].base == [] and got[901].base == []
    assert len(got[902].base) == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "note 0 mail  [EMAIL] thanks alphaa"
    assert clean[30] == dict(rows())[30] and clean[900] is None and clean[901] == ""
    assert pii.sanitise(docs).columns == docs.columns


def test_counts_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    docs = documents(rows())
    before = sorted((r.doc_id or -1, str(r.terms)) for r in pii.find_spans(docs).collect())
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted((r.doc_id or -1, str(r.terms)) for r in pii.find_spans(docs).collect()) == before


def test_copies_are_no_evidence(spark, documents):
    docs = documents([(i, "one rareword joe@corp.com here") for i in range(5)] + [(9, "other")])
    assert all(r.terms == [] for r in pii.find_spans(docs).collect())


def test_one_context_is_evidence_too(spark, documents):
    plain = [(i, f"plain text note number {i}") for i in range(2000)]
    docs = documents(plain + [(5000, "plain note glimbrook sue@corp.com text")])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[5000] == "plain note [TERM] [EMAIL] text"


def test_terms_far_from_the_entity(spark, documents):
    far = "filler words stand here one after another until the end of it "
    plain = [(i, f"{far}plain text note number {i}") for i in range(2000)]
    docs = documents(plain + [(5000, f"glimbrook sue@corp.com {far}glimbrook, {far}(Quandrel)"), (5001, "glimbrook alone")])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[5000] == f"[TERM] [EMAIL] {far}[TERM], {far}([TERM])"
    assert clean[5001] == "glimbrook alone"


def brute_terms(rows, generalise=0.8, remove=0.95, support=2, reveal=0.5):
    """(doc_id, text) -> for each row its term spans with their actions, counted plainly."""
    texts = [t or "" for _, t in rows]
    spans = [brute(t) for t in texts]
    words = [{pii.term_of(x) for x in t.split()} - {""} for t in texts]
    outside = []
    for t, s in zip(texts, spans, strict=True):
        free = [m for m in re.finditer(r"\S+", t) if not any(a < m.end() and m.start() < b for _, a, b in s)]
        outside.append([(pii.term_of(m.group()), m) for m in free if pii.term_of(m.group())])
    entities = [dict() for _ in rows]
    for own, t, s in zip(entities, texts, spans, strict=True):
        for e, near in pii.mentions_of(t, s):
            own[e] = min(near, own.get(e, near))
    n, beside, alone = len(rows), [dict() for _ in rows], {}
    stronger = lambda d, k, v: d.__setitem__(k, max(v, d.get(k, v)))
    for e in {e for own in entities for e in own}:
        of_e = [i for i in range(n) if e in entities[i]]
        for term in {x for i in of_e for x, _ in outside[i]}:
            both = [i for i in of_e if term in {x for x, _ in outside[i]}]
            df_term, contexts = sum(term in w for w in words), len({entities[i][e] for i in both})
            given = (contexts + support * len(of_e) / n) / (contexts * df_term / len(both) + support)
            ratio = math.log2(n * given / len(of_e)) / max(math.log2(n / len(of_e)), 1e-9)
            if ratio >= generalise:
                action = "remove" if ratio >= remove else "generalise"
                for i in both:
                    stronger(beside[i], term, action)
                if given >= reveal and df_term > len(both):
                    stronger(alone, term, action)
    out = []
    for own, terms in zip(outside, beside, strict=True):
        action = {x: max(a for a in (terms.get(x, ""), alone.get(x, "")) if a) for x, _ in own if x in terms or x in alone}
        marks = [(m.start() + len(m.group()) - len(m.group().lstrip(pii._PUNCT)), m.end() - len(m.group()) + len(m.group().rstrip(pii._PUNCT)), action[x]) for x, m in own if x in action]
        out.append(sorted(marks))
    return out


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_thresholds_equal_plain_counting(spark, documents, monkeypatch, bound):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
    rng = random.Random(4)
    names = [f"{chr(97 + i)}name" for i in range(12)]
    rows = []
    for i in range(500):
        who = rng.randrange(12)
        text = " ".join(rng.choice(("plain", "text", "words", "note", "mail")) for _ in range(8))
        if i % 3 == 0:
            text += f" {names[who]} {rng.choice(('', '(' + names[who] + '), ', 'beside '))}{'user' + str(who)}@corp.com"
        if i % 7 == 0:
            text += " " + names[rng.randrange(12)]
        rows.append((None if i % 50 == 0 else i, text))
    rows += rows[9:12] + [(600, None), (601, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.row_key, tuple((s.start, s.end, s.action) for s in r.terms)) for r in pii.find_spans(documents(rows).repartition(3)).collect())
    want = sorted(((i if i is not None else -1, tuple(marks)) for (i, _), marks in zip(rows, brute_terms(rows), strict=True)), key=repr)
    assert sorted(((i, m) for i, _, m in got), key=repr) == want
    assert sum(map(len, (m for _, m in want))) > 50


def test_a_term_that_reveals_goes_everywhere(spark, documents):
    docs = documents([*rows(), (950, "we met Zorblax yesterday"), (None, "zorblax")])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect() if r.doc_id != 902}
    assert clean[950] == "we met [TERM] yesterday" and clean[None] in ("[TERM]", "lost [EMAIL] here")
    assert clean[0].startswith("note 0 mail [TERM] [EMAIL]") and clean[30] == dict(rows())[30]


def test_text_column_by_any_case(spark):
    docs = spark.createDataFrame([(1, "write a@b.co", "x")], "DOC_ID long, TEXT string, Base string")
    assert [tuple(r) for r in pii.sanitise(docs).collect()] == [(1, "write [EMAIL]", "x")]


def test_empty_table(spark, documents):
    empty = documents([(1, "x")]).limit(0)
    assert pii.digest(pii.find_spans(empty)).count() == 0 and pii.sanitise(empty).count() == 0


def test_query(spark, sf_dir):
    from paperloom.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op5_pii(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import bpe, token_counts
from paperloom.llm.vocab import Memo, ranks_of, read_file, splitter, unlike_letters

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CONTENT = read_file(PATH)
RANKS = ranks_of(CONTENT)
CODEC = bpe.Encoder(CONTENT)
SPLIT = splitter(public_tokenizers.PATTERN, unlike_letters())
TIKTOKEN = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TRICKY = ["", None, "a", "  two  spaces \n\n tail  ", "Ünïcödé çñß 中文 🙂🙃", "x" * 3000, " " * 500, "don't I'll <|endoftext|> 12345678", "a b " * 5000, "\U00033344대 \ua7ce1", "x\U000323b0y"]


def test_hash_is_minimal_and_perfect():
    found = [CODEC.hash.find(k) for k in RANKS]
    assert sorted(found) == list(range(len(RANKS)))
    assert CODEC.hash.find(b"surely no entry of it") == -1
    assert all(CODEC.id_at[i] == RANKS[k] for i, k in zip(found, RANKS, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pieces_equal_tiktoken(text):
    ids = [i for part in SPLIT(text) for p in part for i in CODEC.encode_piece(p)]
    assert ids == TIKTOKEN.encode_ordinary(text)


def test_documents_round_trip(spark, documents):
    docs = documents([(i, t, "s", 5) for i, t in enumerate(TRICKY)], ", IDs int")
    out = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(TRICKY)
    for row in out:
        text = TRICKY[row.doc_id] or ""
        assert row.ids == TIKTOKEN.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_digests(spark, sf_dir):
    from paperloom.llm import queries

    got = {r.doc_id: r for r in queries.op9_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = TIKTOKEN.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_lazy_split_equals_whole(monkeypatch):
    monkeypatch.setattr("paperloom.llm.vocab.LAZY_CHARS", 10)
    monkeypatch.setattr("paperloom.llm.vocab.LAZY_PIECES", 3)
    text = "one two  three\n four five"
    assert [p for part in SPLIT(text) for p in part] == __import__("regex").findall(public_tokenizers.PATTERN, text)


def test_memo_stays_bounded():
    memo = Memo(len, most=10 * (Memo.ENTRY + 3), longest=5)
    for i in range(1000):
        assert memo[f"k{i % 37}"] == len(f"k{i % 37}")
    assert memo["longer than that"] == 16
    assert len(memo) <= 11 and len(memo.old) <= 11


def brute_count(data, scores):
    best = [(0, 0)] + [None] * len(data)
    for i in range(1, len(data) + 1):
        options = [(best[j][0] + scores[data[j:i]], best[j][1] - 1) for j in range(i) if data[j:i] in scores]
        best[i] = max(options)
    return -best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), max_size=12))
def test_trie_counts_equal_plain_dynamic_programming(words):
    scores = token_counts.unigram_scores(RANKS)
    for limit in (8, 10_000):  # a trie that starts anew all the time gives the same counts
        trie = token_counts.TrieCounter(scores, limit)
        for w in words:
            assert trie.count(w.encode()) == brute_count(w.encode(), scores)


def test_trie_shares_prefixes():
    trie = token_counts.TrieCounter({b"a": -1, b"b": -1, b"ab": -1}, 100)
    assert [trie.count(x) for x in (b"ab", b"aba", b"abab", b"ab")] == [1, 2, 2, 1]
    assert len(trie.score) == 5  # root and one node for each of a, ab, aba, abab


def test_token_counts(spark, documents):
    docs = documents([(i, t, "s", 5) for i, t in enumerate(TRICKY)] + [(0, "", "s", 5), (None, "a b", "s", 5)], ", N_Tokens int")
    scores = token_counts.unigram_scores(RANKS)
    got = token_counts.count_tokens(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(TRICKY) + 2
    for r in got:
        text = "a b" if r.doc_id is None else TRICKY[r.doc_id] or ""
        pieces = [p for part in SPLIT(text) for p in part]
        assert r.n_pretokens == len(pieces)
        if len(text) < 2000:
            assert r.n_tokens == sum(brute_count(p.encode(), scores) for p in pieces)
    assert token_counts.count_tokens(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_token_counts_query(spark, sf_dir):
    from paperloom.llm import queries

    scores, known = token_counts.unigram_scores(RANKS), {}

    def count(piece):
        if piece not in known:
            known[piece] = brute_count(piece.encode(), scores)
        return known[piece]

    got = sorted(tuple(r) for r in queries.op1_token_counts(spark, sf_dir).collect())
    texts = [(r.doc_id, [p for part in SPLIT(r.text or "") for p in part]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got == sorted((i, len(pieces), sum(map(count, pieces))) for i, pieces in texts)


@pytest.mark.parametrize("text", TRICKY)
def test_whole_texts(text):
    ids = [i for part in SPLIT(text or "") for p in part for i in CODEC.encode_piece(p)]
    assert ids == TIKTOKEN.encode_ordinary(text or "")

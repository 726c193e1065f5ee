import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import hmm, langid


def toy(states=3, symbols=7, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def plain(model, text):
    """Forward and backward without scaling; log likelihood and expected counts."""
    n, k = len(text), len(model.start)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    alpha[0] = model.start * model.emit[text[0]]
    for t in range(1, n):
        alpha[t] = alpha[t - 1] @ model.move * model.emit[text[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (model.emit[text[t + 1]] * beta[t + 1])
    p = alpha[-1].sum()
    move = sum(alpha[t][:, None] * model.move * (model.emit[text[t + 1]] * beta[t + 1])[None, :] for t in range(n - 1)) / p
    emit = np.zeros_like(model.emit)
    for t in range(n):
        emit[text[t]] += alpha[t] * beta[t] / p
    return math.log(p), alpha[0] * beta[0] / p, move + np.zeros((k, k)), emit


@pytest.mark.parametrize("segment", [4, 1024])
def test_messages_equal_the_plain_recursion(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "CHUNK", 30)
    rng, model = np.random.default_rng(1), toy()
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 4, 5, 8, 13, 12, 3, 40, 2, 16)]
    symbols, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    want = [plain(model, t) for t in texts]
    assert np.allclose(hmm.log_likelihoods(model, symbols, lengths), [w[0] for w in want], rtol=1e-12)
    counts = hmm.no_counts(3, 7)
    hmm.expected(model, symbols, lengths, counts)
    assert math.isclose(counts.log, sum(w[0] for w in want), rel_tol=1e-12)
    assert np.allclose(counts.start, sum(w[1] for w in want))
    assert np.allclose(counts.move, sum(w[2] for w in want))
    assert np.allclose(counts.emit, sum(w[3] for w in want))


def test_training_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    truth = toy(seed=5)
    texts, lengths = [], rng.integers(1, 60, 200)
    for n in lengths:
        s = rng.choice(3, p=truth.start)
        for _ in range(n):
            texts.append(rng.choice(7, p=truth.emit[:, s]))
            s = rng.choice(3, p=truth.move[s])
    symbols, unigram = np.array(texts, np.int32), np.full(7, 1 / 7)
    logs = []
    for rounds in range(6):
        model = hmm.first_model(symbols, lengths, unigram, 3, rounds)
        logs.append(hmm.log_likelihoods(model, symbols, lengths).sum())
    assert all(b > a - 0.5 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0]


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("head_words", [hmm.HEAD_WORDS, 60])
def test_scores_of_documents(spark, small, head_words):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    got = hmm.score(docs, langid.held_out(F.col("doc_id"), 5, 1), head_words=head_words).collect()
    assert len(got) == len(texts)
    for r in got:
        own = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_symbols_cover_all_words(spark, monkeypatch):
    """Frequent words, whatever their length, are symbols; shapes hold the rest, with half a count for each and for unknown ones."""
    long_ = "y" * 5000
    texts = [f"aa bb cc {long_}", f"aa bb xx {long_} zz", f"aa qq {long_}", "bb rr ss"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(hmm, "HEAD_LEAST", 9)
    head = hmm.head_of(hmm.word_counts(docs), 4)
    assert len(head.words) == 4 and {b"", b"aa", b"bb"} < set(head.words) and max(map(len, head.words)) == hmm.KEY_BYTES + 1
    assert head.counts.sum() + head.class_tokens.sum() == head.total == 57 and head.class_words.sum() == head.distinct - 4
    weight = np.concatenate([head.counts + 0.5, head.class_tokens + 0.5 * (head.class_words + 1)])
    assert np.allclose(head.unigram(), weight / (head.total + 0.5 * (head.distinct + hmm.CLASSES)))


def test_scores_equal_a_plain_forward_pass(spark, small, monkeypatch):
    """Of the trained model, over each whole text: words by symbol, rare and unknown ones by shape and share."""
    models = []
    plain_round = hmm.whole_round
    monkeypatch.setattr(hmm, "whole_round", lambda *a: models.append(plain_round(*a)) or models[-1])
    heads = []
    plain_head = hmm.head_of
    monkeypatch.setattr(hmm, "head_of", lambda *a: heads.append(plain_head(*a)) or heads[-1])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.score for r in hmm.score(docs, langid.held_out(F.col("doc_id"), 5, 1), head_words=300).collect()}
    again = {r.doc_id: r.score for r in hmm.score(docs, langid.held_out(F.col("doc_id"), 5, 1), head_words=300).collect()}
    assert got == again
    model, head = models[len(hmm.ROUNDS) - 1], heads[0]
    assert len(models) == 2 * len(hmm.ROUNDS) and np.allclose(model.emit.sum(axis=0), 1)
    texts = {r.doc_id: hmm.tokens(r.text) for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if not held(i) for w in t)
    index = head.index()
    for i, words_ in sorted(texts.items())[:60]:
        now, log = model.start, 0.0
        for w in words_:
            if w in index:
                emit = model.emit[index[w]]
            else:
                c = hmm.shape(w)
                emit = model.emit[len(index) + c] * (counts[w] + 0.5) / (head.class_tokens[c] + 0.5 * (head.class_words[c] + 1))
            now = now * emit
            log += math.log10(now.sum())
            now = now / now.sum() @ model.move
        assert math.isclose(got[i], log, rel_tol=1e-9)


def test_odd_rows(spark):
    long_ = "wort " * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long_), (5, "Ein Wort ein wort"), (5, "Ein Wort ein wort"), (None, "wort neu"), (7, "wort ein haus"), (10, "ein")]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id long, text string, score double, row int")
    got = hmm.score(docs, langid.held_out(F.col("doc_id"), 5, 1)).collect()
    assert len(got) == 9 and all(r.score < 0 and r.base_score < 0 and math.isfinite(r.score) for r in got)
    assert {r.doc_id: r.n_tokens for r in got} == {1: 1, 2: 1, 3: 1, 4: 50_001, 5: 5, None: 3, 7: 4, 10: 2}
    assert hmm.score(docs.where("false"), langid.held_out(F.col("doc_id"), 5, 1)).count() == 0
    none = hmm.score(docs, F.lit(True)).collect()
    assert all(r.score == r.base_score and r.n_known == r.train_tokens == 0 for r in none)


def test_encoded_rows_are_handed_on_by_their_tokens(monkeypatch):
    """Before, all rows of a batch were held until the last one was encoded, however long their texts."""
    monkeypatch.setattr(hmm, "CHUNK", 10)
    texts = ["a b a", None, "a q q", "b " * 30, "a", ""]
    batch = pa.record_batch([pa.array(range(6)), pa.array(range(10, 16)), pa.array([False] * 6), pa.array(texts)], names=["row", "doc_id", "held_out", "text"])
    out = list(hmm.encoded_batches(iter([batch, batch.slice(0, 0)]), hmm.Symbols([b"", b"a", b"b"])))
    assert [b.num_rows for b in out] == [4, 2] and [r for b in out for r in b.column("row").to_pylist()] == list(range(6))
    got = [np.frombuffer(x.as_buffer(), np.int32).tolist() for b in out for x in b.column("symbols")]
    rare = 3 + hmm.shape(b"q")
    assert got == [[1, 2, 1, 0], [0], [1, rare, rare, 0], [2] * 30 + [0], [1, 0], [0]]
    assert [x for b in out for x in b.column("tail").to_pylist()] == [[], [], [b"q"], [], [], []]
    assert [x for b in out for x in b.column("times").to_pylist()] == [[], [], [2], [], [], []]

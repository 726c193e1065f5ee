import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuscle.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.98 * len(unseen)


def test_held_out_labels_are_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id"), 4, 2), "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(spoiled).collect())) == sorted(map(tuple, langid.identify(docs).collect()))


def test_odd_rows(spark):
    rows = [(k, "the cat and the dog of the house" if k % 2 else "der hund und die katze der stadt", "en" if k % 2 else "de") for k in range(100)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !!", "de"), (203, "the of " * 100_000, None), (None, "und die der katze", "de"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, lang string, held_out int, score double")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == 105 and langid.identify(docs).count() == 106
    assert [got[k].lang_pred for k in (200, 201, 202, 203, None, 5, 6)] == ["und", "und", "und", "en", "de", "en", "de"]
    assert got[200].score == got[202].score == 0.0
    assert langid.identify(docs.where("false")).count() == 0
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 103


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Abc d", None, "", "ÄÖ x9y", "z" * 300]
    codes, starts = langid.folded(texts)
    many = list(langid.grams(codes))
    for k, t in enumerate(texts):
        alone = list(langid.grams(langid.folded([t])[0]))
        for a, b in zip(alone, many, strict=True):
            assert np.array_equal(a, b[starts[k] : starts[k + 1]])


def test_the_leader_keeps_useless_weights_at_zero():
    rng = np.random.default_rng(3)
    rows = [(np.array([k % 2, 10 + rng.integers(100), langid.BUCKETS]), np.array([1.0, 0.01, 1.0]), k % 2) for k in range(400)]
    w, _ = langid.follow_the_leader(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and (w[10:110] == 0).mean() > 0.5 and not w[200:].any()


def plain_features(text):
    """Buckets of all 1- to 3-grams that end at a character, blanks before the first; and the number of characters."""
    own = [" ", *(c if c.isalpha() else " " for c in (text or "").lower()), " ", " "]
    buckets = []
    for n in (1, 2, 3):
        for k in range(len(own)):
            h = 0
            for m in range(n):
                h = (h + (ord(own[k - m]) if k >= m else 32) + m + 1) * 0x9E3779B1 % (1 << 32)
                h ^= h >> 15
            buckets.append(h * 0x85EBCA6B % (1 << 32) >> 32 - langid.BITS)
    return buckets, len(own)


def plain_leader(rows, classes, alpha=0.3, beta=1.0, l1=0.02, l2=0.01, epochs=3):
    z, n, held = {}, {}, {}

    def weight(key):
        value = z.get(key, 0.0)
        if abs(value) <= l1:
            return 0.0
        return -(value - math.copysign(l1, value)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for index, value, label in rows:
            w = {(i, c): weight((i, c)) for i in index for c in range(classes)}
            logits = [sum(v * w[i, c] for i, v in zip(index, value, strict=True)) for c in range(classes)]
            total = sum(math.exp(x) for x in logits)
            for i, v in zip(index, value, strict=True):
                for c in range(classes):
                    g = v * (math.exp(logits[c]) / total - (c == label))
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, c]
                    n[i, c] = old + g * g
    for key in z:
        held[key] = weight(key)
    return held


def test_features_weights_and_scores_equal_plain_ones(spark):
    texts = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("Das Haus, 12 Äpfel!", "de"), ("a house", "en"), ("le chat", "fr"), ("x", "fr")] * 3
    texts = [(t + f" {'ab'[k % 2]}{'xyz'[k % 3]}", lang) for k, (t, lang) in enumerate(texts)]
    rows, grams = [], []
    for text, lang in texts:
        index, share = langid.counted(text)
        buckets, n = plain_features(text)
        assert dict(zip(index.tolist(), (share * n).round().astype(int).tolist(), strict=True)) == Counter(buckets)
        rows.append((index, share * langid.SCALE, ["de", "en", "fr"].index(lang)))
        grams.append((buckets, n))
    w, bias = langid.follow_the_leader([(np.append(i, langid.BUCKETS), np.append(v, 1.0), k) for i, v, k in rows], 3)
    plain = plain_leader([([*i.tolist(), langid.BUCKETS], [*v.tolist(), 1.0], k) for i, v, k in rows], 3)
    for (bucket, c), value in plain.items():
        assert math.isclose((bias if bucket == langid.BUCKETS else w[bucket])[c], value, rel_tol=1e-9, abs_tol=1e-12)
    model = langid.Model(["de", "en", "fr"], (w * langid.SCALE).astype(np.float32), bias, 1.7)
    names, scores = model.scores([t for t, _ in texts])
    for (buckets, n), name, score in zip(grams, names, scores, strict=True):
        logits = [(sum(langid.SCALE * plain.get((b, c), 0.0) for b in buckets) / n + plain[langid.BUCKETS, c]) / 1.7 for c in range(3)]
        p = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
        assert name == model.langs[p.index(max(p))] and math.isclose(score, max(p), rel_tol=1e-5)


def test_one_hot_id_does_not_fill_the_sample(spark, monkeypatch):
    """A repeated id and a text that most rows have: the sample stays small and has every language."""
    seen = []
    plain = langid.follow_the_leader
    monkeypatch.setattr(langid, "follow_the_leader", lambda rows, *a, **k: seen.append(len(rows)) or plain(rows, *a, **k))
    rows = [(1, "the same text for all of us", "en")] * 3000 + [(None, f"der hund nummer {k} und die katze", "de") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, sample_rows=50).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 3000, "de": 3000} and seen[0] <= 100


def test_accepted_without_labels_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None), (3, "12", None), (3, "éa", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in langid.accepted(docs).collect()) == ["abc", "éa"]
    assert langid.accepted(docs.where("false")).count() == 0
    some = spark.createDataFrame([(k, "the cat and dog" if k % 2 else "der hund und katze", "en" if k % 2 else "de", 1) for k in range(60)], "doc_id long, text string, lang string, score int")
    assert {r.doc_id % 2 for r in langid.accepted(some, langs=["en"]).collect()} == {1}

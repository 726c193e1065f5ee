import os
import random
import re

import numpy as np
import pytest

from corpuscle.llm import packing, simhash


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}


def kept_by_brute_force(texts, similar=0.8):
    """The smallest id of each component of all pairs of similar documents."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[:k]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if both >= similar * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def test_stages(spark, tmp_path):
    """Each stage against brute force on its own input, at sf0.01."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "pack":
            assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "language_id":
            assert set(ids) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            first = {}
            for i, t in before.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", t)
                first[key] = min(first.get(key, (-len(t), i)), (-len(t), i))
            assert sorted(ids) == sorted(i for _, i in first.values())
        elif name == "near_dedup":
            assert set(ids) == kept_by_brute_force(before) and len(ids) == len(set(ids)) < len(before)
        elif name == "mix":
            assert len(ids) > len(set(ids)) and max(ids.count(i) for i in set(ids)) == 2
    rows = docs.collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in before.items()}
    stream = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").select("doc_id").collect()]
    assert sum(r.size for r in rows) == sum(words[i] for i in stream)
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert all(sum(r.size for r in b) <= 2048 and len({r.doc_id for r in b}) == len(b) for b in bins.values())
    assert sum(r.size for r in rows) / (2048 * len(bins)) > 0.5


def test_near_copies_on_odd_rows(spark):
    base = " ".join(f"word{k * 7919 % 1009}" for k in range(300))
    near = base.replace("word7 ", "other ")
    far = " ".join(w if k % 5 else "new" for k, w in enumerate(base.split()))
    rows = [(5, base), (2, near), (9, near.upper()), (3, far), (None, base + " tail"), (7, None), (8, ""), (10, "a b"), (11, "A b"), (12, "a c"), (13, "x " * 50_000), (13, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, keep string")
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["10", "12", "13", "13", "2", "3", "7"]
    assert simhash.without_near_copies(docs.where("false")).count() == 0


def edited(words, case, new):
    n = len(words)
    return {
        "appended": words + new(n * 22 // 100), "truncated": words[: n * 82 // 100],
        "block": words[: n // 2] + new(n * 8 // 100) + words[n // 2 + n * 8 // 100 :],
    }[case]


def test_near_copies_with_block_edits(spark):
    """Text appended, cut off or replaced as a block, all at a similarity of 0.8 or more: every copy goes."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for case in ("appended", "truncated", "block"):
        for _ in range(100):
            words = new(rng.randrange(150, 400))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited(words, case, new)))]
    sets = [shingle_set(t) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    assert left == set(range(0, len(rows), 2))


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Fingerprints of four bits or fewer apart lead to a comparison without any common band, and a comparison decides."""
    monkeypatch.setattr(simhash, "band_keys", lambda own: np.frombuffer(os.urandom(8 * simhash.BANDS), np.int64))
    rng = random.Random(11)
    rows, far = [], 0
    while len(rows) < 60:
        words = [f"w{rng.randrange(5000)}" for _ in range(900)]
        other = words[:450] + ["other"] + words[451:]
        apart = (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(other))).bit_count()
        if 0 < apart <= simhash.MOST:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    for lead in ("x", "y"):  # one shingle that is repeated makes the fingerprint, the sets are dissimilar
        rows.append((1000 + far, " ".join(["same"] * 4000 + [f"{lead}{k}" for k in range(300)])))
        far += 1
    prints = [simhash.fingerprint(t) for _, t in rows[-2:]]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.MOST
    left = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {*range(0, 60, 2), 1000, 1001}


def test_near_copies_inside_template_families(spark):
    """Families of one set of long words, and of a common half: near copies meet though the others are dissimilar."""
    rng = random.Random(6)
    rows = []

    def add(words, at):
        changed = list(words)
        changed[at] = str(rng.randrange(1000, 2000))[1:]
        rows.extend((len(rows) + k, " ".join(w)) for k, w in enumerate((words, changed)))

    for _ in range(30):
        add([w for k in range(60) for w in (f"field{k}", str(rng.randrange(100, 1000)))], 61)
    common = [f"line{rng.randrange(900)}" for _ in range(120)]
    for _ in range(60):
        add(common + [str(rng.randrange(100, 1000)) for _ in range(40)], 140)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    assert left == kept_by_brute_force(dict(rows)) == set(range(0, len(rows), 2))


def test_pack_is_the_last_stage():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]
    assert packing.SHARD_ROWS > 0 and corpus_pipeline.ORACLE_SQL is None


CLASHING = "row string, place int, h long, hit boolean, part int, `order` double, pass int, c0 string, __at int, lang_pred string, score double, keep string, `a.b` int"


def odd_documents(spark, metadata):
    rng = random.Random(9)
    words = lambda n: " ".join(f"the{rng.randrange(500)} and of cat" if rng.random() < 0.5 else f"house{rng.randrange(900)}" for _ in range(n))
    german = lambda n: " ".join(f"der{rng.randrange(500)} und die" for _ in range(n))
    base = words(120)
    texts = [(k, words(40) if k % 2 else german(40), "en" if k % 2 else "de", "ab"[k % 3 > 0]) for k in range(60)]
    texts += [(100, None, "en", "a"), (101, "", "en", None), (102, " \n\t", None, "a"), (103, "12 34 !!", "en", "a")]  # without a letter
    texts += [(110, base, "en", "a"), (111, base + " \n", "en", "a"), (111, base + " \n", "en", "a"), (None, base, None, None), (112, base.replace(" ", "  "), "en", "b")]
    texts += [(120, base + " one two three", "en", "a"), (121, base.upper(), "en", "a"), (None, "short text", None, None), (None, "short text", None, None)]
    texts += [(130, "wort " * 30_000, "de", None), (131, words(3000), "en", "hot"), (7, words(30), "en", "hot"), (7, words(30), None, "hot")]
    extra = (None, 1, 2, True, 3, 0.5, 4, "c", 5, "x", 0.1, "k", 6)
    schema = "doc_id long, text string, lang string, source string, " + CLASHING + (", _metadata string" if metadata else "")
    return spark.createDataFrame([(*t, *extra, *(["m"] if metadata else [])) for t in texts], schema)


@pytest.mark.parametrize("metadata", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, metadata):
    """Null, empty, long, tied and repeated rows and columns of clashing names go through all stages."""
    import corpus_pipeline

    docs = odd_documents(spark, metadata)
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text", "source").collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "pack":
            break
        assert docs.columns == columns and {r["a.b"] for r in docs.select("`a.b`").collect()} == {6}
        after = docs.select("doc_id", "text", "source").collect()
        if name == "language_id":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if any(c.isalpha() for c in r.text or ""))
        elif name == "exact_dedup":
            key = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text)
            assert len(after) == len({key(r) for r in before}) == len({key(r) for r in after})
            hot = next(key(r) for r in before if r.doc_id == 112)
            assert [r.doc_id for r in after if key(r) == hot] == [112]
        elif name == "near_dedup":
            left = {r.text for r in after}
            assert not any(t.isupper() and t.lower() in left for t in left) and sum("house" in t and len(t) > 600 and len(t) < 20_000 for t in left) >= 1
            assert sum(r.doc_id in (112, 120, 121) for r in after) == 1
        else:
            assert max(after.count(r) for r in after) == 2 and {r.doc_id for r in after} <= {r.doc_id for r in before}
    rows = docs.collect()
    assert sum(r.size for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after)
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert all(sum(r.size for r in b) <= 2048 and len({r.source for r in b if r.source}) == sum(bool(r.source) for r in b) for b in bins.values())


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark, False).where("false")
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert after.count() == 0
        docs = after if after.columns == docs.columns else docs

import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscle.llm import exact, simhash
from corpuscle.llm.components import components

SCHEMA = "doc_id long, text string, source string, h string, row string"


def odd_rows(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "a b c", "x", "1", "r"), (2, "ab c", "x", None, "r"), (2, "ab c", "x", None, "r"), (3, None, None, "1", None),
        (4, "", "y", "1", "r"), (5, " \t\n\x0b\x0c\r", "y", "1", "r"), (6, long_, "y", "1", "r"), (7, long_ + " ", "y", "1", "r"),
        (None, "a b c", "x", "1", "r"), (None, "solo", "x", "1", "r"), (8, "a b c", "x", "1", "r"), (9, "A b c", "x", "1", "r"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_groups_on_odd_rows(spark):
    got = exact.exact_groups(odd_rows(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(got) == 12
    assert all(sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)} for rows in by.values())
    keep = {r.doc_id: r.keep_id for r in got if r.doc_id}
    assert keep == {1: 1, 2: 1, 3: 5, 4: 5, 5: 5, 6: 7, 7: 7, 8: 8, 9: 9}
    assert exact.exact_groups(odd_rows(spark).where("false")).count() == 0


def test_exact_groups_survive_hash_collisions(spark):
    """With a digest of one bit nearly all rows collide; the bytes keep unequal texts apart."""
    weak = lambda text: F.unhex(F.when(F.md5(text) < "8", "00").otherwise("01"))
    plain = {tuple(r)[:4] for r in exact.exact_groups(odd_rows(spark)).collect() if r.doc_id != 2}
    assert {tuple(r)[:4] for r in exact.exact_groups(odd_rows(spark), digest=weak).collect() if r.doc_id != 2} == plain


def test_without_exact_copies_keeps_one_row_of_each_text(spark):
    docs = odd_rows(spark)
    left = exact.without_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == 6


def test_words_of_the_code_that_differ_in_two_bits_share_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 20_000, dtype=np.int32)
    a, b = rng.integers(0, 23, (2, len(x)))
    y = x ^ (1 << a).astype(np.int32) ^ np.where(a == b, 0, 1 << b).astype(np.int32)
    p, q = simhash.codeword_keys(x), simhash.codeword_keys(y)
    assert ((p[:, :, None] == q[:, None, :]) & (p >= 0)[:, :, None]).any(axis=(1, 2)).all()


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=4):
    import numpy as np

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= most):
            a, b = sorted((find(k), find(int(j))))
            root[b] = a
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_near_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("large", [simhash.LARGE, 40])
def test_links_of_dense_prints_equal_brute_force(spark, large):
    """Prints around a few centres: chains, large buckets and, with a small limit, crowded ones that are split."""
    rng = random.Random(5)
    prints = {0: 0}
    for c in range(3):
        centre = rng.getrandbits(64)
        for _ in range(200):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 7])):
                x ^= 1 << b
            prints[len(prints)] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = {v: k for k, v in reversed(prints.items())}
    df = spark.createDataFrame([(signed(v),) for v in distinct], "print long")
    links = simhash.near_links(df, 4, large)
    for a, b in links.collect():
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute_components({k: v for v, k in distinct.items()})
    groups = lambda f: {frozenset(v for v in distinct if f(v) == r) for r in {f(v) for v in distinct}}
    assert groups(lambda v: roots.get(signed(v), signed(v))) == groups(lambda v: want[distinct[v]])


def test_near_groups_on_odd_rows(spark):
    got = simhash.near_groups(odd_rows(spark)).collect()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(got) == 12 and {(r.doc_id, r.component_id) for r in zero} == {(3, 3), (4, 3), (5, 3)}
    assert simhash.near_groups(odd_rows(spark).where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(5, 40), 5), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup_agrees_with_sql(spark, small):
    from corpuscle.llm import entries

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{small}/documents.parquet'")
    want = sorted(duckdb.sql(entries.OP6_SQL).fetchall())
    df = entries.op6_exact_dedup(spark, small)
    assert sorted(map(tuple, df.collect())) == want


def test_fingerprints_that_differ_in_four_bits_share_a_key():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(3000):
        for b in rng.choice(64, k % 5, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    p, q = ({(int(a), int(b)) for a, b in zip(*simhash.fuzzy_keys(v)[::-1], strict=True)} for v in (x, y))
    assert {r for r, _ in p & q} == set(range(3000))


def test_names_of_texts_survive_hash_collisions(spark):
    from corpuscle.llm.common import named

    docs = spark.createDataFrame([(k, t, 1, True) for k, t in enumerate(["a", "b", "a", None, "", "c"])], "doc_id long, text string, h int, hit boolean")
    for first in (F.xxhash64, lambda c: F.length(c).cast("long")):
        got = {r.doc_id: r.row for r in named(docs, "text", "row", first).collect()}
        assert got[0] == got[2] and got[3] == got[4] and len(set(got.values())) == 4
    assert named(docs, "text", "row").columns == [*docs.columns, "row"]

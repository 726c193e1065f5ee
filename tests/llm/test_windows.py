import os
import random

import numpy as np
import pytest

from corpuscle.llm import windows


def plain_windows(values, least):
    """By definition: for each position that is the first minimum of some text range, its widest range."""
    out = set()
    for c, v in enumerate(values):
        if v == 0:
            continue
        left, right = c, c
        while left > 0 and values[left - 1] > v:
            left -= 1
        while right + 1 < len(values) and values[right + 1] >= v:
            right += 1
        equal_before = left > 0 and values[left - 1] == v
        if right - left + 1 >= least and not equal_before:
            out.add((left, c, right))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_compact_windows_equal_their_definition(least):
    rng = np.random.default_rng(least)
    for high in (4, 50, 1 << 40):
        for _ in range(60):
            values = rng.integers(1, high, rng.integers(0, 40)).astype(np.uint64)
            values[rng.random(len(values)) < 0.05] = 0
            got = set(zip(*(x.tolist() for x in windows.compact_windows(values, least)), strict=True))
            want = plain_windows(values.tolist(), least)
            assert got <= {w for w in got if w[2] - w[0] + 1 >= least}
            if high > 1000:
                assert got == want
            for left, c, right in want:  # with equal values: the window is there, or the wider one of an equal value before it
                assert any(a <= left and b >= right and values[x] == values[c] for a, x, b in got)


def test_sliding_best():
    x = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    for width in range(1, 20):
        assert windows.sliding(x, width, np.minimum).tolist() == [min(x[k : k + width]) for k in range(50 - width + 1)]


def test_longest_stretch():
    rng = np.random.default_rng(1)
    for _ in range(200):
        match = rng.random(rng.integers(0, 25)) < 0.8
        i, j = windows.longest(match, 0.75)
        sizes = [b - a for a in range(len(match)) for b in range(a + 1, len(match) + 1) if match[a:b].sum() >= 0.75 * (b - a) - 1e-9]
        assert j - i == max(sizes, default=0)


def planted(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    common, pair, hot, loose = words(51), words(80), words(70), words(60)
    rows = {k: words(rng.randrange(60, 300)) for k in range(40)}
    rows[1][20:20] = common
    rows[2] = common + rows[2]
    rows[3] = rows[3] + [w.upper() for w in common]
    near = list(pair)
    near[40] = "changed"
    rows[4][10:10] = pair
    rows[5][50:50] = near
    for k in range(10, 30):
        rows[k][k:k] = hot
    rows[6] = rows[7][:40] + words(100)  # too short
    changed = [w if k % 4 else word() for k, w in enumerate(loose)]
    rows[8][0:0], rows[9][0:0] = loose, changed  # too different
    rows[31] = rows[31] + rows[31][-60:]  # repeats itself only
    rows[32] = [w for w in rows[33]]
    docs = [(k, " ".join(w)) for k, w in rows.items()]
    docs += [(100, None), (101, ""), (102, "a b"), (103, "ha " * 30_000), (104, docs[34][1]), (104, docs[34][1]), (None, docs[35][1])]
    return spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, start_word int, class_id string")


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    got = windows.passages(planted(spark)).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.class_size == sum(x.class_id == r.class_id for x in got) and r.similarity >= 0.8
    assert {frozenset(map(str, v)) for v in classes.values()} == {
        frozenset(x) for x in (["1", "2", "3"], ["4", "5"], [str(k) for k in range(10, 30)], ["32", "33"], ["104", "34"], ["None", "35"])
    }
    spans = {r.doc_id: (r.start_word, r.end_word) for r in got}
    assert spans[1] == (20, 71) and spans[2] == (0, 51) and spans[4] == (10, 90) and spans[5] == (50, 130)
    assert all(spans[k] == (k, k + 70) for k in range(10, 30))
    assert windows.passages(planted(spark).where("false")).count() == 0


def test_all_exact_repeats_of_a_table_are_found(spark):
    """Against all runs of 46 equal shingles by plain counting."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = windows.WordHashes()
    least = windows.LEAST_WORDS - windows.SHINGLE + 1
    where = {}
    for r in docs.collect():
        own = windows.shingles(r.text, seen)
        for k in range(len(own) - least + 1):
            where.setdefault(own[k : k + least].tobytes(), set()).add(r.doc_id)
    want = {d for ids in where.values() if len(ids) > 1 for d in ids}
    got = {r.doc_id for r in windows.passages(docs).collect()}
    assert want and want <= got


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_beside_boilerplate_that_hundreds_share(spark, seed):
    """160 documents have 40 words in common; 30 pairs have 15 more right after them, and 10 pairs all but one of 15."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    common, rows, want = words(40), [], set()
    for k in range(80):
        more = words(15)
        for side in (0, 1):
            tail = more if k < 30 else more[:7] + words(1) + more[8:] if k < 40 else words(15)
            rows.append((len(rows), " ".join(words(rng.randrange(50, 200)) + common + tail + words(rng.randrange(50, 200)))))
        if k < 40:
            want.add((2 * k, 2 * k + 1))
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    found = {tuple(sorted(v)) for v in classes.values()}
    assert {w for w in want if w[0] < 60} <= found and found <= want and len(found) >= 38


def test_a_passage_that_a_document_repeats_often_is_found_everywhere(spark):
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    passage = words(60)
    long_ = [w for _ in range(40) for w in [*words(300), *passage]]
    rows = [(1, " ".join(words(80) + passage + words(80))), (2, " ".join(long_))]
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(1, 80, 140)] + [(2, 300 + 360 * k, 360 + 360 * k) for k in range(40)]


def test_crowded_signatures_equal_brute_force():
    """Families of near copies, templates and common lines: what linked_windows joins is what all verified pairs join."""
    rng = random.Random(7)
    least = 46
    for _ in range(8):
        base, rows, centre, low, parts = [rng.randrange(1 << 30) for _ in range(91)], [], [], [], []
        for k in range(60):
            own = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                at = rng.choice([x for x in range(91) if x != 45])
                own[at] = rng.randrange(1 << 30)
            if k % 3 == 0:
                cut = rng.randrange(46)
                own[:cut] = [rng.randrange(1 << 30) for _ in range(cut)]
                own[cut + 47 :] = [rng.randrange(1 << 30) for _ in range(91 - cut - 47)]
            if k % 5 == 0:
                own = own[:45] + [base[45]] + own[46:]
            first = rng.choice([0, 0, 10, 40])
            last = rng.choice([91, 91, first + 50])
            if not first <= 45 < last:
                first, last = 0, 91
            rows.append(k // 2 if k % 7 == 0 else k)
            centre.append(1000 + k)
            low.append(1000 + k - 45 + first)
            parts.append(np.array(own[first:last], np.int32))
        order = sorted(range(60), key=lambda k: (rows[k], centre[k]))
        rows, centre, low, parts = ([x[k] for k in order] for x in (rows, centre, low, parts))
        got = windows.linked_windows(np.zeros(60, np.int64), np.array(rows), np.array(centre), np.array(low), parts, least, 0.8)
        root = {r: r for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for passage in got:
            a, b, s = passage[0], passage[5], passage[-1]
            assert s >= 0.8 and a != b
            root[find(a)] = find(b)
        for i in range(60):
            for j in range(i):
                if rows[i] != rows[j] and windows.verified(parts[i], parts[j], least, 0.8):
                    assert find(rows[i]) == find(rows[j])


def test_near_repeats_against_brute_force(spark):
    """Recall and precision beside signatures that hundreds share: 300 documents with one common line of 45 words, 120 pairs
    that go on with near repeats, and the documents of a table. Brute force verifies all pairs with enough in common."""
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    common, texts = words(45), []
    for k in range(150):
        passage = words(rng.randrange(60, 160))
        for side in (0, 1):
            own = list(passage) if k < 120 else words(80)
            for _ in range(rng.randrange(1, len(passage) // 50 + 1) if side else 0):
                own[rng.randrange(len(own))] = words(1)[0]
            texts.append(" ".join(words(rng.randrange(20, 120)) + common + own + words(rng.randrange(20, 120))))
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0")
    rows = [(10_000 + k, t) for k, t in enumerate(texts)] + [(r.doc_id, r.text) for r in table.collect()]
    seen, least = windows.WordHashes(), windows.LEAST_WORDS - windows.SHINGLE + 1
    held = {i: (windows.shingles(t, seen) >> np.uint64(32)).astype(np.uint32).view(np.int32) for i, t in rows}
    sets = {i: set(x.tolist()) for i, x in held.items()}
    where = {}
    for i, s in sets.items():
        for h in s:
            where.setdefault(h, []).append(i)
    shared = {}
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    want = {pair for pair, n in shared.items() if n >= 30 and windows.verified(held[pair[0]], held[pair[1]], least, 0.8)}
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.end_word - r.start_word >= windows.LEAST_WORDS
    together = {frozenset((a, b)) for c in classes.values() for a in c for b in c if a != b}
    found = sum(frozenset(pair) in together for pair in want)
    assert len(want) > 150 and found >= 0.99 * len(want)
    linked = {i for pair in want for i in pair}
    assert {r.doc_id for r in got} <= linked  # no document without a repeat
    for c in classes.values():  # and each is linked inside its class
        assert all(any(frozenset((a, b)) in {frozenset(p) for p in want} for b in c if b != a) for a in c)


def test_scratch_tables_go_once_they_are_used(spark):
    """Before, the windows' links and the slices of texts stayed on disk until the driver ended."""
    from corpuscle.llm.common import shared_dir

    passage = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, " ".join(f"a{k}x{i}" for i in range(60)) + " " + passage) for k in range(4)], "doc_id long, text string")
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = windows.passages(docs).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3] and {r.class_size for r in rows} == {4}
    left = {x.partition("-")[0] for x in set(os.listdir(folder)) - before}
    assert "names" in left and not left & {"window", "slices"}
    assert windows.passages(docs.where("false")).count() == 0

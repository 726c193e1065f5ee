import random
import re

from pyspark.sql import functions as F

from corpuscle.llm import packing


def plain_best_fit(sizes, masks, capacity):
    rooms, bits, out = [], [], []
    for size, own in zip(sizes, masks, strict=True):
        fit = [(room, k) for k, room in enumerate(rooms) if room >= size and room > 0 and not bits[k] & own]
        if fit:
            _, k = min(fit)
        else:
            k = len(rooms)
            rooms.append(capacity)
            bits.append(0)
        rooms[k] -= size
        bits[k] |= own
        out.append(k)
    return out


def test_best_fit_equals_a_plain_search():
    rng = random.Random(6)
    for _ in range(60):
        capacity, n = rng.choice([1, 7, 64, 100, 2048]), rng.randrange(300)
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        if rng.random() < 0.5:
            sizes.sort(reverse=True)
        few = rng.choice([1, 3, 40])
        masks = [(1 << rng.randrange(few) if rng.random() < 0.7 else 0) | (1 << 50 + rng.randrange(9) if rng.random() < 0.3 else 0) for _ in range(n)]
        assert packing.best_fit(sizes, masks, capacity) == plain_best_fit(sizes, masks, capacity)


def test_a_hot_source_does_not_slow_the_search(monkeypatch):
    """A third of all items can't share bins: their bins are passed over as whole ranges, so few nodes are visited."""
    visits = [0]
    plain = packing.Bins.leftmost

    def counted(self, node, bits):
        visits[0] += 1
        return plain(self, node, bits)

    monkeypatch.setattr(packing.Bins, "leftmost", counted)
    rng = random.Random(1)
    n = 10_000
    sizes = sorted((rng.randint(1, 500) for _ in range(n)), reverse=True)
    masks = [1 if k % 3 == 0 else 1 << (1 + rng.randrange(19)) for k in range(n)]
    packing.best_fit(sizes, masks, 2048)
    assert visits[0] < 100 * n


def whole(rows, capacity):
    """Every word of every document is in exactly one piece; no bin is over its capacity or in conflict."""
    bins, spans = {}, {}
    for r in rows:
        if r.bin is not None:
            bins.setdefault((r.shard, r.bin), []).append(r)
        spans.setdefault(r.doc_id, []).append((r.first_word, r.size))
    for items in bins.values():
        assert sum(r.size for r in items) == items[0].bin_used <= capacity
        placed = sorted(items, key=lambda r: r.place)
        assert [r.place for r in placed] == [sum(x.size for x in placed[:k]) for k in range(len(placed))]
        sources = [r.source for r in items if r.source is not None]
        assert len(sources) == len(set(sources))
    return bins, spans


def test_packing_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    for shard_rows in (packing.SHARD_ROWS, 30):
        rows = packing.pack(docs, capacity=300, shard_rows=shard_rows).collect()
        bins, spans = whole(rows, 300)
        for i, n in sizes.items():
            at = 0
            for first, size in sorted(spans[i]):
                assert first == at
                at += size
            assert at == n


def test_copies_and_odd_rows(spark):
    rows = [(k, "same text here", f"s{k}", "1") for k in range(6)] + [(10, None, None, "1"), (11, "", "s1", "1"), (12, "a " * 5000, None, "1"), (12, "a " * 5000, None, "1")]
    rows += [(None, "b c", None, None), (20, "d e", None, "1"), (21, "f", "hot", "1"), (22, "g", "hot", "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string")
    got = packing.pack(docs, capacity=100).collect()
    bins, _ = whole(got, 100)
    same = [(r.shard, r.bin) for r in got if r.doc_id is not None and r.doc_id < 6]
    assert len(set(same)) == 6  # copies never meet
    assert [r.bin for r in got if r.doc_id in (10, 11)] == [None, None]
    assert len([r for r in got if r.doc_id == 12]) == 100 and len({(r.shard, r.bin) for r in got if r.doc_id == 12}) == 100
    assert len({(r.shard, r.bin) for r in got if r.doc_id in (21, 22)}) == 2
    assert packing.pack(docs.where("false")).count() == 0
    own = packing.pack(docs.withColumn("c", F.lit(None).cast("int")), capacity=100, cluster="c").where("doc_id < 6").collect()
    assert len({(r.shard, r.bin) for r in own}) == 1  # without clusters they share a bin


def test_rows_alone_decide(spark, small):
    """Other files, partitions and orders of the same rows are packed alike, repeated rows too."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.where("doc_id < 30"))
    a = packing.pack(docs, capacity=300, shard_rows=50).collect()
    b = packing.pack(docs.orderBy(F.desc("text")).repartition(7), capacity=300, shard_rows=50).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(a, key=key) == sorted(b, key=key) and len({r.shard for r in a if r.shard is not None and r.shard >= 0}) > 3


def test_shards_cost_little_fill(spark):
    """Words a bin of independent shards, against one best fit over all pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fill = []
    for shard_rows in (1 << 40, 2000):
        bins = packing.pack(docs, shard_rows=shard_rows).where("shard >= 0").groupBy("shard", "bin").agg(F.first("bin_used").alias("used"))
        fill.append(bins.agg(F.avg(F.col("used") / 2048)).first()[0])
    print(f"fill {fill[0]:.4f} in one, {fill[1]:.4f} in shards")
    assert fill[1] > 0.97 * fill[0]


def test_the_query_packs_as_a_plain_search_does(spark, small):
    """Of the registered query: pieces in order, each in the tightest bin without its source and its cluster of copies."""
    import hashlib

    from corpuscle.llm import entries

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = []
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        copy = hashlib.md5(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()
        if n % 2048:
            items.append((-(n % 2048), r.doc_id, r.source, copy))
    items.sort(key=lambda x: x[:2])
    number = {}
    masks = [(1 << number.setdefault(("s", s), len(number)) if s is not None else 0) | 1 << number.setdefault(("c", c), len(number)) for _, _, s, c in items]
    want = plain_best_fit([-n for n, *_ in items], masks, 2048)
    got = {r.doc_id: r.bin for r in entries.op4_best_fit_packing(spark, small).where("shard >= 0").collect()}
    assert got == {i: b for (_, i, *_), b in zip(items, want, strict=True)} and len(set(want)) < len(items) / 2

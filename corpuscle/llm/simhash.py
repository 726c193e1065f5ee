"""SimHash near-dedup: Golay-code fuzzy hashing of 64-bit fingerprints.

near_groups() links fingerprints of four-word shingles by their distance alone. copies() is what drops near copies from a
corpus: it takes the same links of fingerprints as candidates, adds those that share a band of min-hashes of five-word
shingles, which fingerprints further apart may, and verifies all on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import columns, cut, fresh, named, partitions, small_side, with_row, written
from corpuscle.llm.components import components
from corpuscle.llm.urlfilter import BlockedBloom
from corpuscle.llm.windows import MIX, WordHashes, mixed, shingles, whole_runs

SEED = 42
#: Widths of the segments of a fingerprint, from its lowest bit, each made of two halves. Two halves are a word of the
#: code, with zeros before it.
SEGMENTS = ((11, 11), (11, 10), (11, 10))
#: Differing bits up to which two fingerprints share a key for certain.
MOST = 4
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: A bucket of fingerprints up to which all pairs are linked, and up to which one task takes it.
SMALL, LARGE = 8, 20_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of a word's high and low bits, and for each remainder the errors of weight 4 or less that
    lead to a codeword: one of weight 3 or less, the code being perfect, and where it has weight 3 five of
    weight 4; missing ones are -1."""
    high = np.array([remainder(k << 12) for k in range(1 << 11)], np.int32)
    low = np.array([remainder(k) for k in range(1 << 12)], np.int32)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    bit = [remainder(1 << k) for k in range(23)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            rest = 0
            for k in places:
                rest ^= bit[k]
            known = errors[rest]
            if weight < 4 or bin(known[0]).count("1") == 3:
                known.append(sum(1 << k for k in places))
    assert {len(x) for x in errors} == {1, 6}
    return high, low, np.array([x + [-1] * (6 - len(x)) for x in errors], np.int32)


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of the codewords around it, six or one, -1 for missing ones.
    Words that differ in one or two bits share at least one."""
    high, low, errors = code_tables()
    near = errors[high[words >> 12] ^ low[words & 0xFFF]]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> 11)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of prints). Of three segments that hold MOST errors together some two hold two at most between them, and
    of the four halves of those some two hold none: so for each pair of segments and each two of its halves a key is
    made of these two as they are and of the index of a codeword near the other two. Fingerprints at a distance of MOST
    or less share one. Keys have 33 bits or more, so buckets stay small in large corpora."""
    halves, at = [], 0
    for widths in SEGMENTS:
        for width in widths:
            halves.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
            at += width
    keys, rows, number = [], [], 0
    for one, two in combinations(range(len(SEGMENTS)), 2):
        four = [2 * one, 2 * one + 1, 2 * two, 2 * two + 1]
        for exact in combinations(four, 2):
            a, b = (k for k in four if k not in exact)
            near = codeword_keys((halves[a] << 11 | halves[b]).astype(np.int32)).astype(np.int64)
            whole = number << 34 | halves[exact[0]] << 23 | halves[exact[1]] << 12
            row, column = np.nonzero(near >= 0)
            keys.append(whole[row] | near[row, column])
            rows.append(row)
            number += 1
    return np.concatenate(keys), np.concatenate(rows)


def spanning(prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of distance `most` or less: each print is reached once."""
    left = prints
    while len(left):
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            x = open_.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                hit, left = left[near], left[~near]
                open_.extend(hit)
                yield np.full(len(hit), x), hit


def bucket_links(keys: np.ndarray, prints: np.ndarray, most: int, forest=spanning) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys: all of them in small runs, a forest of them in longer ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    long_ = sizes > SMALL
    lone = np.repeat(~long_, sizes)
    out = [(prints[:0], prints[:0])]
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        hit = (keys[step:] == keys[:-step]) & lone[step:]
        hit[hit] = np.bitwise_count(prints[step:][hit] ^ prints[:-step][hit]) <= most
        out.append((prints[:-step][hit], prints[step:][hit]))
    for start, size in zip(starts[long_], sizes[long_], strict=True):
        out.extend(forest(prints[start : start + size], most))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


#: Rows of the narrow tables that go into one checkpoint file; fingerprints that a task makes keys of.
FILE_ROWS, KEYED_ROWS = 250_000, 10_000
LINKS = "a long, b long, crowded long"


def linker(most: int, large: int, forest=spanning):
    """Over batches (key, print) sorted by key: links between the prints of each key; of keys with more than `large` rows
    only the key."""

    def rows(a: np.ndarray, b: np.ndarray, crowded: list[int]) -> pa.RecordBatch:
        blank = pa.nulls(len(crowded), pa.int64())
        return pa.record_batch(
            [
                pa.concat_arrays([pa.array(a.view(np.int64)), blank]), pa.concat_arrays([pa.array(b.view(np.int64)), blank]),
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(crowded, pa.int64())]),
            ],
            names=["a", "b", "crowded"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skipped = np.empty((2, 0), np.int64), None
        for batch in batches:
            own = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if skipped is not None:
                own = own[:, own[0] != skipped]
            if not own.shape[1]:
                continue
            skipped = None
            held = np.concatenate([held, own], axis=1)
            last = np.searchsorted(held[0], held[0, -1])
            yield from closed(held[:, :last])
            held = held[:, last:]
            if held.shape[1] > large:
                skipped = int(held[0, 0])
                yield rows(held[0, :0], held[0, :0], [skipped])
                held = held[:, :0]
        yield from closed(held)

    def closed(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held.shape[1]:
            values, counts = np.unique(held[0], return_counts=True)
            crowded = values[counts > large]
            keys, prints = held[:, ~np.isin(held[0], crowded)]
            prints = np.ascontiguousarray(prints).view(np.uint64)
            a, b = bucket_links(keys, prints, most, forest) if len(keys) else (prints,) * 2
            if len(a) or len(crowded):
                yield rows(a, b, crowded.tolist())

    return run


def keyed(prints: DataFrame) -> DataFrame:
    """(print) -> (key, print), one row for each fuzzy key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 2048):
                part = own[at : at + 2048]
                key, row = fuzzy_keys(part.view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(part[row])], names=["key", "print"])

    return prints.select("print").mapInArrow(run, "key long, print long")


def near_links(prints: DataFrame, most: int = MOST, large: int = LARGE, forest=spanning) -> DataFrame:
    """Distinct fingerprints (print) -> links (a, b) of prints whose components are those of distance `most`, MOST at most.

    Keys of more than `large` fingerprints come back unlinked from the first pass. Their rows are then dealt
    into blocks, and each pair of blocks is a key of its own: every pair of rows still meets, in tasks of bounded size.
    """
    if most > MOST:
        raise ValueError(f"fingerprints share a key for certain up to {MOST} differing bits")
    prints = cut(prints.select("print"), narrow=True)
    n = prints.count()
    rows = prints.repartition(partitions(prints.sparkSession, n, KEYED_ROWS))  # a row becomes about 90
    linked = keyed(rows).repartition("key").sortWithinPartitions("key", "print").mapInArrow(linker(most, large, forest), LINKS)
    found = cut(linked.repartition(partitions(prints.sparkSession, n, FILE_ROWS)))  # few rows of many tasks in few files
    links = found.where("a is not null").select("a", "b")
    crowded = found.where("crowded is not null").select(F.col("crowded").alias("key")).distinct()
    if crowded.isEmpty():
        return links
    rows = cut(keyed(rows).join(crowded, "key"), narrow=True)
    sizes = rows.groupBy("key").agg(F.ceil(2 * F.count(F.lit(1)) / large).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("print"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("key", "print", "block", every).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "print"
    )
    split = pairs.repartition("key").sortWithinPartitions("key", "print").mapInArrow(linker(most, 1 << 62, forest), LINKS)
    return links.unionByName(split.select("a", "b"))


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 4) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed 64-bit number."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            own = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, print long")


def near_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", most: int = MOST, width: int = 4) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component_id, the smallest id that is reachable over
    fingerprints that differ in `most` bits or fewer, its own included.

    Null and blank texts have fingerprint zero and link like any other. Null ids never are a component's id unless
    all of it are null. Repeated rows come back each. An empty table gives an empty result; other columns are not read.
    Copies share a fingerprint, and only distinct fingerprints are keyed, linked and joined.
    """
    rows = written(fingerprints(docs, text, id, width), "prints", narrow=True)
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(prints, most))
    labelled = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(ids, "root").select("print", "component_id")
    return rows.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near copies by word shingles ---------------------------------------------------------------


#: Bands of min-hashes and hashes of a band: two sets with a Jaccard similarity of j share a band with a probability of
#: 1 - (1 - j ** BAND) ** BANDS, which is 0.9999 at 0.8.
BANDS, BAND = 24, 5
#: A band's bucket up to which all pairs are listed; bytes of the sets that a task takes at once of a larger one.
BUCKET, BLOCK_BYTES = 16, 16_000_000
#: What the hash functions of the bands mix in, and their odd multipliers.
MASKS, FACTORS = ((mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * k) >> np.uint64(32)).astype(np.uint32)[:, None] for k in MIX)
FACTORS |= np.uint32(1)


def shingle_set(text: str | None, seen: WordHashes) -> np.ndarray:
    """A text's set of five-word shingles as sorted 32-bit hashes; of fewer words the whole sequence is the only shingle."""
    hashes = shingles(text, seen)
    if not len(hashes):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()))], np.uint64)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hashes."""
    low = np.full(BANDS * BAND, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 1024):
        values = (own[at : at + 1024] ^ MASKS) * FACTORS
        low = np.minimum(low, ((values ^ (values >> np.uint32(15))) * FACTORS[::-1]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.astype(np.uint64).reshape(BANDS, BAND).T:
        key = mixed((key ^ column) * MIX[1])
    return key.view(np.int64)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, own): the wanted documents' sets of five-word shingles as sorted 32-bit hashes. A Bloom filter of bounded size
    keeps the others from being shuffled."""
    bloom = docs.sparkSession.sparkContext.broadcast(BlockedBloom.of(wanted.select(F.col("row").cast("string").alias("key"))).blocks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = BlockedBloom(bloom.value), WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(held.may_hold([str(r).encode() for r in batch.column("row").to_pylist()])))
            own = [shingle_set(text.as_py(), seen).tobytes() for text in batch.column("text")]
            yield pa.record_batch([batch.column("row"), pa.array(own, pa.binary())], names=["row", "own"])

    parts = docs.select("row", "text").mapInArrow(sets, "row long, own binary").join(wanted, "row", "left_semi").dropDuplicates(["row"])
    return written(parts.repartition(partitions(docs.sparkSession, wanted.count(), FILE_ROWS // 10)), "shingle-sets")


def alike(pairs: DataFrame, parts: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) of rows whose sets have a Jaccard similarity of `similar` or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similar * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(parts.selectExpr("row a", "own own_a"), "a").join(parts.selectExpr("row b", "own own_b"), "b")
    return joined.select("a", "b", "own_a", "own_b").mapInArrow(verify, "a long, b long")


def similar_links(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of sets with a Jaccard similarity of `similar` or more.

    Two such sets share one of their rarest elements, as many as the similarity leaves room for; what so meets is
    compared unless it is linked already. No pair is left out.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    room = sizes - np.ceil(similar * sizes - 1e-9).astype(np.int64) + 1
    early = np.arange(len(token)) - starts[owner] < room[owner]
    held = token[early]
    order = np.argsort(held, kind="stable")
    held, holder = held[order], owner[early][order]
    first, end = (np.searchsorted(held, np.arange(len(counts)), side) for side in ("left", "right"))
    root, mark, links = np.arange(len(sets)), np.zeros(len(counts), np.int32), []
    for i, size in enumerate(sizes.tolist()):
        own = token[starts[i] : starts[i] + size]
        head = own[: room[i]]
        head = head[end[head] - first[head] > 1]
        if not len(head):
            continue
        open_ = np.unique(np.concatenate([holder[first[t] : end[t]] for t in head.tolist()]))
        fits = (open_ > i) & (np.minimum(sizes[open_], size) >= similar * np.maximum(sizes[open_], size) - 1e-9)
        open_, step = open_[fits], 16
        mark[own] = 1
        while len(open_ := open_[root[open_] != root[i]]):
            step = max(1, min(step, int(np.searchsorted(np.cumsum(sizes[open_]), 1_000_000))))
            now, open_, step = open_[:step], open_[step:], 4 * step
            at = np.cumsum(sizes[now]) - sizes[now]
            places = np.repeat(starts[now] - at, sizes[now]) + np.arange(int(sizes[now].sum()))
            both = np.add.reduceat(mark[token[places]], at)
            for j in now[both >= similar * (size + sizes[now] - both)].tolist():
                if root[i] != root[j]:
                    links.append((i, j))
                    root[root == root[j]] = root[i]
        mark[own] = 0
    return links


def buckets(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Over batches (key, row, size) sorted by key: all pairs of rows inside each key that sizes don't rule out; of keys with
    more than BUCKET rows only the key."""
    for own in whole_runs(batches, ["key"]):
        key, row, size = own["key"], own["row"], own["size"]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        lone = np.repeat(counts <= BUCKET, counts)
        out = []
        for step in range(1, min(BUCKET, int(counts.max()))):
            one, two = slice(None, -step), slice(step, None)
            hit = (key[one] == key[two]) & lone[one]
            hit &= np.minimum(size[one], size[two]) >= similar * np.maximum(size[one], size[two]) - 1e-9
            out.append(np.stack([np.minimum(row[one][hit], row[two][hit]), np.maximum(row[one][hit], row[two][hit])]))
        a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        crowded = key[starts[counts > BUCKET]]
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.record_batch(
            [pa.concat_arrays([pa.array(x), none(len(crowded))]) for x in (a, b)] + [pa.concat_arrays([none(len(a)), pa.array(crowded)])],
            names=["a", "b", "crowded"],
        )


def crowded_links(rows: DataFrame, parts: DataFrame, similar: float) -> DataFrame:
    """(key, row, size) and the rows' sets -> links (a, b) that span all similar pairs inside each key. A key's rows are
    dealt into blocks of bounded bytes, and each pair of blocks is a key of its own: every pair of rows meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, [], []
        for batch in batches:
            for k, row, own in zip(batch.column("key").to_pylist(), batch.column("row").to_pylist(), batch.column("own").to_pylist(), strict=True):
                if k != key:
                    yield close(names, sets)
                    key, names, sets = k, [], []
                names.append(row)
                sets.append(np.frombuffer(own, np.uint32))
        yield close(names, sets)

    def close(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        links = similar_links(sets, similar) if len(sets) > 1 else []
        return pa.record_batch([pa.array([names[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    n = rows.groupBy("key").agg(F.ceil(F.sum("size") * F.lit(8) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = rows.join(n, "key").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("key", "row", "block", every).select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "row")
    joined = pairs.join(parts, "row").select("key", "row", "own")
    return joined.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def print_pairs(rows: DataFrame) -> DataFrame:
    """(row, simhash) -> pairs (a, b) of rows that fingerprints link: each row and the first of its fingerprint, and the first
    rows of linked fingerprints."""
    firsts = cut(rows.groupBy("simhash").agg(F.min("row").alias("first")), narrow=True)
    own = rows.join(firsts, "simhash").where("row <> first").selectExpr("first a", "row b")
    near = near_links(firsts.selectExpr("simhash print")).distinct()
    for side in "ab":
        near = near.join(firsts.selectExpr(f"simhash {side}", f"first row_{side}"), side)
    return own.unionByName(near.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")))


def copies(docs: DataFrame, row: str, text: str = "text", id: str = "doc_id", similar: float = 0.8) -> DataFrame:
    """The rows, by their column `row`, that another one of their group replaces: the one with the smallest id stays, and
    rows that are equal to it in id and text. A group is what is linked by a Jaccard similarity of `similar` or more of
    five-word shingle sets.

    Documents with equal sets are linked to the first of them, which stands for all. Those that SimHash fingerprints of
    MOST differing bits or fewer link are compared on their sets. So are all pairs that share a band of min-hashes, those
    of crowded bands inside one task or a pair of blocks, except pairs that are linked already: a block of text that is
    added or cut off moves more bits than MOST at a similarity of 0.8. Null texts count as empty; texts without words are alike; null ids come last.
    """
    docs = named(docs.select(F.col(row).alias("place"), F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", "row")
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("place", "doc_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            size, print_, keys, bits = [], [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), seen)
                size.append(len(own))
                print_.append(xxhash.xxh64_intdigest(own.tobytes()))
                keys.append(band_keys(own))
                bits.append(fingerprint(text.as_py()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            prints = pa.array(np.array(print_, np.uint64).view(np.int64))
            yield pa.record_batch(
                [batch.column("place"), batch.column("doc_id"), batch.column("row"), pa.array(size, pa.int32()), prints, pa.array(np.array(bits, np.uint64).view(np.int64)), lists],
                names=["place", "doc_id", "row", "size", "print", "simhash", "keys"],
            )

    shape = f"place {kinds['place']}, doc_id {kinds['doc_id']}, row long, size int, print long, simhash long, keys array<long>"
    rows = written(docs.select("place", "doc_id", "row", "text").mapInArrow(run, shape), "bands", narrow=True)
    files = partitions(docs.sparkSession, rows.count(), FILE_ROWS)
    firsts = cut(rows.groupBy("print", "size").agg(F.min("row").alias("first")), narrow=True)
    twins = rows.select("row", "print", "size").join(firsts, ["print", "size"]).where("row <> first").selectExpr("first a", "row b").distinct()
    lone = rows.select("row", "size", "keys").join(firsts.selectExpr("first row"), "row").dropDuplicates(["row"])
    keyed = lone.select(F.explode("keys").alias("key"), "row", "size")
    dealt = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: buckets(batches, similar), LINKS)
    found = cut(dealt.distinct(), narrow=True)
    bits = rows.select("row", "simhash").join(firsts.selectExpr("first row"), "row").dropDuplicates(["row"])
    pairs = cut(print_pairs(bits).unionByName(found.where("a is not null").select("a", "b")).distinct(), narrow=True)
    crowded = cut(keyed.join(found.where("crowded is not null").selectExpr("crowded key"), "key", "left_semi"), narrow=True)
    wanted = cut(pairs.selectExpr("a row").unionByName(pairs.selectExpr("b row")).unionByName(crowded.select("row")).unionByName(twins.selectExpr("a row")).unionByName(twins.selectExpr("b row")).distinct(), narrow=True)
    parts = shingle_sets(docs, wanted)
    links = alike(pairs.unionByName(twins), parts, similar).unionByName(crowded_links(crowded, parts, similar))
    roots = components(cut(links.repartition(files)))
    labelled = rows.select("place", "row", "doc_id").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    stays = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    return labelled.join(stays, "root").where(~same).select(F.col("place").alias(row))


def without_near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", similar: float = 0.8) -> DataFrame:
    """The rows of docs without those that copies() finds, with all their columns, whatever their names. Nulls, ties and
    repeats are as there: rows equal in id and text stay or go together. An empty table gives an empty result. Rows are
    told apart by their place in the table; only the places of those that go are joined to it."""
    rows = with_row(docs, row := fresh("place", docs))
    gone = cut(copies(rows, row, text, id, similar), narrow=True)
    return rows.join(small_side(gone), row, "left_anti").select(*columns(docs))

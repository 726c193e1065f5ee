"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, written

SEED = 42
#: Words of 32 bits in a block, each with one bit of a key; and odd multipliers, one for each word.
WORDS = 8
SALTS = np.array([xxhash.xxh32_intdigest(bytes([k])) | 1 for k in range(WORDS)], np.uint64)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`,
    `#` or the end. Null or without `://`: both empty."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(known, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(known, shape, 2)


def places(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and its bit in each of the block's words."""
    h = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF))[:, None] * SALTS[None, :]
    return block.astype(np.int64), (np.uint64(1) << ((low & np.uint64(0xFFFFFFFF)) >> np.uint64(27))).astype(np.uint32)


class BlockedBloom:
    """blocks: (number of blocks, WORDS) of 32-bit words. A key sets one bit in each word of one block."""

    def __init__(self, blocks: np.ndarray) -> None:
        self.blocks = blocks

    @classmethod
    def of(cls, keys: DataFrame, bits_per_key: int = 16, most_bytes: int = 64 << 20) -> BlockedBloom:
        """From the column `key`, its blocks built by the executors and combined by OR. The filter takes
        most_bytes at the most, so it can be broadcast whatever the list's length; beyond that more
        false hits pass on to the join, and the result is the same."""
        n = keys.count()
        count = max(1, min(-(-n * bits_per_key // (32 * WORDS)), most_bytes // (4 * WORDS)))
        names = [f"w{k}" for k in range(WORDS)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, bits = places([k.encode() for k in batch.column(0).to_pylist()], count)
                yield pa.record_batch([pa.array(block), *[pa.array(b.astype(np.int64)) for b in bits.T]], names=["block", *names])

        bits = keys.select("key").mapInArrow(run, "block long, " + ", ".join(f"{w} long" for w in names))
        filled = bits.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]).toPandas()
        blocks = np.zeros((count, WORDS), np.uint32)
        blocks[filled["block"].to_numpy()] = filled[names].to_numpy()
        return cls(blocks)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        block, bits = places(keys, len(self.blocks))
        return (self.blocks[block] & bits == bits).all(axis=1)


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """The keys under which a rule that fits could be listed, and the URL's own canonical key."""
    if not host:
        return
    labels = host.split(".")
    for k in range(len(labels)):
        suffix = ".".join(labels[k:])
        for n in lengths:
            if n <= len(path):
                yield suffix + path[:n]
    yield exact_key(host, path)


def exact_key(host: str, path: str) -> str:
    """`=` can't be in a rule's host, so it sets keys of whole URLs apart."""
    return "=" + host + path.rstrip("/")


def judge(
    pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id: str = "page_id", url: str = "url",
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    rules (host, path, verdict): a rule fits its host and all subdomains of it, if the URL's path starts with
    the rule's, letter by letter. The longest fitting rule decides; of equal rules with different verdicts
    block does. listed (url), optional: whole URLs to block, compared by host and path without trailing
    slashes; they decide where no rule fits. Else the verdict is allow. Null URLs and URLs without `://` have
    an empty host and path: nothing fits. Rules or listed URLs that are null are left out. Repeated pages come
    back each; an empty table gives an empty result; other columns are not read.

    Every page asks the filter for each key that could list it. What may be listed goes on to an equality join
    with the list, which drops false hits. Only the filter is broadcast, at most_bytes at the most; Spark
    chooses the join by the list's size, and splits keys that are hot. Pages without a possible hit aren't shuffled.
    """
    spark = pages.sparkSession
    keys = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("n")
    )
    lengths = sorted(r.n for r in keys.select("n").distinct().collect())  # bounded by the longest path
    keys = keys.select("key", "verdict")
    if listed is not None:
        host, path = host_and_path(F.col("url"))
        whole = listed.select(host.alias("host"), path.alias("path")).where("host <> ''")
        keys = keys.unionByName(
            whole.select(F.concat(F.lit("="), "host", F.regexp_replace("path", "/+$", "")).alias("key"), F.lit("block").alias("verdict"))
        )
    keys = cut(keys.groupBy("key").agg(F.max("verdict").alias("verdict")))
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(keys, most_bytes=most_bytes).blocks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = BlockedBloom(bloom.value)
        for batch in batches:
            asked: list[bytes] = []
            ends = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                asked += [k.encode() for k in candidates(host, path, lengths)]
                ends.append(len(asked))
            may = held.may_hold(asked)
            hits = [k.decode() for k, m in zip(asked, may.tolist(), strict=True) if m]
            offsets = np.concatenate([[0], np.cumsum(may)])[[0, *ends]].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hits, pa.string()))
            yield pa.record_batch([*batch.columns, found], names=[*batch.schema.names, "hits"])

    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    asked = parts.mapInArrow(ask, f"page_id {kind}, host string, path string, hits array<string>")
    numbered = written(asked.withColumn("row", F.monotonically_increasing_id()), "asked", narrow=True)
    possible = numbered.where(F.size("hits") > 0).select("row", "page_id", "host", "path", F.explode("hits").alias("key"))
    real = possible.join(keys.withColumn("known", F.lit(True)), "key", "left")
    rank = F.when(F.col("known"), F.struct(~F.col("key").startswith("="), F.length("key").alias("n"), "key", "verdict"))
    best = real.groupBy("row", "page_id", "host", "path").agg(F.max(rank).alias("best"))
    clear = numbered.where(F.size("hits") == 0).select("row", "page_id", "host", "path", F.lit(None).cast(best.schema["best"].dataType).alias("best"))
    best = best.unionByName(clear)
    ruled = ~F.col("best.key").startswith("=")
    return best.select(
        "page_id", "host", "path", F.when(ruled, F.col("best.key")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.coalesce(~ruled, F.lit(False)).alias("listed"),
    )

"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import partitions, squeezed, words_in, written

#: Pieces that one task packs.
SHARD_ROWS = 40_000
EVERY = -1  # the bitmap with all bits set: what a node without bins carries


class Bins:
    """Open bins by residual: a segment tree over residuals 0..capacity.

    Each leaf holds the bins of one residual, by their bitmaps; each node carries the bits that all
    bins below it have in common. An item conflicts with every bin below a node if it shares a bit
    with the node's bitmap, so the search for the successor of a size passes over whole ranges of
    incompatible bins and goes on until the tightest compatible one.
    """

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.common = [EVERY] * (2 * self.width)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]

    def tightest(self, size: int, bits: int) -> int:
        """The least residual, `size` or more, that a bin without any of the bits has; -1 if none."""
        node = size + self.width
        if self.leftmost(node, bits) >= 0:
            return size
        while True:  # up to the next subtree to the right that has a compatible bin below it
            while node & 1:
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
            found = self.leftmost(node, bits)
            if found >= 0:
                return found

    def leftmost(self, node: int, bits: int) -> int:
        """A node's common bits may be clear while each of its bins has some of the item's: then the search goes on."""
        if self.common[node] == EVERY or self.common[node] & bits:
            return -1
        if node >= self.width:
            leaf = node - self.width
            return leaf if any(not have & bits for have in self.at[leaf]) else -1
        found = self.leftmost(2 * node, bits)
        return found if found >= 0 else self.leftmost(2 * node + 1, bits)

    def take(self, residual: int, bits: int) -> tuple[int, int]:
        """Removes the first-opened bin of this residual that is compatible: its number and bitmap."""
        leaf = self.at[residual]
        have = min((h for h in leaf if not h & bits), key=lambda h: leaf[h][0])
        number = leaf[have].pop(0)
        if not leaf[have]:
            del leaf[have]
            self.refresh(residual)
        return number, have

    def put(self, residual: int, number: int, bits: int) -> None:
        leaf = self.at[residual]
        if bits in leaf:
            held = leaf[bits]
            held.append(number)
            if len(held) > 1 and held[-2] > number:
                held.sort()
        else:
            leaf[bits] = [number]
            self.refresh(residual)

    def refresh(self, residual: int) -> None:
        node, now = residual + self.width, EVERY
        for have in self.at[residual]:
            now &= have
        common = self.common
        while node:
            if common[node] == now:
                return
            common[node] = now
            node >>= 1
            now = common[2 * node] & common[2 * node + 1] if node else now


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """The bin of each item: the open bin with the least room that holds it and shares no bit with it;
    of equals the one opened first; else a new one. Items come in the given order."""
    bins, opened, out = Bins(capacity), 0, []
    for size, bits in zip(sizes, masks, strict=True):
        residual = bins.tightest(size, bits)
        if residual < 0:
            number, have, residual = opened, 0, capacity
            opened += 1
        else:
            number, have = bins.take(residual, bits)
        if residual > size:
            bins.put(residual - size, number, have | bits)
        out.append(number)
    return out


def local_bits(values: pd.Series, first: int) -> tuple[list[int], int]:
    """A bit for each value that more than one item of the shard has, from bit number `first` on; others
    and nulls can't conflict and get none."""
    counts = values.value_counts()
    number = {v: first + k for k, v in enumerate(counts.index[counts > 1])}
    return [1 << number[v] if v in number else 0 for v in values], first + len(number)


def pack(
    docs: DataFrame, capacity: int = 2048, text: str = "text", id: str = "doc_id", source: str = "source",
    cluster: str | None = None, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Packs whole documents into bins of `capacity` words. No two pieces in a bin have the same source
    or the same duplicate cluster; two null sources, or clusters, don't conflict.

    A document longer than a bin is cut: its full pieces fill bins of their own, and the rest is packed
    like a document. cluster: a column; by default texts that are equal without white space are a
    cluster. Documents without a word need no room and get no bin: their row has nulls for bin and place.
    Null text counts as empty. Repeated rows are packed each. Empty tables give an empty result.

    Returns a row per piece: doc_id, source, piece, first_word, size, shard, bin (number in the shard),
    place (first word of the piece in its bin), bin_used (words in the bin).
    Pieces are dealt by a hash of id and text into shards of about `shard_rows`, each packed by one task
    in the order of size, largest first, then id and text; equal rows are numbered and spread, too. So the
    result depends on the rows alone, not on files or partitions. A hot source or cluster spreads over all
    shards, and conflicts are within a bin, so none is lost. More documents mean more shards, not larger
    ones: a bin takes pieces of one shard, which costs little fill (see the README) and is what bounds a task.
    """
    spark = docs.sparkSession
    group = F.col(cluster).cast("string") if cluster else F.md5(squeezed(F.col(text)))
    own = ["doc_id", "source", "cluster", "text_md5", "words"]
    rows = written(
        docs.select(
            F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), group.alias("cluster"),
            F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"), words_in(F.col(text)).alias("words"),
        ).groupBy(*own).agg(F.count(F.lit(1)).cast("int").alias("n")),
        "pack-rows",
        narrow=True,
    ).select(*own, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    whole = F.floor(F.col("words") / capacity).cast("int")
    names = ["doc_id", "source", "cluster", "text_md5", "copy"]
    full = rows.where(F.col("words") >= capacity).select(*names, F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select(
        "doc_id", "source", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("size"),
        (-1 - F.pmod(F.hash(*names, "piece"), F.lit((1 << 31) - 1))).cast("int").alias("shard"), F.xxhash64(*names, "piece").alias("bin"),
        F.lit(0).cast("long").alias("place"), F.lit(capacity).cast("long").alias("bin_used"),
    )
    none = rows.where("words = 0").selectExpr(
        "doc_id", "source", "0 piece", "0L first_word", "0L size", "cast(null as int) shard",
        "cast(null as long) place", "cast(null as long) bin_used", "cast(null as long) bin",
    )
    rest = rows.where(F.col("words") % capacity > 0).select(*names, whole.alias("piece"), (F.col("words") % capacity).alias("size"))
    shards = partitions(spark, rest.count(), shard_rows)
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64(*names), F.lit(shards)).cast("int"))
    shape = "doc_id {}, source string, piece int, first_word long, size long, shard int, bin long, place long, bin_used long".format(
        rows.schema["doc_id"].dataType.simpleString()
    )

    def one_shard(items: pd.DataFrame) -> pd.DataFrame:
        by = ["size", "doc_id", "source", "cluster", "text_md5", "copy"]
        items = items.sort_values(by, ascending=[False] + [True] * 5, kind="stable", ignore_index=True)
        by_source, used = local_bits(items["source"], 0)
        by_cluster, _ = local_bits(items["cluster"], used)
        items["bin"] = best_fit(items["size"].tolist(), [a | b for a, b in zip(by_source, by_cluster, strict=True)], capacity)
        in_bin = items.groupby("bin")["size"]
        items["place"] = in_bin.cumsum() - items["size"]
        items["bin_used"] = in_bin.transform("sum")
        items["first_word"] = items["piece"].astype("int64") * capacity
        return items[["doc_id", "source", "piece", "first_word", "size", "shard", "bin", "place", "bin_used"]]

    packed = dealt.groupBy("shard").applyInPandas(one_shard, shape)
    return packed.unionByName(full).unionByName(none)

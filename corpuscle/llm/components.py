"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, partitions, small_side

#: Links of one task and one checkpoint file; rounds over few links leave few files.
TASK_LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): for every node with a link the smallest node that it reaches, itself included.

    Links with a null end or both ends equal are left out. Each round ties every node's neighbours to the
    least one that it sees, first the larger neighbours, then the smaller; it ends when the links no longer
    change, all of them then being stars. Rounds grow with the logarithm of a path's length. Minima combine map-side, and
    they are broadcast where they are few by their count, so that links stay where they are; beyond that a hub's links
    are a hot key of a join, which Spark splits.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    first = links.where("a <> b").select(high, low).distinct()
    now = cut(first.coalesce(tasks(links, links.count())))
    state = mark(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small_side(least, 2 * state[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_side(least, 2 * state[0]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct().coalesce(tasks(links, state[0])))
        now, before = after, state
        state = mark(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def tasks(links: DataFrame, rows: int) -> int:
    return partitions(links.sparkSession, rows, TASK_LINKS)


def mark(links: DataFrame) -> tuple[int, int]:
    """Number of links and a checksum that doesn't depend on their order."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]

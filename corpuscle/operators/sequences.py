"""Training sequences: sliding windows, blocks, shifts, padding, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.sources.sinks import kept


def sliding(df: DataFrame, id: list[str], ids: str, length: int = 32) -> DataFrame:
    """(id..., start, x, y): every window of length + 1 indices, as input and the same shifted by one. A sequence of n
    indices has max(0, n - length)."""
    own = df.where(F.size(ids) > length)
    starts = F.sequence(F.lit(0), F.size(ids) - length - 1)
    rows = own.select(*id, ids, F.explode(starts).alias("start"))
    window = F.slice(F.col(ids), F.col("start") + 1, F.lit(length + 1))
    return rows.select(*id, "start", F.slice(window, 1, length).alias("x"), F.slice(window, 2, length).alias("y"))


def shift(ids: Column) -> tuple[Column, Column]:
    """Inputs and labels of next-word prediction."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def blocks(df: DataFrame, order: str, ids: str, length: int = 128, batch: int = 1000) -> DataFrame:
    """(batch, block, input_ids, attention_mask, labels): rows in batches of `batch` by the rank of `order`, their
    indices joined and cut into blocks; what is left over of a batch is dropped; null indices count as none. Ranks come
    from a range sort and the sizes of its partitions, not from one window over all rows; order values must differ.

    No task holds a batch: each row is cut where blocks end, by the number of indices before it in its batch, and a
    block is put together from its pieces."""
    n = F.when(F.col(ids).isNull(), 0).otherwise(F.size(ids)).cast("long")
    ranked = ranks(df.select(order, ids, n.alias("n")), order).withColumn("batch", F.floor((F.col("rank") - 1) / batch))
    before = Window.partitionBy("batch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.select("rank", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "batch")  # `batch` narrow rows at a time
    own = ranked.where("n > 0").join(starts.drop("batch"), "rank")

    def piece(block: Column) -> Column:
        low = F.greatest(block * length - F.col("start"), F.lit(0))
        high = F.least((block + 1) * length - F.col("start"), F.col("n"))
        return F.struct(block.alias("block"), F.slice(ids, (low + 1).cast("int"), (high - low).cast("int")).alias("part"))

    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    cut = own.select("batch", "rank", F.inline(F.transform(F.sequence(first, last), piece)))
    parts = F.array_sort(F.collect_list(F.struct("rank", "part")))  # `length` indices at most
    joined = cut.groupBy("batch", "block").agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("input_ids"))
    ones = F.array_repeat(F.lit(1), length).alias("attention_mask")
    return joined.where(F.size("input_ids") == length).select("batch", F.col("block").cast("int"), "input_ids", ones, F.col("input_ids").alias("labels"))


def ranks(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the order of a column whose values differ. Rows are dealt into ranges, which are written so
    that they stay as they are; each range numbers its own rows and adds what lies before it."""
    dealt = kept(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranks")
    inner = Window.partitionBy("__part").orderBy(order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row per range
    own = dealt.withColumn("__own", F.row_number().over(inner))
    return own.join(F.broadcast(starts), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__part")


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Cut or filled up to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))), 1, length)


def masked(ids: Column, pad: int = 0) -> Column:
    """Labels of a padded sequence: each index but the first, null where there is only padding."""
    return F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), lambda x: F.when(x != pad, x))


def last(ids: Column, n: int = 32) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - (n - 1), F.lit(1)), F.lit(n))


def context(ids: Column, position: Column, most: int = 16, skip_first: bool = False) -> Column:
    """The indices before a position (from 0), at most so many. skip_first: the first index of all is never in it, as
    where labels are cut from sequences that are shifted already."""
    first = F.greatest(position - most, F.lit(1 if skip_first else 0))
    return F.when(position > first, F.slice(ids, first + 1, position - first)).otherwise(F.slice(ids, 1, 0))

"""Splits into train, validation and test, by source; seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(id: Column, seed: int) -> Column:
    """The same order in every engine and run."""
    return F.md5(F.concat(F.lit(f"{seed}-"), id.cast("string")))


def ranked(df: DataFrame, id: str, source: str, seed: int, digits: int) -> DataFrame:
    """Adds __rank (from 1, in shuffled order) and __total of each source. Ranks are taken inside buckets of the hash and
    added to what the source's buckets before hold, so a source with most of the rows is ranked by many tasks."""
    keyed = df.withColumn("__h", shuffle_key(F.col(id), seed)).withColumn("__b", F.substring("__h", 1, digits))
    sizes = keyed.groupBy(F.col(source).alias("__s"), "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.partitionBy("__s")
    starts = sizes.select("__s", F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(totals).alias("__total"))
    own = Window.partitionBy(source, "__b").orderBy("__h", id)
    placed = keyed.withColumn("__r", F.row_number().over(own)).join(starts, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c")))
    return placed.select(*df.columns, (F.col("__r") + F.col("__start")).alias("__rank"), "__total")


def by_source(df: DataFrame, id: str, source: str, seed: int = 42, small_to_train: bool = False, digits: int = 2) -> DataFrame:
    """Adds `split`. Of a source's n rows in shuffled order the first floor(0.8 n) are train, the next floor(0.1 n)
    validation, the rest test. small_to_train: sources of fewer than three rows are train altogether."""
    rank, n = F.col("__rank"), F.col("__total")
    train, val = F.floor(n * F.lit(0.8)), F.floor(n * F.lit(0.1))
    name = F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")
    if small_to_train:
        name = F.when(n < 3, "train").otherwise(name)
    return ranked(df, id, source, seed, digits).withColumn("split", name).select(*df.columns, "split")


def halved(df: DataFrame, id: str, source: str, seed: int = 42, small_to_train: bool = True, digits: int = 2) -> DataFrame:
    """80 % train, and the rest halved: validation gets the larger share only if the rest is odd and test the smaller."""
    rank, n = F.col("__rank"), F.col("__total")
    rest = n - F.floor(n * F.lit(0.8))
    name = F.when(rank <= n - rest, "train").when(rank <= n - rest + F.ceil(rest / 2), "val").otherwise("test")
    if small_to_train:
        name = F.when(n < 3, "train").otherwise(name)
    return ranked(df, id, source, seed, digits).withColumn("split", name).select(*df.columns, "split")


def sample(df: DataFrame, id: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """The first n rows in shuffled order: a top-k, not a sort."""
    return df.orderBy(shuffle_key(F.col(id), seed), id).limit(n)


def sizes(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source, "split").agg(F.count(F.lit(1)).alias("n"))

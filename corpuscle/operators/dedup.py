"""Exact dedup that keeps the first row, within a run and across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, text: str, order: list[str], scope: list[str] = (), digest: bool = False) -> DataFrame:
    """The first row, by `order`, of each text (and scope, e.g. an article). One aggregate by digest that combines
    map-side: a text that most rows share reaches its reducer as a row per task, and df is computed once. Order keys
    must name rows. digest: the column holds the texts' digests already, so that df needn't carry the texts along."""
    key = [(F.col(text) if digest else F.md5(F.col(text))).alias("__md5"), *[F.col(c).alias(f"__s{k}") for k, c in enumerate(scope)]]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key the seen table doesn't have, each key once."""
    return df.dropDuplicates([key]).join(seen.select(key).distinct(), key, "left_anti")


def with_md5(df: DataFrame, text: str, name: str = "md5") -> DataFrame:
    return df.withColumn(name, F.md5(F.col(text)))

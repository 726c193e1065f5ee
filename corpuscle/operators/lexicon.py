"""Words and word pairs that a dictionary doesn't have, and slang translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import tokens
from corpuscle.functions.udfs import each, translator


def token_rows(df: DataFrame, id: list[str], text: str) -> DataFrame:
    """(id..., pos, tok), one row per token."""
    return df.select(*id, F.posexplode(tokens(F.col(text))).alias("pos", "tok"))


def pairs(df: DataFrame, id: list[str], text: str) -> DataFrame:
    """(id..., pos, tok, next, pair, before) for every token: the pairs with the next token and with the one before,
    null at the ends. Neighbours are taken inside the row's array, so nothing is shuffled."""
    own = df.select(*id, tokens(F.col(text)).alias("__t"))
    none, n = F.array(F.lit(None).cast("string")), F.greatest(F.size("__t") - 1, F.lit(0))
    cells = F.arrays_zip(F.col("__t").alias("tok"), F.slice("__t", F.lit(2), n).alias("next"), F.concat(none, F.slice("__t", F.lit(1), n)).alias("prev"))
    rows = own.where(F.size("__t") > 0).select(*id, F.posexplode(cells).alias("pos", "__p"))
    return rows.select(
        *id, "pos", F.col("__p.tok").alias("tok"), F.col("__p.next").alias("next"),
        F.concat(F.col("__p.tok"), F.lit(" "), F.col("__p.next")).alias("pair"), F.concat(F.col("__p.prev"), F.lit(" "), F.col("__p.tok")).alias("before"),
    )


def unknown(df: DataFrame, id: list[str], text: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of unknown words (tok, frequency) and of pairs of unknown words that are no phrase (pair, frequency).

    A word counts if the dictionary has neither it nor the pair with a neighbour. Only distinct tokens and pairs are
    looked up: the flags of (tok, pair, pair before) are joined to their counts, not to their occurrences, so the
    dictionary may have any size and frequent words are no hot keys.
    """
    rows = pairs(df, id, text)
    counts = rows.groupBy("tok", "next", "pair", "before").agg(F.count(F.lit(1)).alias("n"))
    known = words.select("word").distinct()
    flags = counts
    for column in ("tok", "next", "pair", "before"):
        own = known.select(F.col("word").alias(f"__{column}"))
        flags = flags.join(own, F.col(column) == F.col(f"__{column}"), "left").withColumn(f"is_{column}", F.col(f"__{column}").isNotNull()).drop(f"__{column}")
    single = flags.where(~F.col("is_tok") & ~F.col("is_pair") & ~F.col("is_before"))
    double = flags.where(F.col("pair").isNotNull() & ~F.col("is_pair") & ~F.col("is_tok") & ~F.col("is_next"))
    return (
        single.groupBy("tok").agg(F.sum("n").alias("frequency")),
        double.groupBy("pair").agg(F.sum("n").alias("frequency")),
    )


def frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("frequency") >= least)


def top(counts: DataFrame, name: str, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("frequency"), name).limit(n)


def translate(df: DataFrame, text: str, entries: list[tuple[str, str]], out: str = "translated") -> DataFrame:
    """Slang translation by (key, value) in file order: texts in NFC, longest key first, whole words in any case, one key
    after another. Values are literal; the dictionary may have any size. Null texts stay null."""
    return df.withColumn(out, each(translator(entries))(F.col(text)))

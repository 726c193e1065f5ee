"""Vocabularies: counts, indices, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import words
from corpuscle.operators.sequences import ranks

#: Texts whose words are looked up at once.
TOGETHER = 1000
#: Indices of the special words.
PAD, UNK, SOS, EOS = 0, 1, 2, 3
SPECIALS = {"<pad>": PAD, "<unk>": UNK, "<sos>": SOS, "<eos>": EOS}


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build(df: DataFrame, text: str, least: int = 3, most: int = 30_000) -> DataFrame:
    """(word, idx, n): words by falling frequency, ties by the word, from index 4; special words come first with no
    count. Only the `most` best words are numbered: they are taken by a top-k, so no task sorts the whole vocabulary."""
    counts = word_counts(df, text).where((F.col("n") >= least) & ~F.col("word").isin(*SPECIALS))
    best = counts.orderBy(F.desc("n"), "word").limit(most - len(SPECIALS))
    numbered = best.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + len(SPECIALS) - 1).cast("int"))
    special = df.sparkSession.createDataFrame([(w, i, 0) for w, i in SPECIALS.items()], "word string, idx int, n long")
    return special.unionByName(numbered.select("word", "idx", "n"))


def encode(df: DataFrame, id: list[str], text: str, vocab: DataFrame, marks: bool = True) -> DataFrame:
    """(id..., ids): indices of the words, unknown ones as UNK, between SOS and EOS if marks. Blank texts have no
    words; texts of one id go together word by word. The vocabulary is capped when it is built, so it goes to the
    tasks as a table; words are looked up where they are read, and only their indices are shuffled, by id."""
    known = vocab.select("word", F.col("idx").cast("int")).toArrow()  # as many rows as the vocabulary may have
    held = df.sparkSession.sparkContext.broadcast((known["word"].to_pylist(), known["idx"].to_numpy()))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, index = held.value
        for whole in batches:
            for batch in (whole.slice(at, TOGETHER) for at in range(0, whole.num_rows, TOGETHER)):
                own = batch.column(len(id))
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                words_ = own.flatten()
                place = pc.fill_null(pc.index_in(words_, value_set=pa.array(listed, words_.type)), -1).to_numpy(zero_copy_only=False)
                values = np.append(index, np.int32(UNK))[place].astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.record_batch([*batch.columns[: len(id)], pa.ListArray.from_arrays(ends, pa.array(values))], names=[*id, "ids"])

    looked_up = df.select(*id, words(F.col(text)).alias("__words")).mapInArrow(run, f"{kinds}, ids array<int>")
    each = F.transform(F.col("__all"), lambda a: F.transform(a, lambda x, k: F.struct(k.alias("pos"), x.alias("idx"))))
    ids = F.when(F.size("__all") == 1, F.col("__all")[0]).otherwise(F.transform(F.array_sort(F.flatten(each)), lambda p: p["idx"]))
    if marks:
        ids = F.concat(F.array(F.lit(SOS)), ids, F.array(F.lit(EOS)))
    return looked_up.groupBy(*id).agg(F.collect_list("ids").alias("__all")).select(*id, ids.alias("ids"))


def decode(df: DataFrame, id: list[str], ids: str, vocab: DataFrame, skip: tuple[int, ...] = (SOS, EOS, PAD)) -> DataFrame:
    """(id..., text): the words of the indices, joined by blanks; unknown indices as <unk>, special ones left out."""
    own = df.select(*id, F.posexplode_outer(ids).alias("pos", "idx"))
    found = own.join(vocab.select("word", "idx"), "idx", "left")
    pair = F.when(F.col("pos").isNotNull() & ~F.coalesce("idx", F.lit(UNK)).isin(*skip), F.struct("pos", F.coalesce("word", F.lit("<unk>")).alias("word")))
    return found.groupBy(*id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["word"]), " ").alias("text"))


def class_index(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Class numbers from 0 in the order of the values, null last."""
    classes = df.select(F.col(column).alias("__c")).distinct().withColumn("__k", F.struct(F.col("__c").isNull(), "__c"))
    own = ranks(classes, "__k", "__rank").select("__c", (F.col("__rank") - 1).cast("int").alias(name))
    return df.join(own, F.col(column).eqNullSafe(F.col("__c"))).drop("__c")

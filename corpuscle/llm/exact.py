"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import columns, cut, fresh, small_side, squeezed, with_row, written


def content_hash(normal: Column) -> Column:
    return F.unhex(F.md5(normal))


def exact_groups(
    docs: DataFrame, text: str = "text", id: str = "doc_id", digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per document, dropped ones too: its group of equal texts and the row of it that stays.

    Texts are equal when identical without white space; null counts as empty, so null,
    empty and blank texts are one group. Of a group, the row with the most code points
    in the original text stays, then the smallest id, null ids last. Of wholly repeated
    rows exactly one has kept = true. Rows of an empty table give an empty result.
    Other columns are neither read nor returned.

    Only rows whose hash another row has, too, bring their texts along; of these the least and
    the greatest of each hash must be the same bytes. Where they differ (a collision), the text
    itself joins the key. All aggregates combine map-side, so a group of any size reaches the
    reducers as one row per task, and the join back to rows is one that Spark splits where a key
    is hot. Single texts are never shuffled; the rest moves digests.
    """
    named = docs.withColumn(row := fresh("row", docs), F.monotonically_increasing_id())
    return grouped(named, row, text, id, digest).drop("row")


def grouped(docs: DataFrame, row: str, text: str, id: str, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """exact_groups() with the column `row`, which names rows."""
    normal = squeezed(F.col(text))
    keyed = docs.select(
        F.col(id).alias("doc_id"), digest(normal).alias("h"), normal.alias("normal"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"), F.col(row).alias("row"),
    )
    apart = F.lit("").alias("apart")
    sha = F.sha2("normal", 256).alias("text_sha256")
    rows = written(keyed.select("doc_id", "h", apart, "chars", sha, "row"), "exact-rows", narrow=True)
    shared = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h").coalesce(8))
    texts = keyed.select("h", "normal").join(small_side(shared), "h", "left_semi")
    clashes = cut(texts.groupBy("h").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi")).where("lo <> hi").select("h").coalesce(8))
    if not clashes.isEmpty():
        marked = keyed.join(clashes.withColumn("clash", F.lit(True)), "h", "left")
        own = F.when(F.col("clash"), F.col("normal")).otherwise("").alias("apart")
        rows = written(marked.select("doc_id", "h", own, "chars", sha, "row"), "exact-rows", narrow=True)
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = rows.groupBy("h", "apart").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["h", "apart"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "row",
    )


def without_exact_copies(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts, of wholly repeated rows
    too. Nulls, ties, repeats and empty tables are as in exact_groups(). Rows are told apart by their place in the
    table; only the places of those that go are joined to it."""
    rows = with_row(docs, row := fresh("row", docs))
    gone = cut(grouped(rows, row, text, id).where("not kept").select(F.col("row").alias(row)).coalesce(64))
    return rows.join(small_side(gone), row, "left_anti").select(*columns(docs))

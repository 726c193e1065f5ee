"""Mixing sources to target weights: a time-varying curriculum in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import columns, cut, fresh, prefix_sums, with_row, words_in, written

#: Rows of a range that a running total goes over in one task.
RANGE_ROWS = 20_000


def source_targets(
    sizes: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets by water-filling, from one row per source: (source, source_size) -> rank, weight, target.

    Sources rank by code point, null last, and take `weights` in turn. Together they get
    `share` of all sizes by weight; a target stops at `most` times the source's size and
    the excess is shared again by weight. The level of that fixed point is the largest of
    the levels that come from capping the first 0, 1, 2 ... sources in the order of cap
    per unit of weight, so two running sums give it without a loop. They go over ranges, so
    sources may be as many as hosts are.
    """
    sizes = cut(sizes.select("source", "source_size", F.lit(1).alias("one")))
    n = sizes.count()
    ranked = prefix_sums(sizes, [F.col("source").asc_nulls_last()], {"one": "place"}, RANGE_ROWS, n).withColumn("rank", F.col("place") + 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    capped = ranked.select("source", "source_size", "rank", F.get(turn, (F.col("rank") - 1) % len(weights)).alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    before = cut(prefix_sums(capped, [F.col("cap") / F.col("weight"), F.col("rank")], {"cap": "caps", "weight": "weights"}, RANGE_ROWS, n))
    total, weight = before.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(float(share)) * F.lit(total) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    highest = before.agg(F.max(level)).first()[0]
    return before.select(
        "source", "rank", "weight", "source_size", F.least(F.col("cap"), F.lit(highest or 0.0) * F.col("weight")).alias("target")
    )


def reached(share: Column, start: Column, end: Column) -> Column:
    """When a source whose rate goes linearly from start to end has given this share of its demand:
    the inverse of its integrated schedule, 0 to 1."""
    slope = end - start
    curved = (F.sqrt(start * start + slope * (start + end) * share) - start) / slope
    return F.when(slope == 0, share).otherwise(curved)


def planned(
    docs: DataFrame, row: str, text: str, id: str, source: str,
    weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    schedules: list[tuple[float, float]] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """For each row of docs, named by the column `row`, how often the mix takes it and from where in its source's stream."""
    rows = written(
        docs.select(
            F.col(id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))).alias("h"), F.col(row).alias("row"),
        ),
        "mix-rows",
        narrow=True,
    )
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).coalesce(1))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = [F.col("source").asc_nulls_last(), F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row")]
    placed = prefix_sums(rows, order, {"size": "before"}, range_rows, n)
    targets = source_targets(sizes, weights, share, most)
    firsts = prefix_sums(sizes, [F.col("source").asc_nulls_last()], {"source_size": "first"}, range_rows).select(F.col("source").alias("__f"), "first")
    targets = cut(targets.join(firsts, F.col("source").eqNullSafe(F.col("__f"))).drop("__f").withColumnRenamed("source", "__s").coalesce(1))
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("__s"))).withColumn("start", F.col("before") - F.col("first"))
    middle = F.col("start") + F.col("size") / F.lit(2.0)
    times = F.when(
        F.col("size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size"))).cast("long")
    ).otherwise(F.lit(0))
    starts = F.array(*[F.lit(float(a)) for a, _ in schedules])
    ends = F.array(*[F.lit(float(z)) for _, z in schedules])
    turn = (F.col("rank") - 1) % len(schedules)
    when = F.when(F.col("times") > 0, reached(F.col("start") / F.col("target"), F.get(starts, turn), F.get(ends, turn)))
    out = placed.withColumn("times", times).withColumn("first_position", when)
    return out.select(
        "row", "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"),
        "times", "first_position", "start", "h", F.get(starts, turn).alias("rate_start"), F.get(ends, turn).alias("rate_end"),
    )


def curriculum(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """One row per document: how many words the mix takes of it and when, range-sorted by first position.

    A source's documents stand in the order of md5(id), id and size: a stream of words that is read
    again from its start when it ends. A document is taken whole, once for each time that the
    middle of its words in that stream lies before the source's target: so a source's words come
    within half a document of its target, and no document is taken more than `most` times, rounded up.
    The k-th copy's position is the time at which the source's integrated rate schedule
    (`schedules`, in turn by rank) reaches the copy's start.

    Size is the number of words; null and empty texts have size 0 and are never taken. A null
    source is a source of its own, the last. Null ids come last in their source; repeated rows
    count as often as they stand there. An empty table gives an empty result. Other columns are not read.
    Running totals go over ranges of the whole order, of about range_rows rows each, and over the
    ranges' sums: no task holds a whole source or all rows of one id.
    """
    named = docs.withColumn(row := fresh("row", docs), F.monotonically_increasing_id())
    plan = planned(named, row, text, id, source, **how).drop("row")
    return plan.orderBy(F.col("first_position").asc_nulls_last(), "h")


def mixed(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The training stream: docs' columns, one row for each time that a row is taken, sorted by training position. What
    the mix doesn't take is not in it. Rows are told apart by their place in the table, so ids may repeat or be null;
    nulls, repeats and empty tables are as in curriculum(), and all columns come back, whatever their names."""
    rows = with_row(docs, row := fresh("row", docs))
    plan = planned(rows, row, text, id, source, **how).where("times > 0")
    pass_ = F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("pass")
    copies = plan.select("row", "h", "start", "source_size", "target", "rate_start", "rate_end", pass_)
    share = (F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target")
    at = F.struct(reached(share, F.col("rate_start"), F.col("rate_end")).alias("at"), "h", "pass", "row")
    copies = copies.select(F.col("row").alias(row), at.alias(order := fresh("order", rows)))
    return rows.join(copies, row).orderBy(order).select(*columns(docs))

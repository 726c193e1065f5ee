"""Counters, rates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import rules
from corpuscle.functions.text import comment_steps, computed, drop_reason, is_blank, word_count


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(n / total * 100, 2))


def cleaned(lines: DataFrame, text: str, least: int = rules.MIN_WORDS, most: int = rules.MAX_CHARS) -> DataFrame:
    """Adds `reason` (of dropping, null if kept), `clean` and the steps' changed_ flags. Blank lines are no samples. A line is
    charged to the first rule that it fails; the costly chain is run for lines that pass the cheap rules, so `clean` of
    the others is null."""
    own = computed(lines.where(~is_blank(F.col(text))), cheap=drop_reason(F.col(text), least))
    own = comment_steps(own.withColumn("passed", F.when(F.col("cheap").isNull(), F.col(text))), "passed", most)
    late = F.when(is_blank(F.col("clean")) | (word_count(F.col("clean")) < least), "empty")
    own = computed(own, reason=F.when(F.col("cheap").isNull(), late).otherwise(F.col("cheap")))
    flags = [F.coalesce(F.col(f"changed_{s}"), F.lit(False)).alias(f"changed_{s}") for s in rules.COMMENT_COUNTED]
    return own.select(*lines.columns, "reason", "clean", *flags)


def summary(rows: DataFrame) -> DataFrame:
    """One row: total_input, total_output, dropped_total, dropped_pct, dropped_<reason>, cleaned_<step>, cleaned_total
    (without truncation). Step counters include rows that are dropped after cleaning."""
    reasons = ("spam", "terminal_cmd", "too_short", "empty")
    counts = rows.agg(
        F.count(F.lit(1)).alias("total_input"), F.count_if(F.col("reason").isNull()).alias("total_output"),
        *[F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in reasons],
        *[F.count_if(f"changed_{s}").alias(f"cleaned_{s}") for s in rules.COMMENT_COUNTED],
    )
    dropped = sum((F.col(f"dropped_{r}") for r in reasons[1:]), F.col(f"dropped_{reasons[0]}"))
    steps = [s for s in rules.COMMENT_COUNTED if s != "truncate"]
    total = sum((F.col(f"cleaned_{s}") for s in steps[1:]), F.col(f"cleaned_{steps[0]}"))
    return counts.select("*", dropped.alias("dropped_total"), percent(dropped, F.col("total_input")).alias("dropped_pct"), total.alias("cleaned_total"))


def kept_by(df: DataFrame, group: str, kept: Column) -> DataFrame:
    """Per group and overall (`ALL`): total, kept, dropped, kept_pct."""
    counts = df.rollup(group).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"))
    name = F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    return counts.select(name.alias(group), "total", "kept", (F.col("total") - F.col("kept")).alias("dropped"), percent(F.col("kept"), F.col("total")).alias("kept_pct"))

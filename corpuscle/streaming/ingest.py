"""Incremental, deduplicated ingestion as Structured Streaming: the checkpoint is the resume cursor, the state store or
a keyed table the set of what was seen, and a micro-batch commits as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.sources.readers import table_or_none

Transform = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest(stream: DataFrame, text: str, out: str, checkpoint: str, clean: Transform | None = None) -> StreamingQuery:
    """Appends rows whose text is new, by its md5, to a table. The seen digests are the query's own state; it grows with
    the distinct texts, so it belongs in a state store that spills (RocksDB)."""
    rows = clean(stream) if clean else stream
    fresh = rows.withColumn("md5", F.md5(F.col(text))).dropDuplicates(["md5"])
    return fresh.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_within(stream: DataFrame, text: str, time: str, delay: str, out: str, checkpoint: str) -> StreamingQuery:
    """The same with bounded state: digests are forgotten `delay` after their event time."""
    fresh = stream.withColumn("md5", F.md5(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["md5"])
    return fresh.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_to_table(stream: DataFrame, text: str, out: str, checkpoint: str) -> StreamingQuery:
    """The same with the table itself as the set of what was seen, by an anti-join in each micro-batch: state of any
    size, shared by many queries and readable. Each batch is a partition of the table and overwritten as a whole, so a
    batch that is run again leaves the same rows."""

    def batch(rows: DataFrame, epoch: int) -> None:
        fresh = rows.withColumn("md5", F.md5(F.col(text))).dropDuplicates(["md5"])
        known = table_or_none(rows.sparkSession, out)
        if known is not None:
            fresh = fresh.join(known.where(F.col("batch") != epoch).select("md5"), "md5", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

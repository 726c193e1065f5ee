"""Sinks: text, JSON lines, CSV, logs, keyed state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.sources.readers import table_or_none


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below the one that spark.checkpoint.dir names. Only where that is unset
    and executors run on this machine it is a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it stays as it is, even where partitions are dealt anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.select(column).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, null fields written, letters as they are."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_frequencies(counts: DataFrame, path: str, name: str, mode: str = "error") -> None:
    """`name,frequency` with a header, most frequent first, range-sorted over as many files as the table needs."""
    counts.select(F.col(counts.columns[0]).alias(name), "frequency").orderBy(F.desc("frequency"), name).write.mode(mode).option("header", True).csv(path)


def write_log(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row summary as one pretty JSON object."""
    summary.select(F.to_json(F.struct(*summary.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode(mode).text(path)


def append_new(df: DataFrame, state_path: str, out_path: str, key: str) -> int:
    """Appends rows whose key the state doesn't have, then their keys; returns how many. The rows are written to the
    output first: a failure in between leaves rows whose keys come again, never keys without rows."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    known = table_or_none(spark, state_path)
    if known is not None:
        fresh = fresh.join(known.select(key), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(out_path)
        fresh.select(key).write.mode("append").parquet(state_path)
    fresh.unpersist()
    return n


def versions(spark: SparkSession, path: str) -> int:
    """The number of the last version of a keyed state, 0 if there is none."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return 0
    whole = [f.getPath() for f in files.listStatus(top) if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((int(p.getName().partition("=")[2]) for p in whole), default=0)


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """A keyed state as its last whole version has it."""
    n = versions(spark, path)
    return spark.read.parquet(f"{path}/version={n}") if n else None


def upsert(rows: DataFrame, path: str, key: str) -> None:
    """Inserts rows into a keyed state or replaces those of their keys, as a new version: a failure leaves the one before.
    Of rows with one key the greatest counts."""
    spark = rows.sparkSession
    other = [c for c in rows.columns if c != key]
    new = rows.groupBy(key).agg(F.max(F.struct(*other)).alias("__own")).select(key, "__own.*").select(*rows.columns)
    old = state(spark, path)
    whole = new if old is None else old.join(new.select(key), key, "left_anti").select(*rows.columns).unionByName(new)
    whole.write.mode("overwrite").parquet(f"{path}/version={versions(spark, path) + 1}")


def delete(keys: DataFrame, path: str, key: str) -> None:
    """Takes the rows with these keys out of a keyed state, as a new version."""
    spark = keys.sparkSession
    old = state(spark, path)
    if old is not None:
        old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns).write.mode("overwrite").parquet(f"{path}/version={versions(spark, path) + 1}")

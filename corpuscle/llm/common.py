"""What the training-data operators share: the shared scratch folder, lineage cuts and small column helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white space of the word and equality rules, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names. Only where that is unset and
    executors run on this machine, as in tests, a temporary folder is made and set; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpuscle-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, keeps columns prunable. The folder is
    deleted when the session ends. narrow: a few bytes of each row of a large table; Spark deals them into files by size,
    not one for each task."""
    path = scratch_path(df.sparkSession, name)
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    atexit.register(drop_path, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """A checkpoint in the shared folder, for narrow tables; Spark's cleaner removes its files with the DataFrame. narrow: few
    rows of many tasks; Spark deals them into files by size."""
    shared_dir(df.sparkSession)
    return (df.hint("rebalance") if narrow else df).checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through the cluster's own file system; nothing once the session is stopped."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(table: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more, and shuffle files with it."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        drop_path(table.sparkSession, folder)
    freed(table.sparkSession)


#: Rows of a narrow table (a few dozen bytes each) up to which a join's side is broadcast.
SMALL_ROWS = 500_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A narrow table for a join: broadcast if it has SMALL_ROWS rows at most, by its count; else as Spark sees fit."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL_ROWS else df


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a last column that names each row, the same whenever the plan is run: file and place for tables that
    come straight from Parquet files; others are written first."""
    if plain_scan(docs):
        return docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    own = docs.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")))
    return written(own, "rows")


def plain_scan(docs: DataFrame) -> bool:
    """Whether docs is nothing but a selection of rows and columns of Parquet files."""
    if "_metadata" in docs.columns:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    own = plan.relation()
    return own.getClass().getSimpleName() == "HadoopFsRelation" and own.fileFormat().toString() == "Parquet"


def named(docs: DataFrame, text: str, name: str, first: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs with a last column that names each text by 64 bits; null counts as empty. Equal texts have one name, and
    names are checked against 128-bit digests: texts that share one by chance get names of their own."""
    own = F.coalesce(F.col(text), F.lit(""))
    sums = docs.select(first(own).alias("h"), F.md5(own).alias("m")).groupBy("h").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    clashes = cut(sums.where("lo <> hi").select("h").coalesce(1))
    if clashes.isEmpty():
        return docs.withColumn(name, first(own))
    h, hit = fresh("h", docs), fresh("hit", docs)
    marked = docs.withColumn(h, first(own)).join(clashes.select(F.col("h").alias(h), F.lit(True).alias(hit)), h, "left")
    return marked.withColumn(name, F.when(F.col(hit), F.xxhash64(F.md5(own), F.lit(1))).otherwise(F.col(h))).select(*columns(docs), name)


def words_in(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`, without building them; null counts as empty."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]*+[^{SPACE}]++", "w")
    return F.length(F.regexp_replace(one_each, rf"[{SPACE}]+$", "")).cast("long")


def squeezed(text: Column) -> Column:
    """The text without any character of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession, rows: int, per_task: int, least: int = 1) -> int:
    """Tasks for so many rows; no upper cap."""
    return max(least, -(-rows // per_task))


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, str], per_task: int = 20_000, rows: int | None = None) -> DataFrame:
    """df with, for each of `values` (name of a numeric column -> name of a new one), the sum of that column over all rows
    before, by `order`, which should tell rows apart. Rows are dealt into ranges, each range runs on its own and adds the
    sums of the ranges before it: one value of the order may have any share of the rows, and no task holds more than
    about per_task rows."""
    n = partitions(df.sparkSession, df.count() if rows is None else rows, per_task)
    part = fresh("part", df)
    dealt = written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges", narrow=True)
    sums = dealt.groupBy(part).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{k}") for k, v in enumerate(values)])  # a row per range
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"own__{k}") for k, v in enumerate(values)])
    both = own.join(small_side(starts, n), part)
    return both.select(*columns(df), *[(F.col(f"own__{k}") + F.col(f"__{k}")).alias(name) for k, name in enumerate(values.values())])

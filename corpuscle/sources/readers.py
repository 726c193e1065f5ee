"""Sources: text lines, JSON lines, dictionaries, vocabularies, file names, crawl state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import is_blank, strip

BASE = "source string, domain string, raw_text string"
RICH = BASE + ", segmented_text string"


def text_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, strict: bool = False) -> DataFrame:
    """(value, file, line): lines that aren't blank. Bytes that aren't UTF-8 become U+FFFD; strict: they are an error,
    and lines are stripped. line orders a file's lines, without being their number."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    raw = reader.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    if strict:
        good = F.when(F.is_valid_utf8("value"), strip(F.col("value")))
        raw = raw.withColumn("value", F.coalesce(good, F.raise_error(F.concat(F.lit("not UTF-8: "), "file"))))
    else:
        raw = raw.withColumn("value", F.make_valid_utf8("value"))
    return raw.where(~is_blank(F.col("value")))


def json_text(line: Column, key: str = "text") -> Column:
    """The text under a key of a JSON line: empty if it is missing or null; the line itself if it isn't JSON."""
    parsed = F.try_parse_json(line)
    return F.when(parsed.isNull(), line).otherwise(F.coalesce(F.try_variant_get(parsed, f"$['{key}']", "string"), F.lit("")))


def json_updated(line: Column, key: str, value: Column) -> Column:
    """The JSON object with one key set, its other keys as they are."""
    own = F.from_json(line, "map<string,variant>")
    rest = F.map_filter(own, lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant"))))


def tolerant_json(spark: SparkSession, path: str, key: str | None = None, is_json: bool | None = None) -> DataFrame:
    """(value, text): lines of any file. They are JSON if a key is given or the name ends in .json or .jsonl."""
    lines = text_lines(spark, path)
    named = path.endswith((".jsonl", ".json"))
    own = named or key is not None if is_json is None else is_json
    text = json_text(F.col("value"), key or "text") if own else F.col("value")
    return lines.select("value", text.alias("text"))


def strict_json(spark: SparkSession, path: str | list[str], schema: str = BASE) -> DataFrame:
    """A malformed line fails the read; rows without raw_text are left out."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.where(F.coalesce("raw_text", F.lit("")) != "")


def permissive_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, segmented_text): malformed lines and blank texts are left out, texts stripped, sources `unknown`."""
    rows = spark.read.schema("source string, segmented_text string").option("mode", "DROPMALFORMED").json(path)
    own = rows.select(F.coalesce("source", F.lit("unknown")).alias("source"), strip(F.col("segmented_text")).alias("segmented_text"))
    return own.where(~is_blank(F.col("segmented_text")))


def news_labels(file: Column, prefix: str = "forum_") -> tuple[Column, Column]:
    """Source and domain from names like `site_topic.txt`."""
    # fixed value: the shape of the names
    shape = r"([a-zA-Z0-9]+)_([a-zA-Z0-9]+)\.txt$"
    known = file.rlike(shape)
    source = F.lower(F.concat(F.lit(prefix), F.regexp_extract(file, shape, 1)))
    return F.when(known, source).otherwise("news_unknown"), F.when(known, F.lower(F.regexp_extract(file, shape, 2))).otherwise("unknown")


def forum_labels(file: Column) -> tuple[Column, Column]:
    """Source and domain from names like `data_site_topic_normalized.txt`."""
    # fixed value: the shape of the names
    shape = r"^data_([^_]+)_([^_]+)_normalized\.txt$"
    known = file.rlike(shape)
    return (
        F.when(known, F.concat(F.lit("forum_"), F.regexp_extract(file, shape, 1))).otherwise("forum_unknown"),
        F.when(known, F.regexp_extract(file, shape, 2)).otherwise("unknown"),
    )


def slang_map(spark: SparkSession, path: str, key: str = "teencode_unigrams_meaningful") -> DataFrame:
    """(key, value, place) of one object of a JSON file; empty if it isn't there."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.get_json_object("value", f"$.{key}"), "map<string,string>")
    return whole.select(F.posexplode(F.map_entries(entries)).alias("place", "e")).select("e.key", "e.value", "place")


def dictionary(*lists: DataFrame) -> DataFrame:
    """The union of word lists (value): stripped, lower-cased, `_` as a space, no blanks, each word once."""
    out = None
    for own in lists:
        part = own.select(F.translate(F.lower(strip(F.col("value"))), "_", " ").alias("word")).where(F.col("word") != "")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, idx) from `{"word2idx": {...}}` or the bare object."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.from_json(F.get_json_object("value", "$.word2idx"), "map<string,int>")
    bare = F.from_json("value", "map<string,int>")
    return whole.select(F.explode(F.coalesce(inner, bare)).alias("word", "idx"))


def crawl_cursor(state: Column) -> tuple[Column, Column]:
    """Category and page of a state `i,p`."""
    parts = F.split(state, ",")
    return F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise

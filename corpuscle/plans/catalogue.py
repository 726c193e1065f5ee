"""The named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import bpe, html, rules, text, udfs
from corpuscle.operators import dedup, lexicon, lm, metrics, sequences, split, vocab
from corpuscle.sources import readers, sinks
from corpuscle.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, one row per line: (doc_id, source, lang, line_no from 0, line)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- SQL fragments -------------------------------------------------------------------------------

LINES = (
    "SELECT doc_id, source, lang, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line "
    "FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents)"
)


def sql_words(column: str) -> str:
    return rf"list_filter(string_split_regex({column}, '\s+'), lambda w: w <> '')"


def sql_count(column: str) -> str:
    return f"CAST(len({sql_words(column)}) AS BIGINT)"


def sql_strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replace(column: str, *pairs: tuple[str, str]) -> str:
    for pattern, replacement in pairs:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return column


def steps_sql(first: str, steps: list[str], source: str) -> str:
    """Nested selects: each step is an expression over column t of the one before."""
    out = f"SELECT *, {first} AS t FROM ({source})"
    for s in steps:
        out = f"SELECT * REPLACE ({s} AS t) FROM ({out})"
    return out


WEB_SQL = [sql_replace("t", (r"https?\s*:\s*/\s*/\s*\S+", " ")), sql_replace("t", (r"\S+@\S+\.\S+", " "))]
AFTER = (r"([,:;!?])([^\s\d\"”\)])".replace('\\"', '"'), r"\1 \2")
GAP = (r"([a-zà-ỹ])\.([A-ZÀ-Ỹ])", r"\1. \2")
NEWS_STEPS = [
    *WEB_SQL, sql_replace("t", (r"\.{3,}", "…")), sql_replace("t", (r"\s+([,.:;!?…])", r"\1")), sql_replace("t", AFTER, AFTER),
    sql_replace("t", GAP, GAP), sql_replace("t", (" +", " ")), sql_strip("t"),
    "CASE WHEN (length(t) - length(replace(t, '\"', ''))) % 2 = 1 THEN replace(t, '\"', '') ELSE t END", sql_strip("t"),
]
NEWS_SQL = steps_sql("nfc_normalize(translate(coalesce(text, ''), chr(160) || '“”', ' \"\"'))", NEWS_STEPS, "SELECT * FROM documents")
QUALITY_SQL = (
    f"{sql_count('t')} >= 15 AND length(t) - length("
    + sql_replace("t", (r"[^\p{L}\p{N}_\s.,!?;:\-\"'()/%…]".replace('\\"', '"'), ""))
    + ") <= length(t) * CAST(0.05 AS DOUBLE)"
)


def nfc_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = text.computed(docs, plain=text.plain_quotes(F.coalesce("text", F.lit(""))))
    nfc = plain.withColumn("nfc", udfs.nfc(F.col("plain")))
    return text.computed(nfc, clean=text.news_clean(F.col("nfc"))).drop("plain", "nfc")


# ---- cleaning, filters, dedup --------------------------------------------------------------------


@query(f"SELECT doc_id, t AS clean FROM ({NEWS_SQL})")
def news_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nfc_docs(spark, sf_dir).select("doc_id", "clean")


@query(f"""
SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE coalesce(source, 'unknown') END AS source, count(*) AS total, count(*) FILTER (q) AS kept,
       count(*) - count(*) FILTER (q) AS dropped, round(count(*) FILTER (q) / count(*) * 100, 2) AS kept_pct
FROM (SELECT source, {QUALITY_SQL} AS q FROM ({NEWS_SQL})) GROUP BY ROLLUP (source)""")
def news_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kept_by(nfc_docs(spark, sf_dir), "source", text.news_quality(F.col("clean")))


FIRST_SQL = f"SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS place FROM (SELECT * FROM ({NEWS_SQL}) WHERE {QUALITY_SQL})"


@query(f"SELECT doc_id, source, lang AS domain, md5(t) AS md5 FROM ({FIRST_SQL}) WHERE place = 1")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = nfc_docs(spark, sf_dir).where(text.news_quality(F.col("clean")))
    narrow = good.select("doc_id", "source", F.col("lang").alias("domain"), F.md5("clean").alias("md5"))
    return dedup.keep_first(narrow, "md5", ["doc_id"], digest=True)


@query(f"""
SELECT source, count(*) AS total, count(*) FILTER (place = 1) AS kept, count(*) FILTER (place > 1) AS dropped
FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS place FROM ({NEWS_SQL})) GROUP BY source""")
def dedup_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nfc_docs(spark, sf_dir).select("doc_id", "source", F.md5("clean").alias("md5"))
    total = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    kept = dedup.keep_first(docs, "md5", ["doc_id"], digest=True).groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("k"))
    both = total.join(kept, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("kept", F.coalesce("k", F.lit(0)))
    return both.select("source", "total", "kept", (F.col("total") - F.col("kept")).alias("dropped"))


# Fixed values, stated for the SQL on their own: patterns of spam and of terminal commands, code words, letters of tokens.
SPAM_PATTERNS = (
    r"byvn\.net/\S+", r"share cho m[aấ]y (th[iíy]m|b[aá]c|[aâ]nh em) con deal", r"(rút gọn|áp\s+dc|áp\s+được)\s+(full\s+)?mã\s+giảm",
    r"mã\s+giảm\s+giá.{0,30}(sale|giảm)\s*\d+[%k]", r"chuột\s+bạch\s+xem", r"quốc\s+hàng\s+của\s+vozer",
)
TERMINAL_PATTERNS = (
    r"(?i)^(sudo|apt|pkg|pip|npm|git|cd|ls|rm|mv|cp|chmod|chown|grep|awk|sed|curl|wget)\s", r"(?i)^(pkg upgrade|su|debugging|force-vp9|header-switch)$",
    r"^\$\s+\w+", r"^>>>\s+\w+", r"^#\s*!/\w+",
)
KEYS = "script html div doctype src href interface ethernet pppoe wlan ssid dhcp mikrotik hotspot default-name supplicant wpa2 ap-bridge".split()
LETTERS = "[a-zàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ0-9]+"
NOISE = r"<url>|https?://\S+|www\.\S+"
SPAM_SQL = " OR ".join(f"regexp_matches(line, {quoted('(?i)' + p)})" for p in SPAM_PATTERNS)
TERMINAL_SQL = " OR ".join(f"regexp_matches({sql_strip('line')}, {quoted(p)})" for p in TERMINAL_PATTERNS)
REASON_SQL = f"CASE WHEN {SPAM_SQL} THEN 'spam' WHEN {TERMINAL_SQL} THEN 'terminal_cmd' WHEN {sql_count('line')} < 15 THEN 'too_short' ELSE 'kept' END"


def both_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.explode(F.split("text", "\n")).alias("line"))
    return lines(spark, sf_dir).select(F.lit("documents").alias("origin"), "line").unionByName(talk)


@query(f"""
SELECT origin, {REASON_SQL} AS reason, count(*) AS n
FROM (SELECT 'documents' AS origin, line FROM ({LINES}) UNION ALL
      SELECT 'conversations', unnest(string_split(text, chr(10))) FROM conversations)
WHERE regexp_matches(line, '\\S') GROUP BY ALL""")
def drop_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = both_texts(spark, sf_dir).where(~text.is_blank(F.col("line")))
    reason = F.coalesce(text.drop_reason(F.col("line")), F.lit("kept"))
    return own.groupBy("origin", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


CUT_SQL = "greatest(" + ", ".join(f"CASE WHEN strpos(reverse(left(text, 5000)), {c}) > 0 THEN 5000 - strpos(reverse(left(text, 5000)), {c}) ELSE -1 END" for c in ("'.'", "'!'", "'?'", "chr(10)")) + ")"
CUT_AT_SQL = f"CASE WHEN length(text) > 5000 THEN {sql_strip(f'CASE WHEN {CUT_SQL} > 2500 THEN left(text, CAST({CUT_SQL} + 1 AS BIGINT)) ELSE left(text, 5000) END')} ELSE text END"
# The comment chain for RE2, which has neither look-behind nor back references: what stands before a word is put back, and
# repeats are spelt out for the characters that the tables hold.
W, NW = r"[\p{L}\p{N}_]", r"(^|[^\p{L}\p{N}_])"
MONTH = "(?i)\\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{1,2},?\\s+20\\d{2}\\b"
SINGLE = [(rf"{re.escape(c)}{{4,}}", c) for c in ".!?-_~"]
DOUBLE = [(rf"{re.escape(c)}{{4,}}", c.replace("\\", "\\\\") * 2) for c in string.ascii_letters + string.digits + " \t,;:'\"()[]{}<>/\\|@#$%^&*+=`" + "áàâäãåçéèêëíìîïñóòôöõúùûüßÁÀÂÄÉÈÊËÍÎÓÔÖÚÜ"]
COMMENT_SQL = {
    "signature": [(rf"(?i)\bvia\s+the{W}*voz{W}*\s+for\s+{W}+", ""), (rf"(?i)\bSent\s+from\s+.{{3,60}}\s+using\s+voz{W}+", ""), (rf"(?i)\bGửi\s+từ\s+.{{2,60}}\s+bằng\s+{W}+App\b", ""), (rf"(?i)\bvia\s+{W}+\s+for\s+(iPhone|Android|iPad)\b", "")],
    "facebook": [(r"(?i)Log\s+in\s+(to|or sign up to view)\s+Facebook.*", "")],
    "url": [(r"(?i)https?://\S+", "<URL>"), (rf"(?i){NW}(www\.\S+|vn\.shp\.ee/\S+|s\.lazada\.vn/\S+|bit\.ly/\S+|shopee\.vn/\S+)", r"\1<URL>")],
    "metadata": [(r"""(?i)Post\s+in\s+thread\s+['"].+?['"]""", ""), (rf"(?i)Replies:\s*\d+\s+Forum:\s*{W}+", ""), (MONTH, ""), (r"\b\d{1,2}/\d{1,2}/20\d{2}\b", "")],
    "repeat": SINGLE + DOUBLE,
    "emoticon": [(rf"(?i){NW}:v\b", r"\1"), (rf"{NW}:\)\s*$", r"\1"), (r"\){3,}", ""), (rf"{NW}=\)\s*$", r"\1"), (rf"{NW}>\.<", r"\1"), (rf"{NW}: {W}+:($|[^\p{{L}}\p{{N}}_])", r"\1\2")],
    "emoji": [(r"[\x{10000}-\x{10ffff}]|[☀-➿]|[⌀-⏿]|[■-◿]", "")],
    "punctuation": [(r"([!?])[!?]{2,}", r"\1"), (r"\.{4,}", ".")],
    "whitespace": [(r"[ \t]{2,}", " ")],
}


def comment_sql(source: str) -> str:
    """From (..., line): every sample with its reason, the texts after the steps as step_<name>, and clean."""
    out = f"SELECT *, {REASON_SQL} AS cheap FROM ({source}) WHERE regexp_matches(line, '\\S')"
    now = "line"
    for step, pairs in COMMENT_SQL.items():
        expression = sql_replace(now, *pairs)
        out = f"SELECT *, {sql_strip(expression) if step == 'whitespace' else expression} AS step_{step} FROM ({out})"
        now = f"step_{step}"
    out = f"SELECT *, {CUT_AT_SQL} AS clean FROM (SELECT *, {now} AS text FROM ({out}))"
    return f"SELECT *, CASE WHEN cheap <> 'kept' THEN cheap WHEN NOT regexp_matches(clean, '\\S') OR {sql_count('clean')} < 15 THEN 'empty' END AS reason FROM ({out})"


def counters_sql(source: str) -> str:
    names = [*COMMENT_SQL][:-1]
    texts = ["line", *(f"step_{n}" for n in names)]
    steps = [f"count(*) FILTER (cheap = 'kept' AND {a} <> {b}) AS cleaned_{n}" for n, a, b in zip(names, texts, texts[1:], strict=False)]
    steps.append("count(*) FILTER (cheap = 'kept' AND clean <> step_whitespace) AS cleaned_truncate")
    reasons = [f"count(*) FILTER (reason = '{r}') AS dropped_{r}" for r in ("spam", "terminal_cmd", "too_short", "empty")]
    total = " + ".join(f"cleaned_{n}" for n in names)
    counts = f"SELECT count(*) AS total_input, count(*) FILTER (reason IS NULL) AS total_output, {', '.join(reasons + steps)} FROM ({comment_sql(source)})"
    dropped = "dropped_spam + dropped_terminal_cmd + dropped_too_short + dropped_empty"
    return f"SELECT *, {dropped} AS dropped_total, round(({dropped}) / total_input * 100, 2) AS dropped_pct, {total} AS cleaned_total FROM ({counts})"


BOTH_SQL = f"SELECT line FROM ({LINES}) UNION ALL SELECT unnest(string_split(text, chr(10))) AS line FROM conversations"


@query(counters_sql(BOTH_SQL))
def clean_step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics.cleaned(both_texts(spark, sf_dir), "line"))


@query(f"SELECT doc_id, line_no, clean FROM ({comment_sql(LINES)}) WHERE reason IS NULL")
def comment_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.cleaned(lines(spark, sf_dir), "line").where("reason is null")
    return own.select("doc_id", "line_no", "clean")


@query(f"SELECT doc_id, CAST(length(text) AS INTEGER) AS before, CAST(length(t) AS INTEGER) AS after, md5(t) AS md5 FROM (SELECT doc_id, text, {CUT_AT_SQL} AS t FROM documents)")
def truncate_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", text.truncated(F.col("text")))
    return docs.select("doc_id", F.length("text").alias("before"), F.length("t").alias("after"), F.md5("t").alias("md5"))


KEYS_SQL = "[" + ", ".join(map(quoted, KEYS)) + "]"
MOST_SQL = "(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT unnest(w) AS x) WHERE length(x) > 1 GROUP BY x))"


@query(f"""
SELECT lang, count(*) AS total, count(*) FILTER (len(w) >= 4) AS long_enough, count(*) FILTER (len(list_intersect(w, {KEYS_SQL})) < 2) AS no_code,
       count(*) FILTER ({MOST_SQL} <= 5) AS no_repeats, count(*) FILTER (len(w) >= 4 AND len(list_intersect(w, {KEYS_SQL})) < 2 AND {MOST_SQL} <= 5) AS kept
FROM (SELECT lang, {sql_words('line')} AS w FROM ({LINES})) GROUP BY lang""")
def forum_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, line = lines(spark, sf_dir), F.col("line")
    return own.groupBy("lang").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(text.word_count(line) >= rules.MIN_FORUM_WORDS).alias("long_enough"),
        F.count_if(text.code_words(line) < 2).alias("no_code"), F.count_if(text.most_repeated(line) <= rules.MAX_WORD_REPEATS).alias("no_repeats"),
        F.count_if(text.forum_quality(line)).alias("kept"),
    )


MARKUP = r"[<>=\"/]+".replace('\\"', '"')


@query(f"SELECT page_id, CAST(len(list_intersect({sql_words(sql_replace('html', (MARKUP, ' ')))}, {KEYS_SQL})) AS INTEGER) AS code_words FROM pages")
def code_dump_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.code_words(F.regexp_replace("html", MARKUP, " ")).alias("code_words"))


@query(f"SELECT doc_id, CAST({MOST_SQL} AS INTEGER) AS most FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)")
def repeated_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.most_repeated(F.col("text")).alias("most"))


LINE_STEPS = [
    sql_replace("t", (r"https?://\S+|www\.\S+|ftp://\S+", "")), sql_replace("t", (r"(?i)\[hình ảnh\]|\[image\]|\[img\]", "")),
    sql_replace("t", (r">+\s*.*", "")), sql_replace("t", (r"-{2,}\s*$", "")),
    sql_replace("t", (r"=\)+|:\){2,}|:>+|;\)+|:D+|>\.<|T_T|:\|+|>_<|:v+|:\*+|<3+", "")),
    sql_replace("t", (r"\(\s*\)", "")), sql_replace("t", (r"\.{2,}", ".")), sql_strip(sql_replace("t", (" {2,}", " "))),
]


@query(f"SELECT doc_id, line_no, t AS clean FROM ({steps_sql('line', LINE_STEPS, LINES)}) WHERE length(t) >= 7")
def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).withColumn("clean", text.line_clean(F.col("line")))
    return own.where(F.length("clean") >= rules.MIN_LINE_CHARS).select("doc_id", "line_no", "clean")


TERMS = [
    (1, "144 hz và 1080 p"), (2, "i5 12400f"), (3, "i5 12400 ngon"), (4, "card rtx 3060 ti ngon"), (5, "card rtx 3060 ngon"), (6, "logitech g102"),
    (7, "razer  viper gtx-1660 super 16 gb 500 k"), (8, "r 5 - 5600x hd 7770"), (9, "rx 580 8 gb, 2 tb"),
]
ENTITY_SQL = sql_replace(
    "t", (r"\b(\d+)\s*(k|vnd|đ|nd|th|st|rd|gb|tb|hz|mhz|p|fps)\b", r"\1\2"), (r"\b(i|r)\s*(\d)\s*[-_]?\s*(\d{4,5})\s*([kxf]{0,2})\b", r"\1\2_\3\4"),
    (r"\b(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*(ti|xt|super)\b", r"\1_\2_\3"), (r"\b(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*\b", r"\1_\2"),
    (r"\b(logitech|corsair|fuhlen|mchose|vxe|razer|dareu)\s+([a-z0-9]+)\b", r"\1_\2"),
)


@query("SELECT id, " + ENTITY_SQL + " AS packed FROM (VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in TERMS) + ") v(id, t)")
def entity_packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark, TERMS, "id int, t string").select("id", text.entities(F.col("t")).alias("packed"))


def sql_words_apart(pattern: str, replacement: str) -> list[tuple[str, str]]:
    """A pattern between Unicode word bounds, spelt out and twice, as a bound that two neighbours share is used up."""
    whole = (rf"(^|[^\p{{L}}\p{{N}}_]){pattern}($|[^\p{{L}}\p{{N}}_])", replacement)
    return [whole, whole]


# The forum chain for RE2. Groups count from the bound before, which is the first.
FORUM_STEPS = [
    sql_replace("t", (r"(?is)\[QUOTE\].*?\[/QUOTE\]", " "), (r"(?i)Sent from (my )?[a-zA-Z0-9 ]+ using .*", " "), (r"(?i)Sent from .* via .*", " "),
                (r"(?i)via theNEXTvoz.*", " "), (r"(?i)Gửi từ .* bằng .*", " ")),
    "nfc_normalize(t)", *WEB_SQL, "lower(t)",
    sql_replace("t", *sql_words_apart(r"(\d+)\s*(k|vnd|đ|nd|th|st|rd|gb|tb|hz|mhz|p|fps)", r"\1\2\3\4")),
    sql_replace("t", (r"(^|[^-/\p{L}\p{N}_])(\d+)\s*[\"']".replace('\\"', '"'), r"\1\2inch ")),
    sql_replace("t", *sql_words_apart(r"(i|r)\s*(\d)\s*[-_]?\s*(\d{4,5})\s*([kxf]{0,2})", r"\1\2\3_\4\5\6")),
    sql_replace("t", *sql_words_apart(r"(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*(ti|xt|super)", r"\1\2_\3_\4\5")),
    sql_replace("t", (r"(^|[^\p{L}\p{N}_])(rtx|gtx|rx|hd|gt)\s*[-_]?\s*(\d{3,4})\s*[-_]?\s*\b", r"\1\2_\3")),
    sql_replace("t", *sql_words_apart(r"(logitech|corsair|fuhlen|mchose|vxe|razer|dareu)\s+([a-z0-9]+)", r"\1\2_\3\4")),
    sql_replace("t", (r"\.{3,}", "…")), sql_replace("t", (r"\s+([,.:;!?…])", r"\1")), sql_replace("t", AFTER, AFTER), sql_replace("t", (" +", " ")), sql_strip("t"),
]
FORUM_SQL = steps_sql("line", FORUM_STEPS, f"SELECT * FROM ({LINES}) WHERE regexp_matches(line, '\\S')")


@query(f"SELECT doc_id, line_no, t AS clean FROM (SELECT doc_id, line_no, t, {sql_words('t')} AS w FROM ({FORUM_SQL})) WHERE len(w) >= 4 AND len(list_intersect(w, {KEYS_SQL})) < 2 AND {MOST_SQL} <= 5")
def forum_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).where(~text.is_blank(F.col("line")))
    plain = text.computed(own.withColumn("plain", udfs.unescape(F.col("line"))), raw=text.rewrite(F.col("plain"), rules.FORUM_RAW))
    clean = text.computed(plain.withColumn("nfc", udfs.nfc(F.col("raw"))), clean=text.forum_clean(F.col("nfc")))
    return clean.where(text.forum_quality(F.col("clean"))).select("doc_id", "line_no", "clean")


@query(f"SELECT doc_id, t AS scrubbed FROM ({steps_sql('text', WEB_SQL, 'SELECT * FROM documents')}) WHERE t <> text")
def email_url_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("scrubbed", text.rewrite(F.col("text"), rules.FORUM_WEB))
    return docs.where(F.col("scrubbed") != F.col("text")).select("doc_id", "scrubbed")


SLANG = [("of the", "OFF"), ("of", "off-$1"), ("the", "a\\b"), ("and", "n"), ("n", "und"), ("by the", "beside the")]


def slang_sql() -> str:
    """RE2 has ASCII word bounds only, so bounds are spelt out. A bound that two neighbours share is used up by the first
    one, so each key is replaced twice."""
    out, bound = "nfc_normalize(text)", r"[^\p{L}\p{N}_]"
    for k, v in sorted(SLANG, key=lambda e: -len(e[0])):
        pair = (rf"(?i)(^|{bound}){k}($|{bound})", r"\1" + v.replace("\\", "\\\\") + r"\2")
        out = sql_replace(out, pair, pair)
    return out


@query(f"SELECT doc_id, {slang_sql()} AS translated FROM documents")
def slang_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.translate(table(spark, sf_dir, "documents"), "text", SLANG).select("doc_id", "translated")


@query()
def final_polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).where(~text.is_blank(F.col("line")))
    return own.select("doc_id", "line_no", udfs.final_polish(F.col("line")).alias("polished"))


@query()
def word_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the pairs of words that the benchmark has in two places or more as a dictionary of phrases."""
    counts = lexicon.pairs(table(spark, sf_dir, "benchmark"), ["item_id"], "text").where("pair is not null").groupBy("pair").count()
    phrases = [r.pair for r in counts.where("count > 1").orderBy("pair").collect()]  # a dictionary is a table for the driver
    own = lines(spark, sf_dir).where(~text.is_blank(F.col("line")))
    return own.select("doc_id", "line_no", udfs.each(udfs.term_segmenter(phrases))(F.col("line")).alias("segmented"))


#: Where the vocabulary of the BPE query lies; a parameter of the operator.
BPE_FILE = os.environ.get("CORPUSCLE_BPE", "/opt/tokenizers/byte_bpe_50k.json")


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to 128 of each document: the limit is the operator's, for sequences of a fixed length."""
    docs = table(spark, sf_dir, "documents").withColumn("ids", bpe.encode(F.col("text"), BPE_FILE, 128))
    return docs.select("doc_id", F.size("ids").alias("n"), joined("ids").alias("md5"))


# ---- tokens, lexicon, vocabulary -----------------------------------------------------------------

TOKENS = "list_filter(regexp_extract_all(" + sql_replace("lower({})", (NOISE, " ")) + f", {quoted(LETTERS)}), lambda k: NOT regexp_full_match(k, '[0-9]+'))"


def sql_tokens(column: str) -> str:
    return TOKENS.replace("{}", column)


@query(f"SELECT tok, count(*) AS frequency FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM documents) GROUP BY tok")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.token_rows(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return rows.groupBy("tok").agg(F.count(F.lit(1)).alias("frequency"))


PAIRS = "SELECT doc_id, k, t[k] AS tok, t[k + 1] AS next, t[k] || ' ' || t[k + 1] AS pair, t[k - 1] || ' ' || t[k] AS before FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, {} AS t FROM documents))".replace("{}", sql_tokens("text"))
PAIRS = PAIRS.replace("t[k - 1] || ' ' || t[k] AS before", "CASE WHEN k > 1 THEN t[k - 1] || ' ' || t[k] END AS before")


@query(f"SELECT pair, count(*) AS frequency FROM ({PAIRS}) WHERE pair IS NOT NULL GROUP BY pair ORDER BY frequency DESC, pair LIMIT 10")
def bigram_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.pairs(table(spark, sf_dir, "documents"), ["doc_id"], "text").where("pair is not null")
    return lexicon.top(rows.groupBy("pair").agg(F.count(F.lit(1)).alias("frequency")), "pair")


BENCH_PAIRS = "SELECT t[k] || ' ' || t[k + 1] AS word FROM (SELECT t, unnest(range(1, len(t))) AS k FROM (SELECT {} AS t FROM benchmark))".replace("{}", sql_tokens("text"))
LEXICON_SQL = f"SELECT unnest({sql_tokens('text')}) AS word FROM benchmark UNION SELECT word FROM ({BENCH_PAIRS})"


def benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words and word pairs."""
    rows = lexicon.pairs(table(spark, sf_dir, "benchmark"), ["item_id"], "text")
    return readers.dictionary(rows.select(F.col("tok").alias("value")), rows.where("pair is not null").select(F.col("pair").alias("value")))


OOV = f"""WITH lex AS ({LEXICON_SQL}), p AS ({PAIRS}),
f AS (SELECT p.*, a.word IS NOT NULL AS is_tok, b.word IS NOT NULL AS is_next, c.word IS NOT NULL AS is_pair, d.word IS NOT NULL AS is_before
      FROM p LEFT JOIN lex a ON tok = a.word LEFT JOIN lex b ON next = b.word LEFT JOIN lex c ON pair = c.word LEFT JOIN lex d ON before = d.word)"""


@query(f"{OOV} SELECT tok, count(*) AS frequency FROM f WHERE NOT is_tok AND NOT is_pair AND NOT is_before GROUP BY tok HAVING count(*) >= 10")
def oov_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.frequent(lexicon.unknown(table(spark, sf_dir, "documents"), ["doc_id"], "text", benchmark_lexicon(spark, sf_dir))[0], 10)


@query(f"{OOV} SELECT pair, count(*) AS frequency FROM f WHERE pair IS NOT NULL AND NOT is_pair AND NOT is_tok AND NOT is_next GROUP BY pair HAVING count(*) >= 2")
def oov_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two occurrences or more, as invented words rarely meet again; the operator's usual limit is five."""
    return lexicon.frequent(lexicon.unknown(table(spark, sf_dir, "documents"), ["doc_id"], "text", benchmark_lexicon(spark, sf_dir))[1], 2)


@query(f"{OOV} SELECT count(DISTINCT tok) FILTER (NOT is_tok AND NOT is_pair AND NOT is_before) AS unigrams, count(DISTINCT pair) FILTER (NOT is_pair AND NOT is_tok AND NOT is_next) AS bigrams FROM f")
def oov_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = lexicon.unknown(table(spark, sf_dir, "documents"), ["doc_id"], "text", benchmark_lexicon(spark, sf_dir))
    count = F.count(F.lit(1))
    return one.agg(count.alias("unigrams")).crossJoin(two.agg(count.alias("bigrams")))  # one row by one row


@query(f"{LEXICON_SQL} UNION SELECT DISTINCT lower(source) FROM documents WHERE source <> ''")
def lexicon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("value"))
    return readers.dictionary(benchmark_lexicon(spark, sf_dir).select(F.col("word").alias("value")), sources)


VOCAB_SQL = f"""SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<sos>', 2, 0), ('<eos>', 3, 0)) v(word, idx, n) UNION ALL
SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER), n FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 3) QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 29996"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.build(table(spark, sf_dir, "documents"), "text")


@query(VOCAB_SQL)
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir)


ENCODED_SQL = f"""WITH voc AS ({VOCAB_SQL}),
e AS (SELECT doc_id, CAST([2] AS INTEGER[]) || coalesce(list(coalesce(idx, 1) ORDER BY k) FILTER (k IS NOT NULL), CAST([] AS INTEGER[])) || CAST([3] AS INTEGER[]) AS ids
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)) LEFT JOIN voc USING (word) GROUP BY doc_id)"""


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text", vocabulary(spark, sf_dir))


def listed(ids: str | Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def joined(ids: str | Column) -> Column:
    return F.md5(listed(ids))


@query(f"{ENCODED_SQL} SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS md5 FROM e")
def vocab_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("doc_id", F.size("ids").alias("n"), joined("ids").alias("md5"))


@query(f"""{ENCODED_SQL} SELECT doc_id, md5(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT list_contains([0, 2, 3], idx)), '')) AS md5
FROM (SELECT doc_id, unnest(ids) AS idx, unnest(range(len(ids))) AS k FROM e) LEFT JOIN voc USING (idx) GROUP BY doc_id""")
def vocab_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = vocab.decode(encoded(spark, sf_dir), ["doc_id"], "ids", vocabulary(spark, sf_dir))
    return back.select("doc_id", F.md5("text").alias("md5"))


@query(f"{ENCODED_SQL} SELECT doc_id, CAST(len(ids) - 32 AS BIGINT) AS windows, CAST(list_sum(ids[1:len(ids) - 32]) AS BIGINT) AS first_x, CAST(list_sum(ids[33:len(ids)]) AS BIGINT) AS last_y FROM e WHERE len(ids) > 32")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.sliding(encoded(spark, sf_dir), ["doc_id"], "ids")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.element_at("x", 1)).alias("first_x"), F.sum(F.element_at("y", -1)).alias("last_y")
    )


@query(f"""{ENCODED_SQL}, b AS (SELECT batch, flatten(list(ids ORDER BY doc_id)) AS a FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch FROM e) GROUP BY batch)
SELECT CAST(batch AS BIGINT) AS batch, CAST(block AS INTEGER) AS block, md5(array_to_string(a[block * 128 + 1:block * 128 + 128], ',')) AS md5 FROM (SELECT batch, a, unnest(range(len(a) // 128)) AS block FROM b)""")
def block_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.blocks(encoded(spark, sf_dir), "doc_id", "ids")
    return rows.select("batch", "block", joined("input_ids").alias("md5"))


@query(f"{ENCODED_SQL} SELECT doc_id, array_to_string(ids[greatest(len(ids) - 31, 1):len(ids)], ',') AS last_ids, md5(array_to_string((ids || [0 FOR z IN range(128)])[1:128], ',')) AS padded FROM e")
def padded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    return encoded(spark, sf_dir).select("doc_id", listed(sequences.last(ids)).alias("last_ids"), joined(sequences.padded(ids, 128)).alias("padded"))


# ---- splits and samples --------------------------------------------------------------------------

RANKED = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents"
SPLIT_SQL = f"SELECT doc_id, source, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ({RANKED})"


@query(SPLIT_SQL)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.by_source(table(spark, sf_dir, "documents"), "doc_id", "source").select("doc_id", "source", "split")


@query(f"""SELECT doc_id, source, CASE WHEN n < 3 THEN 'train' WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) + ceil((n - floor(n * CAST(0.8 AS DOUBLE))) / 2) THEN 'val' ELSE 'test' END AS split FROM ({RANKED})""")
def halved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.halved(table(spark, sf_dir, "documents"), "doc_id", "source").select("doc_id", "source", "split")


@query(f"SELECT source, split, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY ALL")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sizes(split.by_source(table(spark, sf_dir, "documents"), "doc_id", "source"), "source")


@query("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample(table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id")


@query("SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source NULLS LAST) - 1 AS INTEGER) AS label FROM documents")
def class_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.class_index(table(spark, sf_dir, "documents"), "source").select("doc_id", "source", "label")


# ---- language model and evaluation ---------------------------------------------------------------

GROUP = "CASE WHEN grouping(source) = 1 AND grouping(lang) = 1 THEN 'OVERALL' WHEN grouping(lang) = 1 THEN 'Source: ' || source ELSE 'Domain: ' || lang END"


@query(f"SELECT {GROUP} AS \"group\", count(*) AS docs, CAST(sum({sql_count('text')}) AS BIGINT) AS words FROM documents GROUP BY GROUPING SETS ((), (source), (lang))")
def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("w", text.word_count(F.col("text")))
    grouped = docs.groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"))
    name = F.when(F.col("gid") == 3, "OVERALL").when(F.col("gid") == 1, F.concat(F.lit("Source: "), "source")).otherwise(F.concat(F.lit("Domain: "), "lang"))
    return grouped.select(name.alias("group"), "docs", "words")


STEPS_SQL = f"SELECT doc_id, source, lang, split, CAST(k + 1 AS INTEGER) AS pos, CASE WHEN k = 0 THEN '<sos>' ELSE w[k] END AS prev, CASE WHEN k = len(w) THEN '<eos>' ELSE w[k + 1] END AS label FROM (SELECT *, unnest(range(len(w) + 1)) AS k FROM (SELECT d.doc_id, d.source, d.lang, s.split, {sql_words('d.text')} AS w FROM documents d JOIN ({SPLIT_SQL}) s USING (doc_id)))"
SCORED_SQL = f"""WITH st AS ({STEPS_SQL}), c AS (SELECT prev, label, count(*) AS n FROM st WHERE split = 'train' GROUP BY ALL),
u AS (SELECT label, sum(n) AS n_label FROM c GROUP BY label), x AS (SELECT prev, sum(n) AS n_prev FROM c GROUP BY prev),
z AS (SELECT CAST(sum(n_label) + count(*) + 1 AS DOUBLE) AS total FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, label) AS rank FROM c),
sc AS (SELECT st.*, (coalesce(n_label, 0) + 1) / z.total AS p1, CASE WHEN n_prev IS NULL THEN (coalesce(n_label, 0) + 1) / z.total ELSE coalesce(c.n, 0) / CAST(n_prev AS DOUBLE) END AS p2, CASE WHEN r.rank <= 10 THEN r.rank END AS rank
       FROM st CROSS JOIN z LEFT JOIN c USING (prev, label) LEFT JOIN u USING (label) LEFT JOIN x USING (prev) LEFT JOIN r USING (prev, label) WHERE split = 'test')"""


def lm_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = split.by_source(table(spark, sf_dir, "documents"), "doc_id", "source")
    counts = lm.bigrams(docs.where("split = 'train'"), "text")
    return lm.scores(docs.where("split = 'test'"), ["doc_id", "source", "lang"], "text", counts), counts


@query(f"""{SCORED_SQL} SELECT {GROUP} AS "group", count(*) AS tokens, round(sum(-ln(0.7 * p2 + (1 - CAST(0.7 AS DOUBLE)) * p1)) / count(*), 4) AS cce, round(exp(least(sum(-ln(0.7 * p2 + (1 - CAST(0.7 AS DOUBLE)) * p1)) / count(*), 100)), 2) AS ppl,
round(count(*) FILTER (rank <= 1) / count(*) * 100, 2) AS top1, round(count(*) FILTER (rank <= 5) / count(*) * 100, 2) AS top5, round(count(*) FILTER (rank <= 10) / count(*) * 100, 2) AS top10
FROM sc GROUP BY GROUPING SETS ((), (source), (lang))""")
def ppl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(lm_parts(spark, sf_dir)[0], "source", "lang")


BATCH_SQL = f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM ({SPLIT_SQL}) WHERE split = 'test'"


@query(f"""{SCORED_SQL}, m AS (SELECT batch, avg(-ln(0.7 * p2 + (1 - CAST(0.7 AS DOUBLE)) * p1)) AS loss FROM sc JOIN ({BATCH_SQL}) USING (doc_id) GROUP BY batch)
SELECT count(*) AS batches, round(avg(loss), 4) AS loss, round(exp(least(avg(loss), 100)), 2) AS ppl FROM m""")
def validation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over batches of 16 texts, as a training loop reports it; texts in the order of their ids."""
    scored, _ = lm_parts(spark, sf_dir)
    docs = split.by_source(table(spark, sf_dir, "documents"), "doc_id", "source").where("split = 'test'").select("doc_id")
    batches = sequences.ranks(docs, "doc_id").select("doc_id", F.floor((F.col("rank") - 1) / 16).alias("batch"))
    return lm.batch_loss(scored.join(batches, "doc_id"), "batch")


@query(f"{ENCODED_SQL} SELECT doc_id, CAST(least(len(ids), 128) - 1 AS INTEGER) AS valid, CAST(list_sum(ids[2:128]) AS BIGINT) AS total FROM e")
def padding_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of sequences cut or filled up to 128: how many count, and their sum."""
    labels = sequences.masked(sequences.padded(F.col("ids"), 128))
    rows = encoded(spark, sf_dir).select("doc_id", F.filter(labels, lambda x: x.isNotNull()).alias("own"))
    return rows.select("doc_id", F.size("own").alias("valid"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"{SCORED_SQL} SELECT prev, label, n, rank FROM r WHERE rank <= 3")
def topk_next_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.ranked(lm_parts(spark, sf_dir)[1], 3)


@query(f"{ENCODED_SQL} SELECT doc_id, CAST(k AS INTEGER) AS position, array_to_string(ids[greatest(k - 15, 1):k], ',') AS before, ids[k + 1] AS label FROM (SELECT doc_id, ids, unnest(range(1, len(ids))) AS k FROM e)")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 indices before every predicted position."""
    ids = encoded(spark, sf_dir).where(F.size("ids") > 1)
    rows = ids.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("position"))
    window = sequences.context(F.col("ids"), F.col("position"))
    return rows.select("doc_id", "position", listed(window).alias("before"), F.element_at("ids", F.col("position") + 1).alias("label"))


@query(f"""{SCORED_SQL}, g AS (SELECT prev, list(label ORDER BY k) [1:3] AS words FROM (SELECT prev, label, row_number() OVER (PARTITION BY prev ORDER BY n DESC, label) AS k FROM c WHERE label NOT IN ('<eos>', '<unk>')) WHERE k <= 3 GROUP BY prev)
SELECT doc_id, pos, sc.prev, label, words FROM sc LEFT JOIN (SELECT prev, array_to_string(list_transform(words, lambda w: replace(w, '_', ' ')), '|') AS words FROM g) USING (prev) WHERE coalesce(rank, 0) <> 1 AND label NOT IN ({", ".join(quoted(w) for w in (*rules.ORPHANS, "<eos>"))})""")
def mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, counts = lm_parts(spark, sf_dir)
    return lm.mismatches(scored, counts, (*rules.ORPHANS, "<eos>")).select("doc_id", "pos", "prev", "label", F.array_join("words", "|").alias("words"))


@query()
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark, sf_dir)
    counts = lm.bigrams(table(spark, sf_dir, "documents"), "text")
    prompts = literal_rows(spark, [(1, "The of"), (2, "the"), (3, "la de"), (4, "der und")], "id int, t string")
    ids = vocab.encode(prompts.withColumn("t", F.lower("t")), ["id"], "t", words, marks=False)
    model = lm.index_model(counts, words)
    one = lm.beam_search(ids, "id", "ids", model).withColumnRenamed("ids", "by_step")
    two = lm.beam_search(ids, "id", "ids", model, step_penalty=False).withColumnRenamed("ids", "by_rank")
    three = lm.beam_search(ids, "id", "ids", model, step_penalty=False, no_repeat=2).withColumnRenamed("ids", "no_pair_twice")
    return one.join(two, "id").join(three, "id")


@query()
def short_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = literal_rows(spark, [("the",), ("la",), ("der",)], "prev string")
    return lm.short_completions(lm.bigrams(table(spark, sf_dir, "documents"), "text"), starts)


# ---- pages, links, crawl state -------------------------------------------------------------------


def site_pages(spark: SparkSession, sf_dir: str, body: str, author: str) -> DataFrame:
    """documents as articles: a line a paragraph, every fifth in a caption, every seventh set right, every eleventh under an
    author's class, every third a div; the first two lines stand as title and summary before the body, too."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def paragraph(line: Column, at: Column) -> Column:
        k = at + 1
        around = lambda tag, end: F.concat(F.lit(tag), safe(line), F.lit(end))
        return (
            F.when(k % 5 == 0, around("<figcaption><p>", "</p></figcaption>")).when(k % 7 == 0, around('<p style="Text-Align: x; text-align: right;">', "</p>"))
            .when(k % 11 == 0, around(f'<p class="{author}">', "</p>")).when(k % 3 == 0, around("<div><b>", "</b></div>")).otherwise(around("<p>", "</p>"))
        )

    own = F.split("text", "\n")
    head = F.concat(F.lit('<h1 data-slot="title">'), safe(F.get(own, F.lit(0))), F.lit('</h1><h2 data-slot="sapo">'), safe(F.coalesce(F.get(own, F.lit(1)), F.lit(""))), F.lit("</h2>"))
    page = F.concat(F.lit("<html><body>"), head, F.lit(body), F.array_join(F.transform(own, paragraph), ""), F.lit("</article></div></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("html"))


SITE_BODIES = {"vnexpress": '<div><article class="fck_detail x">', "dantri": '<div class="singular-content"><article>', "thanhnien": '<div class="detail-cmain"><article>'}


def site_sql(site: str, kept: str, least: int, extra: str = "") -> str:
    text_ = "trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ')"
    own = f"SELECT doc_id, line_no + 2 AS place, {text_} AS t FROM ({LINES}) WHERE (line_no + 1) % 5 <> 0 AND (line_no + 1) % 7 <> 0 AND {kept}{extra}"
    return f"SELECT '{site}' AS site, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INTEGER) AS idx, md5(t) AS md5 FROM ({own}) WHERE length(t) > {least}"


NOT_DIV = "((line_no + 1) % 3 <> 0 OR (line_no + 1) % 11 = 0)"
HEAD_SQL = f" UNION ALL SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') FROM ({LINES}) WHERE line_no < 2"


@query(
    site_sql("vnexpress", "true", 50) + " UNION ALL " + site_sql("thanhnien", NOT_DIV, 40) + " UNION ALL "
    + site_sql("dantri", f"{NOT_DIV} AND (line_no + 1) % 11 <> 0", 40, HEAD_SQL).replace("WHERE length(t) > 40", "WHERE length(t) > 40 AND first = 1").replace("FROM (SELECT doc_id, line_no + 2", "FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY place) AS first FROM (SELECT doc_id, line_no + 2").replace("line_no < 2)", "line_no < 2))")
)
def site_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of the same articles as three sites' profiles find them: body and head, what is cut out, what is
    passed over, least length, and numbers from 1."""
    out = None
    for site, body in SITE_BODIES.items():
        found = html.paragraphs(site_pages(spark, sf_dir, body, "name author-name"), site, id="doc_id")
        own = found.select(F.lit(site).alias("site"), "doc_id", "idx", F.md5("text").alias("md5"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS idx, md5(t) AS md5 FROM (SELECT doc_id, line_no, {sql_strip('line')} AS t FROM ({LINES})) WHERE length(t) > 25")
def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as threads, a line a comment under a quoted one, and the texts of the forum's profile."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = lambda line: F.concat(F.lit('<div class="bbWrapper"><blockquote>quoted <p>text</p></blockquote>'), safe(line), F.lit("</div>"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), block), "<hr>").alias("html"))
    return html.paragraphs(pages, "forum", id="doc_id").select("doc_id", "idx", F.md5("text").alias("md5"))


@query()
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.paragraphs(table(spark, sf_dir, "pages"), "plain")


@query(r"""SELECT page_id, list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) IS NOT NULL AS has_links,
CAST(len(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href="([^"]*)"', 1))) AS INTEGER) AS n FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.hrefs(F.col("html")).isNotNull().alias("has_links"), F.size(html.hrefs(F.col("html"))).alias("n"))


URL_SQL = "regexp_replace(url, '(?s)[?#].*', '')"


@query(f"SELECT page_id, {URL_SQL} AS url, {URL_SQL} LIKE '%.html' AS is_html, regexp_matches({URL_SQL}, '/video/|/podcast/|/interactive/|/infographics/') AS banned FROM pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = text.url_without_query(F.col("url"))
    banned = url.rlike("|".join(html.SITES["vnexpress"].banned))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), url.endswith(".html").alias("is_html"), banned.alias("banned"))


@query(f"SELECT DISTINCT {URL_SQL} AS url FROM pages WHERE {URL_SQL} NOT IN (SELECT {URL_SQL} FROM pages WHERE page_id % 3 = 0)")
def frontier_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that weren't visited, a third of the pages being so."""
    pages = table(spark, sf_dir, "pages").withColumn("url", text.url_without_query(F.col("url")))
    return dedup.unseen(pages.select("url"), pages.where("page_id % 3 = 0"), "url")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY md5(text)")
def cross_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids as a second run after those with even ids."""
    docs = dedup.with_md5(table(spark, sf_dir, "documents"), "text")
    new = docs.where("doc_id % 2 = 1").join(docs.where("doc_id % 2 = 0").select("md5"), "md5", "left_anti")
    return dedup.keep_first(new, "text", ["doc_id"]).select("doc_id", "md5")


@query("SELECT page_id, contains(html, 'Just a moment...') OR contains(html, 'Checking your browser') AS wall FROM pages")
def bot_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.is_bot_wall(F.col("html")).alias("wall"))


@query("SELECT doc_id, line_no, md5(line) AS md5 FROM (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM (" + LINES + ")) WHERE length(line) > 50 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) = 1")
def paragraph_dedup_in_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).withColumn("line", text.strip(text.rewrite(F.col("line"), rules.PARAGRAPH)))
    long_ = own.where(F.length("line") > rules.PARAGRAPH_CHARS["vnexpress.net"])
    return dedup.keep_first(long_, "line", ["line_no"], ["doc_id"]).select("doc_id", "line_no", F.md5("line").alias("md5"))


PAGES = [(1, "https://a.net/x", 1), (2, "https://a.net/x", 2), (3, "https://b.vn/y", 7)]


@query("""SELECT id, CASE WHEN n <= 1 THEN base ELSE base || '-p' || n END AS one, CASE WHEN n <= 1 THEN base ELSE base || '/trang-' || n || '.htm' END AS two,
CASE WHEN n <= 1 THEN base ELSE base || '/page-' || n || '?prefix_id=9' END AS three FROM (VALUES (1, 'https://a.net/x', 1), (2, 'https://a.net/x', 2), (3, 'https://b.vn/y', 7)) v(id, base, n)""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, PAGES, "id int, base string, n int")
    made = {k: html.page_url(p, F.col("base"), F.col("n")) for k, p in (("one", "-p{n}"), ("two", "/trang-{n}.htm"), ("three", "/page-{n}?prefix_id=9"))}
    return rows.select("id", *[c.alias(k) for k, c in made.items()])


# ---- sources, records, relational ----------------------------------------------------------------

RAW_LINES = [(1, '{"text": "a b", "x": {"y": 1}}'), (2, '{"x": 1}'), (3, '{"text": null}'), (4, "not json"), (5, '{"text": "é ỹ"}'), (6, '{"broken": ')]


@query("SELECT id, CASE WHEN NOT json_valid(v) THEN v ELSE coalesce(json_extract_string(v, '$.text'), '') END AS text FROM (VALUES " + ", ".join(f"({i}, {quoted(v)})" for i, v in RAW_LINES) + ") r(id, v)")
def json_tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, RAW_LINES, "id int, v string")
    return rows.select("id", readers.json_text(F.col("v")).alias("text"))


@query("SELECT event_id, CASE WHEN NOT json_valid(props) THEN props ELSE coalesce(json_extract_string(props, '$.text'), '') END AS text, json_valid(props) AS valid FROM events")
def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", readers.json_text(F.col("props")).alias("text"), F.try_parse_json("props").isNotNull().alias("valid"))


NAMES = [(1, "data_voz_tech_normalized.txt"), (2, "thanhnien_edu.txt"), (3, "other.csv"), (4, "data_a_b.txt"), (5, "X_Y.txt")]


@query(r"""SELECT id, CASE WHEN regexp_matches(f, '([a-zA-Z0-9]+)_([a-zA-Z0-9]+)\.txt$') THEN lower('forum_' || regexp_extract(f, '([a-zA-Z0-9]+)_([a-zA-Z0-9]+)\.txt$', 1)) ELSE 'news_unknown' END AS news_source,
CASE WHEN regexp_matches(f, '([a-zA-Z0-9]+)_([a-zA-Z0-9]+)\.txt$') THEN lower(regexp_extract(f, '([a-zA-Z0-9]+)_([a-zA-Z0-9]+)\.txt$', 2)) ELSE 'unknown' END AS news_domain,
CASE WHEN regexp_matches(f, '^data_([^_]+)_([^_]+)_normalized\.txt$') THEN 'forum_' || regexp_extract(f, '^data_([^_]+)_([^_]+)_normalized\.txt$', 1) ELSE 'forum_unknown' END AS forum_source,
CASE WHEN regexp_matches(f, '^data_([^_]+)_([^_]+)_normalized\.txt$') THEN regexp_extract(f, '^data_([^_]+)_([^_]+)_normalized\.txt$', 2) ELSE 'unknown' END AS forum_domain
FROM (VALUES """ + ", ".join(f"({i}, {quoted(v)})" for i, v in NAMES) + ") r(id, f)")
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal_rows(spark, NAMES, "id int, f string")
    (a, b), (c, d) = readers.news_labels(F.col("f")), readers.forum_labels(F.col("f"))
    return rows.select("id", a.alias("news_source"), b.alias("news_domain"), c.alias("forum_source"), d.alias("forum_domain"))


@query("SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE coalesce(source, 'unknown') END AS source, count(*) AS total, count(*) FILTER (n_chars > 500) AS kept, count(*) - count(*) FILTER (n_chars > 500) AS dropped, round(count(*) FILTER (n_chars > 500) / count(*) * 100, 2) AS kept_pct FROM documents GROUP BY ROLLUP (source)")
def source_rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kept_by(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 500)


@query("SELECT g AS \"group\", count(*) AS n FROM (SELECT unnest(['OVERALL', source, lang]) AS g FROM documents) GROUP BY g")
def group_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array(F.lit("OVERALL"), "source", "lang")).alias("group"))
    return docs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT md5(text) AS md5 FROM documents GROUP BY md5(text)")
def stream_dedup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a stream of files, deduplicated into a table of the cluster's shared folder."""
    folder = sinks.shared_folder(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = ingest.file_stream(spark, f"{sf_dir}/documents.parque*", schema)
    running = ingest.ingest(stream, "text", f"{folder}/out", f"{folder}/checkpoint")
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("md5")


# ---- files written and read back -----------------------------------------------------------------


@query(f"SELECT lang, count(*) AS n, count(DISTINCT md5(line)) AS texts, CAST(sum(length(line)) AS BIGINT) AS chars FROM ({LINES}) WHERE regexp_matches(line, '\\S') AND lang IN ('en', 'de') GROUP BY lang")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as text files, a folder for each language; two of them are read back by name."""
    folder = sinks.shared_folder(spark, "text")
    lines(spark, sf_dir).select("lang", F.col("line").alias("value")).write.partitionBy("lang").text(folder)
    found = None
    for lang in ("en", "de"):
        own = readers.text_lines(spark, f"{folder}/lang={lang}", glob="part-*.txt").select(F.lit(lang).alias("lang"), "value")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("value")).alias("texts"), F.sum(F.length("value")).alias("chars"))


@query(f"SELECT doc_id, line_no, md5({sql_strip('line')}) AS md5 FROM ({LINES}) WHERE regexp_matches(line, '\\S')")
def strict_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their place before them, read back as strict UTF-8 and stripped."""
    folder = sinks.shared_folder(spark, "strict")
    own = lines(spark, sf_dir).where(~text.is_blank(F.col("line")))
    sinks.write_text(own.select(F.concat_ws("|", "doc_id", "line_no", text.strip(F.col("line")), F.lit(" ")).alias("value")), "value", folder)
    back = readers.text_lines(spark, folder, strict=True)
    part = lambda k: F.split("value", r"\|", 3)[k]
    return back.select(part(0).cast("long").alias("doc_id"), part(1).cast("int").alias("line_no"), F.md5(F.regexp_replace(part(2), r"\|$", "")).alias("md5"))


@query("SELECT doc_id % 3 AS third, source, lang AS domain, count(*) AS n, min(md5(text)) AS texts FROM documents WHERE text <> '' GROUP BY ALL")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base records as JSON lines, three batches of files; read back strictly, batches told apart by their folder."""
    folder = sinks.shared_folder(spark, "json")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id") % 3, "source", F.col("lang").alias("domain"), F.col("text").alias("raw_text")).toDF("third", "source", "domain", "raw_text")
    for k in range(3):
        sinks.write_json(docs.where(F.col("third") == k).drop("third"), f"{folder}/batch={k}")
    back = readers.strict_json(spark, [f"{folder}/batch={k}" for k in range(3)]).withColumn("third", F.regexp_extract("_metadata.file_path", r"batch=(\d)", 1).cast("long"))
    return back.groupBy("third", "source", "domain").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("raw_text")).alias("texts"))


@query(f"SELECT coalesce(source, 'unknown') AS source, count(*) AS n, min(md5({sql_strip('text')})) AS texts FROM documents WHERE regexp_matches(text, '\\S') GROUP BY ALL")
def loose_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich records among broken and blank lines, read back with the broken ones left out."""
    folder = sinks.shared_folder(spark, "loose")
    rich = table(spark, sf_dir, "documents").select("source", F.concat(F.lit(" "), "text", F.lit(" \n")).alias("segmented_text"))
    broken = F.when(F.rand(4) < 0.2, F.lit('{"source": "x", "segmented_text": ')).otherwise(F.lit('{"source": "x", "segmented_text": "  "}'))
    rows = rich.select(F.to_json(F.struct("source", "segmented_text")).alias("value")).unionByName(rich.select(broken.alias("value")))
    sinks.write_text(rows, "value", folder)
    back = readers.permissive_json(spark, folder)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("segmented_text")).alias("texts"))


@query(f"SELECT tok AS unigram, count(*) AS frequency FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM documents) GROUP BY tok HAVING count(*) >= 10")
def frequency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent tokens as a CSV file with a header, and back."""
    folder = sinks.shared_folder(spark, "csv")
    sinks.write_frequencies(lexicon.frequent(token_counts(spark, sf_dir), 10), folder, "unigram")
    return spark.read.option("header", True).schema("unigram string, frequency long").csv(folder)


@query(f"SELECT word, idx FROM ({VOCAB_SQL}) WHERE idx < 4000")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's first indices as one JSON object, and back."""
    folder = sinks.shared_folder(spark, "vocab")
    best = vocabulary(spark, sf_dir).where("idx < 4000")  # one object, so of a size for one task
    whole = best.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("word", "idx"))).alias("word2idx"))).alias("value"))
    sinks.write_text(whole, "value", folder)
    return readers.vocabulary_json(spark, folder)


@query("SELECT key, value, CAST(place AS INTEGER) AS place FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)}, {n})" for n, (k, v) in enumerate(SLANG)) + ") v(key, value, place)")
def slang_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slang dictionary's JSON file, in file order."""
    folder = sinks.shared_folder(spark, "slang")
    whole = json.dumps({"other": {"a": "b"}, "teencode_unigrams_meaningful": dict(SLANG)}, indent=1)
    sinks.write_text(literal_rows(spark, [(whole,)], "value string"), "value", folder)
    return readers.slang_map(spark, folder)


@query("SELECT count(*) AS total, count(*) FILTER (n_chars > 500) AS kept, round(count(*) FILTER (n_chars > 500) / count(*) * 100, 2) AS kept_pct FROM documents")
def stats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as a pretty JSON log, and back."""
    folder = sinks.shared_folder(spark, "log")
    summary = metrics.kept_by(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 500).where("source = 'ALL'")
    sinks.write_log(summary.select("total", "kept", "kept_pct"), folder)
    return spark.read.option("multiLine", True).schema("total long, kept long, kept_pct double").json(folder)


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS seen, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key set in every event's object, the other keys as they are."""
    rows = table(spark, sf_dir, "events")
    now = readers.json_updated(F.col("props"), "seen", F.col("user_id").cast("string"))
    return rows.select("event_id", now.alias("now")).select("event_id", F.get_json_object("now", "$.seen").alias("seen"), F.get_json_object("now", "$.k").alias("k"))


@query("SELECT url_site, CAST(max(page_id) AS BIGINT) AS page FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS url_site FROM pages) GROUP BY url_site HAVING max(page_id) % 5 <> 0")
def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor of each site: set by the even pages, then by the rest where those are later; finished sites are deleted."""
    folder = sinks.shared_folder(spark, "state")
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("url_site"), F.col("page_id").alias("page"))
    sinks.upsert(pages.where("page % 2 = 0"), folder, "url_site")
    before = sinks.state(spark, folder)
    later = pages.where("page % 2 = 1").unionByName(before)
    sinks.upsert(later, folder, "url_site")
    sinks.delete(sinks.state(spark, folder).where("page % 5 = 0"), folder, "url_site")
    return sinks.state(spark, folder)


@query("SELECT lang, count(*) AS labelled, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query("SELECT doc_id, source, lang AS domain, text AS raw_text FROM documents WHERE regexp_matches(text, '\\S')")
def base_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(~text.is_blank(F.col("text")))
    return docs.select("doc_id", "source", F.col("lang").alias("domain"), F.col("text").alias("raw_text"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE {sql_count('text')} > 30")
def first_long_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(text.word_count(F.col("text")) > 30)
    return docs.orderBy("doc_id").limit(1).select("doc_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

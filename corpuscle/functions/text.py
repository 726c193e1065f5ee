"""Column expressions over text: words, strips, rewrite chains, predicates. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import rules
from corpuscle.functions.rules import Rule, rx


def once(value: Column, expression: Callable[[Column], Column]) -> Column:
    """An expression over a costly value that is computed once. The optimiser puts a column's expression in wherever a
    filter names the column; a lambda's variable stays a variable."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are costly, computed once however often they are named: the optimiser puts an expression in
    wherever a filter or another column names it, but not past a generator, so they come out of one."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


#: Letters that match others in any case and don't turn into them when lower-cased.
ODD_CASE = ("ſ", "ı", "\u0307")


def may_match(text: Column, needs: tuple[str, ...]) -> Column:
    """Whether a text holds one of some strings in any case; `0` is any digit."""
    low = F.lower(text)
    held = [low.rlike(r"(?U)\d") if n == "0" else low.contains(n) for n in needs]
    held += [low.contains(c) for c in ODD_CASE if any(x.isalpha() for n in needs for x in n)]
    return reduce(or_, held)


def rewrite(text: Column, chain: Iterable[Rule]) -> Column:
    """The chain's patterns in turn, each only on texts that hold what it needs: looking for a few letters costs little
    beside a pattern of Unicode classes."""
    for needs, own in groupby(chain, key=lambda r: r.needs):
        text = once(text, guarded(needs, list(own))) if needs else replaced(text, own)
    return text


def replaced(text: Column, chain: Iterable[Rule]) -> Column:
    for rule in chain:
        text = F.regexp_replace(text, rule.pattern, rule.replacement)
    return text


def guarded(needs: tuple[str, ...], chain: list[Rule]) -> Callable[[Column], Column]:
    return lambda t: F.when(may_match(t, needs), replaced(t, chain)).otherwise(t)


def any_of(text: Column, patterns: Iterable[str], flags: str = "") -> Column:
    return text.rlike(rx("|".join(f"(?:{p})" for p in patterns), flags))


def is_spam(text: Column) -> Column:
    return any_of(text, rules.SPAM, "i")


def is_terminal(text: Column) -> Column:
    own = strip(text)
    return any_of(own, rules.TERMINAL_ANY_CASE, "i") | any_of(own, rules.TERMINAL)


def truncated(text: Column, most: int = rules.MAX_CHARS) -> Column:
    """Texts of more than `most` characters end after their last sentence end in the first `most`, if that lies in
    the second half; else at `most`."""
    head = F.substring(text, 1, most)
    back = F.reverse(head)
    ends = [F.when(F.locate(c, back) > 0, F.lit(most) - F.locate(c, back)) for c in ".!?\n"]
    last = F.greatest(*ends, F.lit(-1))
    cut = F.when(last > most // 2, F.substring(head, F.lit(1), last + 1)).otherwise(head)
    return F.when(F.length(text) > most, strip(cut)).otherwise(text)


def comment_steps(df: DataFrame, text: str, most: int = rules.MAX_CHARS) -> DataFrame:
    """Adds `clean` and, for each counted step, `changed_<step>`. Each step's text is computed once, however often it is
    compared. Null texts stay null, without any work."""
    now, names, kept = text, [], df.columns
    for k, (step, chain) in enumerate(groupby(rules.COMMENT, key=lambda r: r.step)):
        after = rewrite(F.col(now), chain)
        names.append(f"__step{k}")
        df = computed(df, **{names[-1]: strip(after) if step == "whitespace" else after})
        if step in rules.COMMENT_COUNTED:
            df = df.withColumn(f"changed_{step}", F.col(names[-1]) != F.col(now))
        now = names[-1]
    df = computed(df, clean=truncated(F.col(now), most)).withColumn("changed_truncate", F.col("clean") != F.col(now))
    return df.select(*kept, "clean", *[f"changed_{s}" for s in rules.COMMENT_COUNTED])


def comment_clean(text: Column, most: int = rules.MAX_CHARS) -> Column:
    return truncated(strip(rewrite(text, rules.COMMENT)), most)


def line_clean(text: Column) -> Column:
    return strip(rewrite(text, rules.LINE))


def entities(text: Column, fixed: bool = False) -> Column:
    return rewrite(text, rules.ENTITIES_FIXED if fixed else rules.ENTITIES)


def forum_clean(unescaped_nfc: Column, fixed: bool = False) -> Column:
    """From text whose entities are resolved, forum marks removed, and that is in NFC."""
    return strip(rewrite(entities(F.lower(rewrite(unescaped_nfc, rules.FORUM_WEB)), fixed), rules.FORUM_MARKS))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "\u00a0“”", ' ""')


def news_clean(nfc: Column) -> Column:
    """From text with plain quotes in NFC. An odd number of `"` removes them all."""
    bare = lambda t: F.replace(t, F.lit('"'), F.lit(""))
    return once(strip(rewrite(nfc, rules.NEWS)), lambda t: strip(F.when((F.length(t) - F.length(bare(t))) % 2 == 1, bare(t)).otherwise(t)))


def news_quality(text: Column, least: int = rules.MIN_WORDS) -> Column:
    """Words enough, and five in a hundred characters at most that are neither letters, digits, space nor usual marks."""
    odd = lambda t: F.length(t) - F.length(F.regexp_replace(t, rx(r"[^\w\s.,!?;:\-\"'()/%…]"), ""))
    return once(text, lambda t: (word_count(t) >= least) & (odd(t) <= F.length(t) * F.lit(0.05)))


def code_words(text: Column) -> Column:
    """Number of different code words that a text has as whole words."""
    return F.size(F.array_intersect(words(text), F.array(*[F.lit(w) for w in rules.CODE_WORDS])))


def most_repeated(text: Column) -> Column:
    """How often the most frequent word of two characters or more occurs. The words are sorted once, and the longest
    run is taken over them, so the cost doesn't grow with the square of the text."""
    own = F.sort_array(F.filter(words(text), lambda w: F.length(w) > 1))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["word"] == w, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(own, start, step, lambda acc: acc["most"])


def forum_quality(text: Column) -> Column:
    good = lambda t: (word_count(t) >= rules.MIN_FORUM_WORDS) & (code_words(t) < 2) & (most_repeated(t) <= rules.MAX_WORD_REPEATS)
    return once(text, good)


#: The same runs, with the commonest letters taken as runs of their own: the whole alphabet is a slow class.
FAST_TOKEN = f"((?:[a-z0-9]++|{rules.TOKEN[:-1]})+)"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters of the alphabet and digits, without URLs and without plain numbers."""
    low = F.lower(text)
    noisy = low.contains("<url>") | low.contains("http") | low.contains("www.")
    own = F.when(noisy, F.regexp_replace(low, rx(rules.TOKEN_NOISE), " ")).otherwise(low)
    number = lambda t: (t < ":") & t.rlike(r"\A[0-9]+\z")  # noqa: E731  # digits come before `:`, letters after it
    return F.filter(F.regexp_extract_all(own, F.lit(FAST_TOKEN), F.lit(1)), lambda t: ~number(t))


def url_without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*", "")


def continuation(decoded: Column, prompt: Column) -> Column:
    """What follows the prompt, underscores as spaces."""
    return F.translate(strip(F.substring(decoded, F.length(prompt) + 1, F.length(decoded))), "_", " ")


def first_word(text: Column) -> Column:
    return F.translate(F.split_part(strip(text), F.lit(" "), F.lit(1)), "_", " ")


def drop_reason(text: Column, least: int = rules.MIN_WORDS) -> Column:
    """The first of the cheap rules that a text fails; null if none."""
    return F.when(is_spam(text), "spam").when(is_terminal(text), "terminal_cmd").when(word_count(text) < least, "too_short")

"""Rewrite rules against an independent statement of them in Python, on samples and on random strings."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import rules, text, udfs

ALPHABET = "aAbhivx 0123456789.,!?;:-_~()<>=\"'/@\t\n|…đỬửéàýỸêơ😀☀■[]*DT3" + "rtxgi5kfHzgbrazerhd"


def strings(n, seed, size=30):
    rng = random.Random(seed)
    own = [unicodedata.normalize("NFC", "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(size)))) for _ in range(n)]
    pieces = ["rtx 3060 ti", "i5 12400f", "r5-5600", "144 hz", "logitech g102", "https://a.b/c", "a@b.cd", ":v", ":)", "=))", "....", "haaaa", "?!?", "12 \"", "gtx-1060", " . . ."]
    own += [" ".join(rng.choice([*pieces, "x", "nhé", "1", ","]) for _ in range(rng.randrange(8))) for _ in range(n)]
    return own


def differences(spark, expression, plain, values):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, t string").select("id", "t", expression(F.col("t")).alias("got")).collect()
    return [(r.t, r.got, plain(r.t)) for r in rows if r.got != plain(r.t)]


def repeat_plain(t):
    return re.sub(r"(.)\1{3,}", lambda m: m[1] * (1 if m[1] in ".!?-_~" else 2), t)


def punctuation_plain(t):
    return re.sub(r"([!?]){3,}|\.{4,}", lambda m: m[0][0], t)


def by_step(step):
    return lambda c: text.rewrite(c, [r for r in rules.COMMENT if r.step == step])


@pytest.mark.parametrize(
    ("expression", "plain"),
    [
        (by_step("repeat"), repeat_plain),
        (by_step("punctuation"), punctuation_plain),
        (lambda c: text.word_count(c), lambda t: len(t.split())),
        (text.strip, str.strip),
        (lambda c: text.most_repeated(c), lambda t: max([t.split().count(w) for w in t.split() if len(w) > 1], default=0)),
    ],
)
def test_rules_equal_their_statement(spark, expression, plain):
    assert differences(spark, expression, plain, strings(1500, 7)) == []


SAMPLES = [
    (lambda c: text.rewrite(c, [r for r in rules.COMMENT if r.step == "repeat"]), {"haaaa": "haa", "!!!!!": "!"}),
    (lambda c: text.rewrite(c, [r for r in rules.COMMENT if r.step == "punctuation"]), {"?!?": "?", "a....": "a."}),
    (lambda c: text.rewrite(c, [r for r in rules.COMMENT if r.step == "signature"]), {"Sent from HUAWEI NOVA 5T using vozFApp": "", "GỬI TỪ OnePlus 15 bằng VOZVNApp": ""}),
    (text.comment_clean, {"xem https://a.b/c nhé": "xem <URL> nhé", "hay 😀☀ quá": "hay quá", "ok :)\nrồi": "ok \nrồi", "Jan 10, 2026 x 05/09/2025": "x"}),
    (text.entities, {
        "144 hz": "144hz", "i5 12400f": "i5_12400f", "i5 12400 ngon": "i5_12400ngon", "card rtx 3060 ti ngon": "card rtx_3060_ti ngon",
        "card rtx 3060 ngon": "card rtx_3060ngon", "logitech g102": "logitech_g102",
    }),
    (lambda c: text.entities(c, fixed=True), {"i5 12400 ngon": "i5_12400 ngon", "i5 12400f": "i5_12400f", "card rtx 3060 ngon": "card rtx_3060 ngon", "rtx 3060 ti x": "rtx_3060_ti x"}),
    (text.line_clean, {"a > b": "a", "hay :)) ok": "hay  ok".replace("  ", " "), "xem [IMG] () x..": "xem x.", "hi :) --": "hi :)", "<URL> x": "<URL"}),
    (lambda c: text.strip(text.rewrite(c, rules.FORUM_MARKS)), {
        "a ,b;c 5:30 x,1": "a, b; c 5: 30 x,1".replace("5: 30", "5:30"), "hay.... quá  !": "hay… quá!", "a,”b": "a,”b", "so;)": "so;)", "x . y": "x. y", "?b": "? b",
    }),
    (text.entities, {"5 \" x": "5inch  x", "a-5\" x": "a-5\" x", "gtx-1660 super 16 gb": "gtx_1660_super 16gb", "r 5 - 5600x": "r5_5600x", "razer  viper": "razer_viper", "500 k 2 th": "500k 2th"}),
    (udfs.final_polish, {"xin chào. bạn... ok": "Xin chào. Bạn... ok.", "a) (b) (c": "A (b) c.", "a . . . b": "A... b.", "": ""}),
    (text.news_clean, {'a"b': "ab", 'x "y" z': 'x "y" z', "chào.Bạn , nhé": "chào. Bạn, nhé", "a@b.cd x": "x"}),
    (text.url_without_query, {"http://a/b?c#d": "http://a/b", "http://a#b?c": "http://a"}),
]


@pytest.mark.parametrize("case", range(len(SAMPLES)))
def test_samples(spark, case):
    expression, pairs = SAMPLES[case]
    rows = spark.createDataFrame(list(pairs.items()), "t string, want string").select("t", "want", expression(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_tokens_and_predicates(spark):
    def one(expression, value):
        return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]

    assert one(text.tokens, "Xin CHÀO <URL> 123 a1 https://x.y ö-ß đẹp") == ["xin", "chào", "a1", "đẹp"]
    assert one(text.is_spam, "Chuột  bạch xem") and not one(text.is_spam, "chuột xem")
    assert one(text.is_terminal, " SUDO apt") and one(text.is_terminal, "$ ls") and not one(text.is_terminal, "x sudo apt")
    assert one(lambda c: text.drop_reason(c), "a b") == "too_short"
    assert one(text.code_words, "div div script x") == 2 and not one(text.forum_quality, "div a b script c")
    assert one(text.is_blank, None) and one(text.is_blank, "  ") and not one(text.is_blank, "x")
    assert one(lambda c: text.truncated(c, 10), "aaaaaa. bbbbbb") == "aaaaaa." and one(lambda c: text.truncated(c, 10), "a. bbbbbbbbbbbb") == "a. bbbbbbb"
    assert not one(text.news_quality, "a " * 14) and one(text.news_quality, "a " * 15) and not one(text.news_quality, "a # " * 15)


def test_slang(spark):
    from corpuscle.operators import lexicon

    df = spark.createDataFrame([("K dc ko, KO dcx $1",)], "t string")
    entries = [("ko", "không"), ("k dc", "ko được"), ("dc", r"được\$1"), ("không", "hông")]
    plain = udfs.translator(entries)("K dc ko, KO dcx $1")
    assert lexicon.translate(df, "t", entries).first().translated == plain
    many = entries + [(f"zz{k}", "q") for k in range(300)]
    assert lexicon.translate(df, "t", many).first().translated == plain


def test_segmentation():
    run = udfs.segmenter(["thi công", "băng_thông rộng"])
    assert run("Thi công băng thông rộng quá") == "Thi_công băng_thông_rộng quá"


def test_segment_marks(spark):
    df = spark.createDataFrame([("ngon qua! ok? (a) 2026. b. 1,5",)], "t string")
    got = df.select(text.strip(text.rewrite(F.col("t"), rules.SEGMENT_MARKS))).first()[0]
    assert got == "ngon qua ok a 2026. b . 1,5"


def test_properties_of_cleaned_texts(spark):
    """Of any text: marks stand by their words, blanks are single, balanced brackets, a capital first and a stop last."""
    import re as r

    values = strings(1500, 11)
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(
        "t", text.strip(text.rewrite(F.col("t"), rules.FORUM_MARKS)).alias("marks"), udfs.final_polish(F.col("t")).alias("polished"), text.entities(F.col("t")).alias("terms")
    ).collect()
    for row in rows:
        assert "  " not in row.marks and not row.marks[:1].isspace()
        assert r.sub(r"[\s.…]", "", row.marks) == r.sub(r"[\s.…]", "", row.t)  # but for blanks and dots nothing changes
        depth = 0
        for c in row.polished:
            depth += {"(": 1, ")": -1}.get(c, 0)
            assert depth >= 0
        assert depth == 0 and (not row.polished or row.polished[-1] in ".?!")
        kept = lambda t: r.sub(r"[\s_\-\"']|inch", "", t)
        assert kept(row.terms) == kept(row.t)  # terms are joined, never lost


def test_costly_columns_are_computed_once(spark, small):
    """One normalisation and one chain in the plans of queries that filter by what they clean."""
    from corpuscle.plans import catalogue

    def operators(name):
        plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("ArrowEvalPython"), plan.count("regexp_replace(")

    assert operators("news_clean")[0] == operators("exact_dedup_first")[0] == 1
    assert operators("exact_dedup_first")[1] <= operators("news_clean")[1] + 1  # one in the filter's own count of marks
    assert operators("forum_clean")[0] == 2
    comment = sum(1 for _ in rules.COMMENT)
    assert operators("comment_clean")[1] < 3 * comment and operators("clean_step_counters")[1] < 3 * comment


@pytest.mark.parametrize("chain", ["COMMENT", "LINE", "FORUM_RAW", "FORUM_WEB", "ENTITIES", "ENTITIES_FIXED", "FORUM_MARKS", "NEWS"])
def test_what_a_rule_needs_changes_no_result(spark, chain):
    """With and without trying patterns on texts only that hold what they need."""
    own = getattr(rules, chain)
    free = [r._replace(needs=()) for r in own]
    rng = random.Random(3)
    pieces = ["Sent from my x1 using vozFApp", "via theNEXTvoz for iPhone", "GỬI TỪ a bằng VOZVNApp", "Log in to Facebook now", "HTTPS://a.b", "WWW.a", "bit.ly/x", "Post in thread 'a'", "Replies: 5 Forum: x",
              "Jan 10, 2026", "5/09/2025", "[QUOTE]a[/quote]", "[IMG]", "-- ", "()", "a..", "ﬅ ſent from ıphone İPAD", "٣ gb", "Sent from a via b", "Razer  viper", "RTX 3060 TI", "a@b.c"]
    values = strings(800, 5) + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) for _ in range(800)] + [None, ""]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.rewrite(F.col("t"), own).alias("a"), text.rewrite(F.col("t"), free).alias("b")).collect()
    assert [(r.t, r.a, r.b) for r in rows if r.a != r.b] == []

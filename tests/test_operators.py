import json
import math

from pyspark.sql import functions as F

from corpuscle.functions import html
from corpuscle.operators import dedup, lexicon, lm, metrics, sequences, split, vocab
from corpuscle.sources import readers, sinks
from corpuscle.streaming import ingest


def test_text_and_json_sources(spark, tmp_path):
    (tmp_path / "data_voz_tech_normalized.txt").write_bytes("một\n\n  \nhai \xa0\n".encode() + b"b\xffd\nlast")
    rows = readers.text_lines(spark, str(tmp_path), "*_normalized.txt").orderBy("line").collect()
    assert [r.value for r in rows] == ["một", "hai \xa0", "b�d", "last"]
    source, domain = readers.forum_labels(F.col("file"))
    assert set(map(tuple, readers.text_lines(spark, str(tmp_path)).select(source, domain).collect())) == {("forum_voz", "tech")}
    lines = ['{"text": "a"}', "", "plain", '{"x": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert sorted(r.text for r in readers.tolerant_json(spark, str(tmp_path / "a.jsonl")).collect()) == ["", "a", "plain"]
    (tmp_path / "b.jsonl").write_text('{"source": "s", "domain": "d", "raw_text": "x"}\n{"source": null, "raw_text": ""}\n')
    assert readers.strict_json(spark, str(tmp_path / "b.jsonl")).count() == 1
    (tmp_path / "c.jsonl").write_text('{"segmented_text": " x "}\n{bad\n{"source": "s", "segmented_text": " "}\n')
    assert [tuple(r) for r in readers.permissive_json(spark, str(tmp_path / "c.jsonl")).collect()] == [("unknown", "x")]


def test_strict_reads_fail(spark, tmp_path):
    import pytest

    (tmp_path / "x.txt").write_bytes(b"ok\nb\xff\n")
    with pytest.raises(Exception, match="not UTF-8"):
        readers.text_lines(spark, str(tmp_path / "x.txt"), strict=True).collect()
    (tmp_path / "x.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_json(spark, str(tmp_path / "x.jsonl")).collect()


def test_maps_and_dictionaries(spark, tmp_path):
    (tmp_path / "slang.json").write_text(json.dumps({"teencode_unigrams_meaningful": {"k": "không", "dc": "được"}, "other": {}}))
    assert [(r.key, r.value) for r in readers.slang_map(spark, str(tmp_path / "slang.json")).orderBy("place").collect()] == [("k", "không"), ("dc", "được")]
    (tmp_path / "slang.json").write_text(json.dumps({"teencode_unigrams_meaningful": {"k": "không"}}, indent=2))
    assert [r.value for r in readers.slang_map(spark, str(tmp_path / "slang.json")).collect()] == ["không"]
    for body in ({"word2idx": {"a": 4, "b": 5}}, {"a": 4, "b": 5}):
        (tmp_path / "vocab.json").write_text(json.dumps(body, indent=2))
        assert {r.word: r.idx for r in readers.vocabulary_json(spark, str(tmp_path / "vocab.json")).collect()} == {"a": 4, "b": 5}
    one = spark.createDataFrame([(" Băng_Thông ",), ("",), ("x",)], "value string")
    assert sorted(r.word for r in readers.dictionary(one, one).collect()) == ["băng thông", "x"]
    row = spark.createDataFrame([("3,14",)], "s string").select(*readers.crawl_cursor(F.col("s"))).first()
    assert tuple(row) == (3, 14)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 2), ("b", "đ", 5)], "word string, x string, frequency int")
    sinks.write_json(df.select("word", "x"), str(tmp_path / "j"))
    out = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert '"x":null' in out and "đ" in out
    sinks.write_frequencies(df.select("word", "frequency"), str(tmp_path / "c"), "unigram")
    assert "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))).splitlines()[:2] == ["unigram,frequency", "b,5"]
    sinks.write_log(df.agg(F.count(F.lit(1)).alias("total")), str(tmp_path / "l"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "l").glob("part-*"))) == {"total": 2}
    for first, n in ((df, 2), (df, 0), (df.withColumn("word", F.lit("c")), 1)):
        assert sinks.append_new(first.select("word"), str(tmp_path / "seen"), str(tmp_path / "out"), "word") == n
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_keep_first(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", "x"), (4, None, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "id int, t string, s string")
    assert sorted(r.id for r in dedup.keep_first(df, "t", ["id"]).collect()) == [1, 2, 4]
    assert sorted(r.id for r in dedup.keep_first(df, "t", ["id"], ["s"]).collect()) == [1, 2, 3, 4]
    again = dedup.keep_first(dedup.keep_first(df, "t", ["id"]), "t", ["id"])
    assert again.count() == 3


def test_unknown_words(spark):
    df = spark.createDataFrame([(1, "băng thông lạ quá"), (2, "lạ lạ k dc"), (3, ""), (4, "một")], "id int, t string")
    words = spark.createDataFrame([("băng thông",), ("quá",), ("thông lạ",)], "word string")
    one, two = lexicon.unknown(df, ["id"], "t", words)
    assert {r.tok: r.frequency for r in one.collect()} == {"lạ": 2, "k": 1, "dc": 1, "một": 1}
    assert {r.pair: r.frequency for r in two.collect()} == {"lạ lạ": 1, "lạ k": 1, "k dc": 1}


def test_vocabulary_round_trip(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, "b c"), (3, ""), (4, "<pad> a")], "id int, t string")
    words = vocab.build(df, "t", least=1, most=7)
    assert {r.word: r.idx for r in words.collect()} == {"<pad>": 0, "<unk>": 1, "<sos>": 2, "<eos>": 3, "a": 4, "b": 5, "c": 6}
    ids = vocab.encode(df, ["id"], "t", words.where("word <> 'c'"))
    assert {r.id: r.ids for r in ids.collect()} == {1: [2, 5, 4, 4, 3], 2: [2, 5, 1, 3], 3: [2, 3], 4: [2, 0, 4, 3]}
    assert {r.id: r.text for r in vocab.decode(ids, ["id"], "ids", words).collect()} == {1: "b a a", 2: "b <unk>", 3: "", 4: "a"}
    assert [r.label for r in vocab.class_index(df, "t").orderBy("t").collect()] == [0, 1, 2, 3]


def test_encoding_looks_words_up_where_they_are(spark):
    """Before, a row for each word was shuffled to the vocabulary and back. Texts of one id go word by word, as before."""
    df = spark.createDataFrame([(1, "a zz b"), (1, "b"), (2, None), (None, " \u00a0 "), (3, "b\u2003a b\x1cq")], "id int, t string")
    words = spark.createDataFrame([("a", 7), ("b", 9), ("b\x1cq", 11)], "word string, idx int")
    got = vocab.encode(df, ["id"], "t", words)
    assert {r.id: r.ids for r in got.collect()} == {1: [2, 7, 9, 1, 9, 3], 2: [2, 3], None: [2, 3], 3: [2, 9, 7, 11, 3]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert vocab.encode(df.where("false"), ["id"], "t", words, marks=False).count() == 0


def test_windows_and_blocks(spark):
    df = spark.createDataFrame([(k, list(range(k))) for k in (0, 3, 4, 5, 9)], "id int, ids array<int>")
    got = sequences.sliding(df, ["id"], "ids", 3).collect()
    assert sorted((r.id, r.start) for r in got) == [(4, 0), (5, 0), (5, 1)] + [(9, s) for s in range(6)]
    assert all(r.x == list(range(r.start, r.start + 3)) and r.y == list(range(r.start + 1, r.start + 4)) for r in got)
    blocks = sequences.blocks(df, "id", "ids", 4, batch=3).orderBy("batch", "block").collect()
    assert [(r.batch, r.block, r.input_ids) for r in blocks] == [
        (0, 0, [0, 1, 2, 0]), (1, 0, [0, 1, 2, 3]), (1, 1, [4, 0, 1, 2]), (1, 2, [3, 4, 5, 6])
    ]
    row = df.where("id = 5").select(
        sequences.padded(F.col("ids"), 7), sequences.padded(F.col("ids"), 2), sequences.last(F.col("ids"), 3),
        sequences.context(F.col("ids"), F.lit(4), 2), sequences.context(F.col("ids"), F.lit(0)), sequences.context(F.col("ids"), F.lit(2), 15, True),
        *sequences.shift(F.col("ids")),
    ).first()
    assert list(row) == [[0, 1, 2, 3, 4, 0, 0], [0, 1], [2, 3, 4], [2, 3], [], [1], [0, 1, 2, 3], [1, 2, 3, 4]]


def test_blocks_of_a_large_batch(spark):
    """Before, each block carried its whole batch along, and a row without indices took its batch with it."""
    sizes = [None if k % 97 == 5 else (k * 7919) % 9001 for k in range(400)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "id int, n int")
    df = df.select("id", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: F.col("id") * 10_000 + x)).alias("ids"))
    got = sequences.blocks(df, "id", "ids", 128, batch=150)
    nodes = [got._jdf.queryExecution().optimizedPlan()]
    for node in nodes:
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    carried = [n.requiredChildOutput().mkString(",") for n in nodes if n.nodeName() == "Generate"]
    assert carried and not any("ids#" in c or "all#" in c for c in carried)
    expected = set()
    for at in range(0, 400, 150):
        ids = [k * 10_000 + x for k in range(at, min(at + 150, 400)) for x in range(1, (sizes[k] or 0) + 1)]
        expected |= {(at // 150, k, sum(ids[128 * k : 128 * k + 128])) for k in range(len(ids) // 128)}
    rows = got.select("batch", "block", F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x), F.size("labels"), F.size("attention_mask")).collect()
    assert len(rows) == len(expected) and {tuple(r)[:3] for r in rows} == expected and all(tuple(r)[3:] == (128, 128) for r in rows)


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sequences.ranks(df, "k").orderBy("k").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))


def test_splits_are_disjoint_and_complete(spark):
    df = spark.createDataFrame([(k, "a" if k < 25 else "b" if k < 27 else None) for k in range(40)], "id int, s string")
    got = split.by_source(df, "id", "s")
    assert got.count() == 40
    sizes = {(r.s, r.split): r.n for r in split.sizes(got, "s").collect()}
    assert sizes[("a", "train")] == 20 and sizes[("a", "val")] == 2 and sizes[("a", "test")] == 3 and sizes[(None, "train")] == 10
    assert {r.split for r in split.by_source(df, "id", "s", small_to_train=True).where("s = 'b'").collect()} == {"train"}
    other = {r.id: r.split for r in split.by_source(df, "id", "s", digits=1).collect()}
    assert other == {r.id: r.split for r in got.collect()}
    half = {(r.s, r.split): r.n for r in split.sizes(split.halved(df, "id", "s"), "s").collect()}
    assert half[("a", "val")] == 3 and half[("a", "test")] == 2
    assert [r.id for r in split.sample(df, "id", 5).collect()] == [r.id for r in split.sample(df.repartition(7), "id", 5).collect()]


def test_summary_adds_up(spark):
    rows = ["sudo apt install x", "chuột bạch xem " * 9, "ngắn", "w " * 20, "haaaa " * 20, ":v " * 20, None, "  ", "a. " * 2500]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    s = metrics.summary(metrics.cleaned(df, "t")).first()
    assert s.total_input == 7 == s.total_output + s.dropped_total
    assert (s.dropped_spam, s.dropped_terminal_cmd, s.dropped_too_short, s.dropped_empty) == (1, 1, 1, 1)
    assert s.cleaned_repeat == 1 and s.cleaned_emoticon == 1 and s.cleaned_truncate == 1 and s.dropped_pct == 57.14
    empty = metrics.summary(metrics.cleaned(df.where("false"), "t")).first()
    assert empty.dropped_pct == 0 and empty.total_input == 0


def test_language_model(spark):
    train = spark.createDataFrame([("a b a b",), ("a c",)], "t string")
    counts = lm.bigrams(train, "t")
    test = spark.createDataFrame([(1, "s1", "d", "a b"), (2, "s2", "d", "x")], "id int, s string, d string, t string")
    rows = {(r.id, r.pos): r for r in lm.scores(test, ["id", "s", "d"], "t", counts).collect()}
    assert len(rows) == 5 and rows[(1, 1)]["rank"] == 1 and rows[(2, 1)]["rank"] is None
    n, v = 8, 4
    p = 0.7 * 2 / 2 + 0.3 * (3 + 1) / (n + v + 1)
    assert math.isclose(rows[(1, 1)].log_p, math.log(p))
    report = {r.group: r for r in lm.report(lm.scores(test, ["id", "s", "d"], "t", counts), "s", "d").collect()}
    assert report.keys() == {"OVERALL", "Source: s1", "Source: s2", "Domain: d"}
    assert report["OVERALL"].tokens == 5 == sum(report[f"Source: {k}"].tokens for k in ("s1", "s2"))
    assert {r.prev: r.words for r in lm.suggestions(counts).collect()}["a"] == ["b", "c"]


def test_beam_search():
    table = {2: [(4, -0.1), (5, -3.0)], 4: [(5, -0.2), (4, -0.1)], 5: [(3, -0.1)]}
    assert lm.beam([2], table, 2, 5, 0.7, True) == [2, 4, 5, 3]
    assert lm.beam([2], table, 2, 5, 0.7, False) == [2, 4, 5, 3]
    assert lm.beam([2, 9], {1: [(3, 0.0)]}, 1, 5, 0.7, True) == [2, 9, 3]


PAGE = """<html><body><article class="fck_detail x"><p style="text-align: right">Tác giả viết bài này rất dài dòng và lê thê quá đi thôi</p>
<p>Đoạn <b>một</b> có đủ dài để được giữ lại trong kết quả cuối cùng &amp; nữa &gt;&gt; Xem thêm: x</p><div><p>trong div: đoạn này cũng đủ dài để được giữ lại trong kết quả</p></div>
<table><tr><td><p>bảng này phải bị xoá khỏi kết quả dù nó dài đến đâu đi nữa nhé</p></td></tr></table><p>ngắn</p><script>var s="</p>";</script></article>
<h3 class="title-news"><a href="https://vnexpress.net/a.html?x=1#y">t</a></h3><h3 class="title-news"><a href="https://vnexpress.net/a.html">t</a></h3>
<div class="thumb-art"><a href="https://vnexpress.net/video/b">v</a><a href="https://other.com/c">o</a></div>
<div class="structItem structItem--thread"><div class="structItem-title"><a href="/t/abc.1/unread">n</a></div></div>
<div class="structItem structItem--thread structItem--sticky"><div class="structItem-title"><a href="/t/sticky.2/">n</a></div></div>
<div class="bbWrapper"><blockquote>trích</blockquote>bình luận dài hơn hai mươi lăm ký tự</div></body></html>"""


def test_html(spark):
    own = html.paragraphs_of(PAGE, html.SITES["vnexpress"])
    assert own == ["Đoạn một có đủ dài để được giữ lại trong kết quả cuối cùng & nữa ", "trong div: đoạn này cũng đủ dài để được giữ lại trong kết quả"]
    assert html.links_of(PAGE, html.SITES["vnexpress"]) == ["https://vnexpress.net/a.html"]
    assert html.links_of(PAGE, html.SITES["forum"]) == ["https://voz.vn/t/abc.1"]
    assert html.paragraphs_of(PAGE, html.SITES["forum"]) == ["bình luận dài hơn hai mươi lăm ký tự"]
    assert html.paragraphs_of(None, html.SITES["dantri"]) == []
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    assert [(r.page_id, r.idx) for r in html.paragraphs(df, "vnexpress").collect()] == [(1, 1), (1, 2)]
    assert html.links(df, "vnexpress").collect()[0].link == "https://vnexpress.net/a.html"


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k % 7}", f"2024-01-01 00:00:{k % 60:02d}") for k in range(40)], "id int, t string, ts string").withColumn("ts", F.to_timestamp("ts"))
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = "id int, t string, ts timestamp"
    stream = lambda: ingest.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    ingest.ingest(stream(), "t", str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    ingest.ingest_to_table(stream(), "t", str(tmp_path / "b"), str(tmp_path / "cb")).awaitTermination()
    ingest.ingest_within(stream(), "t", "ts", "1 hour", str(tmp_path / "c"), str(tmp_path / "cc")).awaitTermination()
    for out in "abc":
        assert sorted(r.t for r in spark.read.parquet(str(tmp_path / out)).collect()) == [f"t{k}" for k in range(7)]
    spark.createDataFrame([(99, "new", None), (98, "t1", None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for f, out, at in ((ingest.ingest, "a", "ca"), (ingest.ingest_to_table, "b", "cb")):
        f(stream(), "t", str(tmp_path / out), str(tmp_path / at)).awaitTermination()
        assert spark.read.parquet(str(tmp_path / out)).count() == 8


def test_json_updates_keep_other_keys(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2]}, "text": "x", "n": null}', 'y "z"')], "line string, t string")
    got = df.select(readers.json_updated(F.col("line"), "text", F.col("t"))).first()[0]
    assert json.loads(got)["a"] == {"b": [1, 2]} and isinstance(json.loads(got)["text"], str)


def test_terms_stay_whole():
    from corpuscle.functions import udfs

    run = udfs.term_segmenter(["thi công"])
    assert run("mua rtx_3060_ti, thi công 1.5 i5_12400f.") == "mua rtx_3060_ti , thi_công 1.5 i5_12400f ."
    assert run("a_b " * 12) == " ".join(["a_b"] * 12)
    assert udfs.term_segmenter([], fixed=True)("ok!") == "ok !"


def test_bpe_round_trip(spark):
    import os

    import pytest

    from corpuscle.functions import bpe
    from corpuscle.plans.catalogue import BPE_FILE

    if not os.path.exists(BPE_FILE):
        pytest.skip("no vocabulary file")
    df = spark.createDataFrame([("Xin chào, <|endoftext|> 123",), (None,), ("",)], "t string").withColumn("ids", bpe.encode(F.col("t"), BPE_FILE))
    assert [r.back for r in df.select(bpe.decode(F.col("ids"), BPE_FILE).alias("back")).collect()] == ["Xin chào, <|endoftext|> 123", None, ""]
    assert df.select(F.max(F.size(bpe.encode(F.col("t"), BPE_FILE, 2)))).first()[0] == 2


def test_beams_without_repeated_pairs():
    from corpuscle.operators import lm

    table = {2: [(5, -0.1)], 5: [(6, -0.1), (7, -2.0)], 6: [(5, -0.1), (3, -5.0)], 7: [(5, -0.1)]}
    free = lm.beam([2], table, 2, 12, 0.7, step_penalty=False)
    bound = lm.beam([2], table, 2, 12, 0.7, step_penalty=False, no_repeat=2)
    pairs = lambda seq: list(zip(seq, seq[1:], strict=False))
    assert len(set(pairs(free))) < len(pairs(free)) and len(set(pairs(bound))) == len(pairs(bound)) and bound[-1] == 3


def test_a_keyed_state_replaces_and_deletes(spark, tmp_path):
    from corpuscle.sources import sinks

    path = f"file://{tmp_path}/state"
    rows = lambda *r: spark.createDataFrame(list(r), "site string, category int, page int")
    assert sinks.state(spark, path) is None
    sinks.delete(rows(("a", 0, 0)), path, "site")
    sinks.upsert(rows(("a", 0, 1), ("a", 0, 2), ("b", 1, 1)), path, "site")
    sinks.upsert(rows(("b", 2, 1), ("c", 0, 1)), path, "site")
    assert sorted(map(tuple, sinks.state(spark, path).collect())) == [("a", 0, 2), ("b", 2, 1), ("c", 0, 1)]
    sinks.delete(rows(("a", 9, 9), ("x", 0, 0)), path, "site")
    assert sorted(r.site for r in sinks.state(spark, path).collect()) == ["b", "c"]
    (tmp_path / "state" / "version=9").mkdir()  # an attempt that failed
    assert sinks.versions(spark, path) == 3


def test_loss_of_batches_and_padding(spark):
    from corpuscle.operators import lm

    rows = spark.createDataFrame([(0, "x", -1.0, 1), (0, "y", -3.0, None), (1, "z", -5.0, 2), (1, "<pad>", -90.0, None), (2, "<pad>", -9.0, None)], "batch int, label string, log_p double, rank int")
    assert tuple(lm.batch_loss(rows, "batch").first()) == (2, 3.5, round(math.exp(3.5), 2))
    whole = lm.report(rows.withColumn("s", F.lit("b")).withColumn("d", F.lit("a")), "s", "d").collect()
    assert [r.group for r in whole] == ["Domain: a", "OVERALL", "Source: b"] and {r.tokens for r in whole} == {3}
    assert lm.perplexity(F.lit(500.0)) is not None

"""Every query with SQL gives the rows that DuckDB gives, at sf0.001."""

import math
import re
import unicodedata

import duckdb
import pytest

from corpuscle.plans import catalogue

TABLES = "documents pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(columns), sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sql, small, name):
    df = catalogue.QUERIES[name](spark, small)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = sql.execute(catalogue.SQL[name])
    assert got == canonical([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_have_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_context_window_has_every_position(spark, small):
    ids = {r.doc_id: r.ids for r in catalogue.encoded(spark, small).collect()}
    want = {(d, k): (",".join(map(str, x[max(k - 16, 0) : k])), x[k]) for d, x in ids.items() for k in range(1, len(x))}
    rows = catalogue.QUERIES["context_window"](spark, small).collect()
    assert len(rows) == len(want)
    assert {(r.doc_id, r.position): (r.before, r.label) for r in rows} == want


def test_slang_translate_takes_every_document(spark, tmp_path):
    texts = ["of the And N", "été of THE élan", "theé éthe thé the", "von und and", "日本 of 日本the the。", "by the", "", None, "e\u0301and and"]
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(t):
        t = unicodedata.normalize("NFC", t)
        for key, value in sorted(catalogue.SLANG, key=lambda e: -len(e[0])):
            t = re.sub(rf"\b{key}\b", lambda _, v=value: v, t, flags=re.I)
        return t

    got = {r.doc_id: r.translated for r in catalogue.QUERIES["slang_translate"](spark, str(tmp_path)).collect()}
    assert got == {k: t if t is None else brute(t) for k, t in enumerate(texts)}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bpe_encode_equals_the_library(spark, small):
    import hashlib

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(catalogue.BPE_FILE)
    plain.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalogue.QUERIES["bpe_encode"](spark, small).collect():
        ids = plain.encode(docs[r.doc_id], add_special_tokens=False).ids[:128]
        assert (r.n, r.md5) == (len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest())


def test_word_segmentation_joins_the_longest_phrases(spark, small):
    pairs = {}
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        own = [t for t in re.findall(catalogue.LETTERS, r.text.lower()) if not re.fullmatch("[0-9]+", t)]
        for pair in zip(own, own[1:], strict=False):
            pairs[" ".join(pair)] = pairs.get(" ".join(pair), 0) + 1
    known = {p for p, n in pairs.items() if n > 1}
    joined = 0
    for r in catalogue.QUERIES["word_segmentation"](spark, small).collect():
        words = r.segmented.split()
        joined += sum("_" in w for w in words)
        assert all(w.lower().replace("_", " ") in known for w in words if "_" in w)
        for a, b in zip(words, words[1:], strict=False):  # what stands alone before another word can't be joined with it
            assert "_" in a or "_" in b or f"{a} {b}".lower() not in known
    assert joined > 50


def test_short_completions_equal_plain_counting(spark, small):
    counts = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        own = ["<sos>", *r.text.split(), "<eos>"]
        for a, b in zip(own, own[1:], strict=False):
            counts.setdefault(a, {}).setdefault(b, 0)
            counts[a][b] += 1
    best = {a: sorted((w for w in n if w != "<eos>"), key=lambda w: (-n[w], w)) for a, n in counts.items()}
    want = set()
    for start in ("the", "la", "der"):
        for rank, word in enumerate(best[start][:6], 1):
            text = [word]
            for _ in range(3):
                if not best.get(text[-1]):
                    break
                text.append(best[text[-1]][0])
            want.add((start, rank, " ".join(text)))
    assert {tuple(r) for r in catalogue.QUERIES["short_completions"](spark, small).collect()} == want


def test_polished_lines_are_balanced_and_end(spark, small):
    lines = {(r.doc_id, r.line_no): r.line for r in catalogue.lines(spark, small).collect()}
    for r in catalogue.QUERIES["final_polish"](spark, small).collect():
        depth = 0
        for c in r.polished:
            depth += {"(": 1, ")": -1}.get(c, 0)
            assert depth >= 0
        kept = lambda t: re.sub(r"[\s().]", "", unicodedata.normalize("NFC", t)).lower()
        assert depth == 0 and r.polished[-1] in ".?!" and kept(r.polished) == kept(lines[r.doc_id, r.line_no])
        first = next((c for c in r.polished if not c.isspace()), "")
        assert first == first.upper() or first.upper().lower() != first


def test_beams_follow_the_model_and_keep_their_rules(spark, small):
    for r in catalogue.QUERIES["beam_search"](spark, small).collect():
        for ids in (r.by_step, r.by_rank, r.no_pair_twice):
            assert ids[0] == 2 and len(ids) <= 2 + 4 + 20 and 3 not in ids[1:-1]
        pairs = list(zip(r.no_pair_twice, r.no_pair_twice[1:], strict=False))
        assert len(set(pairs)) == len(pairs)

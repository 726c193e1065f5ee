import math
import re

import duckdb
import pytest

from corpuscle.llm import entries, mixing

ODD = [(1, "a b c", "b"), (2, None, "b"), (3, "", None), (4, "x y", None), (4, "x y", None), (None, "q r s t", "a"), (None, "q", "a"), (7, "w " * 40_000, "b"), (8, " \n ", "zz"), (9, "one", "é")]


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares the excess again and again, until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    free, left, out = set(names), share * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")


@pytest.mark.parametrize("range_rows", [mixing.RANGE_ROWS, 20])
def test_mix_of_documents(spark, small, range_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    own = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    total = {}
    for s, n in own.values():
        total[s] = total.get(s, 0) + n
    target = plain_targets(total)
    got = mixing.curriculum(docs, range_rows=range_rows).collect()
    assert len(got) == len(own)
    taken = {}
    for r in got:
        s, n = own[r.doc_id]
        assert (r.size, r.source_size) == (n, total[s]) and math.isclose(r.target, target[s], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * n and r.taken % max(n, 1) == 0
        taken[s] = taken.get(s, 0) + r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(n for t, n in own.values() if t == s)
    again = mixing.curriculum(docs, range_rows=7).collect()
    assert {r.doc_id: (r.taken, r.first_position) for r in again} == {r.doc_id: (r.taken, r.first_position) for r in got}
    positions = [r.first_position for r in got if r.first_position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1


def test_agrees_with_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{small}/documents.parquet'")
    want = duckdb.sql(entries.OP10_SQL).fetchall()
    got = entries.op10_mixing(spark, small).select("doc_id", "size", "source_size", "target", "taken", "first_position").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark):
    docs = table(spark, ODD)
    got = mixing.curriculum(docs).collect()
    assert len(got) == len(ODD)
    sizes = {"a": 5, "b": 40_003, "é": 1, "zz": 0, None: 4}
    target = plain_targets(sizes)
    assert math.isclose(sum(target.values()), 1.5 * 40_013)
    assert sorted(r.source_size for r in got) == sorted(sizes[s] for _, _, s in ODD)
    assert sorted(r.target for r in got) == pytest.approx(sorted(target[s] for _, _, s in ODD))
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.curriculum(docs.where("false")).count() == 0
    assert all(r.taken == 0 for r in mixing.curriculum(docs.where("size is null or text is null")).collect())


def test_the_stream_repeats_documents_and_keeps_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = {r.doc_id: r.taken // r.size for r in mixing.curriculum(docs).where("size > 0").collect()}
    stream = mixing.mixed(docs)
    assert stream.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in stream.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}


def test_schedules_move_sources_in_time(spark):
    rows = [(k, "w " * 10, "early" if k % 2 else "late") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.curriculum(docs, weights=[1], share=1.0, schedules=[(2.0, 0.0), (0.0, 2.0)]).collect()
    half = {s: [r.first_position for r in plan if (r.doc_id % 2 == 1) == (s == "early") and r.taken] for s in ("early", "late")}
    share = {s: sum(p < 0.5 for p in v) / len(v) for s, v in half.items()}
    assert abs(share["early"] - 0.75) < 0.02 and abs(share["late"] - 0.25) < 0.02


def test_the_stream_has_each_row_as_often_as_planned(spark):
    """Repeated and null ids, repeated rows, clashing names: as many copies as the plan says, of the rows that it names."""
    rows = [(k % 7 if k % 3 else None, f"text of {k % 5} " * (k % 5 + 1), "hot" if k % 3 else "cold", k % 2, 0.5) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, order double")
    for range_rows in (mixing.RANGE_ROWS, 8):
        plan = mixing.curriculum(docs, range_rows=range_rows).collect()
        want, got = {}, {}
        for r in plan:
            want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.times
        for r in mixing.mixed(docs, range_rows=range_rows).collect():
            key = r.doc_id, len(r.text.split())
            got[key] = got.get(key, 0) + 1
        assert got == {k: n for k, n in want.items() if n}
        assert sum(got.values()) == sum(r.times for r in plan)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs.where("false")).count() == 0

import gzip
import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import warc
from corpuscle.llm.common import scratch_path


def test_a_loser_tree_merges_like_a_heap():
    rng = random.Random(3)
    for k in range(12):
        runs = [sorted((rng.randrange(30), s, j) for j in range(rng.randrange(20))) for s in range(k)]
        merged = [key for key, _ in warc.LoserTree([(key, None) for key in run] for run in runs)]
        assert merged == list(heapq.merge(*runs))


def test_members_of_any_reading_size():
    contents = [b"a" * 10, b"", random.Random(1).randbytes(100_000), b"z"]
    packed = [gzip.compress(c) for c in contents]
    whole = b"".join(packed)
    for size in (1, 7, 1000, 1 << 20):
        got = list(warc.members(whole[k : k + size] for k in range(0, len(whole), size)))
        assert [c for *_, c in got] == contents
        assert all(whole[o : o + n] == p for (o, n, _), p in zip(got, packed, strict=True))
    with pytest.raises(ValueError):
        list(warc.members([whole[:-5]]))


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A/b?c=1#d") == "com,example,www)/A/b?c=1"
    assert warc.url_key("https://x.org?q") == "org,x)?q"
    assert warc.url_key(None) == ")"


def odd_pages(spark):
    big = "<p>" + "x" * 300 + "</p>"
    rows = [
        (5, "http://b.org/2", big), (3, "http://a.org/1", big), (9, "http://a.org/1", big), (3, "http://a.org/1", big), (None, "http://a.org/1", big),
        (1, None, None), (2, "", ""), (4, "http://a.org/\r\nX: y%0A", "short"), (6, "http://c.org", "short"), (7, "http://ü.org/é", "é" * 400_000),
        (8, "http://d.org", "\r\n\r\nWARC/1.1\r\n" * 9),
    ]
    return spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, record_type string, offset int"), rows


def test_round_trip_of_odd_pages(spark):
    pages, rows = odd_pages(spark)
    folder = scratch_path(spark, "test-warc")
    got = warc.archive_pages(pages, folder=folder).collect()
    assert len(got) == len(rows)
    html = {i: t for i, _, t in rows}
    for r in got:
        index, payload = warc.read_record(folder, r.archive, r.offset, r.length)
        full = (html[r.page_id] or "").encode()
        assert r.payload_bytes == len(full) and r.payload_digest == hashlib.sha256(full).hexdigest() == index["payload_digest"]
        assert payload == (full if r.record_type == "response" else b"")
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == 307)
    assert kinds == [("3", "response", None)] * 2 + [("5", "revisit", 3), ("9", "revisit", 3), ("None", "response", None)]
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_global_order_over_many_runs_and_ranges(spark, small):
    """With small limits: several merge passes and ranges, one hot URL among them."""
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumn("url", F.when(F.col("page_id") % 3 == 0, "http://hot.org/").otherwise(F.col("url")))
    pages = pages.select("page_id", "url", F.substring("html", 1, 500).alias("html")).repartition(5)
    folder = scratch_path(spark, "test-warc")
    marked = pages.select(F.col("page_id").cast("string").alias("page"), "url", F.lit("2024-01-01T00:00:00Z").alias("date"), "html", F.lit(None).cast("string").alias("refers"))
    archives = warc.write_archives(marked, folder, file_bytes=2000)
    assert archives.count() > 5
    runs = warc.index_runs(folder, archives, run_rows=3)
    assert runs.count() > 9
    got = warc.merge_runs(folder, runs, fan_in=3, range_rows=10, part_rows=20).collect()
    assert sorted(int(r.page) for r in got) == sorted(r.page_id for r in pages.collect())
    placed = sorted(got, key=lambda r: (r.range_no, r.place))
    assert placed == sorted(got, key=lambda r: warc.order(r.asDict())) and len({r.range_no for r in got}) > 2
    hot = [r for r in got if r.url_key == "org,hot)/"]
    assert len({r.range_no for r in hot}) > 1


def test_a_payload_that_changed_is_an_error():
    good = gzip.decompress(warc.record("1", "http://a", "d", b"payload", None))
    assert warc.parsed(good)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"payload\r\n", b"pAyload\r\n"))


def test_ids_of_any_size_and_kind(spark):
    rows = [(10**13, "http://a.org/1", "x" * 200), (3 * 10**11, "http://a.org/1", "y" * 50), (-5, "http://a.org/1", "x" * 200), (7, "http://a.org/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (10**13, "revisit", -5), (3 * 10**11, "response", None), (-5, "response", None), (7, "response", None)
    }
    assert all("2024" <= r.captured_at[:4] <= "2056" and len(r.captured_at) == 20 for r in got)
    assert {r.captured_at for r in got if r.page_id == 7} == {"2024-01-01T00:00:07Z"}
    named = spark.createDataFrame([("a1", *rows[0][1:]), ("b2", *rows[0][1:]), ("12", "u", "z"), (None, "u", "z")], pages.schema.simpleString()[7:-1].replace(":", " ").replace("page_id bigint", "page_id string"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(named).collect()}
    assert got == {"a1": ("response", None), "b2": ("revisit", "a1"), "12": ("response", None), None: ("response", None)}


def test_ranges_of_a_hot_url_are_read_once(tmp_path):
    """All captures are of one URL: the ranges together read each row about once, a block more at each limit."""
    store = warc.Store(f"file://{tmp_path}")
    rows = [
        {"url_key": "org,hot)/", "captured_at": f"2024-01-01T{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}Z", "page": str(k), "archive": "a", "offset": k, "length": 1,
         "record_type": "response", "payload_bytes": 0, "payload_digest": "", "refers": None}
        for k in range(40_000)
    ]
    warc.write_run(store, "one.parquet", rows[:25_000])
    warc.write_run(store, "two.parquet", rows[25_000:])
    limits = [None, *(warc.order(rows[k]) for k in range(2000, 40_000, 2000)), None]
    read, got = 0, []
    for low, high in zip(limits, limits[1:], strict=False):
        cursor = warc.Cursor(store, ["one.parquet", "two.parquet"], low, high)
        got += [row["offset"] for _, row in cursor]
        read += cursor.read
    assert got == list(range(40_000)) and read <= 40_000 + 2 * len(limits) * warc.GROUP_ROWS

"""WARC archives of pages, and their index: sorted capture runs merged by loser trees into one global order."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, partitions, scratch_path

#: Payloads shorter than this are always written whole.
LEAST_BYTES = 100
#: Bytes of an archive file before the next is begun; rows of a run; runs that one merge takes, about; rows of an output
#: range, and of a range of a longer run.
FILE_BYTES, RUN_ROWS, FAN_IN, RANGE_ROWS, PART_ROWS = 64 << 20, 100_000, 64, 50_000, 1_000_000
#: Rows of a run's block: what a cursor holds in memory.
GROUP_ROWS = 2048
#: Keys that a run's file offers for choosing ranges, to twice as many.
RUN_KEYS = 64
#: Invented times of capture lie in so many seconds from the start of 2024 on.
FIRST_SECOND, SECONDS = 1_704_067_200, 1_000_000_000
#: Names of the format.
VERSION, RESPONSE, REVISIT = "WARC/1.1", "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN, NO_PAGE = "urn:corpuscle:page:", "urn:corpuscle:none"

INDEX = pa.schema(
    [
        ("url_key", pa.string()), ("captured_at", pa.string()), ("page", pa.string()), ("archive", pa.string()), ("offset", pa.int64()),
        ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers", pa.string()),
    ]
)
INDEX_SQL = "url_key string, captured_at string, page string, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers string"
Key = tuple[str, str, str, str, int]


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the path and query: pages of a site sort together."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.partition("#")[0]
    cut_ = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
    host, path = rest[:cut_].lower(), rest[cut_:]
    return ",".join(reversed(host.split("."))) + ")" + path


# --- archives -----------------------------------------------------------------------------------


def quoted(value: str | None) -> str:
    """A header's value stays on its line."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unquoted(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page: str | None, url: str | None, date: str, payload: bytes, refers: str | None) -> bytes:
    """One WARC record in a gzip member of its own. A revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers is None else b"")
    lines = [
        VERSION, f"WARC-Type: {RESPONSE if refers is None else REVISIT}", f"WARC-Record-ID: <{NO_PAGE if page is None else PAGE_URN + quoted(page)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quoted(url)}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{PAGE_URN}{quoted(refers)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(stream: Iterable[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    unpack, parts, start, at = zlib.decompressobj(31), [], 0, 0
    for data in stream:
        while data:
            parts.append(unpack.decompress(data))
            left = unpack.unused_data
            at += len(data) - len(left)
            if not unpack.eof:
                break
            yield start, at - start, b"".join(parts)
            unpack, parts, start, data = zlib.decompressobj(31), [], at, left
    if any(parts):
        raise ValueError("the archive ends within a record")


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name: value for name, _, value in pairs}, body


def parsed(content: bytes) -> dict:
    """What the index says of a record. A response's payload is digested again; a digest that differs is an error."""
    own, body = headers(content)
    http, payload = headers(body[: int(own["Content-Length"])])
    digest, size = own["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
    if own["WARC-Type"] == RESPONSE and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"{own['WARC-Record-ID']}: the payload is not the one that was written")
    page = lambda name: unquoted(own[name][1:-1].removeprefix(PAGE_URN)) if own.get(name, f"<{NO_PAGE}>") != f"<{NO_PAGE}>" else None
    return {
        "url_key": url_key(unquoted(own["WARC-Target-URI"])), "captured_at": own["WARC-Date"], "page": page("WARC-Record-ID"),
        "record_type": own["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers": page("WARC-Refers-To"),
    }


class Store:
    """A folder of the shared store. Files appear under their names when they are whole, so a task that is run
    again replaces what an earlier attempt left."""

    def __init__(self, uri: str) -> None:
        self.files, self.top = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.top, recursive=True)

    def publish(self, temporary: str, name: str) -> None:
        if self.files.get_file_info(f"{self.top}/{name}").type != fs.FileType.NotFound:
            self.files.delete_file(f"{self.top}/{name}")
        self.files.move(f"{self.top}/{temporary}", f"{self.top}/{name}")

    def temporary(self) -> str:
        return f"attempt-{uuid.uuid4().hex}"


def write_archives(marked: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page, url, date, html, refers) -> (name, size) of the archive files, one or more for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, task = Store(folder), TaskContext.get().partitionId()
        number, out, temporary, done = 0, None, "", []

        def close() -> None:
            nonlocal number, out
            size = out.tell()
            out.close()
            store.publish(temporary, f"pages-{task:06d}-{number:04d}.warc.gz")
            done.append((f"pages-{task:06d}-{number:04d}.warc.gz", size))
            number, out = number + 1, None

        for batch in batches:
            for page, url, date, html, refers in zip(*batch.columns, strict=True):
                if out is None:
                    temporary = store.temporary()
                    out = store.files.open_output_stream(f"{store.top}/{temporary}", compression=None)
                out.write(record(page.as_py(), url.as_py(), date.as_py(), (html.as_py() or "").encode(), refers.as_py()))
                if out.tell() >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["name", "size"])

    return cut(marked.select("page", "url", "date", "html", "refers").mapInArrow(run, "name string, size long"))


# --- index --------------------------------------------------------------------------------------


def order(row: dict) -> Key:
    """Order of captures: URL key, time, page (numbers by value), place in the archives."""
    page = row["page"] or ""
    return row["url_key"], row["captured_at"], page.rjust(20, "0") if page.isdigit() else page, row["archive"], row["offset"]


def write_run(store: Store, name: str, rows: Iterable[dict]) -> tuple[int, list[Key]]:
    """Sorted rows as a file of blocks, with the first key of each block in its footer; number of rows and keys spread over them."""
    temporary, n, keys, step, block, firsts = store.temporary(), 0, [], 1, [], []
    with store.files.open_output_stream(f"{store.top}/{temporary}", compression=None) as out, pq.ParquetWriter(out, INDEX) as writer:
        for row in rows:
            if (n + len(block)) % step == 0:
                keys.append(order(row))
                if len(keys) == 2 * RUN_KEYS:
                    keys, step = keys[::2], 2 * step
            if not block:
                firsts.append(order(row))
            block.append(row)
            if len(block) == GROUP_ROWS:
                writer.write_table(pa.Table.from_pylist(block, INDEX))
                n, block = n + len(block), []
        if block:
            writer.write_table(pa.Table.from_pylist(block, INDEX))
        n += len(block)
        writer.add_key_value_metadata({"firsts": json.dumps(firsts)})
    store.publish(temporary, name)
    return n, keys


class Cursor:
    """The rows of one run's files, which follow each other, from key `low` on, up to `high`, a block at a time. Blocks that
    lie outside are not read; `read` counts the rows of those that are."""

    def __init__(self, store: Store, names: list[str], low: Key | None = None, high: Key | None = None) -> None:
        self.store, self.names, self.low, self.high, self.read = store, names, low, high, 0

    def __iter__(self) -> Iterator[tuple[Key, dict]]:
        for name in self.names:
            file = pq.ParquetFile(self.store.files.open_input_file(f"{self.store.top}/{name}"))
            firsts = [tuple(k) for k in json.loads(file.metadata.metadata[b"firsts"])]
            begin = 0 if self.low is None else max(0, bisect_right(firsts, self.low) - 1)
            end = len(firsts) if self.high is None else bisect_left(firsts, self.high)
            for g in range(begin, end):
                rows = file.read_row_group(g).to_pylist()
                self.read += len(rows)
                for row in rows:
                    key = order(row)
                    if self.low is not None and key < self.low:
                        continue
                    if self.high is not None and key >= self.high:
                        return
                    yield key, row


class LoserTree:
    """Merges sorted iterators. Inner nodes hold the losers of their matches, so the next row costs one match
    on each level of the path from the leaf that won last."""

    def __init__(self, sources: Iterable[Iterable[tuple[Key, dict]]]) -> None:
        self.sources = [iter(s) for s in sources]
        self.heads = [next(s, None) for s in self.sources]
        k = len(self.sources)
        self.losers = [-1] * max(k, 1)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else k - 1

    def beats(self, a: int, b: int) -> bool:
        one, two = self.heads[a], self.heads[b]
        if one is None or two is None:
            return two is None and (one is not None or a < b)
        return one[0] < two[0] or (one[0] == two[0] and a < b)

    def __iter__(self) -> Iterator[tuple[Key, dict]]:
        k, heads, losers = len(self.sources), self.heads, self.losers
        now = self.winner
        while k and heads[now] is not None:
            yield heads[now]
            heads[now] = next(self.sources[now], None)
            node = (now + k) >> 1
            while node:
                if self.beats(losers[node], now):
                    now, losers[node] = losers[node], now
                node >>= 1


KEY = "struct<a: string, b: string, c: string, d: string, e: long>"
KEY_TYPE = pa.struct([("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("d", pa.string()), ("e", pa.int64())])
#: Files of runs: run and place in it, name, rows, keys from the first on.
RUNS = f"run string, part int, name string, n long, keys array<{KEY}>"
#: Ranges to merge: its bounds, and of each run the files that reach into it, in order.
WORK = f"grp long, range_no long, low {KEY}, high {KEY}, runs array<array<string>>"


def keyed(key: Key | None) -> dict | None:
    return None if key is None else dict(zip("abcde", key, strict=True))


def unkeyed(key: dict | None) -> Key | None:
    return None if key is None else tuple(key[c] for c in "abcde")


def runs_table(made: list[tuple[str, int, str, int, list[Key]]]) -> pa.RecordBatch:
    keys = [[keyed(k) for k in ks] for *_, ks in made]
    columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))]
    return pa.record_batch([*columns, pa.array(keys, pa.list_(KEY_TYPE))], names=["run", "part", "name", "n", "keys"])


def index_runs(folder: str, archives: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Reads the archives back, record by record, and writes their index as sorted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        rows, made, named = [], [], ""

        def close() -> None:
            name = f"run-0-{named}-{len(made):04d}.parquet"
            made.append((name, 0, name, *write_run(store, name, sorted(rows, key=order))))
            rows.clear()

        for archive in sorted(name for batch in batches for name in batch.column(0).to_pylist()):
            named = named or archive
            with store.files.open_input_stream(f"{store.top}/{archive}", compression=None) as stream:
                for offset, length, content in members(iter(lambda: stream.read(1 << 20), b"")):  # noqa: B023
                    rows.append(parsed(content) | {"archive": archive, "offset": offset, "length": length})
                    if len(rows) == run_rows:
                        close()
        if rows:
            close()
        yield runs_table(made)

    size = archives.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = partitions(archives.sparkSession, size, FILE_BYTES // 4)
    return cut(archives.select("name").repartition(tasks, "name").mapInArrow(run, RUNS))


def ranges_of(runs: DataFrame, groups: int, range_rows: int) -> DataFrame:
    """The work of merging each group of runs: ranges of about range_rows rows, by whole keys, down to the place in the
    archive, so the captures of one hot URL divide like any others."""

    def plan(key: tuple, files: pa.Table) -> pa.Table:
        files = sorted(files.to_pylist(), key=lambda f: (f["run"], f["part"]))
        files = [f | {"keys": [unkeyed(k) for k in f["keys"]]} for f in files if f["n"]]
        # each key stands for as many rows as lie up to its file's next one
        weighed = sorted((k, f["n"] / len(f["keys"])) for f in files for k in f["keys"])
        limits, size = [None], 0.0
        for k, weight in weighed:
            if size >= range_rows and k != limits[-1]:
                limits.append(k)
                size = 0.0
            size += weight
        limits.append(None)
        lasts = [g["keys"][0] if f["run"] == g["run"] else None for f, g in zip(files, [*files[1:], {"run": None}], strict=True)]
        out = []
        for number, (low, high) in enumerate(zip(limits, limits[1:], strict=False)):
            held: dict[str, list[str]] = {}
            for f, last in zip(files, lasts, strict=True):
                if (high is None or f["keys"][0] < high) and (low is None or last is None or last > low):
                    held.setdefault(f["run"], []).append(f["name"])
            out.append({"grp": key[0].as_py(), "range_no": number, "low": keyed(low), "high": keyed(high), "runs": list(held.values())})
        schema = pa.schema([("grp", pa.int64()), ("range_no", pa.int64()), ("low", KEY_TYPE), ("high", KEY_TYPE), ("runs", pa.list_(pa.list_(pa.string())))])
        return pa.Table.from_pylist(out, schema)

    return cut(runs.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups))).groupBy("grp").applyInArrow(plan, WORK))


def merged(store: Store, work: dict) -> Iterator[dict]:
    low, high = unkeyed(work["low"]), unkeyed(work["high"])
    return (row for _, row in LoserTree(Cursor(store, names, low, high) for names in work["runs"]))


def merge_runs(folder: str, runs: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """One globally ordered table of all runs: partition after partition, and within each. `range_no` and `place`
    give a row's position.

    While there are more than fan_in runs, groups of about so many are merged into longer runs, a task for each range
    of part_rows rows, which writes a file of the longer run; then every range of keys is merged from all runs by a task
    of its own. A cursor holds one block of its run and reads no block outside its range.
    """
    level = 0
    while (n := runs.select("run").distinct().count()) > fan_in:
        level += 1
        work = ranges_of(runs, -(-n // fan_in), part_rows)

        def longer(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            store = Store(folder)
            for batch in batches:
                for own in batch.to_pylist():
                    name = f"run-{level}-{own['grp']:06d}-{own['range_no']:06d}.parquet"
                    size, keys = write_run(store, name, merged(store, own))
                    if size:
                        yield runs_table([(f"{level}-{own['grp']}", own["range_no"], name, size, keys)])

        runs = cut(work.repartition(max(1, work.count()), "grp", "range_no").mapInArrow(longer, RUNS))
    work = ranges_of(runs, 1, range_rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for own in batch.to_pylist():
                rows, place = [], 0
                for row in merged(store, own):
                    rows.append(row | {"range_no": own["range_no"], "place": place})
                    place += 1
                    if len(rows) == GROUP_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, MERGED)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, MERGED)

    dealt = work.repartitionByRange(max(1, work.count()), "range_no").sortWithinPartitions("range_no")
    return dealt.mapInArrow(merge, INDEX_SQL + ", range_no long, place long")


MERGED = INDEX.append(pa.field("range_no", pa.int64())).append(pa.field("place", pa.int64()))


def read_record(folder: str, archive: str, offset: int, length: int) -> tuple[dict, bytes]:
    """One record through its index entry: what the index says, and its payload (empty for a revisit)."""
    store = Store(folder)
    with store.files.open_input_file(f"{store.top}/{archive}") as file:
        content = next(members([file.read_at(length, offset)]))[2]
    own, body = headers(content)
    return parsed(content), headers(body[: int(own["Content-Length"])])[1]


def archive_pages(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, folder: str | None = None
) -> DataFrame:
    """Writes a WARC record per page, reads the archives back and returns their index in its global order:
    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at, archive, offset, length,
    range_no, place. Archives and runs lie in `folder`, by default one of the shared store.

    Of records with equal payloads of LEAST_BYTES bytes or more, that with the smallest id is a response and the
    others revisit it; shorter ones are all responses. Null html is an empty payload, null URLs an empty one. Rows
    with a null id are responses and never referred to; repeated rows of the smallest id are all responses.
    captured: the time of capture; by default one is invented, a second for each id from the start of 2024 on, ids that
    aren't whole numbers by their hash, all within some thirty years. Ids may be of any type and size. An empty table
    gives an empty result; other columns are not read. Payloads are shuffled once, by id; equal ones meet as digests only.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    number = F.coalesce(F.col(id).cast("string").try_cast("long"), F.xxhash64(F.col(id).cast("string")))
    invented = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.when(F.col(id).isNull(), 0).otherwise(F.pmod(number, F.lit(SECONDS))))
    stamp = captured if captured is not None else invented
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes"),
    )
    large = rows.where(F.col("bytes") >= LEAST_BYTES).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = large.join(first, "digest").where("id > first").select("id", "digest", "first").distinct()
    marked = rows.drop("bytes").join(marks, ["id", "digest"], "left").select(
        F.col("id").cast("string").alias("page"), "url", "date", "html", F.col("first").cast("string").alias("refers")
    )
    archives = write_archives(marked, folder)
    index = merge_runs(folder, index_runs(folder, archives))
    kind = pages.schema[id].dataType
    own = lambda c: F.col(c).cast(kind)
    return index.select(
        own("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers").alias("refers_to"),
        "url_key", "captured_at", "archive", "offset", "length", "range_no", "place",
    )

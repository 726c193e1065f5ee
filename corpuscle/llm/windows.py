"""Near-duplicate passages across documents, found by compact windows of shingle min-hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import cut, dropped, freed, named, partitions, written
from corpuscle.llm.components import components
from corpuscle.llm.urlfilter import BlockedBloom

#: Words of a shingle and of the shortest passage; hash functions, and how many of them must agree; similarity.
SHINGLE, LEAST_WORDS, HASHES, AGREE, SIMILAR = 5, 50, 4, 2, 0.8
#: Words that a task takes at a time; words whose hashes it remembers.
CHUNK_WORDS, REMEMBERED = 1_000_000, 250_000
#: Windows of one signature up to which all pairs are listed; windows of larger ones that are compared at once.
SMALL, TOGETHER = 8, 16_384
#: Windows for which the small tables made of them get one file more.
FILE_WINDOWS = 500_000
#: Grain to which the ranges that are fetched are widened; common ranges that are held before overlapping ones are united.
GRAIN, HELD = 64, 2_000_000
#: Odd multipliers that mix bits.
MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, seen: WordHashes) -> np.ndarray:
    """A hash of each five words in a row; none for texts of fewer words."""
    words = (text or "").encode().lower().split()
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = (total ^ (own[k : k + n] + np.uint64(k + 1))) * MIX[k % 2]
    return mixed(total)


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """best() of each `width` values in a row, by doubling."""
    now, have = values, 1
    while 2 * have <= width:
        now, have = best(now[:-have], now[have:]), 2 * have
    return now if have == width else best(now[: len(now) - (width - have)], now[width - have :])


def compact_windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the compact windows of `least` positions or more: every subsequence that
    includes centre, lies within left..right and has `least` positions has its minimum at centre.

    They are the nodes of the Cartesian tree with so many positions below them. Zeros stand between texts and
    belong to no window. Positions that are the minimum of some `least` values in a row are the tree's nodes of
    that size, and the nearest smaller values of such positions are such positions, so one pass with a stack over
    them alone gives the borders. Of equal minima in one window the first stands for all.
    """
    n = len(values)
    if n < least:
        return (np.empty(0, np.int64),) * 3
    low = sliding(values, least, np.minimum)
    pad = np.zeros(least - 1, np.uint64)
    high = sliding(np.concatenate([pad, low, pad]), least, np.maximum)
    nodes = np.flatnonzero((high == values) | (values == 0))
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = [[0, -1, -1, -1]]  # value, place, left, last place of an equal value
    for at, value in zip(nodes.tolist(), values[nodes].tolist(), strict=True):
        while stack[-1][0] > value:
            top = stack.pop()
            found.append((top[2], top[1], at - 1))
        if stack[-1][0] == value:
            stack[-1][3] = at
        else:
            stack.append([value, at, stack[-1][3] + 1, at])
    for top in stack[1:]:
        found.append((top[2], top[1], n - 1))
    if not found:
        return (np.empty(0, np.int64),) * 3
    left, centre, right = np.array(found, np.int64).T
    return left, centre, right


# --- windows with equal signatures --------------------------------------------------------------

#: What a row is: a window, a note that a chunk has more than SMALL of its key, a text's length, one window of such a key.
WINDOW, NOTE, TEXT, MANY = range(4)
SIGNED = "kind int, key long, row long, l int, c int, r int"
#: Edges between windows; windows of crowded keys (a, al, ac, ar, key in b); lengths of texts (a, ar).
EDGE, CROWDED, LENGTH = range(3)
LINKED = "kind int, a long, al int, ac int, ar int, b long, bl int, bc int, br int, hash int"


def record(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in columns.values()], names=list(columns))


def signed_windows(rows: list[int], hashes: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """Windows of all texts of a chunk under all hash functions, sorted by signature, then row and place."""
    lengths = np.array([len(h) + 1 for h in hashes])
    starts = np.cumsum(lengths) - lengths
    joined = np.zeros(int(lengths.sum()), np.uint64)
    between = starts + lengths - 1
    inside = np.ones(len(joined), bool)
    inside[between] = False
    joined[inside] = np.concatenate(hashes)
    parts = []
    for number in range(HASHES):
        values = mixed(joined + np.uint64(0x9E3779B97F4A7C15 * (number + 1) & (1 << 64) - 1)) | np.uint64(HASHES)
        values[between] = 0
        left, centre, right = compact_windows(values, least)
        text = np.searchsorted(starts, centre, side="right") - 1
        key = (values[centre] & ~np.uint64(HASHES - 1) | np.uint64(number)).view(np.int64)
        parts.append((key, np.array(rows, np.int64)[text], *((x - starts[text]).astype(np.int32) for x in (left, centre, right))))
    key, row, left, centre, right = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((centre, row, key))
    return key[order], row[order], left[order], centre[order], right[order]


def windows(docs: DataFrame, least: int) -> DataFrame:
    """(row, text) -> windows, and the length of each text that is long enough. Equal texts, which have one row, come
    once from a task. A chunk that has more than SMALL windows of a key says so in a note, and its windows of that key
    need not meet the others by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = WordHashes(), set()
        rows, hashes, size = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if row in done:
                    continue
                done.add(row)
                own = shingles(text.as_py(), seen)
                if len(own) >= least:
                    rows.append(row)
                    hashes.append(own)
                    size += len(own)
                if size >= CHUNK_WORDS:
                    yield from close(rows, hashes)
                    rows, hashes, size = [], [], 0
        if rows:
            yield from close(rows, hashes)

    def close(rows: list[int], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, row, left, centre, right = signed_windows(rows, hashes, least)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, len(key)])
        many = np.repeat(sizes > SMALL, sizes)
        yield record({"kind": np.where(many, MANY, WINDOW).astype(np.int32), "key": key, "row": row, "l": left, "c": centre, "r": right})
        for kind, keys, own, ends in ((NOTE, key[first[sizes > SMALL]], None, None), (TEXT, None, rows, [len(h) for h in hashes])):
            n = len(keys if own is None else own)
            none = np.zeros(n, np.int32)
            yield record({
                "kind": none + np.int32(kind), "key": keys if own is None else np.zeros(n, np.int64), "row": np.full(n, np.iinfo(np.int64).min) if own is None else np.array(own, np.int64),
                "l": none, "c": none, "r": none if own is None else np.array(ends, np.int32),
            })

    return docs.select("row", "text").mapInArrow(run, SIGNED)


def pairs_of(key: np.ndarray, row: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:  # noqa: E741
    """All pairs of windows of equal key and different rows; runs have SMALL windows at most, sorted by row."""
    one, two = [], []
    for step in range(1, SMALL):
        hit = np.flatnonzero((key[step:] == key[:-step]) & (row[step:] != row[:-step]))
        one.append(hit)
        two.append(hit + step)
    a, b = np.concatenate(one), np.concatenate(two)
    return {
        "kind": np.full(len(a), EDGE, np.int32), "a": row[a], "al": l[a], "ac": c[a], "ar": r[a], "b": row[b], "bl": l[b], "bc": c[b], "br": r[b],
        "hash": (key[a] & (HASHES - 1)).astype(np.int32),
    }


def linked(found: DataFrame) -> DataFrame:
    """Edges between the windows of a signature; of signatures with more than SMALL windows the windows, as they are.

    A task that meets a signature's windows holds SMALL of them at most: from the next one on, and after a note, they
    are passed on one by one."""
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def passed(own: np.ndarray, kind: int) -> pa.RecordBatch:
        _, key, row, left, centre, right = own
        none = np.zeros(len(key), np.int32)
        small = lambda x: x.astype(np.int32)
        return record({
            "kind": none + np.int32(kind), "a": row, "al": small(left), "ac": small(centre), "ar": small(right), "b": key, "bl": none, "bc": none, "br": none,
            "hash": small(key & (HASHES - 1)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = np.empty((6, 0), np.int64), None
        for batch in batches:
            own = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
            for kind, to in ((TEXT, LENGTH), (MANY, CROWDED)):
                out = own[0] == kind
                if out.any():
                    yield passed(own[:, out], to)
            own = own[:, own[0] <= NOTE]
            if hot is not None and own.shape[1]:
                same = (own[1] == hot) & (own[0] == WINDOW)
                if same.any():
                    yield passed(own[:, same], CROWDED)
                rest = own[1] != hot
                hot = hot if not rest.any() else None
                own = own[:, rest]
            own = np.concatenate([held, own], axis=1)
            if not own.shape[1]:
                continue
            again = np.r_[False, (own[1:4, 1:] == own[1:4, :-1]).all(axis=0) & (own[4, 1:] == own[4, :-1])]
            own = own[:, ~again]
            last = int(np.searchsorted(own[1], own[1, -1]))
            yield from closed(own[:, :last])
            held = own[:, last:]
            if held.shape[1] > SMALL or held[0, 0] == NOTE:
                hot = int(held[1, 0])
                yield passed(held[:, held[0] == WINDOW], CROWDED)
                held = held[:, :0]
        yield from closed(held)

    def closed(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not own.shape[1]:
            return
        first = np.flatnonzero(np.r_[True, own[1, 1:] != own[1, :-1]])
        sizes = np.diff(np.r_[first, own.shape[1]])
        many = np.repeat((sizes > SMALL) | (own[0, first] == NOTE), sizes)
        crowded = own[:, many & (own[0] == WINDOW)]
        if crowded.shape[1]:
            yield passed(crowded, CROWDED)
        rest = own[:, ~many]
        if rest.shape[1]:
            key, row, *ranges = rest[1:]
            edges = pairs_of(key, row, *(x.astype(np.int32) for x in ranges))
            if len(edges["a"]):
                yield record(edges)

    late = F.col("kind") >= TEXT
    dealt = found.withColumn("late", late).repartition(F.when(late, F.xxhash64("row", "c")).otherwise(F.col("key")))
    # notes have the least row, so they come first of their key
    return dealt.sortWithinPartitions("late", "key", "row", "c").select(*names).mapInArrow(run, LINKED)


def whole_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches, dealt anew so that rows with equal values of `by` are together."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        own = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, bool)
        for n in by:
            differs |= own[n] != own[n][-1]
        last = int(differs.nonzero()[0][-1]) + 1 if differs.any() else 0
        if last or (held and any(held[-1][n][-1] != own[n][0] for n in by)):
            head = {n: np.concatenate([*(h[n] for h in held), v[:last]]) for n, v in own.items()}
            held = []
            if len(head[by[0]]):
                yield head
        held.append({n: v[last:] for n, v in own.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


# --- crowded signatures -------------------------------------------------------------------------


class Sets:
    """Sets of numbers below n, joined by links: root[x] names the set of x."""

    def __init__(self, n: int, one: np.ndarray, two: np.ndarray) -> None:
        now = np.arange(n)
        while True:
            least = np.minimum(now[one], now[two])
            after = now.copy()
            np.minimum.at(after, now[one], least)
            np.minimum.at(after, now[two], least)
            after = after[after]
            if (after == now).all():
                break
            now = after
        self.root = now

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[a]] = self.root[b]


def aligned(parts: list[np.ndarray], before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows' hashes side by side, their centres in column least - 1; and which cells hold one."""
    width = 2 * least - 1
    out, there = np.zeros((len(parts), width), np.int32), np.zeros((len(parts), width), bool)
    lengths = np.array([len(p) for p in parts])
    line = np.repeat(np.arange(len(parts)), lengths)
    column = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(least - 1 - before, lengths)
    out[line, column], there[line, column] = np.concatenate(parts), True
    return out, there


def equal_passages(group: np.ndarray, row: np.ndarray, cells: np.ndarray, there: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(one, two, from, to): for each window and each `least` columns around its centre the first window of another row
    that has the same hashes there, runs of columns put together: half-open. So windows that share a range that long
    are linked over the first that has it, however many they are."""
    power = np.cumprod(np.full(cells.shape[1], MIX[0]), dtype=np.uint64)
    sums = np.concatenate([np.zeros((len(cells), 1), np.uint64), np.cumsum(mixed(cells.astype(np.uint64) + np.uint64(1)) * power, axis=1, dtype=np.uint64)], axis=1)
    known = np.concatenate([np.zeros((len(cells), 1), np.int32), np.cumsum(there, axis=1, dtype=np.int32)], axis=1)
    line, at = np.nonzero(known[:, least:] - known[:, :-least] == least)
    value = (sums[line, at + least] - sums[line, at]) ^ mixed(group[line].astype(np.uint64) * np.uint64(64) + at.astype(np.uint64))
    order = np.lexsort((line, value))
    line, at, value = line[order], at[order], value[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.empty(0, bool)
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    first = line[start][run]
    other = row[line] != row[first]
    # of a run's rows, windows come sorted by row: the first of another row than the first one
    second = np.full(len(start), -1)
    change = np.flatnonzero(other)
    held, where = np.unique(run[change], return_index=True)
    second[held] = line[change[where]]
    partner = np.where(other, first, second[run])
    hit = (partner >= 0) & (other | (line != first))
    one, two, at = line[hit], partner[hit], at[hit]
    order = np.lexsort((at, two, one))
    one, two, at = one[order], two[order], at[order]
    begin = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (at[1:] != at[:-1] + 1)]) if len(one) else np.empty(0, np.int64)
    end = np.r_[begin[1:], len(one)] - 1 if len(one) else begin
    one, two, low, high = one[begin], two[begin], at[begin], at[end] + least
    same = np.concatenate([np.zeros((len(one), 1), np.int32), np.cumsum(cells[one] == cells[two], axis=1, dtype=np.int32)], axis=1)
    k = np.arange(len(one))
    fine = same[k, high] - same[k, low] == high - low
    return one[fine], two[fine], low[fine], high[fine]


def near_passages(
    own: np.ndarray, row: np.ndarray, parts: list[np.ndarray], cells: np.ndarray, there: np.ndarray, sets: Sets, least: int, similar: float
) -> Iterator[tuple[int, int, list]]:
    """Of one signature's windows (their numbers `own`) the links that join what similar passages join and equal ones have
    not joined. Two windows with such passages share one of the rarest hashes of each, as many as the similarity leaves
    room for; what so meets is compared unless it is joined already. No pair of windows is left out: of two that are
    not joined one at least lies outside the largest set, and those outside look for all others."""
    have, m = there[own], len(own)
    values, token = np.unique(cells[own][have], return_inverse=True)
    pairs = np.unique(np.nonzero(have)[0] * len(values) + token)
    holder, held = np.divmod(pairs, len(values))
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(np.bincount(held), kind="stable")] = np.arange(len(values))
    ranks = np.full(have.shape, len(values))
    ranks[have] = rank[token]
    held = rank[held]
    order = np.lexsort((held, holder))
    holder, held = holder[order], held[order]
    sizes = np.bincount(holder, minlength=m)
    ends = np.cumsum(sizes)
    repeats = have.sum(axis=1) - sizes
    common = np.ceil((similar * (least - repeats) if repeats.any() else np.full(m, 2 * similar / (1 + similar) * least)) - 1e-9)
    room = np.maximum(sizes - np.maximum(common, 1).astype(np.int64) + 1, 0)
    early = np.arange(len(held)) - np.repeat(ends - sizes, sizes) < np.repeat(room, sizes)
    order = np.argsort(held[early], kind="stable")
    list_token, list_holder = held[early][order], holder[early][order]
    local = np.full(len(values) + 1, -1)
    share = 2 * similar / (1 + similar)

    def holds(match: np.ndarray) -> np.ndarray:
        """Which lines have `least` cells or more in a row of which `share` match."""
        total = np.zeros((len(match), match.shape[1] + 1))
        np.cumsum(match - share, axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total[:, : total.shape[1] - least], axis=1)
        return (total[:, least:] - low >= -1e-9).any(axis=1)

    def compare(i: int, others: np.ndarray) -> Iterator[tuple[int, int, list]]:
        mine = ranks[i][have[i]]
        different = np.unique(mine)
        local[different] = np.arange(len(different))
        for at in range(0, len(others), 512):
            now = others[at : at + 512]
            now = now[sets.root[own[now]] != sets.root[own[i]]]
            place = local[ranks[now]]
            fits = holds(place >= 0)
            now, place = now[fits], place[fits]
            there_too = np.zeros((len(now), len(different) + 1), bool)
            there_too[np.arange(len(now))[:, None], place] = True  # the last column takes what isn't in i
            for j in now[holds(there_too[:, local[mine]])].tolist():
                if sets.root[own[i]] != sets.root[own[j]] and (found := verified(parts[own[i]], parts[own[j]], least, similar)):
                    sets.join(int(own[i]), int(own[j]))
                    yield int(own[i]), int(own[j]), found
        local[different] = -1

    roots, counts = np.unique(sets.root[own], return_counts=True)
    outside = sets.root[own] != roots[counts.argmax()]
    first = int(np.flatnonzero(~outside)[0])
    yield from compare(first, np.flatnonzero(outside & (row[own] != row[own[first]])))
    for i in np.flatnonzero(outside).tolist():
        if sets.root[own[i]] == sets.root[own[first]]:
            continue
        heads = held[ends[i] - sizes[i] : ends[i] - sizes[i] + room[i]]
        bounds = zip(np.searchsorted(list_token, heads, "left").tolist(), np.searchsorted(list_token, heads, "right").tolist(), strict=True)
        met = [list_holder[x:z] for x, z in bounds if z - x > 1]
        if met:
            met = np.unique(np.concatenate(met))
            yield from compare(i, met[((met > i) | ~outside[met]) & (row[own[met]] != row[own[i]])])


def linked_windows(
    group: np.ndarray, row: np.ndarray, centre: np.ndarray, low: np.ndarray, parts: list[np.ndarray], least: int, similar: float
) -> list[tuple]:
    """Verified passages, as in PASSAGES, around the windows' centres that join all windows of a group
    that have similar passages there. Windows come sorted by group, then row; parts hold their hashes from `low` on."""
    cells, there = aligned(parts, centre - low, least)
    one, two, begin, end = equal_passages(group, row, cells, there, least)
    left = centre.astype(np.int64) - (least - 1)
    sides = [[row[k], *[left[k] + begin, left[k] + end] * 2] for k in (one, two)]
    out = list(zip(*(x.tolist() for x in (*sides[0], *sides[1], np.ones(len(one)))), strict=True))
    sets = Sets(len(row), one, two)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
        own = np.arange(at, end)
        if row[at] != row[end - 1] and (sets.root[own] != sets.root[at]).any():
            for i, j, found in near_passages(own, row, parts, cells, there, sets, least, similar):
                x, y = int(low[i]), int(low[j])
                out += [(int(row[i]), *(x + k for k in a), int(row[j]), *(y + k for k in b), s) for a, b, s in found]
    return out


def crowded_passages(crowd: DataFrame, parts: DataFrame, least: int, similar: float) -> DataFrame:
    """Windows of crowded signatures (key, row, c, al, ar, low, high) and their texts' parts -> verified passages. A
    signature's windows are dealt into blocks, and each pair of blocks is a group of its own: every pair meets, in
    tasks of bounded memory; only links that join windows come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for own in whole_runs(batches, ["key"]):
            held.append(own)
            if sum(len(h["key"]) for h in held) >= TOGETHER:
                yield close(held)
                held = []
        if held:
            yield close(held)

    def close(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        key, row, c, low, part = (np.concatenate([h[n] for h in held]) for n in ("key", "row", "c", "low", "part"))
        keep = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (c[1:] != c[:-1])]
        key, row, c, low, part = (x[keep] for x in (key, row, c, low, part))
        return passage_rows(linked_windows(key, row, c, low, [np.frombuffer(x, np.int32) for x in part], least, similar))

    sizes = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last")
    n = sizes.select("key", F.ceil(2 * F.col("n") / TOGETHER).cast("int").alias("blocks"))
    dealt = crowd.join(n, "key").withColumn("block", F.pmod(F.xxhash64("row", "c"), "blocks").cast("int"))
    own = F.expr("substring(part, 4 * (low - al) + 1, 4 * (high - low + 1))").alias("part")
    held = dealt.join(parts.select("row", F.col("l").alias("al"), F.col("r").alias("ar"), "part"), ["row", "al", "ar"])
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = held.select("key", "row", "c", "low", own, "block", every)
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
    return pairs.select(group, "row", "c", "low", "part").repartition("key").sortWithinPartitions("key", "row", "c").mapInArrow(run, PASSAGES)


# --- pairs of documents -------------------------------------------------------------------------

REGION = "a long, a1 int, a2 int, b long, b1 int, b2 int"
#: Ranges of shingles of both sides, and within them the ranges from the first to the last that the other side has, too.
PASSAGES = "a long, a1 int, a2 int, a3 int, a4 int, b long, b1 int, b2 int, b3 int, b4 int, similarity double"


def passage_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 4] * 2 + [pa.float64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PASSAGES.split(", ")])


def split_at_gaps(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges, as an order of them and the number of the cluster of each: those of a group that overlap are one."""
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    number = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    span = int(high.max(initial=0)) + 2
    reach = np.maximum.accumulate(high + number * span)
    return order, np.cumsum(np.r_[True, low[1:] + number[1:] * span > reach[:-1]]) - 1


def joined_ranges(ranges: np.ndarray) -> np.ndarray:
    """Rows (pair, a1, a2, b1, b2): those of a pair that overlap on both sides are one."""
    pair, a1, a2, b1, b2 = ranges
    whose = pair
    for low, high in ((a1, a2), (b1, b2), (a1, a2)):
        order, cluster = split_at_gaps(pair, low, high)
        pair = np.empty(len(order), np.int64)
        pair[order] = cluster
    order = np.argsort(pair, kind="stable")
    start = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
    return np.stack([
        whose[order[start]], np.minimum.reduceat(a1[order], start), np.maximum.reduceat(a2[order], start),
        np.minimum.reduceat(b1[order], start), np.maximum.reduceat(b2[order], start),
    ])


def agreeing(own: dict[str, np.ndarray], least: int) -> dict[str, np.ndarray]:
    """The interval join: edges of one pair of documents, from different hash functions, whose windows have `least`
    positions in common on both sides. Edges come sorted by pair and al; each is compared with all that begin inside it.
    The common ranges, united where they overlap on both sides."""
    pair = np.cumsum(np.r_[False, (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1])])
    out, size, step, live = [np.empty((5, 0), np.int64)], 0, 1, np.arange(len(pair) - 1)
    while len(live):
        after = live + step
        near = pair[after] == pair[live]
        near &= own["al"][after] <= own["ar"][live] - least + 1
        live, after = live[near], after[near]
        a1, a2 = own["al"][after], np.minimum(own["ar"][live], own["ar"][after])
        b1, b2 = np.maximum(own["bl"][live], own["bl"][after]), np.minimum(own["br"][live], own["br"][after])
        hit = (own["hash"][live] != own["hash"][after]) & (a2 - a1 + 1 >= least) & (b2 - b1 + 1 >= least)
        out.append(np.stack([pair[live][hit], a1[hit], a2[hit], b1[hit], b2[hit]]).astype(np.int64))
        size += out[-1].shape[1]
        if size > HELD:
            out = [joined_ranges(np.concatenate(out, axis=1))]
            size = out[0].shape[1]
        step += 1
        live = live[live + step < len(pair)]
    whole = np.concatenate(out, axis=1)
    if whole.shape[1]:
        whole = joined_ranges(whole)
    first = np.searchsorted(pair, whole[0])
    small = lambda x: x.astype(np.int32)
    return {"a": own["a"][first], "a1": small(whole[1]), "a2": small(whole[2]), "b": own["b"][first], "b1": small(whole[3]), "b2": small(whole[4])}


def regions(edges: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_runs(batches, ["a", "b"]):
            found = agreeing(own, least)
            if len(found["a"]):
                yield record(found)

    return edges.repartition("a", "b").sortWithinPartitions("a", "b", "al").mapInArrow(run, REGION)


def longest(match: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch of which at least `share` matches, as a half-open range."""
    total = np.concatenate([[0.0], np.cumsum(np.where(match, 1 - share, -share))])
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -(total + 1e-9), side="left")
    end = int(np.argmax(np.arange(len(total)) - first))
    return int(first[end]), end


def trimmed(match: np.ndarray, i: int, j: int, least: int) -> tuple[int, int]:
    """Without what doesn't match at the ends, as far as `least` positions are left."""
    hits = np.flatnonzero(match[i:j])
    if len(hits):
        i, j = max(i, min(i + int(hits[0]), j - least)), max(i + int(hits[-1]) + 1, min(j, i + int(hits[0]) + least))
    return i, j


def ends(hits: np.ndarray, low: int) -> tuple[int, int]:
    found = np.flatnonzero(hits)
    return low + int(found[0]), low + int(found[-1]) + 1


def verified(one: np.ndarray, two: np.ndarray, least: int, similar: float) -> list[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """Passages of two shingle sequences, `least` shingles or more on both sides, whose sets have a Jaccard
    similarity of `similar` or more: (range, range, similarity), half-open, the longest first, then what is left of it
    and right of it. After a range's ends come those of what the other side has of it."""
    share = 2 * similar / (1 + similar)  # of both sides' shingles, when both have as many
    shares = (share, (1 + share) / 2, 1.0)  # stricter where a stretch that matches well enough pairs with one that doesn't
    out, open_ = [], [(0, len(one), 0)]
    first, second = one.tolist(), two.tolist()  # the ranges are short, so sets beat sorting
    among = lambda values, known: np.fromiter(map(known.__contains__, values), bool, len(values))
    whole = among(first, set(second))
    while open_:
        low, high, level = open_.pop()
        if high - low < least:
            continue
        match = whole[low:high]
        i, j = longest(match, shares[level])
        if j - i < least:
            continue
        i, j = (low + x for x in trimmed(match, i, j, least))
        x = set(first[i:j])
        other = among(second, x)
        p, q = longest(other, shares[level])
        alike = 0.0
        if q - p >= least:
            p, q = trimmed(other, p, q, least)
            y = set(second[p:q])
            both = len(x & y)
            alike = both / (len(x) + len(y) - both)
        if alike >= similar:
            out.append(((i, j, *ends(match[i - low : j - low], i)), (p, q, *ends(other[p:q], p)), alike))
        elif level + 1 < len(shares):
            open_.append((low, high, level + 1))
            continue
        open_ += [(low, i, 0), (j, high, 0)]
    return out


def slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, l, r, part): the wanted ranges of shingles, as 32-bit hashes. A Bloom filter of bounded size keeps documents of
    which nothing is wanted from being shuffled; ranges of one text are distinct and widened to a grain, so their
    number depends on its length alone. Of equal texts a task passes on one."""
    per_row = wanted.groupBy("row").agg(F.collect_set(F.struct("l", "r")).alias("ranges"))
    bloom = docs.sparkSession.sparkContext.broadcast(BlockedBloom.of(per_row.select(F.col("row").cast("string").alias("key"))).blocks)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = BlockedBloom(bloom.value), set()
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("row").to_pylist()
                keep = held.may_hold([str(r).encode() for r in rows]).tolist()
                for k, r in enumerate(rows):
                    keep[k] = keep[k] and r not in done
                    if keep[k]:
                        done.add(r)
                yield batch.filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            ranges, parts = batch.column("ranges"), []
            ends = ranges.offsets.to_numpy()
            low, high = (ranges.values.field(k).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for k in (0, 1))
            for k, text in enumerate(batch.column("text")):
                own = (shingles(text.as_py(), seen) >> np.uint64(32)).astype(np.uint32).tobytes()
                mine = slice(ends[k] - ends[0], ends[k + 1] - ends[0])
                parts += [own[4 * x : 4 * (z + 1)] for x, z in zip(low[mine].tolist(), high[mine].tolist(), strict=True)]
            rows = np.repeat(batch.column("row").to_numpy(), np.diff(ends))
            yield pa.record_batch([pa.array(rows), pa.array(low), pa.array(high), pa.array(parts, pa.binary())], names=["row", "l", "r", "part"])

    picked = docs.select("row", "text").mapInArrow(pick, "row long, text string")
    joined = picked.join(per_row, "row").dropDuplicates(["row"]).select("row", "text", "ranges")
    return joined.mapInArrow(run, "row long, l int, r int, part binary")


def checked(pairs: DataFrame, parts: DataFrame, least: int, similar: float) -> DataFrame:
    """The verified passages of each region: half-open ranges of shingles of both documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            cells = (batch.column(n).to_pylist() for n in ("a", "a1", "a2", "al", "b", "b1", "b2", "bl"))
            for a, a1, a2, al, b, b1, b2, bl, x, y in zip(*cells, batch.column("part_a"), batch.column("part_b"), strict=True):
                one = np.frombuffer(x.as_buffer(), np.int32)[a1 - al : a2 - al + 1]
                two = np.frombuffer(y.as_buffer(), np.int32)[b1 - bl : b2 - bl + 1]
                rows += [(a, *(a1 + k for k in i), b, *(b1 + k for k in j), s) for i, j, s in verified(one, two, least, similar)]
            yield passage_rows(rows)

    for side in "ab":
        own = parts.select(*[F.col(c).alias(n) for c, n in (("row", side), ("l", f"{side}l"), ("r", f"{side}r"), ("part", f"part_{side}"))])
        pairs = pairs.join(own, [side, f"{side}l", f"{side}r"])
    return pairs.select("a", "a1", "a2", "al", "b", "b1", "b2", "bl", "part_a", "part_b").mapInArrow(run, PASSAGES)


def passages(
    docs: DataFrame, text: str = "text", id: str = "doc_id", least_words: int = LEAST_WORDS, similar: float = SIMILAR
) -> DataFrame:
    """One row for each passage that another document has, too: doc_id, start_word, end_word (half-open), class_id,
    class_size, similarity.

    Two documents share a passage if each has least_words words or more in a row such that the two sets of five-word
    shingles (A-Z lower-cased) have a Jaccard similarity of `similar` or more. Overlapping passages of a document are
    one. Passages that are linked, directly or over others, are a class: class_id is the smallest doc_id in it,
    class_size its passages; similarity is the best of the passage's own links. Clean documents have no row.

    Texts of fewer words have no passage, nor have null and empty ones. Rows with equal id and text are one document;
    null ids are ids. Documents with one text share all of it. An empty table gives an empty result; other columns are
    not read.

    Windows under HASHES min-hashes meet by signature. Of signatures with few windows all pairs are edges, and pairs of
    documents that AGREE hashes link over a common range are candidates, each verified on its shingles. Windows of
    crowded signatures are compared on the shingles around their centres, so that all that share a passage there are
    joined. A pair that shares its passage exactly is found; at a similarity of 0.8 two of four hashes agree with a
    probability of 0.97.
    """
    least = least_words - SHINGLE + 1
    docs = named(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", "row")
    names = written(docs.select("row", "doc_id").distinct(), "names", narrow=True)
    found = written(linked(windows(docs, least)), "window-links")
    freed(docs.sparkSession)
    files = partitions(docs.sparkSession, found.count(), FILE_WINDOWS)
    near = cut(regions(found.where(F.col("kind") == EDGE), least).repartition(files))
    freed(docs.sparkSession)
    snap = lambda c, up: ((F.floor(F.col(c) / GRAIN) + up) * GRAIN - up).cast("int")
    pairs = near.select("*", snap("a1", 0).alias("al"), snap("a2", 1).alias("ar"), snap("b1", 0).alias("bl"), snap("b2", 1).alias("br"))
    low, high = F.greatest("al", F.col("ac") - (least - 1)).alias("low"), F.least("ar", F.col("ac") + (least - 1)).alias("high")
    crowd = found.where(F.col("kind") == CROWDED).select(F.col("b").alias("key"), F.col("a").alias("row"), F.col("ac").alias("c"), low, high)
    crowd = crowd.select("*", snap("low", 0).alias("al"), snap("high", 1).alias("ar"))
    wanted = pairs.selectExpr("a row", "al l", "ar r").unionByName(pairs.selectExpr("b row", "bl l", "br r")).unionByName(crowd.selectExpr("row", "al l", "ar r"))
    parts = written(slices(docs, wanted.distinct()).repartition(files), "slices")
    freed(docs.sparkSession)
    shared = cut(checked(pairs, parts, least, similar).coalesce(files))  # one after the other: their shuffles don't add up on disk
    freed(docs.sparkSession)
    shared = cut(shared.unionByName(crowded_passages(crowd, parts, least, similar)).distinct().coalesce(files))
    dropped(parts)
    many = names.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    copies = found.where(F.col("kind") == LENGTH).selectExpr("a row", "0 s", "ar e", "1D similarity").join(many, "row", "left_semi")
    side = lambda k: shared.selectExpr(f"{k} row", f"{k}1 s", f"{k}2 e", f"{k}3 s_own", f"{k}4 e_own", "similarity")
    sides = side("a").unionByName(side("b")).unionByName(copies.selectExpr("*", "s s_own", "e e_own"))
    spans = sides.groupBy("row", "s", "e").agg(F.min("s_own").alias("s_own"), F.max("e_own").alias("e_own"), F.max("similarity").alias("similarity"))
    united = cut(unite(spans).coalesce(files))
    dropped(found)
    nodes = cut(united.select("row", "first").distinct().coalesce(files).withColumn("node", F.monotonically_increasing_id()))
    united = cut(united.join(nodes, ["row", "first"]).coalesce(files))
    ends = united.select("row", "s", "e", "node")
    links = shared.join(ends.selectExpr("row a", "s a1", "e a2", "node node_a"), ["a", "a1", "a2"])
    links = links.join(ends.selectExpr("row b", "s b1", "e b2", "node node_b"), ["b", "b1", "b2"])
    roots = components(links.selectExpr("node_a a", "node_b b"))
    extent = [f(c).alias(c) for f, cs in ((F.min, ("s", "s_own")), (F.max, ("e", "e_own", "similarity"))) for c in cs]
    whole = united.groupBy("node", "row").agg(*extent)
    long_ = F.col("e_own") - F.col("s_own") >= least  # else the words around make up the least length
    whole = whole.select("node", "row", "similarity", *[F.when(long_, F.col(f"{c}_own")).otherwise(F.col(c)).alias(c) for c in "se"])
    whole = whole.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_ = cut(whole.join(names, "row").coalesce(files))  # so that classes are counted map-side before they are dealt out
    classes = named_.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named_.join(classes, "root").select(
        "doc_id", F.col("s").alias("start_word"), (F.col("e") + SHINGLE - 1).alias("end_word"), "class_id", "class_size", "similarity"
    )


def unite(spans: DataFrame) -> DataFrame:
    """Adds to each span of a row the start of the first of those that it overlaps with, directly or over others."""
    before = Window.partitionBy("row").orderBy("s", "e")
    reach = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") >= reach), F.col("s"))
    return spans.withColumn("first", F.last(fresh, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))

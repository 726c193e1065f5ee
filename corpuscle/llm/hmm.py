"""A hidden Markov language model: Baum-Welch over the whole training corpus, exact likelihoods by scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import partitions, scratch_path, written

#: Hidden states.
STATES = 8
#: The model's vocabulary: words with an emission of their own, at most, and their least count; the rest emit one of
#: CLASSES shapes. Longer words than KEY_BYTES go by their first bytes and a digest, so a key's size is bounded.
HEAD_WORDS, HEAD_LEAST, CLASSES, KEY_BYTES = 1 << 18, 16, 256, 64
#: Share of the training rows that each round of Baum-Welch goes over, at every size of the corpus.
ROUNDS = (1 / 16, 1 / 16, 1 / 16, 1 / 4, 1.0, 1.0)
#: Training tokens of a task, about: each hands on a table of all symbols.
TASK_TOKENS = 8_000_000
#: Weight, in tokens, of the unigram distribution in each state's emissions.
PRIOR = 100.0
#: Tokens of a segment; longer texts are cut, and joined again through their segments' transfer matrices.
SEGMENT = 1024
#: Tokens whose messages are held at a time; distinct words that a task counts before it hands them on; symbols of a block of counts.
CHUNK, COUNTED, BLOCK = 1 << 18, 400_000, 4096
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then the end, which is the empty word. A word of more than
    KEY_BYTES bytes is named by one byte more than that, of which sixteen are its digest."""
    words = (text or "").encode().lower().split()
    if words and max(map(len, words)) > KEY_BYTES:
        words = [w if len(w) <= KEY_BYTES else w[: KEY_BYTES - 15] + xxhash.xxh3_128_digest(w) for w in words]
    words.append(END)
    return words


def shape(word: bytes) -> int:
    """The class of a word outside the head: by its last two bytes."""
    return xxhash.xxh32_intdigest(word[-2:]) % CLASSES


class Symbols(dict):
    """The symbol of each word: its place among the frequent ones, else one after them for its shape. The latter are
    remembered up to COUNTED words."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.size, self.rare = len(words), []

    def __missing__(self, word: bytes) -> int:
        if len(self.rare) >= COUNTED:
            for w in self.rare:
                del self[w]
            self.rare.clear()
        self.rare.append(word)
        value = self[word] = self.size + shape(word)
        return value


@dataclass
class Head:
    """The frequent words, and what the rest amount to."""

    words: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def index(self) -> Symbols:
        return Symbols(self.words)

    def unigram(self) -> np.ndarray:
        """The symbols' smoothed distribution; a class has half a count for each of its words and one for unknown ones."""
        weight = np.concatenate([self.counts + 0.5, self.class_tokens + 0.5 * (self.class_words + 1)])
        return weight / weight.sum()


@dataclass
class Model:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


# --- messages -----------------------------------------------------------------------------------


def cuts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that stand one after another: first token, length, text and number within the text."""
    per = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(lengths) - lengths, per) + number * SEGMENT
    return first, np.minimum(np.repeat(lengths, per) - number * SEGMENT, SEGMENT), text, number


def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Segments by falling length, in groups of about CHUNK tokens."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[order[at]] + CHUNK, side="right")))
        yield order[at:to]
        at = to


def transfers(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For full segments the matrices that lead from the distribution of the state at their first token, over
    their tokens, to that at the token after; scaled to sum to one."""
    k = len(model.start)
    out = np.empty((len(first), k, k))
    step = 1024
    for at in range(0, len(first), step):
        own = first[at : at + step]
        now = np.broadcast_to(np.eye(k), (len(own), k, k))
        for t in range(SEGMENT):
            now = (now * model.emit[symbols[own + t]][:, None, :]).reshape(-1, k) @ model.move
            now = now.reshape(len(own), k, k)
            if t % 8 == 7 or t + 1 == SEGMENT:
                now /= now.sum(axis=(1, 2), keepdims=True)
        out[at : at + step] = now
    return out


def entries(model: Model, links: np.ndarray, linked: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The distribution of the state at each segment's first token, given all tokens before: `links` has the
    transfer matrices of the segments for which `linked` holds, those that another one follows."""
    out = np.broadcast_to(model.start, (len(number), len(model.start))).copy()
    place = np.cumsum(linked) - 1
    for wave in range(1, int(number.max(initial=0)) + 1):
        own = np.flatnonzero(number == wave)
        now = np.einsum("sk,skj->sj", out[own - 1], links[place[own - 1]])
        out[own] = now / now.sum(axis=1, keepdims=True)
    return out


class Layout:
    """Tokens of a group of segments by time: column t has the t-th token of all segments that are that long."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        steps = int(length[0])  # segments come by falling length
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        self.bounds = np.concatenate([[0], np.cumsum(active)])
        self.symbols = np.concatenate([symbols[first[:n] + t] for t, n in enumerate(active)])
        self.active = active


def forward(model: Model, lay: Layout, entry: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log likelihood of each segment, given its entry; and the filtered state distributions, if kept."""
    emitted = model.emit[lay.symbols]
    scale = np.empty(len(lay.symbols))
    kept = np.empty_like(emitted) if keep else None
    now = entry
    for t, n in enumerate(lay.active):
        a, z = lay.bounds[t], lay.bounds[t + 1]
        now = now[:n] * emitted[a:z]
        total = now.sum(axis=1)
        now /= total[:, None]
        scale[a:z] = total
        if kept is not None:
            kept[a:z] = now
        now = now @ model.move
    logs, out = np.log(scale), np.zeros(len(entry))
    for t, n in enumerate(lay.active):
        out[:n] += logs[lay.bounds[t] : lay.bounds[t + 1]]
    return out, kept


def log_likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's probability: exact, whatever its length."""
    first, length, text, number = cuts(lengths)
    linked = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    entry = entries(model, transfers(model, symbols, first[linked]), linked, number)
    out = np.zeros(len(lengths))
    for own in groups(length):
        logs, _ = forward(model, Layout(symbols, first[own], length[own]), entry[own])
        np.add.at(out, text[own], logs)
    return out


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float


def backward(
    model: Model, lay: Layout, exit_: np.ndarray, kept: np.ndarray | None = None, counts: Counts | None = None
) -> np.ndarray:
    """The likelihood of each segment's tokens and what follows, by the state at its first token, up to a factor.
    exit_: the same for what follows, by the state at the last token. Adds expected counts, if asked to."""
    emitted = model.emit[lay.symbols]
    k = len(model.start)
    now = exit_.copy()
    start = np.empty_like(now)
    shares = np.empty_like(emitted) if counts else None
    ahead = np.zeros((0, k))
    for t in range(len(lay.active) - 1, -1, -1):
        a, z, n = lay.bounds[t], lay.bounds[t + 1], lay.active[t]
        after = len(ahead)
        beta = now[:n]
        if after:
            beta[:after] = ahead @ model.move.T
        if counts:
            own = kept[a:z] * beta
            own /= own.sum(axis=1, keepdims=True)
            shares[a:z] = own
            if after:
                left = kept[a : a + after]
                norm = ((left @ model.move) * ahead).sum(axis=1)
                counts.move += model.move * (left.T @ (ahead / norm[:, None]))
        ahead = emitted[a:z] * beta
        ahead /= ahead.sum(axis=1, keepdims=True)
        start[:n] = ahead
    if counts:
        for state in range(k):
            counts.emit[:, state] += np.bincount(lay.symbols, shares[:, state], minlength=len(counts.emit))
    return start


def expected(model: Model, symbols: np.ndarray, lengths: np.ndarray, counts: Counts) -> None:
    """Adds the texts' expected counts (the E step of Baum-Welch)."""
    first, length, text, number = cuts(lengths)
    linked = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    links = transfers(model, symbols, first[linked])
    entry = entries(model, links, linked, number)
    k = len(model.start)
    future = np.ones((len(first), k))  # of a segment and all after it, by the state at its first token
    last = np.flatnonzero(~linked & (number > 0))
    for own in groups(length[last]):
        own = last[own]
        future[own] = backward(model, Layout(symbols, first[own], length[own]), np.ones((len(own), k)))
    place = np.cumsum(linked) - 1
    for wave in range(int(number.max(initial=0)) - 1, -1, -1):
        own = np.flatnonzero(linked & (number == wave))
        now = np.einsum("skj,sj->sk", links[place[own]], future[own + 1])
        future[own] = now / now.sum(axis=1, keepdims=True)
    exit_ = np.ones((len(first), k))
    exit_[linked] = future[np.flatnonzero(linked) + 1] @ model.move.T
    for own in groups(length):
        lay = Layout(symbols, first[own], length[own])
        logs, kept = forward(model, lay, entry[own], keep=True)
        begun = backward(model, lay, exit_[own], kept, counts)
        whole = entry[own] * begun
        whole /= whole.sum(axis=1, keepdims=True)
        counts.start += whole[number[own] == 0].sum(axis=0)
        # moves into the first token of the next segment
        followed = linked[own]
        if followed.any():  # such segments are full, and full ones come first
            ends = kept[lay.bounds[SEGMENT - 1] :][followed[: lay.active[SEGMENT - 1]]]
            ahead = future[own[followed] + 1]
            norm = ((ends @ model.move) * ahead).sum(axis=1)
            counts.move += model.move * (ends.T @ (ahead / norm[:, None]))
        counts.log += logs.sum()


def no_counts(states: int, symbols: int) -> Counts:
    return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0)


def maximised(counts: Counts, unigram: np.ndarray, prior: float = PRIOR) -> Model:
    """The M step. Emissions are drawn to the unigram distribution, so every symbol has a probability in each state."""
    k = len(counts.start)
    start = counts.start + 1 / k
    move = counts.move + 1 / k
    emit = counts.emit + prior * unigram[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(symbols: np.ndarray, lengths: np.ndarray, unigram: np.ndarray, states: int, rounds: int, seed: int = 3) -> Model:
    """From random emissions and states that tend to stay, by rounds of Baum-Welch on texts at hand."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), states)) + 1e-12
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    for _ in range(rounds if len(lengths) else 0):
        counts = no_counts(states, len(unigram))
        expected(model, symbols, lengths, counts)
        model = maximised(counts, unigram)
    return model


# --- the corpus ---------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, shape, n) over all tokens of the column `text`. Tasks count first and hand on partial counts."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.record_batch(
            [pa.array(words, pa.binary()), pa.array([shape(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "shape", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    partial = texts.select("text").mapInArrow(run, "word binary, shape int, n long")
    return partial.groupBy("word", "shape").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, head_words: int) -> Head:
    """Words at least as frequent as the least count of which there are no more than head_words, HEAD_LEAST or more, and the end."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    best = counts.where(F.col("n") >= HEAD_LEAST).select("n").orderBy(F.desc("n")).limit(head_words + 1)  # a top-k
    held, last = best.agg(F.count(F.lit(1)), F.min("n")).first()
    least = HEAD_LEAST if held <= head_words else last + 1
    is_head = (F.col("n") >= least) | (F.length("word") == 0)
    top = counts.where(is_head).select("word", "n").toArrow().sort_by("word")  # head_words at most
    rest = {r["shape"]: (r["t"], r["w"]) for r in counts.where(~is_head).groupBy("shape").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("w")).collect()}
    by_class = np.array([rest.get(k, (0, 0)) for k in range(CLASSES)], np.int64)
    return Head(top["word"].to_pylist(), top["n"].to_numpy(), by_class[:, 0], by_class[:, 1], total, distinct)


ENCODED = "row long, doc_id {}, held_out boolean, symbols binary, tail array<binary>, times array<int>"


def encoded(docs: DataFrame, head, kind: str) -> DataFrame:
    """Symbols (32-bit) of each text, and its words outside the head, each once, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(batches, head.value.index())

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, ENCODED.format(kind))


def encoded_batches(batches: Iterator[pa.RecordBatch], index: Symbols) -> Iterator[pa.RecordBatch]:
    """Rows as ENCODED, handed on as soon as they have CHUNK tokens, so neither side of the pipe holds a whole batch of them."""
    size = index.size
    for batch in batches:
        at, held = 0, 0
        symbols, tails, times = [], [], []
        for k, text in enumerate(batch.column("text")):
            words = tokens(text.as_py())
            own = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
            tail = [words[k] for k in np.flatnonzero(own >= size).tolist()]
            symbols.append(own.tobytes())
            once = Counter(tail)
            tails.append(list(once))
            times.append(list(once.values()))
            held += len(words)
            if held < CHUNK and k + 1 < batch.num_rows:
                continue
            part = batch.slice(at, k + 1 - at)
            yield pa.record_batch(
                [
                    part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(symbols, pa.binary()),
                    pa.array(tails, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())),
                ],
                names=["row", "doc_id", "held_out", "symbols", "tail", "times"],
            )
            at, held = k + 1, 0
            symbols, tails, times = [], [], []


def gathered(column: pa.Array, limit: int = 4 * CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of encoded texts in runs of about `limit` tokens: rows, symbols and lengths."""
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in column]
    at, size = 0, 0
    for k, p in enumerate(parts):
        size += len(p)
        if size >= limit or k + 1 == len(parts):
            own = parts[at : k + 1]
            yield slice(at, k + 1), np.concatenate(own), np.array([len(x) for x in own], np.int64)
            at, size = k + 1, 0


def summed(parts: DataFrame, fans: int) -> pa.Table:
    """Adds up rows (block, fan, task, data) with equal blocks in the order of tasks, so that reruns agree, and first by
    fan, so no task gathers more than the root of all."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows, total = rows.sort_by("task"), 0.0
        for x in rows["data"].combine_chunks():
            total = total + np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"block": rows["block"][:1], "fan": pa.array([0], pa.int32()), "task": rows["task"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    once = parts.groupBy("block", "fan").applyInArrow(add, SUMS) if fans > 1 else parts
    return once.groupBy("block").applyInArrow(add, SUMS).toArrow()  # states x head words, whatever the corpus


SUMS = "block int, fan int, task int, data binary"


def whole_round(data: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One round of Baum-Welch: expected counts from all training rows, added up across tasks, then the M step."""
    sc = data.sparkSession.sparkContext
    held = sc.broadcast(model)  # (head words + classes) x states
    tasks = data.rdd.getNumPartitions()
    fans = max(1, int(np.ceil(np.sqrt(tasks / 8))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = held.value, TaskContext.get().partitionId()
        states, symbols = len(own.start), len(own.emit)
        counts, seen = no_counts(states, symbols), False
        for batch in batches:
            for _, text, lengths in gathered(batch.column(0)):
                expected(own, text, lengths, counts)
                seen = True
        if not seen:
            return
        tables = [np.concatenate([counts.start, counts.move.ravel(), [counts.log]])]
        tables += [counts.emit[k : k + BLOCK].ravel() for k in range(0, symbols, BLOCK)]
        for k, t in enumerate(tables):
            yield pa.record_batch(
                [pa.array([k - 1], pa.int32()), pa.array([task % fans], pa.int32()), pa.array([task], pa.int32()), pa.array([t.tobytes()], pa.binary())],
                names=["block", "fan", "task", "data"],
            )

    table = summed(data.mapInArrow(run, SUMS), fans)
    got = {b: np.frombuffer(x.as_buffer(), np.float64) for b, x in zip(table["block"].to_pylist(), table["data"], strict=True)}
    held.destroy()
    k = len(model.start)
    if not got:
        return model
    ends = got.pop(-1)
    emit = np.concatenate([got[b].reshape(-1, k) for b in sorted(got)])
    return maximised(Counts(ends[:k], ends[k : k + k * k].reshape(k, k), emit, ends[-1]), unigram)


def score(
    docs: DataFrame, held_out: Column, text: str = "text", id: str = "doc_id",
    states: int = STATES, head_words: int = HEAD_WORDS, rounds: tuple[float, ...] = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end; null and blank texts have the end alone. The model learns from the rows that
    held_out doesn't pick. base_score: the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))); score: the model's
    log10 probability of the tokens, known words one by one and unknown words as one outcome of their shape. If nothing
    can be learned from, score is base_score. Repeated rows come back each; an empty table gives an empty result;
    other columns are not read.

    Counts cover every training token. The model's vocabulary, the frequent words (head_words at most), has emissions
    of its own and goes to the tasks as a table of bounded size. Other words emit their shape's symbol, times the word's
    share of its shape; their counts come by an equality join of each text's different rare words with the counts, so
    the corpus may have any number of words. Each round of Baum-Welch goes over the share of the training rows that
    `rounds` says, whatever their number, the last ones over all: what is gathered grows with the corpus.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(
        F.col(id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    counts_path, data_path = scratch_path(spark, "word-counts"), scratch_path(spark, "symbols")
    word_counts(rows.where("not held_out")).write.parquet(counts_path)
    counts = spark.read.schema("word binary, shape int, n long").parquet(counts_path)
    top = head_of(counts, head_words)
    head = spark.sparkContext.broadcast(top)  # head_words at most
    encoded(rows, head, kind).write.parquet(data_path)
    data = spark.read.schema(ENCODED.format(kind)).parquet(data_path)

    learn = data.where("not held_out").select("symbols")
    unigram = top.unigram()
    model = first_model(np.empty(0, np.int32), np.empty(0, np.int64), unigram, states, 0)
    place, span = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 30)), 1 << 30
    few = max((r for r in rounds if r < 1), default=0)
    part = written(data.where(~F.col("held_out") & (place < int(span * few))).select(place.alias("place"), "symbols"), "symbols-part") if few else None
    for share in rounds if top.total else ():
        own = learn if share >= 1 else part.where(F.col("place") < int(span * share)).select("symbols")
        model = whole_round(own.coalesce(partitions(spark, int(top.total * share) + 1, TASK_TOKENS)), model, unigram)
    size, learned = len(top.words), bool(top.total)
    held = spark.sparkContext.broadcast(model)
    # of a head word the logarithm of its smoothed count; of a shape's words that comes by the join, here is their share's divisor
    logs = np.log10(np.concatenate([top.counts + 0.5, np.ones(CLASSES)]))
    divisors = np.concatenate([np.zeros(size), np.log10(top.class_tokens + 0.5 * (top.class_words + 1))])
    by_symbol = spark.sparkContext.broadcast((logs, divisors))
    floor = float(np.log10(top.total + 0.5 * (top.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (logs, divisors) = held.value, by_symbol.value
        for batch in batches:
            n, heads, bases, scores = [], [], [], []
            for _, text, lengths in gathered(batch.column("symbols")):
                starts = np.cumsum(lengths) - lengths
                n.append(lengths)
                heads.append(np.add.reduceat((text < size).astype(np.int64), starts))
                bases.append(np.add.reduceat(logs[text], starts))
                scores.append(log_likelihoods(own, text, lengths) / np.log(10) - np.add.reduceat(divisors[text], starts))
            if n:
                yield pa.record_batch(
                    [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *[pa.array(np.concatenate(x)) for x in (n, heads, bases, scores)]],
                    names=["row", "doc_id", "held_out", "n_tokens", "heads", "head_base", "head_score"],
                )

    scored = data.select("row", "doc_id", "held_out", "symbols").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, heads long, head_base double, head_score double"
    )
    rare = data.select("row", F.explode(F.arrays_zip(F.col("tail").alias("word"), "times")).alias("w")).select("row", "w.word", "w.times")
    rare = rare.join(counts.drop("shape"), "word", "left")
    tails = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
    )
    zero = F.lit(0.0)
    out = scored.join(tails, "row", "left")
    total = F.lit(top.total).cast("long")
    base_score = F.col("head_base") + F.coalesce("tail_base", zero) - F.col("n_tokens") * F.lit(floor)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("heads") * F.lit(int(learned)) + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        total.alias("train_tokens"), base_score.alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_base", zero) if learned else base_score).alias("score"),
    )

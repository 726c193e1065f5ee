"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import columns

#: n-grams of 1 to SIZES characters, hashed to 2^BITS buckets.
SIZES, BITS = 3, 16
BUCKETS = 1 << BITS
#: Characters that are turned into features at a time.
CHUNK = 1 << 20
SCALE = 40.0


@cache
def letters() -> np.ndarray:
    """Which code points are letters, as Python has it."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased code points, one after another, a blank before and two after each, all
    but letters blanked; and where each text starts."""
    parts = [f" {(t or '').lower()}  " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.where(letters()[codes], codes, np.uint32(32)), starts


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1, 2, 3 the bucket of the n-gram that ends at each position. A text's first ones reach back into
    the blanks after the text before, never into that text."""
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(SIZES):
        shifted = codes if n == 0 else np.concatenate([np.full(n, 32, np.uint32), codes[:-n]])
        mixed = (mixed + shifted + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK characters, each text whole."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= CHUNK:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def has_letter(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat((codes != 32).astype(np.int64), starts[:-1]) > 0


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share that each has of its n-grams."""
    codes, _ = folded([text])
    index, n = np.unique(np.concatenate(list(grams(codes))), return_counts=True)
    return index.astype(np.int64), n / len(codes)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs), with IDF and scale within
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; und and 0 if it has no letter."""
        names, best = [], np.zeros(len(texts))
        for first, part in batches_of(texts):
            codes, starts = folded(part)
            total = np.zeros((len(part), len(self.langs)))
            for index in grams(codes):
                total += np.add.reduceat(self.weights[index], starts[:-1], axis=0, dtype=np.float64)
            logits = (total / np.diff(starts)[:, None] + self.bias) / self.temperature
            p = softmax(logits)
            top = p.argmax(axis=1)
            real = has_letter(codes, starts)
            best[first : first + len(part)] = np.where(real, p[np.arange(len(part)), top], 0)
            names += [self.langs[k] if r else "und" for k, r in zip(top, real, strict=True)]
        return names, best


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with one learning rate per coordinate. l1 keeps weights at zero, l2 shrinks the rest.
    Bucket BUCKETS is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            own_z, own_n = z[index], n[index]
            w = solved(own_z, own_n)
            p = softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p[None, :]
            more = own_n + g * g
            z[index] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / alpha * w
            n[index] = more
    w = solved(z, n)
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights weren't fitted to."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 121))
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for _, part in batches_of(texts):
                codes, starts = folded(part)
                lengths = np.diff(starts)
                for at in range(0, len(part), 64):
                    group = lengths[at : at + 64]
                    own = codes[starts[at] : starts[at + len(group)]]
                    seen = np.zeros((len(group), BUCKETS), bool)
                    row = np.repeat(np.arange(len(group)), group)
                    for index in grams(own):
                        seen[row, index] = True
                    total += seen.sum(axis=0)
        yield pa.record_batch([pa.array([-1]), pa.array([n])], names=["bucket", "n"])
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    sums = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(BUCKETS, np.int64), 0
    for bucket, count in sums:  # at most BUCKETS + 1 rows
        if bucket < 0:
            n = count
        else:
            out[bucket] = count
    return out, n


def train(docs: DataFrame, text: str, id: str, lang: str, learn: Column, sample_rows: int = 2000, **how) -> Model | None:
    """A model from the labelled rows that `learn` picks; None if there are none.

    IDF comes from all of them. Weights and temperature are fitted to a sample by hash of the text with about
    sample_rows different texts, for each language as many as it has or its equal share; of four in five the weights,
    of the rest the temperature. Copies and repeated ids count once in it, and twice sample_rows texts are its limit.
    """
    known = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    digest = F.xxhash64(F.col(text), F.lit(7))
    texts = F.approx_count_distinct(digest, 0.02).alias("texts")
    counts = {r[lang]: max(r["texts"], 1) for r in known.groupBy(lang).agg(texts).collect()}  # a row per language
    if not counts:
        return None
    frequencies, n = document_frequencies(known.select(text))
    idf = np.log((1 + n) / (1 + frequencies)) + 1
    langs = sorted(counts)
    each = -(-sample_rows // len(langs))
    span = 1 << 30
    place = F.pmod(digest, F.lit(span))
    quota = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(span, span * each // c + 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [counted(t) for t in batch.column("t").to_pylist()]
            yield pa.record_batch(
                [batch.column("place"), batch.column("l"), pa.array([i for i, _ in pairs], pa.list_(pa.int64())), pa.array([v for _, v in pairs], pa.list_(pa.float64()))],
                names=["place", "l", "i", "v"],
            )

    picked = known.where(place < quota[F.col(lang)]).select(digest.alias("place"), F.col(lang).alias("l"), F.col(text).alias("t"))
    picked = picked.dropDuplicates(["place", "l"]).orderBy(F.pmod("place", F.lit(span)), "place", "l").limit(2 * sample_rows)
    sample = picked.mapInArrow(run, "place long, l string, i array<long>, v array<double>").collect()
    number = {k: i for i, k in enumerate(langs)}
    rows = []
    for r in sorted(sample, key=lambda r: (r.place, r.l, r.i)):
        index, value = np.array(r.i, np.int64), np.array(r.v)
        rows.append((np.append(index, BUCKETS), np.append(value * idf[index] * SCALE, 1.0), number[r.l]))
    fit = [r for k, r in enumerate(rows) if k % 5 < 4]
    rest = [r for k, r in enumerate(rows) if k % 5 == 4]
    weights, bias = follow_the_leader(fit, len(langs), **how)
    whole = np.vstack([weights, bias])
    logits = np.array([v @ whole[i] for i, v, _ in rest]).reshape(len(rest), len(langs))
    temperature = best_temperature(logits, np.array([k for *_, k in rest], np.int64))
    return Model(langs, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


def held_out(id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id is an empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", folds: int = 4, fold: int = 2, **how) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from rows with text and language whose crc32(id as text) mod folds is not `fold`; predicts from the
    text alone. lang_pred is a learned language; `und` with score 0 if the text is null or has no letter, or if
    nothing could be learned. Score is the calibrated probability. Repeated rows come back each; an empty table
    gives an empty result; other columns are not read.
    """
    out = held_out(F.col(id), folds, fold)
    model = train(docs, text, id, lang, ~out, **how)
    rows = docs.select(F.col(id).alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    return predicted(rows, model)


def predicted(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows with a column text -> the same with lang_pred and score in its place."""
    keep = [c for c in rows.columns if c != "text"]
    shape = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    held = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = own.scores(texts) if own else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return rows.select(*keep, "text").mapInArrow(run, shape)


#: Probability from which a document's language counts as told. Short texts and texts in two languages reach less than
#: 0.5 with none of four languages ahead of the rest by much; the README has the figures for other limits.
TOLD = 0.4


def accepted(
    docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", least: float = TOLD, langs: list[str] | None = None, **how
) -> DataFrame:
    """The rows whose language is told with a probability of `least` or more, with all their columns; langs: and is one
    of these. Texts that are null or have no letter go. The language column is read to learn from only.

    Repeated rows stay or go together; other columns may have any names. An empty table gives an empty result. Where no
    row is labelled nothing can be told, and every row with a letter stays unless langs are given.
    """
    model = train(docs, text, id, lang, ~held_out(F.col(id), 4, 2), **how)
    if model is None:
        return docs.where(F.col(text).rlike(r"\p{L}")) if langs is None else docs.where(F.lit(False))
    rows = docs.select(*[c.alias(f"c{k}") for k, c in enumerate(columns(docs))], F.col(text).alias("text"))
    fine = (F.col("lang_pred") != "und") & (F.col("score") >= least)
    told = predicted(rows, model).where(fine if langs is None else fine & F.col("lang_pred").isin(langs))
    return told.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])

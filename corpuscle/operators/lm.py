"""A bigram language model in place of neural scorers, with the same output, and what is computed from it.

It doesn't reproduce neural scores. It emits (id..., pos, label, log_p, rank): what the grouped report, the mismatch
report and the suggestions take.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import words
from corpuscle.operators.vocab import EOS, SOS, UNK

#: Weight of the bigram estimate beside the unigram one, which has one added to each count.
MIX = 0.7


def steps(df: DataFrame, id: list[str], text: str) -> DataFrame:
    """(id..., pos from 1, prev, label): each word with the one before; `<sos>` before the first, `<eos>` at the end."""
    own = df.select(*id, words(F.col(text)).alias("__w"))
    labels = F.concat("__w", F.array(F.lit("<eos>")))
    prev = F.concat(F.array(F.lit("<sos>")), F.col("__w"))
    rows = own.select(*id, F.posexplode(F.arrays_zip(prev.alias("prev"), labels.alias("label"))).alias("__pos", "__s"))
    return rows.select(*id, (F.col("__pos") + 1).alias("pos"), F.col("__s.prev").alias("prev"), F.col("__s.label").alias("label"))


def bigrams(train: DataFrame, text: str) -> DataFrame:
    """(prev, label, n)."""
    return steps(train, [], text).groupBy("prev", "label").agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, most: int = 10) -> DataFrame:
    """(prev, label, n, rank): the next words of each word, most frequent first, ties by the word; the first `most`.
    The window limits its groups before the shuffle, so a frequent word's many followers aren't gathered."""
    order = Window.partitionBy("prev").orderBy(F.desc("n"), "label")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def scores(test: DataFrame, id: list[str], text: str, counts: DataFrame, mix: float = MIX) -> DataFrame:
    """(id..., pos, prev, label, log_p, rank): natural logarithm of the interpolated probability; rank up to 10 among
    the followers of prev, null beyond. Scores are joined to distinct pairs of the test texts, then to their places."""
    rows = steps(test, id, text)
    unigram = counts.groupBy("label").agg(F.sum("n").alias("n_label"))
    contexts = counts.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    total, size = unigram.agg(F.sum("n_label"), F.count(F.lit(1))).first()
    asked = rows.select("prev", "label").distinct()
    own = (
        asked.join(counts, ["prev", "label"], "left").join(unigram, "label", "left").join(contexts, "prev", "left")
        .join(ranked(counts).select("prev", "label", "rank"), ["prev", "label"], "left")
    )
    one = (F.coalesce("n_label", F.lit(0)) + 1) / F.lit(float((total or 0) + size + 1))
    two = F.when(F.col("n_prev").isNull(), one).otherwise(F.coalesce("n", F.lit(0)) / F.col("n_prev"))
    own = own.select("prev", "label", F.ln(mix * two + (1 - mix) * one).alias("log_p"), "rank")
    return rows.join(own, ["prev", "label"]).select(*id, "pos", "prev", "label", "log_p", "rank")


def perplexity(cce: Column, most: float = 100.0) -> Column:
    return F.exp(F.least(cce, F.lit(most)))


def unpadded(scored: DataFrame, pad: str = "<pad>") -> DataFrame:
    """Without the places that only fill a sequence up: they count in no loss and no rate."""
    return scored.where(F.col("label") != pad)


def batch_loss(scored: DataFrame, batch: str, pad: str = "<pad>") -> DataFrame:
    """One row: batches, loss, ppl. The loss is the mean over batches of each batch's mean, as training loops report it, so
    a short batch weighs as much as a full one; batches of nothing but padding don't count."""
    each_ = unpadded(scored, pad).groupBy(batch).agg(F.avg(-F.col("log_p")).alias("loss"))
    means = each_.agg(F.count(F.lit(1)).alias("batches"), F.avg("loss").alias("loss"))
    return means.select("batches", F.round("loss", 4).alias("loss"), F.round(perplexity(F.col("loss")), 2).alias("ppl"))


def report(scored: DataFrame, source: str, domain: str, pad: str = "<pad>") -> DataFrame:
    """group, tokens, cce, ppl, top1, top5, top10 (in percent), sorted by group: all rows, each source and each domain, in
    one pass, without padding."""
    scored = unpadded(scored, pad)
    grouped = scored.groupingSets([[], [source], [domain]], source, domain).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("tokens"), F.sum(-F.col("log_p")).alias("loss"),
        *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in (1, 5, 10)],
    )
    name = F.when(F.col("gid") == 3, "OVERALL").when(F.col("gid") == 1, F.concat(F.lit("Source: "), source)).otherwise(F.concat(F.lit("Domain: "), domain))
    cce = F.col("loss") / F.col("tokens")
    percent = [F.round(F.col(f"hit{k}") / F.col("tokens") * 100, 2).alias(f"top{k}") for k in (1, 5, 10)]
    rows = grouped.select(name.alias("group"), "tokens", F.round(cce, 4).alias("cce"), F.round(perplexity(cce), 2).alias("ppl"), *percent)
    return rows.orderBy("group")


def suggestions(counts: DataFrame, n: int = 3, skip: tuple[str, ...] = ("<eos>", "<unk>")) -> DataFrame:
    """(prev, words): the first n different next words, underscores as blanks."""
    own = ranked(counts.where(~F.col("label").isin(*skip)), n + len(skip))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda r: F.translate(r["label"], "_", " "))
    return own.groupBy("prev").agg(F.slice(F.array_distinct(ordered), 1, n).alias("words"))


def mismatches(scored: DataFrame, counts: DataFrame, skip: tuple[str, ...], n: int = 3) -> DataFrame:
    """Places where the best guess isn't the label, with n suggestions; labels in `skip` are left out."""
    wrong = scored.where((F.coalesce("rank", F.lit(0)) != 1) & ~F.col("label").isin(*skip))
    return wrong.join(suggestions(counts, n), "prev", "left")


# --- beam search --------------------------------------------------------------------------------


def beam(
    start: list[int], table: dict[int, list[tuple[int, float]]], width: int, most: int, alpha: float, step_penalty: bool, window: int = 32,
    no_repeat: int = 0,
) -> list[int]:
    """The best continuation. step_penalty: every step's gain is divided by the length penalty, and indices that have
    occurred lose 2; else the penalty counts in ranking alone, the last index loses 3 and the one before it 1. no_repeat:
    no run of so many indices comes twice; where nothing else is left the sequence ends."""
    beams = [(start, 0.0)]
    penalty = lambda seq: ((5 + len(seq)) / 6) ** alpha
    for _ in range(most):
        grown = []
        for seq, score in beams:
            if seq[-1] == EOS:
                grown.append((seq, score))
                continue
            context = seq if step_penalty else seq[-window:]
            logits = {k: v for k, v in table.get(context[-1], table.get(UNK, [(EOS, 0.0)]))}
            lose = dict.fromkeys(seq, 2.0) if step_penalty else {**({seq[-2]: 1.0} if len(seq) > 1 else {}), seq[-1]: 3.0}
            if no_repeat:
                n = no_repeat - 1
                last = seq[len(seq) - n :]
                banned = {seq[k + n] for k in range(len(seq) - n) if seq[k : k + n] == last}
                logits = {k: v for k, v in logits.items() if k not in banned} or {EOS: 0.0}
            logits = {k: v - lose.get(k, 0.0) for k, v in logits.items()}
            norm = math.log(sum(map(math.exp, logits.values())))
            for k, v in sorted(logits.items(), key=lambda e: (-e[1], e[0]))[:width]:
                new = [*seq, k]
                grown.append((new, score + (v - norm) / (penalty(new) if step_penalty else 1.0)))
        key = (lambda b: -b[1]) if step_penalty else (lambda b: -b[1] / penalty(b[0]))
        beams = sorted(grown, key=key)[:width]
        if all(seq[-1] == EOS for seq, _ in beams):
            break
    return beams[0][0]


def beam_search(
    prompts: DataFrame, id: str, ids: str, model: DataFrame, width: int = 3, most: int = 20, alpha: float = 0.7, step_penalty: bool = True,
    no_repeat: int = 0,
) -> DataFrame:
    """(id, ids): prompts of indices with their best continuations. model: (prev, next, log_p), the best few followers of
    each index of a capped vocabulary, so it is a table of bounded size."""
    table: dict[int, list[tuple[int, float]]] = {}
    for r in model.select("prev", "next", "log_p").collect():
        table.setdefault(r["prev"], []).append((r["next"], r["log_p"]))
    held = prompts.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else beam([SOS, *map(int, v)], held.value, width, most, alpha, step_penalty, no_repeat=no_repeat))

    return prompts.select(id, run(F.col(ids)).alias("ids"))


def index_model(counts: DataFrame, vocab: DataFrame, most: int = 10, mix: float = MIX) -> DataFrame:
    """(prev, next, log_p) over indices: the `most` best followers of each word of the vocabulary."""
    numbers = vocab.select("word", "idx")
    own = ranked(counts.join(numbers.selectExpr("word prev", "idx p"), "prev").join(numbers.selectExpr("word label", "idx l"), "label"), most)
    total = Window.partitionBy("prev")
    return own.select(F.col("p").alias("prev"), F.col("l").alias("next"), F.ln(F.col("n") / F.sum("n").over(total)).alias("log_p"))


def short_completions(counts: DataFrame, starts: DataFrame, first: int = 6, more: int = 3) -> DataFrame:
    """(prev, text): from the `first` best followers of each start, up to `more` greedy steps each."""
    best = ranked(counts.where("label <> '<eos>'"), 1).select(F.col("prev").alias("__p"), F.col("label").alias("__next"))
    rows = ranked(counts.where("label <> '<eos>'"), first).join(starts.select("prev").distinct(), "prev").select("prev", "rank", F.col("label").alias("last"), F.col("label").alias("text"))
    for _ in range(more):
        rows = rows.join(best, F.col("last") == F.col("__p"), "left").select(
            "prev", "rank", F.coalesce("__next", "last").alias("last"), F.concat_ws(" ", "text", "__next").alias("text")
        )
    return rows.select("prev", "rank", "text")

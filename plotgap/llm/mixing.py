"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent and normalised. The exponent is bisected: the largest one whose weights reach the
target entropy (as a part of the highest possible), or, if that would repeat some source more often than allowed, the
smallest one that keeps the repetition limit. The token budget is the smallest that gives every source its weight and
uses each of its documents at least once, so nothing is dropped.

Each source's budget is realised as block permutations: its documents are dealt to blocks of about ``block_tokens`` by
their hash; in every epoch the blocks, and the documents within each block, are put in a fresh keyed order. Whole epochs
are followed by the part of one that the budget still holds (documents in order while their running total fits).
``position`` is where a copy stands in its source's stream, as a part of the budget: reading all sources by position keeps
the weights in every prefix of the mix.

Windows run over one block of one source; blocks are joined by their totals. Only one row per source comes to the driver
(more than ``most_sources`` is an error).

Defined results: null sources are one source of their own; null text has no words; documents without words have no
weight and are used as often as the rest of their source, a source without any words once; rows with equal doc_id share
their fate; an empty table gives an empty result; other columns are kept by ``mixed`` and ignored by ``streams``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap.llm.base import native_words


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))


def keyed(seed: str, *parts: str | Column) -> Column:
    """60-bit number from md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
                                    .cast("binary")), 1, 15), 16, 10).cast("bigint")


def weights_at(tokens: Sequence[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    norm = sum(raised)
    return [r / norm for r in raised]


def entropy(weights: Sequence[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repeats(tokens: Sequence[int], weights: Sequence[float]) -> float:
    each = [w / t for t, w in zip(tokens, weights)]
    return max(each) / min(each)


def fit_exponent(tokens: Sequence[int], target_entropy: float, max_repeats: float) -> float:
    """Exponent in [0, 1] for positive token counts; ``target_entropy`` is a part of ln(number of sources)."""
    goal = target_entropy * math.log(len(tokens)) - 1e-12
    if entropy(weights_at(tokens, 1.0)) >= goal:
        return 1.0

    def bisect(good) -> float:  # good holds up to some exponent
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low
    wanted = bisect(lambda a: entropy(weights_at(tokens, a)) >= goal)
    if repeats(tokens, weights_at(tokens, wanted)) <= max_repeats:
        return wanted
    return bisect(lambda a: repeats(tokens, weights_at(tokens, a)) > max_repeats)


def plan(sized: DataFrame, target_entropy: float, max_repeats: float, most_sources: int = 100_000) -> DataFrame:
    """(_key, _tokens, _budget, _whole): one row per source, from its total; a table of at most ``most_sources`` rows."""
    rows = sorted((r[0], int(r[1] or 0)) for r in sized.groupBy("_key").agg(F.sum("n_tokens")).limit(most_sources + 1).collect())
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    full = [(k, t) for k, t in rows if t > 0]
    out = [(k, 0, 0, 1) for k, t in rows if t == 0]
    if full:
        tokens = [t for _, t in full]
        weights = weights_at(tokens, fit_exponent(tokens, target_entropy, max_repeats))
        total = max(t / w for t, w in zip(tokens, weights))
        for (k, t), w in zip(full, weights):
            budget = max(t, math.floor(w * total + 0.5))
            out.append((k, t, budget, budget // t))
    return sized.sparkSession.createDataFrame(out, "_key string, _tokens long, _budget long, _whole int")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, _key, n_tokens), one row per doc_id."""
    counted = docs.select("doc_id", "source", source_key().alias("_key"), F.size(native_words(F.col("text"))).cast("long").alias("n_tokens"))
    return counted.groupBy("doc_id", "source", "_key").agg(F.sum("n_tokens").alias("n_tokens"))


def _order(seed: str) -> list[Column]:
    """What sorts the documents of an epoch: block first, then the document."""
    return [keyed(seed, F.lit("block"), "_key", "epoch", "block").alias("_b"), keyed(seed, F.lit("document"), "epoch", "doc_id").alias("_d")]


def _block(seed: str, block_tokens: int) -> Column:
    n = F.greatest(F.ceil(F.col("_tokens") / F.lit(block_tokens)), F.lit(1))
    return F.pmod(keyed(seed, F.lit("deal"), "doc_id"), n).cast("int")


def streams(counts: DataFrame, sources: DataFrame, seed: str = "mix", block_tokens: int = 1 << 20) -> DataFrame:
    """One row per use: doc_id, source, n_tokens, epoch, block, start, position (and keys starting with _)."""
    uses = (counts.join(F.broadcast(sources), "_key").withColumn("block", _block(seed, block_tokens))
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("_budget") > F.col("_whole") * F.col("_tokens"), F.col("_whole"))
                                                      .otherwise(F.col("_whole") - 1)))))
    uses = uses.select("*", *_order(seed))
    here = Window.partitionBy("_key", "epoch", "block").orderBy("_d", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_key", "epoch").orderBy("_b", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (uses.groupBy("_key", "epoch", "block", "_b").agg(F.sum("n_tokens").alias("_n"))
              .withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_key", "epoch", "block", "_ahead"))
    placed = (uses.withColumn("_in", F.coalesce(F.sum("n_tokens").over(here), F.lit(0)))
              .join(blocks, ["_key", "epoch", "block"])
              .withColumn("start", F.col("epoch") * F.col("_tokens") + F.col("_ahead") + F.col("_in")))
    return (placed.where(F.col("start") + F.col("n_tokens") <= F.col("_budget"))
            .withColumn("position", F.when(F.col("_budget") > 0, F.col("start") / F.col("_budget")).otherwise(F.lit(0.0))))


def mix(docs: DataFrame, target_entropy: float, max_repeats: float, seed: str = "mix", block_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, start, position of every use of a document."""
    counts = sized(docs)
    used = streams(counts, plan(counts, target_entropy, max_repeats), seed, block_tokens)
    return used.select("doc_id", "source", "n_tokens", "epoch", "block", "start", "position")


def mixed(docs: DataFrame, target_entropy: float, max_repeats: float, seed: str = "mix", block_tokens: int = 1 << 20) -> DataFrame:
    """``docs`` with its own columns, each row as often as the mix uses it.

    The last document of each source's unfinished epoch is all that the rows need to know, so texts are not shuffled.
    """
    counts = sized(docs)
    sources = plan(counts, target_entropy, max_repeats)
    used = streams(counts, sources, seed, block_tokens)
    last = (used.where(F.col("epoch") == F.col("_whole")).groupBy("_key")
            .agg(F.max(F.struct("_b", "block", "_d", "doc_id")).alias("_last")))
    bounds = sources.join(last, "_key", "left")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    dealt = (docs.select(row, source_key().alias("_key"), F.col("doc_id")).join(F.broadcast(bounds), "_key")
             .withColumn("block", _block(seed, block_tokens)).withColumn("epoch", F.col("_whole")).select("*", *_order(seed)))
    once_more = F.coalesce(F.struct("_b", "block", "_d", "doc_id") <= F.col("_last"), F.lit(False)).cast("int")
    return (dealt.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_whole") + once_more)))
            .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))

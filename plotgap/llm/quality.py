"""Quality rules with risk-controlled thresholds.

Every rule is a number that grows with badness and rejects a document above a cutoff. Cutoffs come from labelled holdouts,
per stratum (language) and rule. For each cutoff of a fixed grid, from lax to strict, the exact binomial tail tests whether
false rejection of clean documents could still be ``alpha / rules`` or more; the first cutoff that cannot exclude it ends the
row, so within a row no further correction is due. Over strata and rules the error ``delta`` is divided equally
(Bonferroni). With probability 1 - delta, no stratum loses more than ``alpha`` of its clean documents to all rules
together. Among the cutoffs that pass, the one that rejects most labelled bad documents, less ``price`` times the clean ones, is
used, the laxest of equals; if none gains anything the rule is idle there.

Everything runs on DataFrame expressions; a document's repeated word windows are found by sorting its own window hashes.
One row per stratum and rule is collected (more than ``most_strata`` strata is an error).

Defined results: null text is empty and fails the base; a null language is a stratum of its own, and a stratum without
enough labels rejects nothing; rows of labels without a label are ignored and several labels of a document
count as bad if any is; repeated rows are judged each; an empty table gives an empty result; columns that are
not used are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.llm.base import let, native_words, stored

N = 5
#: Fixed grids of cutoffs, lax to strict.
GRIDS = {
    "symbols": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeats": [0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05, 0.03],
    "shouting": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08],
    "word_length": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}
SYMBOLS = "#*$%&|<>"
LOUD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"


def repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the same text."""
    def covered(marked: Column) -> Column:  # (hash, place), sorted
        twice = F.filter(marked, lambda s, k: (s["h"] == F.get(marked, k - 1)["h"]) | (s["h"] == F.get(marked, k + 1)["h"]))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-N).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(N), p - a["last"])).alias("n"), p.alias("last")))["n"]

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - N), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(N)]))

    def count(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(marked, covered))

    return F.when(F.size(words) < N, F.lit(0)).otherwise(let(windows(words), count))


def without(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, the base counts, base_failed, rules): rules is a map of rule to value."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", F.col("lang").alias("stratum"), text.alias("_t")).select(
        "doc_id", "stratum",
        let(native_words(F.col("_t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r"))).alias("_w"),
        (F.length("_t") - without(F.col("_t"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        let(F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            lambda lines: F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("d"))).alias("_l"),
        without(F.col("_t"), LOUD).alias("_loud"))
    counted = facts.select("doc_id", "stratum", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols",
                           (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"),
                           F.col("_l.n").alias("_lines"), "_loud")
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "_lines", "word_chars"))
    rules = {"symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words,
             "shouting": F.col("_loud") / chars, "word_length": F.col("word_chars") / words}
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (counted.withColumn("base_failed", failed).select("*", *[v.alias(f"r_{k}") for k, v in rules.items()])
            .drop("_lines", "_loud"))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(at most k of n), each with probability ``rate``; summed from the largest term down until terms vanish."""
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    if k > n * rate:  # beyond the mean: from the other side
        term = total = 1.0
        top += math.log((n - k) / (k + 1) * rate / (1 - rate))
        for i in range(k + 2, n + 1):
            term *= (n - i + 1) / i * rate / (1 - rate)
            total += term
            if term < 1e-18 * total:
                break
        return max(0.0, 1 - math.exp(top) * total)
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - rate) / rate
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, math.exp(top) * total)


def rejected(holdout: DataFrame, most_strata: int) -> dict:
    """{(stratum, rule): rows of (clean rejected, bad rejected) by cutoff, and clean documents} from (stratum, good, r_...)."""
    def first_below(rule: str, grid: list[float]) -> Column:  # place of the first cutoff that rejects
        at = F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c >= F.col(f"r_{rule}")))
        return F.struct(F.lit(rule).alias("rule"), at.alias("at"))
    first = [first_below(rule, grid) for rule, grid in GRIDS.items()]
    rows = (holdout.select("stratum", "good", F.explode(F.array(*first)).alias("_f"))
            .groupBy("stratum", "good", "_f.rule", "_f.at").count().limit(most_strata * 200 + 1).collect())
    if len({r["stratum"] for r in rows}) > most_strata:
        raise ValueError(f"more than {most_strata} strata")
    out: dict = {}
    for r in rows:
        grid = GRIDS[r["rule"]]
        table = out.setdefault((r["stratum"], r["rule"]), {"clean": [0] * len(grid), "bad": [0] * len(grid), "n": 0})
        table["n"] += r["count"] if r["good"] else 0
        for k in range(r["at"], len(grid)):
            table["clean" if r["good"] else "bad"][k] += r["count"]
    return out


def choose(tables: dict, alpha: float, delta: float, price: float) -> list[tuple]:
    """(stratum, rule, cutoff) of the rules in use."""
    level, chosen = delta / max(1, len({s for s, _ in tables}) * len(GRIDS)), []
    for (stratum, rule), t in tables.items():
        best, gain = None, 0.0
        for cutoff, clean, bad in zip(GRIDS[rule], t["clean"], t["bad"]):
            if not t["n"] or binomial_tail(clean, t["n"], alpha / len(GRIDS)) > level:
                break
            if bad - price * clean > gain:
                best, gain = cutoff, bad - price * clean
        if best is not None:
            chosen.append((stratum, rule, best))
    return chosen


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.1, price: float = 5.0, most_strata: int = 1000) -> DataFrame:
    """The base counts and verdict of every document, with ``failed_rules``; see the top of the file."""
    facts = stored(measured(docs))
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    cutoffs = choose(rejected(facts.where(~F.col("base_failed")).join(good, "doc_id"), most_strata), alpha, delta, price)
    by_rule = {rule: {s: c for s, r, c in cutoffs if r == rule} for rule in GRIDS}
    failed = []
    for rule, by_stratum in by_rule.items():
        hit = F.lit(False)
        for cutoff in sorted(set(by_stratum.values())):
            those = [s for s, c in by_stratum.items() if c == cutoff]
            here = F.col("stratum").isin([s for s in those if s is not None])
            here = F.coalesce(here, F.lit(None in those))
            hit = hit | (here & (F.col(f"r_{rule}") > cutoff))
        failed.append(F.when(hit, F.lit(rule)))
    verdict = facts.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                          (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.concat_ws(",", "failed_rules").alias("failed_rules"))

"""Exact quantiles and ranks without one task per group.

Values are first collapsed to (group, value, count) with partial aggregation, and
cumulative counts run over value-range chunks, so neither a hot group nor the
whole table ever sits in one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.plans.sequence import running


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: Column, width: float) -> DataFrame:
    """(keys, v, n, upto, total): distinct values with cumulative and total counts."""
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = (df.select(*keys, value.alias("v")).where(F.col("v").isNotNull())
              .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")))
    chunk = F.floor(F.col("v") / F.lit(width)).cast("bigint")
    upto = running(counts, keys, ["v"], F.col("n"), "upto", "sum", chunk)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return upto.join(totals, keys)


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, positions: dict[str, Column],
              width: float) -> DataFrame:
    """One row per group with the value at each zero-based rank.

    ``positions`` maps an output column to an expression over ``total`` that gives
    the zero-based rank wanted; the exact order statistic is returned.
    """
    ranked = cumulative_counts(df, keys, value, width)
    first = F.col("upto") - F.col("n")
    picks = [F.max(F.when((first <= pos) & (pos < F.col("upto")), F.col("v"))).alias(name)
             for name, pos in positions.items()]
    return ranked.groupBy(*keys).agg(F.max("total").alias("n"), *picks)


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float], width: float) -> DataFrame:
    """Linear-interpolated percentiles, from the two order statistics around each position."""
    picks = {}
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("total") - 1)
        picks[f"{name}_lo"], picks[f"{name}_hi"] = F.floor(at), F.ceil(at)
    got = quantiles(df, keys, value, picks, width)
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        got = got.withColumn(name, lo + (hi - lo) * (at - F.floor(at))).drop(f"{name}_lo", f"{name}_hi")
    return got


def median(df: DataFrame, keys: Sequence[str], value: Column, out: str, width: float) -> DataFrame:
    """Exact median (mean of the two middle values when the count is even)."""
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    got = quantiles(df, keys, value, {"_lo": lo, "_hi": hi}, width)
    return got.withColumn(out, (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")


def nearest_rank(p: float) -> Column:
    """Zero-based rank of the nearest-rank rule ceil(p*n) - 1, clamped."""
    n = F.col("total")
    return F.greatest(F.lit(0), F.least(n - 1, F.ceil(F.lit(p) * n) - 1))


def index_rank(p: float) -> Column:
    """Zero-based rank of the rule int(p * (n - 1))."""
    return F.floor(F.lit(p) * (F.col("total") - 1))


def uniform(seed: str, *parts) -> Column:
    """Hash uniform in [0, 1): first eight hex digits of md5 over 2^32."""
    key = F.concat_ws("|", F.lit(seed), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string")
                                          for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_rank(df: DataFrame, keys: Sequence[str], u: Column, tie: Sequence[str], out: str,
              chunks: int = 256) -> DataFrame:
    """One-based rank of each row by a hash uniform, within ``keys``.

    The uniform is cut into equal slices, so a group of any size spreads over
    ``chunks`` window partitions.
    """
    with_u = df.withColumn("_u", u)
    chunk = F.floor(F.col("_u") * F.lit(chunks)).cast("bigint")
    return running(with_u, keys, ["_u", *tie], F.lit(1), out, "sum", chunk).drop("_u")

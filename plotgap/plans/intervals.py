"""Interval joins on time buckets.

The interval side is short (scenes, uptime spans); it is repeated over a fixed number of
salts, so rows of one busy bucket spread over that many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def _bucket(c: str, width) -> Column:
    return F.floor(F.col(c) / width).cast("bigint")


def _salted(rows: DataFrame, spans: DataFrame, t: str) -> tuple[DataFrame, DataFrame]:
    salt = F.pmod(F.xxhash64(t), F.lit(SALTS)).cast("int")
    return rows.withColumn("_s", salt), spans.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def around_instants(rows: DataFrame, instants: DataFrame, t: str, at: str, half_us: int, equal: Sequence[str] = ()) -> DataFrame:
    """Rows within +/- ``half_us`` of each instant, by an equi-join on buckets of that width."""
    width = F.lit(half_us)
    base = _bucket(at, width)
    left, right = _salted(rows.withColumn("_b", _bucket(t, width)), instants.withColumn("_b", F.explode(F.sequence(base - 1, base + 1))), t)
    return left.join(right, [*equal, "_b", "_s"]).where(F.abs(F.col(t) - F.col(at)) <= width).drop("_b", "_s")


def containing(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, width: int, equal: Sequence[str] = (),
               how: str = "inner") -> DataFrame:
    """Join each point to the spans [lo, hi] that contain it, on buckets of ``width``."""
    left, right = _salted(points.withColumn("_b", _bucket(t, F.lit(width))),
                          spans.withColumn("_b", F.explode(F.sequence(_bucket(lo, F.lit(width)), _bucket(hi, F.lit(width))))), t)
    cond = (F.col(f"p.{t}") >= F.col(f"s.{lo}")) & (F.col(f"p.{t}") <= F.col(f"s.{hi}"))
    for k in [*equal, "_b", "_s"]:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    joined = left.alias("p").join(right.alias("s"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_b", "_s")
    return joined.select(*[F.col(f"p.{c}") for c in points.columns],
                         *[F.col(f"s.{c}") for c in spans.columns if c not in equal and c not in points.columns])

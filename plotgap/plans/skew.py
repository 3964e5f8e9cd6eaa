"""Equi-join whose hot keys are split before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 500_000


def split_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str,
              hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Add a ``_salt`` column to both sides.

    Keys with more than ``hot_rows`` rows on the right are cut into
    ceil(n / hot_rows) pieces by a hash of ``spread``; the matching left rows are
    repeated once per piece. The list of hot keys has at most
    rows / ``hot_rows`` entries, which bounds its broadcast.
    """
    hot = (right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
           .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_pieces")))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    right = (right.join(F.broadcast(hot), list(keys), "left")
             .withColumn("_salt", F.pmod(F.xxhash64(spread), pieces).cast("int")).drop("_pieces"))
    left = (left.join(F.broadcast(hot), list(keys), "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces"))
    return left, right

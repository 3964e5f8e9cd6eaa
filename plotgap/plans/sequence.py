"""Ordered access along a key that stays parallel when one key is huge.

A plain ``lag`` or running sum partitioned by a platform puts the whole platform
in one task. Here the window is partitioned by (key, chunk), where ``chunk`` is a
monotone function of the leading order column, and one small summary row per
(key, chunk) carries the value across the seam. The summary is built with partial
aggregation, so its size follows the number of chunks, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def chunk_of(name: str, width: int) -> Column:
    """Chunk number of a non-negative integer order column."""
    return F.floor(F.col(name) / F.lit(width)).cast("bigint")


def _neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
               chunk: Column, prefix: str, forward: bool) -> DataFrame:
    keyed = df.withColumn("_chunk", chunk)
    packed = F.struct(*[F.col(v) for v in values])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    shift = F.lead if forward else F.lag
    here = keyed.withColumn("_near", shift(packed).over(inside))
    edge = F.min_by if forward else F.max_by
    edges = keyed.groupBy(*keys, "_chunk").agg(edge(packed, F.struct(*order)).alias("_edge"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (edges.withColumn("_carry", shift("_edge").over(along))
               .where(F.col("_carry").isNotNull()).select(*keys, "_chunk", "_carry"))
    out = here.join(carried, [*keys, "_chunk"], "left")
    near = F.coalesce("_near", "_carry")
    for v in values:
        out = out.withColumn(prefix + v, near.getField(v))
    return out.drop("_chunk", "_near", "_carry")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  chunk: Column, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<value>`` of the preceding row of the same key (null at the first)."""
    return _neighbour(df, keys, order, values, chunk, prefix, forward=False)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
              chunk: Column, prefix: str = "next_") -> DataFrame:
    """Add ``next_<value>`` of the following row of the same key (null at the last)."""
    return _neighbour(df, keys, order, values, chunk, prefix, forward=True)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
            how: str, chunk: Column, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of ``value`` along the order, seam-free across chunks.

    ``backward`` runs from the last row towards the first.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    keyed = df.withColumn("_chunk", chunk).withColumn("_v", value)
    steps = [F.col(o).desc() if backward else F.col(o).asc() for o in order]
    along = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*steps)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    totals = (keyed.groupBy(*keys, "_chunk").agg(agg("_v").alias("_total"))
              .withColumn("_before", agg("_total").over(before)).select(*keys, "_chunk", "_before"))
    joined = keyed.withColumn("_in", agg("_v").over(inside)).join(totals, [*keys, "_chunk"], "left")
    if how == "sum":
        joined = joined.withColumn(out, F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    else:
        first = (F.col("_in") >= F.col("_before")) if how == "max" else (F.col("_in") <= F.col("_before"))
        joined = joined.withColumn(out, F.when(F.col("_before").isNull() | first, F.col("_in"))
                                   .otherwise(F.col("_before")))
        joined = joined.withColumn(out, F.coalesce(out, "_before"))
    return joined.drop("_chunk", "_v", "_in", "_before")

"""Straight lines cut at the edges of a lattice, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.functions.geo import cell_index, col


def _edges(a: Column, b: Column, cell_deg: float) -> Column:
    """Places in (0, 1) on the way from ``a`` to ``b`` where a lattice edge is crossed."""
    lo, hi = cell_index(F.least(a, b), cell_deg) + 1, cell_index(F.greatest(a, b), cell_deg)
    steps = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(F.transform(steps, lambda k: (k * F.lit(cell_deg) - a) / (b - a)), lambda t: (t > 0) & (t < 1))


def crossed_cells(lines: DataFrame, keep: Sequence[str], x0: str, y0: str, x1: str, y1: str, cell_deg: float) -> DataFrame:
    """(keep, col, row, from, to): the stretches of each line by cell, as parts of its length from 0 to 1.

    A line is expanded where it stands, so nothing is shuffled and the rows follow its length. A line without length is one
    stretch from 0 to 1. Rows with a null end have none.
    """
    a, b, c, d = (col(v) for v in (x0, y0, x1, y1))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _edges(a, c, cell_deg), _edges(b, d, cell_deg))))
    cut = lines.where(a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()).withColumn("_marks", marks)
    parts = F.transform(F.sequence(F.lit(1), F.size("_marks") - 1),
                        lambda i: F.struct(F.get("_marks", i - 1).alias("from"), F.get("_marks", i).alias("to")))
    middle = (F.col("from") + F.col("to")) / 2
    return (cut.select(*keep, *[v.alias(n) for n, v in (("_a", a), ("_b", b), ("_c", c), ("_d", d))], F.inline(parts))
            .select(*keep, cell_index(F.col("_a") + middle * (F.col("_c") - F.col("_a")), cell_deg).alias("col"),
                    cell_index(F.col("_b") + middle * (F.col("_d") - F.col("_b")), cell_deg).alias("row"), "from", "to"))

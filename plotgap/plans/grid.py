"""Spatial band joins: an equi-join on lattice cells plus the exact distance test.

Each right row carries its own reach in metres. Reaches are sorted into a ladder
of cell sizes (each tier covers twice the previous one), so a few loose fixes do
not force large cells on everybody. A right row is stored once, in the cell of its
tier; a left row is looked up in the 3 x 3 neighbourhood of every tier in use.
Column width follows the latitude row, so the lookup is exact at any latitude.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.constants import M_PER_DEG
from plotgap.plans.skew import HOT_ROWS, split_hot


def _row_height(cell_m: Column) -> Column:
    # one per mille of margin covers the difference between flat and spherical metres
    return cell_m * F.lit(1.001) / F.lit(M_PER_DEG)


def _column_width(row: Column, height: Column) -> Column:
    edge = F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + height
    return height / F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.01))


def home_cell(lat: str, lon: str, cell_m: float, names: tuple[str, str]) -> list[Column]:
    """(row, column) of the cell that holds a place."""
    height = _row_height(F.lit(float(cell_m)))
    row = F.floor(F.col(lat) / height).cast("bigint")
    return [row.alias(names[0]), F.floor(F.col(lon) / _column_width(row, height)).cast("bigint").alias(names[1])]


def cells_around(df: DataFrame, lat: str, lon: str, cell_m: float, names: tuple[str, str]) -> DataFrame:
    """Each row once for every cell that can hold a place within ``cell_m`` of its own."""
    height = _row_height(F.lit(float(cell_m)))
    base = F.floor(F.col(lat) / height).cast("bigint")
    df = df.withColumn(names[0], F.explode(F.sequence(base - 1, base + 1)))
    middle = F.floor(F.col(lon) / _column_width(F.col(names[0]), height)).cast("bigint")
    return df.withColumn(names[1], F.explode(F.sequence(middle - 1, middle + 1)))


def band_join(left: DataFrame, right: DataFrame, left_pos: tuple[str, str], right_pos: tuple[str, str],
              reach: Column, tiers_m: Sequence[float], equal: Sequence[str] = (), spread: str | None = None,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidate pairs: every left/right pair within ``reach`` plus some farther ones.

    ``left_pos``/``right_pos`` name (lat, lon); ``equal`` are extra equality keys
    present on both sides; ``reach`` is evaluated on the right side and must not
    exceed the last tier. Column names must differ apart from ``equal``. The
    caller adds the exact distance predicate.
    """
    tier = F.raise_error(F.lit(f"reach over the widest tier of {tiers_m[-1]} m")).cast("int")
    for i in reversed(range(len(tiers_m))):
        tier = F.when(reach <= F.lit(float(tiers_m[i])), F.lit(i)).otherwise(tier)
    sizes = F.array(*[F.lit(float(t)) for t in tiers_m])
    ry, rx = right_pos
    right = right.withColumn("_tier", tier)
    height = _row_height(F.element_at(sizes, F.col("_tier") + 1))
    right = (right.withColumn("_row", F.floor(F.col(ry) / height).cast("bigint"))
             .withColumn("_col", F.floor(F.col(rx) / _column_width(F.col("_row"), height)).cast("bigint")))
    ly, lx = left_pos
    tiers = F.array(*[F.lit(i) for i in range(len(tiers_m))])
    left = left.withColumn("_tier", F.explode(tiers))
    base = F.floor(F.col(ly) / height).cast("bigint")
    left = left.withColumn("_row", F.explode(F.sequence(base - 1, base + 1)))
    middle = F.floor(F.col(lx) / _column_width(F.col("_row"), height)).cast("bigint")
    left = left.withColumn("_col", F.explode(F.sequence(middle - 1, middle + 1)))
    keys = [*equal, "_tier", "_row", "_col"]
    if spread is not None:
        left, right = split_hot(left, right, keys, spread, hot_rows)
        keys = [*keys, "_salt"]
    drop = [k for k in keys if k not in equal]
    return left.join(right, keys).drop(*drop)

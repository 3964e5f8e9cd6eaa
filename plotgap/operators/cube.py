"""Space-time cube over dyadic cells, and what changes when it is binned anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.functions.geo import cell_index, col
from plotgap.plans.reuse import pin

BITS = 16


def interleaved(*axes: Column) -> Column:
    """One key of the bits of whole numbers below 2^16, so that key >> n is the key of the cell twice as wide on every axis."""
    n = len(axes)
    bits = [F.shiftleft(F.shiftright(a, b).bitwiseAND(F.lit(1).cast("bigint")), n * b + n - 1 - i) for b in range(BITS) for i, a in enumerate(axes)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def axis(key, i: int, n: int = 3) -> Column:
    """Axis ``i`` of an interleaved key."""
    out = F.lit(0).cast("bigint")
    for b in range(BITS):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(col(key), n * b + n - 1 - i).bitwiseAND(F.lit(1).cast("bigint")), b))
    return out


def finest(events: DataFrame, cell_deg: float, period_us: int) -> DataFrame:
    """(key, n) of the finest cells; the only shuffle of events, partial counts first."""
    x, y = cell_index(F.col("lon") + 180.0, cell_deg), cell_index(F.col("lat") + 90.0, cell_deg)
    t = F.expr(f"t_us div {period_us}")
    inside = (x >= 0) & (x < 1 << BITS) & (y >= 0) & (y < 1 << BITS) & (t >= 0) & (t < 1 << BITS)
    return events.where(inside).select(interleaved(x, y, t).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def event_cube(events: DataFrame, cell_deg: float = 0.05, period_us: int = 3_600_000_000, levels: int = 6) -> DataFrame:
    """(level, key, x, y, t, n): occupied cells of the cube and of its coarser versions, each twice as wide and long.

    Keys interleave the bits of the three axes, so a coarser cube is the sum over key prefixes of the finest and no event is
    read again. Events without a place or time are left out.
    """
    base = finest(events, cell_deg, period_us)
    every = base.select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "key", "n")
    summed = every.groupBy("level", F.expr("shiftright(key, 3 * level)").alias("key")).agg(F.sum("n").alias("n"))
    return summed.select("level", "key", axis("key", 0).alias("x"), axis("key", 1).alias("y"), axis("key", 2).alias("t"), "n")


def cube_sensitivity(cube: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """For every level: occupied cells, dispersion of their counts, and how far the finest hot cells agree with it.

    A cell is hot at ``sigmas`` standard deviations over the mean of its level. ``kept_share`` is the part of the events in hot
    finest cells that a hot cell of the level holds too; ``diluted_share`` the part of the level's hot events outside them.
    A finding that lives at one cell size alone shows as a low kept or a high diluted share.
    """
    cube = pin(cube.select("level", "key", "n"))
    n = F.col("n").cast("double")
    stats = cube.groupBy("level").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_events"), F.max("n").alias("max_n"), F.sum(n * n).alias("_sq"))
    mean = F.col("n_events") / F.col("n_cells")
    var = F.greatest(F.lit(0.0), F.col("_sq") / F.col("n_cells") - mean * mean)
    stats = stats.withColumn("mean_n", mean).withColumn("dispersion", var / mean).withColumn("_hot", mean + sigmas * F.sqrt(var)).drop("_sq")
    flagged = cube.join(F.broadcast(stats.select("level", "_hot")), "level").withColumn("hot", F.col("n") > F.col("_hot")).drop("_hot")  # one row a level
    levels = F.broadcast(stats.select("level"))
    base = flagged.where("level = 0").select(F.col("key").alias("_fine"), F.col("n").alias("_n"), F.col("hot").alias("_fine_hot")).crossJoin(levels)
    base = base.withColumn("key", F.expr("shiftright(_fine, 3 * level)"))
    both = base.join(flagged.select("level", "key", "hot"), ["level", "key"]).groupBy("level").agg(
        F.sum(F.when(F.col("_fine_hot"), F.col("_n")).otherwise(0)).alias("_f"), F.sum(F.when(F.col("hot"), F.col("_n")).otherwise(0)).alias("_h"),
        F.sum(F.when(F.col("_fine_hot") & F.col("hot"), F.col("_n")).otherwise(0)).alias("_b"))
    hot = flagged.groupBy("level").agg(F.count_if("hot").alias("n_hot"))
    return (stats.drop("_hot").join(hot, "level").join(both, "level")
            .withColumn("kept_share", F.col("_b") / F.nullif("_f", F.lit(0))).withColumn("diluted_share", (F.col("_h") - F.col("_b")) / F.nullif("_h", F.lit(0)))
            .drop("_f", "_h", "_b"))

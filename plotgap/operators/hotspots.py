"""Local hot spots (Gi*) with correction for many cells, and how they emerge over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.plans.ranks import cumulative_counts
from plotgap.plans.reuse import pin

TILE = 32
Z_95 = 1.96
#: Polynomial of the normal tail, good to 7.5e-8.
TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def two_sided(z: Column) -> Column:
    """Two-sided probability of a standard normal value, by the fixed polynomial, to nine decimals."""
    t = 1.0 / (1.0 + TAIL[0] * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(TAIL[1:]):
        poly = (poly + c) * t
    return F.round(F.least(F.lit(1.0), 2.0 * poly * F.exp(-z * z / 2.0) / (2.0 * np.pi) ** 0.5), 9)


def local_sums(cells: DataFrame, radius: int) -> DataFrame:
    """(col, row, series, near, weight): for each cell the sums over its neighbourhood, itself included, at every place of
    ``series``; ``weight`` is the number of cells in it.

    The lattice is cut into tiles, and a cell near an edge goes to the next tiles too (their halo), so neighbourhoods are
    summed inside a tile by running sums over a small dense array. No pair of neighbours is ever a row, and a tile has at most
    (``TILE`` + 2 ``radius``)^2 cells however dense the data.
    """
    def tiles(c: str) -> Column:
        return F.array_distinct(F.array(*[F.floor((F.col(c) + d) / F.lit(TILE)).cast("bigint") for d in (-radius, 0, radius)]))
    spread = (cells.select("col", "row", "series", F.explode(tiles("col")).alias("_tc"))
              .select("col", "row", "series", "_tc", F.explode(tiles("row")).alias("_tr")))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tc, tr = key
        side = TILE + 2 * radius
        x, y = frame["col"].to_numpy() - tc * TILE + radius, frame["row"].to_numpy() - tr * TILE + radius
        values = np.array(frame["series"].tolist(), np.float64).reshape(len(frame), -1)
        dense = np.zeros((side + 1, side + 1, values.shape[1] + 1))
        dense[x + 1, y + 1, :-1], dense[x + 1, y + 1, -1] = values, 1
        total = dense.cumsum(axis=0).cumsum(axis=1)
        home = (x >= radius) & (x < side - radius) & (y >= radius) & (y < side - radius)
        x, y = x[home], y[home]
        w = 2 * radius + 1
        sums = total[x + radius + 1, y + radius + 1] - total[x + radius + 1 - w, y + radius + 1] - total[x + radius + 1, y + radius + 1 - w] + total[x + radius + 1 - w, y + radius + 1 - w]
        return pd.DataFrame({"col": frame["col"].to_numpy()[home], "row": frame["row"].to_numpy()[home], "series": [v.tolist() for v in values[home]],
                             "near": [v.tolist() for v in sums[:, :-1]], "weight": np.rint(sums[:, -1]).astype(np.int64)})
    return spread.groupBy("_tc", "_tr").applyInPandas(run, "col long, row long, series array<double>, near array<double>, weight long")


def standardised(near: Column, weight: Column, n: Column, mean: Column, sd: Column) -> Column:
    """Gi* of a neighbourhood sum; null where all cells are alike or the neighbourhood is everything."""
    spread = sd * F.sqrt((n * weight - weight * weight) / (n - 1.0))
    return F.when(spread > 1e-12, (near - mean * weight) / spread)


def gi_star(cells: DataFrame, value: str, radius: int = 1, alpha: float = 0.05) -> DataFrame:
    """(col, row, value, weight, z, p, significant) of every cell; neighbours are the cells that are there.

    ``significant`` controls the share of false findings over all cells by the step-up rule: the largest p that is at most
    ``alpha`` times its rank share. Ranks come from counts of equal p and running sums over slices of p, not from one sort.
    """
    base = pin(cells.select("col", "row", F.col(value).cast("double").alias("x")))
    one = base.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("x").alias("_mean"), F.avg(F.col("x") * F.col("x")).alias("_sq"))
    got = local_sums(base.select("col", "row", F.array("x").alias("series")), radius).crossJoin(F.broadcast(one))  # one row
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("_mean") * F.col("_mean")))
    z = F.round(standardised(F.get("near", F.lit(0)), F.col("weight"), F.col("_n"), F.col("_mean"), sd), 9)
    scored = pin(got.select("col", "row", F.get("series", F.lit(0)).alias(value), "weight", z.alias("z")).withColumn("p", two_sided(F.col("z"))))
    ranked = cumulative_counts(scored, [], F.col("p"), 0.01)
    limit = ranked.where(F.col("v") <= alpha * F.col("upto") / F.col("total")).agg(F.max("v").alias("_limit"))
    return scored.crossJoin(F.broadcast(limit)).withColumn("significant", F.coalesce(F.col("p") <= F.col("_limit"), F.lit(False))).drop("_limit")


def trend(values: np.ndarray) -> tuple[int, float]:
    """Mann-Kendall statistic and variance with ties, by merge counting."""
    n, s, width = len(values), 0, 1
    now = np.asarray(values, np.float64).copy()
    while width < n:
        for at in range(0, n - width, 2 * width):
            left, right = now[at:at + width], now[at + width:at + 2 * width]
            s += int(np.searchsorted(left, right, "left").sum()) - int((len(left) - np.searchsorted(left, right, "right")).sum())
            now[at:at + 2 * width] = np.sort(now[at:at + 2 * width], kind="stable")
        width *= 2
    _, t = np.unique(values, return_counts=True)
    return s, (n * (n - 1) * (2 * n + 5) - int((t * (t - 1) * (2 * t + 5)).sum())) / 18.0


def category(hot: np.ndarray, z: float) -> str:
    """Name of a cell's history from its hot periods and the trend."""
    n, share = len(hot), hot.mean()
    tail = n if hot.all() else int(np.argmin(hot[::-1]))
    before = bool(hot[:n - tail].any())
    if not hot.any():
        return "none"
    if share >= 0.9:
        if not hot[-1]:
            return "historical"
        return "intensifying" if z >= Z_95 else "diminishing" if z <= -Z_95 else "persistent"
    if tail and not before:
        return "new" if tail == 1 else "consecutive"
    return "sporadic" if tail else "cooled"


def emerging(counts: DataFrame, radius: int = 1) -> DataFrame:
    """(col, row, n_hot, last_z, s, trend_z, category) of every cell that ever held an event.

    ``counts(col, row, t, n)`` are the occupied cells of each period; periods run from the first to the last without a break
    and empty ones count as zero. Gi* is taken in each period against the mean over all cells and periods, and the trend from
    the neighbourhood sums, of which Gi* is a rising function. A cell's history is one short array of periods.
    """
    counts = pin(counts)
    span = counts.agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    held = counts.groupBy("col", "row").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("_m")).crossJoin(F.broadcast(span))
    series = pin(held.select("col", "row", F.transform(F.sequence("_t0", "_t1"), lambda t: F.coalesce(F.element_at("_m", t), F.lit(0)).cast("double")).alias("series")))
    flat = F.aggregate("series", F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("series", F.lit(0.0), lambda s, x: s + x * x)
    one = series.agg(F.sum(F.size("series")).cast("double").alias("_n"), F.sum(flat).alias("_s"), F.sum(square).alias("_q"), F.count(F.lit(1)).cast("double").alias("_cells"))
    one = one.select("_cells", (F.col("_s") / F.col("_n")).alias("_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - (F.col("_s") / F.col("_n")) * (F.col("_s") / F.col("_n")))).alias("_sd"))
    got = local_sums(series, radius).crossJoin(F.broadcast(one))  # one row
    z = F.transform("near", lambda v: F.round(F.coalesce(standardised(v, F.col("weight"), F.col("_cells"), F.col("_mean"), F.col("_sd")), F.lit(0.0)), 9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for near, zs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                zs = np.array(zs)
                s, var = trend(np.array(near))
                tz = 0.0 if var <= 0 or s == 0 else (s - np.sign(s)) / var ** 0.5
                hot = zs >= Z_95
                rows.append((int(hot.sum()), float(zs[-1]), s, round(float(tz), 9), category(hot, tz)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.string())))],
                                             names=["col", "row", "n_hot", "last_z", "s", "trend_z", "category"])
    return got.select("col", "row", "near", z.alias("z")).mapInArrow(run, "col long, row long, n_hot long, last_z double, s long, trend_z double, category string")

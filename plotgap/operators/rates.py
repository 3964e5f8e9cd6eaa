"""Events to rates: hours of traffic in each cell, weighed by coverage, and shrunken event rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import cell_index
from plotgap.plans.sequence import HOUR_US, chunk_of, with_previous
from plotgap.plans.traversal import crossed_cells

US = 1_000_000


def track_steps(reports: DataFrame, max_gap_s: float = C.MAX_GAP_S) -> DataFrame:
    """Stretches between consecutive reports of a platform that are close enough to be one movement."""
    rows = with_previous(reports.select("platform_id", "t_us", "event_id", "lat", "lon"), ["platform_id"], ["t_us", "event_id"],
                         ["t_us", "lat", "lon"], chunk_of("t_us", 6 * HOUR_US))
    dt = (F.col("t_us") - F.col("prev_t_us")) / US
    return rows.where((dt > 0) & (dt <= max_gap_s)).select("platform_id", dt.alias("dt_s"), F.col("prev_lon").alias("lon0"), F.col("prev_lat").alias("lat0"),
                                                           F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))


def traffic_exposure(reports: DataFrame, grid: DataFrame, cell_deg: float = C.RECEPTION_CELL_DEG, max_gap_s: float = C.MAX_GAP_S) -> DataFrame:
    """(col, row, hours, n_platforms, seen_hours): time that platforms spent in each cell.

    Stretches are cut at cell edges and their time is dealt by length, so the hours of all cells are the hours of all tracks.
    ``seen_hours`` weighs a cell by the share of its reporting intervals that were not long ones: uneven observation would
    else pass for uneven behaviour. A busy cell is reduced to its platforms before it is reduced to one row.
    """
    part = (F.col("to") - F.col("from")) * F.col("dt_s") / 3600.0
    each = (crossed_cells(track_steps(reports, max_gap_s), ["platform_id", "dt_s"], "lon0", "lat0", "lon1", "lat1", cell_deg)
            .groupBy("col", "row", "platform_id").agg(F.sum(part).alias("hours")))
    cells = each.groupBy("col", "row").agg(F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("n_platforms"))
    share = grid.select("col", "row", (1.0 - F.col("p_long")).alias("_share"))
    return cells.join(share, ["col", "row"], "left").withColumn("seen_hours", F.col("hours") * F.coalesce("_share", F.lit(0.0))).drop("_share")


def event_rates(events: DataFrame, exposure: DataFrame, cell_deg: float = C.RECEPTION_CELL_DEG) -> DataFrame:
    """Events per seen hour of every cell, raw and shrunken towards the rate of all cells.

    Counts are Poisson around a rate that is gamma distributed over cells. Its mean is the overall rate and its variance the
    weighted variance of the raw rates less what chance alone gives (never below zero); a cell keeps its own rate as far as
    its exposure outweighs chance. A cell without seen traffic has no rate, with the reason, never a rate of zero.
    """
    counts = events.groupBy(cell_index("lon", cell_deg).alias("col"), cell_index("lat", cell_deg).alias("row")).agg(F.count(F.lit(1)).alias("n_events"))
    cells = exposure.select("col", "row", "hours", "seen_hours").join(counts, ["col", "row"], "full_outer").select(
        "col", "row", F.coalesce("hours", F.lit(0.0)).alias("hours"), F.coalesce("seen_hours", F.lit(0.0)).alias("seen_hours"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
    rated = cells.withColumn("rate", F.when(F.col("seen_hours") > 0, F.col("n_events") / F.col("seen_hours")))
    used = rated.where("rate IS NOT NULL")
    one = used.agg(F.sum("n_events").alias("o"), F.sum("seen_hours").alias("e"), F.count(F.lit(1)).alias("k"), F.sum(F.col("seen_hours") * F.col("rate") * F.col("rate")).alias("q"))
    prior = one.select((F.col("o") / F.col("e")).alias("_m"), F.greatest(F.lit(0.0), F.col("q") / F.col("e") - (F.col("o") / F.col("e")) * (F.col("o") / F.col("e"))
                                                                   - (F.col("o") / F.col("e")) / (F.col("e") / F.col("k"))).alias("_v"))
    weight = F.when(F.col("_v") > 0, F.col("_v") / (F.col("_v") + F.col("_m") / F.col("seen_hours"))).otherwise(0.0)
    reason = F.when(F.col("hours") <= 0, "no traffic").when(F.col("seen_hours") <= 0, "traffic never well heard")
    return (rated.crossJoin(F.broadcast(prior))  # one row
            .withColumn("shrunken", F.when(F.col("rate").isNotNull(), F.col("_m") + weight * (F.col("rate") - F.col("_m"))))
            .withColumn("relative", F.col("shrunken") / F.nullif("_m", F.lit(0.0)))
            .withColumn("reason", F.when(F.col("rate").isNull(), reason)).drop("_m", "_v"))

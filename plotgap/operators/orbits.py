"""Circling: turn statistics of tracks, the same for any domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap.functions.geo import M_PER_DEG, bearing_deg, haversine_m
from plotgap.plans.sequence import HOUR_US, chunk_of, running, with_previous

US = 1_000_000
#: Fixed edges of the turn-rate histogram, degrees a second.
TURN_RATES = (0.1, 0.5, 1.0, 2.0, 5.0)
DWELL_M = 2000.0


def orbit_features(tracks: DataFrame, keys: tuple[str, ...] = ("platform_id", "track_seq"), dwell_m: float = DWELL_M) -> DataFrame:
    """One row a track: how far it went, how much it turned, and how long it stayed about its centre.

    ``laps`` is the winding number, the net turn in whole circles; ``unwrapped_range`` the span of the heading followed without
    wrapping, a running sum over chunks; ``turn_hist`` counts turn rates between the fixed edges; ``dwell_share`` is the part of
    the duration spent (by its later report) within ``dwell_m`` of the mean position. Reports where the platform has not moved have
    no bearing and are passed over. Nulls stand where a track has no movement.
    """
    keys = list(keys)
    chunk = chunk_of("t_us", 6 * HOUR_US)
    base = tracks.select(*keys, "t_us", "event_id", "lat", "lon")
    rows = with_previous(base, keys, ["t_us", "event_id"], ["t_us", "lat", "lon"], chunk)
    rows = rows.withColumn("dist", haversine_m("prev_lat", "prev_lon", "lat", "lon"))
    moved = rows.where((F.col("dist") > 0) & (F.col("t_us") > F.col("prev_t_us"))).withColumn("bearing", bearing_deg("prev_lat", "prev_lon", "lat", "lon"))
    moved = with_previous(moved.select(*keys, "t_us", "event_id", "prev_t_us", "bearing"), keys, ["t_us", "event_id"], ["bearing"], chunk, prefix="last_")
    turned = moved.where("last_bearing IS NOT NULL").withColumn("turn", F.pmod(F.col("bearing") - F.col("last_bearing") + 540.0, F.lit(360.0)) - 180.0)
    turned = running(turned, keys, ["t_us", "event_id"], F.col("turn"), "heading", "sum", chunk)
    rate = F.abs(F.col("turn")) / ((F.col("t_us") - F.col("prev_t_us")) / US)
    edges = [0.0, *TURN_RATES, float("inf")]
    hist = F.array(*[F.count_if((rate >= lo) & (rate < hi)) for lo, hi in zip(edges, edges[1:])])
    turns = turned.groupBy(*keys).agg(F.sum("turn").alias("net_turn"), F.sum(F.abs("turn")).alias("total_turn"), hist.alias("turn_hist"),
                                      (F.greatest(F.max("heading"), F.lit(0.0)) - F.least(F.min("heading"), F.lit(0.0))).alias("unwrapped_range"))
    order = F.struct("t_us", "event_id")
    whole = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.max("t_us") - F.min("t_us")) / US).alias("duration_s"), F.coalesce(F.sum("dist"), F.lit(0.0)).alias("path_m"),
        F.min_by(F.struct("lat", "lon"), order).alias("_a"), F.max_by(F.struct("lat", "lon"), order).alias("_b"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"),
        ((F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon")) * F.cos(F.radians(F.avg("lat"))) * (M_PER_DEG / 1000.0) ** 2).alias("box_km2"))
    whole = whole.withColumn("net_m", haversine_m(F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon")))
    near = haversine_m("lat", "lon", "_lat", "_lon") <= dwell_m
    dwell = rows.where("prev_t_us IS NOT NULL").join(whole.select(*keys, "_lat", "_lon"), keys).groupBy(*keys).agg(
        (F.sum(F.when(near, F.col("t_us") - F.col("prev_t_us")).otherwise(0)) / US).alias("_dwell_s"))
    return (whole.join(turns, keys, "left").join(dwell, keys, "left")
            .withColumn("laps", F.abs(F.col("net_turn")) / 360.0).withColumn("path_over_net", F.col("path_m") / F.nullif("net_m", F.lit(0.0)))
            .withColumn("dwell_share", F.col("_dwell_s") / F.nullif("duration_s", F.lit(0.0)))
            .select(*keys, "n", "duration_s", "path_m", "net_m", "path_over_net", "box_km2", "net_turn", "total_turn", "laps", "unwrapped_range", "turn_hist", "dwell_share"))

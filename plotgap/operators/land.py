"""Land study: accepted fixes, speed pairs, cell-hours, slow anomalies and the declared share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import cosine_cell, cosine_cell_centre, haversine_m
from plotgap.plans.grid import band_join
from plotgap.plans.nearest import nearest_line
from plotgap.plans.ranks import index_rank, median, quantiles, uniform
from plotgap.plans.reuse import pin
from plotgap.plans.sequence import chunk_of, running, with_next, with_previous

KEYS = ["feed_id", "vehicle_key"]
ARRIVAL_CHUNK = 1_000_000
FILE_CHUNK = 64
CLOCK_CHUNK = 86_400


def local_wall_time(df: DataFrame, seconds: str, zones: dict[str, str]) -> DataFrame:
    """Keep feeds with a known zone and add their local wall time."""
    zone = F.lit(None).cast("string")
    for feed, name in zones.items():
        zone = F.when(F.col("feed_id") == feed, F.lit(name)).otherwise(zone)
    # shift from UTC by the zone's offset, independent of the session time zone
    utc = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col(seconds)), F.current_timezone()),
                                           "yyyy-MM-dd HH:mm:ss"))
    return (df.withColumn("_zone", zone).where(F.col("_zone").isNotNull())
            .withColumn("local_time", F.convert_timezone(F.lit("UTC"), F.col("_zone"), utc)).drop("_zone"))


def accepted_fixes(fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded with reason): files in order, each by vehicle clock, fetch time and arrival; the clock must advance.

    Jitter inside a file is thus no disorder; only a clock behind an earlier file is out of order.
    """
    reason = F.when(F.col("vehicle_key").startswith("entity:"), "entity_key").when(F.col("vehicle_ts").isNull(), "no_vehicle_ts")
    tagged = fixes.withColumn("reason", reason)
    timed = running(tagged.where("reason IS NULL").drop("reason"), KEYS, ["file", "vehicle_ts", "fetched_at", "arrival"], F.col("vehicle_ts"), "_seen",
                    "max", chunk_of("file", FILE_CHUNK), inclusive=False)
    late = F.when(F.col("vehicle_ts") == F.col("_seen"), "duplicate").when(F.col("vehicle_ts") < F.col("_seen"), "out_of_order")
    timed = timed.withColumn("reason", late).drop("_seen")
    excluded = tagged.where("reason IS NOT NULL").unionByName(timed.where("reason IS NOT NULL"))
    return timed.where("reason IS NULL").drop("reason"), excluded


def speed_pairs(accepted: DataFrame) -> DataFrame:
    """Each accepted fix with the one before (their clocks advance): speed, or the reason there is none."""
    rows = with_previous(accepted, KEYS, ["vehicle_ts"], ["vehicle_ts", "lat", "lon", "trip_id"], chunk_of("vehicle_ts", CLOCK_CHUNK))
    dt = F.col("vehicle_ts") - F.col("prev_vehicle_ts")
    dist = haversine_m("prev_lat", "prev_lon", "lat", "lon")
    idle = ((F.coalesce("prev_trip_id", F.lit("")) == "") & (F.coalesce("trip_id", F.lit("")) == "") & (dist < C.PARKED_M))
    reason = (F.when(F.col("prev_vehicle_ts").isNull(), "first_fix").when(dt < C.MIN_DT_S, "too_close")
              .when(dt > C.MAX_DT_S, "gap").when(dist / dt > C.MAX_ROAD_MPS, "impossible").when(idle, "parked").otherwise("pairs"))
    return rows.withColumn("reason", reason).withColumn("speed_mps", F.when(F.col("reason") == "pairs", dist / dt))


REASONS = ["entity_key", "no_vehicle_ts", "duplicate", "out_of_order", "first_fix", "too_close", "gap", "impossible", "parked", "pairs"]


def exclusion_ledger(excluded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per feed and reason; they add up to the fixes read."""
    both = excluded.select("feed_id", "reason").unionByName(pairs.select("feed_id", "reason"))
    return both.groupBy("feed_id").agg(F.count(F.lit(1)).alias("fixes"),
                                       *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def cell_hours(pairs: DataFrame, zones: dict[str, str]) -> DataFrame:
    """Midpoint cell x local date x hour: pairs, vehicles, feeds and bin-centre quantiles of speed."""
    middle = {"mid_s": F.floor((F.col("prev_vehicle_ts") + F.col("vehicle_ts")) / 2), "mid_lat": (F.col("prev_lat") + F.col("lat")) / 2,
              "mid_lon": (F.col("prev_lon") + F.col("lon")) / 2}
    return midpoint_cell_hours(pairs.where("reason = 'pairs'").select(*KEYS, "speed_mps", *[v.alias(k) for k, v in middle.items()]), zones)


def midpoint_cell_hours(good: DataFrame, zones: dict[str, str]) -> DataFrame:
    """Cell-hours of pairs that are known by their midpoint (mid_s, mid_lat, mid_lon) and speed."""
    timed = local_wall_time(good, "mid_s", zones)
    cell = cosine_cell(F.col("mid_lat"), F.col("mid_lon"), C.ROAD_CELL_DEG)
    rows = timed.select(cell["row"].alias("cell_row"), cell["col"].alias("cell_col"), F.to_date("local_time").alias("local_date"),
                        F.hour("local_time").alias("local_hour"), *KEYS,
                        F.least(F.lit(C.ROAD_BINS - 1), F.floor(F.col("speed_mps") / C.ROAD_BIN_MPS)).alias("bin"))
    key = ["cell_row", "cell_col", "local_date", "local_hour"]
    hist = rows.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*key).orderBy("bin")  # at most ROAD_BINS rows per cell-hour
    cum = hist.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*key)))
    centre = (F.col("bin") + 0.5) * C.ROAD_BIN_MPS

    def q(p):
        return F.min(F.when(F.col("upto") > F.lit(p) * (F.col("total") - 1), centre))
    stats = cum.groupBy(*key).agg(F.max("total").alias("n_pairs"), q(0.5).alias("median_mps"), q(0.25).alias("p25_mps"), q(0.75).alias("p75_mps"),
                                  (F.sum(F.when(F.col("bin") < 1, F.col("n")).otherwise(0)) / F.max("total")).alias("share_stopped"))
    seen = rows.select(*key, *KEYS).distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_vehicles"), F.array_join(F.array_sort(F.collect_set("feed_id")), ",").alias("feeds"))
    centre_at = cosine_cell_centre("cell_row", "cell_col", C.ROAD_CELL_DEG)
    return (stats.join(seen, key).withColumn("weekday", F.weekday("local_date"))
            .withColumn("lat", F.round(centre_at["lat"], 6)).withColumn("lon", F.round(centre_at["lon"], 6)))


def slow_anomalies(cells: DataFrame, ratio: float, min_pairs: int, min_vehicles: int, min_days: int) -> DataFrame:
    """Cell-hours slower than ``ratio`` times their own usual median on the same kind of day."""
    ok = cells.where((F.col("n_pairs") >= min_pairs) & (F.col("n_vehicles") >= min_vehicles) & F.col("median_mps").isNotNull())
    ok = ok.withColumn("workday", F.col("weekday") < 5)
    key = ["cell_row", "cell_col", "local_hour", "workday"]
    # one row per day and group, so the exact median holds at most the days of the window
    base = ok.groupBy(*key).agg(F.median("median_mps").alias("baseline_mps"), F.count_distinct("local_date").alias("n_days"))
    base = base.where((F.col("n_days") >= min_days) & (F.col("baseline_mps") > 0))
    return (ok.join(base, key).where(F.col("median_mps") < ratio * F.col("baseline_mps"))
            .withColumn("ratio", F.col("median_mps") / F.col("baseline_mps")))


def new_fixes(polls: DataFrame) -> DataFrame:
    """Mark fixes that differ from the same vehicle's fix in the feed's previous poll."""
    rows = with_previous(polls, KEYS, ["poll_no", "arrival"], ["poll_no", "vehicle_ts", "lat", "lon"], chunk_of("poll_no", 10_000))
    same = (F.col("prev_poll_no") == F.col("poll_no") - 1) & F.col("prev_vehicle_ts").eqNullSafe(F.col("vehicle_ts")) & (
        F.col("prev_lat") == F.col("lat")) & (F.col("prev_lon") == F.col("lon"))
    return rows.withColumn("is_new", ~F.coalesce(same, F.lit(False))).drop("prev_poll_no", "prev_vehicle_ts", "prev_lat", "prev_lon")


def vehicle_poll_ledger(polls: DataFrame) -> DataFrame:
    """Per (feed, poll): vehicles, new, repeated, without id or clock, median position age."""
    marked = new_fixes(polls)
    key = ["feed_id", "poll_no"]
    counts = marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_vehicles"), F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_repeat"),
        F.count_if(F.col("vehicle_key").startswith("entity:")).alias("n_no_vehicle_id"), F.count_if(F.col("vehicle_ts").isNull()).alias("n_no_vehicle_ts"))
    age = median(polls, key, F.col("fetched_at") - F.col("vehicle_ts"), "position_age_s", width=600.0).select(*key, "position_age_s")
    return counts.join(age, key, "left")


def feed_cadence(polls: DataFrame, interval_s: float) -> DataFrame:
    """Cost, cadence and freshness per feed from a table of parsed polls."""
    mid = {"b": F.floor(F.col("total") / 2)}
    raw = quantiles(polls, ["feed_id"], F.col("raw_bytes"), mid, 4096.0).select("feed_id", F.col("n").alias("n_polls"), F.col("b").alias("raw_median"))
    stored = quantiles(polls, ["feed_id"], F.col("stored_bytes"), mid, 4096.0).select("feed_id", F.col("b").alias("stored_median"))
    age = quantiles(polls, ["feed_id"], F.col("age_s"), {"age_p10": index_rank(0.10), "age_median": F.floor(F.col("total") / 2), "age_p90": index_rank(0.90)}, 60.0)
    rest = polls.groupBy("feed_id").agg(F.count_distinct("header_ts").alias("distinct_headers"),
                                        F.avg(F.col("changed") / F.greatest(F.col("vehicles"), F.lit(1))).alias("changed_share"), F.max("age_s").alias("age_max"))
    out = raw.join(stored, "feed_id").join(age.drop("n"), "feed_id").join(rest, "feed_id")
    per_day = F.floor(F.lit(86400.0 / interval_s))
    return (out.withColumn("ratio", F.col("raw_median") / F.greatest(F.col("stored_median"), F.lit(1)))
            .withColumn("gib_per_day", F.col("stored_median") * per_day / float(1024 ** 3))
            .withColumn("header_static", (F.col("distinct_headers") == 1) & (F.col("n_polls") > 2)))


def body_cadence(polls: DataFrame, interval_s: float, feeds_assumed: int) -> DataFrame:
    """How often a feed's bytes really change, from digests alone."""
    order = ["event_id"]
    rows = with_previous(polls, ["feed"], order, ["body"], chunk_of("event_id", ARRIVAL_CHUNK))
    change = F.col("prev_body").isNotNull() & (F.col("prev_body") != F.col("body"))
    numbered = running(rows.withColumn("_change", change), ["feed"], order, F.lit(1), "_i", "sum", chunk_of("event_id", ARRIVAL_CHUNK))
    changes = numbered.where("_change").select("feed", "event_id", "_i")
    gaps = with_previous(changes, ["feed"], order, ["_i"], chunk_of("event_id", ARRIVAL_CHUNK)).withColumn(
        "gap", F.col("_i") - F.coalesce("prev__i", F.lit(1)))
    middle = {"m": F.floor(F.col("total") / 2)}
    gap = quantiles(gaps, ["feed"], F.col("gap"), middle, 8.0).select("feed", F.col("m").alias("polls_between_changes"))
    size = quantiles(polls, ["feed"], F.col("bytes"), middle, 4096.0).select("feed", F.col("m").alias("bytes_median"))
    bodies = polls.groupBy("feed", "body").agg(F.count(F.lit(1)).alias("n"))
    counts = bodies.groupBy("feed").agg(F.sum("n").alias("n_polls"), F.count(F.lit(1)).alias("distinct_bodies"))
    out = counts.join(size, "feed").join(gap, "feed", "left")
    return (out.withColumn("duplicate_share", 1.0 - F.col("distinct_bodies") / F.col("n_polls"))
            .withColumn("update_period_s", F.col("polls_between_changes") * interval_s)
            .withColumn("never_changed", F.col("polls_between_changes").isNull())
            .withColumn("at_resolution_floor", F.coalesce((F.col("polls_between_changes") == 1) & (F.col("n_polls") > 2), F.lit(False)))
            .withColumn("gib_per_day", F.floor(F.lit(86400.0 / interval_s)) * feeds_assumed * F.col("bytes_median") / float(1024 ** 3)))


# ---- declared share ----------------------------------------------------------------------


def declared_anomalies(anomalies: DataFrame, bodies: DataFrame, near_m: float = 300.0) -> DataFrame:
    """Mark each anomaly cell-hour as declared or not.

    ``anomalies(a_id, lat, lon, hour)`` with hour in epoch hours; ``bodies(feed, t_body,
    e_id, e_lat, e_lon, e_start, e_end, e_status)`` lists the events of every stored body.
    An event counts when it is in the latest body at or before the end of the hour, active
    in that hour and close enough. Bodies are first reduced to those that are the latest at
    some hour's end, which makes the as-of match an equality on the hour.
    """
    stamps = bodies.select("feed", "t_body").distinct()
    spans = with_next(stamps, ["feed"], ["t_body"], ["t_body"], chunk_of("t_body", 30 * 86400))
    horizon = anomalies.agg((F.max("hour") + 1).alias("_last"))
    first = F.ceil(F.col("t_body") / 3600.0)
    last = F.coalesce(F.ceil(F.col("next_t_body") / 3600.0) - 1, F.col("_last"))
    current = (spans.join(F.broadcast(horizon)).where(first <= last)
               .select("feed", "t_body", F.explode(F.sequence(first, last)).alias("_end")))
    live = bodies.join(current, ["feed", "t_body"]).withColumn("hour", (F.col("_end") - 1).cast("bigint")).drop("_end")
    hour_end, hour_start = (F.col("hour") + 1) * 3600, F.col("hour") * 3600
    active = ((F.col("e_start") <= hour_end) & (F.col("e_end").isNull() | (F.col("e_end") >= hour_start))
              & ~F.coalesce(F.col("e_status"), F.lit("")).isin("completed", "cancelled"))
    near = band_join(anomalies, live.where(active).select("hour", "e_id", "e_lat", "e_lon"), ("lat", "lon"), ("e_lat", "e_lon"),
                     F.lit(near_m), (near_m,), equal=["hour"], spread="e_id")
    hit = near.where(haversine_m("lat", "lon", "e_lat", "e_lon") <= near_m).select("a_id").distinct().withColumn("declared", F.lit(True))
    return anomalies.join(hit, "a_id", "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def line_groups(points: DataFrame, key: str, segments: DataFrame) -> DataFrame:
    """(key, grp, zone): nearer kind of line and near (0-2 km) or far (2-10 km); others are absent."""
    d = nearest_line(points, segments, key).groupBy(key).agg(
        F.max(F.when(F.col("line_set") == "treatment", F.col("d_m"))).alias("dt"), F.max(F.when(F.col("line_set") == "control", F.col("d_m"))).alias("dc"))
    inf = F.lit(float("inf"))
    dt, dc = F.coalesce("dt", inf), F.coalesce("dc", inf)
    mine = F.least(dt, dc)
    return d.where(mine <= 10_000).select(key, F.when(dt <= dc, "treatment").otherwise("control").alias("grp"),
                                          F.when(mine <= 2_000, "near").otherwise("far").alias("zone"))


def _land_did(groups: DataFrame, keys: Sequence[str] = (), min_group: int = 0) -> DataFrame:
    """Difference in differences of undeclared shares; groups(grp, zone, n, k)."""
    def at(grp, zone, value):
        return F.max(F.when((F.col("grp") == grp) & (F.col("zone") == zone), value))
    share = F.col("k") / F.col("n")
    cells = [(g, z) for g in ("treatment", "control") for z in ("near", "far")]
    agg = [at(g, z, share).alias(f"{g}_{z}") for g, z in cells] + [F.coalesce(at(g, z, F.col("n")), F.lit(0)).alias(f"n_{g}_{z}") for g, z in cells]
    out = groups.groupBy(*keys).agg(*agg) if keys else groups.agg(*agg)
    small = F.least(*[f"n_{g}_{z}" for g, z in cells])
    value = (F.col("treatment_near") - F.col("treatment_far")) - (F.col("control_near") - F.col("control_far"))
    return (out.withColumn("did", F.when(small >= min_group, value))
            .withColumn("stop_reason", F.when(small < min_group, F.lit(f"a group holds fewer than {min_group} anomaly cell-hours"))))


def land_did(anomalies: DataFrame, segments: DataFrame, min_group: int = 30) -> DataFrame:
    """The study statistic over anomalies with a ``declared`` flag; stops on a small group."""
    g = line_groups(anomalies, "a_id", segments)
    counts = anomalies.join(g, "a_id").groupBy("grp", "zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("declared")).alias("k"))
    return _land_did(counts, min_group=min_group)


def _draw_labels(batches: Iterator[pd.DataFrame], seed: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for trial, groups, sizes, k in b.itertuples(index=False):
            rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{trial}".encode()).digest()[:8], "big"))
            got = rng.multivariate_hypergeometric(np.asarray(sizes, dtype=np.int64), int(k), method="marginals")
            out += [(trial, *g.split("|"), int(n), int(x)) for g, n, x in zip(groups, sizes, got)]
        yield pd.DataFrame(out, columns=["trial", "grp", "zone", "n", "k"])


def land_nulls(anomalies: DataFrame, segments: DataFrame, trials: int, shift_trials: int, seed: str) -> DataFrame:
    """Label throws and line displacements of 3 to 20 km, reported as k of n + 1.

    Throwing the undeclared label over the rows only changes four group counts, so each
    trial draws them from the matching hypergeometric law. Displacing the lines is the same
    as displacing the cells the other way; cells are collapsed to counts before that.
    """
    cells = pin(anomalies.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("declared")).alias("k")).withColumn(
        "cell", F.concat_ws(":", "lat", "lon")))
    at = line_groups(cells, "cell", segments)
    counts = pin(cells.join(at, "cell").groupBy("grp", "zone").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    observed = _land_did(counts).select(F.col("did").alias("observed"))
    packed = counts.agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("|", "grp", "zone").alias("g"), "n"))).alias("s"), F.sum("k").alias("k"))
    throws = packed.select(F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), F.transform("s", lambda x: x["g"]).alias("groups"),
                           F.transform("s", lambda x: x["n"]).alias("sizes"), "k")
    thrown = throws.mapInPandas(lambda it: _draw_labels(it, seed), "trial int, grp string, zone string, n bigint, k bigint")
    moves = cells.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(shift_trials))))
    dist = 3_000.0 + 17_000.0 * uniform(seed, F.lit("d"), "trial")
    angle = uniform(seed, F.lit("a"), "trial") * 6.283185307179586
    moved = (moves.withColumn("lat2", F.col("lat") - dist * F.cos(angle) / C.M_PER_DEG)
             .withColumn("lon2", F.col("lon") - dist * F.sin(angle) / (C.M_PER_DEG * F.cos(F.radians("lat"))))
             .select("trial", "n", "k", F.col("lat2").alias("lat"), F.col("lon2").alias("lon"), F.concat_ws("|", "cell", "trial").alias("cell")))
    moved = pin(moved)
    groups = moved.select("cell", "trial", "n", "k").join(line_groups(moved, "cell", segments), "cell")
    shifted = groups.groupBy("trial", "grp", "zone").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def beyond(sims, name):
        both = _land_did(sims, ["trial"]).join(F.broadcast(observed))
        return both.agg(F.count_if(F.col("did") >= F.col("observed")).alias(f"{name}_k"), F.count("did").alias(f"{name}_n"))
    return observed.join(F.broadcast(beyond(thrown, "scattered"))).join(F.broadcast(beyond(shifted, "shift")))


# ---- boundary detail ---------------------------------------------------------------------


def _turn(p: Column, b: Column, n: Column) -> Column:
    """Absolute change of direction at b in radians, travelling p -> b -> n."""
    kx = F.cos(F.radians(b["lat"]))
    ux, uy = (b["lon"] - p["lon"]) * kx, b["lat"] - p["lat"]
    vx, vy = (n["lon"] - b["lon"]) * kx, n["lat"] - b["lat"]
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    cosine = (ux * vx + uy * vy) / F.nullif(size, F.lit(0.0))
    return F.when(size == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def boundary_segments(vertices: DataFrame) -> DataFrame:
    """Ring segments with length, turns at both ends and deviation; vertices(ring, i, lon, lat).

    Consecutive duplicate vertices are dropped first; rings under three vertices vanish.
    The window holds one ring.
    """
    around = Window.partitionBy("ring").orderBy("i")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("lon", "lat")
    rows = vertices.withColumn("v", here).withColumn("_p", F.coalesce(F.lag("v").over(around), F.last("v").over(whole)))
    rows = rows.where(~F.col("v").eqNullSafe(F.col("_p"))).drop("_p")
    rows = (rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ring"))).where("_n >= 3")
            .withColumn("prev", F.coalesce(F.lag("v").over(around), F.last("v").over(whole)))
            .withColumn("next", F.coalesce(F.lead("v").over(around), F.first("v").over(whole))))
    rows = rows.withColumn("turn", _turn(F.col("prev"), F.col("v"), F.col("next")))
    rows = rows.withColumn("turn_b", F.coalesce(F.lead("turn").over(around), F.first("turn").over(whole)))
    length = haversine_m(F.col("v")["lat"], F.col("v")["lon"], F.col("next")["lat"], F.col("next")["lon"])
    return rows.select("ring", "i", length.alias("length_m"), F.degrees("turn").alias("turn_a_deg"), F.degrees("turn_b").alias("turn_b_deg"),
                       (length * (F.col("turn") + F.col("turn_b")) / 16.0).alias("deviation_m"))


def boundary_detail(segments: DataFrame, threshold_m: float, sharp_deg: float = 60.0) -> DataFrame:
    """Nearest-rank quantiles of deviation with and without sharp vertices, and a verdict."""
    from plotgap.plans.ranks import nearest_rank
    sharp = (F.col("turn_a_deg") > sharp_deg) | (F.col("turn_b_deg") > sharp_deg)
    picks = {f"p{int(100 * p)}": nearest_rank(p) for p in (0.10, 0.50, 0.90, 0.99)}
    every = quantiles(segments, [], F.col("deviation_m"), picks, 1000.0)
    smooth = quantiles(segments.where(~sharp), [], F.col("deviation_m"), {"soft_p99": nearest_rank(0.99)}, 1000.0).select("soft_p99")
    rest = segments.agg(F.count_if(sharp).alias("n_sharp"), F.max("deviation_m").alias("worst_m"), (F.sum("length_m") / 1000).alias("perimeter_km"))
    out = every.join(F.broadcast(rest)).join(F.broadcast(smooth))
    soft = F.coalesce("soft_p99", "p99")
    verdict = (F.when(F.col("n") == 0, "no geometry").when(F.col("p99") <= threshold_m / 10, "discretisation is not the limiting factor")
               .when(F.col("p99") <= threshold_m, "usable with care").when(soft <= threshold_m, "too coarse only because of sharp vertices")
               .otherwise("too coarse for the threshold"))
    return out.withColumn("verdict", verdict)


def worst_segments(segments: DataFrame, n: int) -> DataFrame:
    return segments.orderBy(F.desc("deviation_m"), "ring", "i").limit(n)

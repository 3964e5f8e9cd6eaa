"""Track construction and windowed analytics over position reports.

Reports are rows (platform_id, t_us, lat, lon, uncertainty_m, speed_mps, heading_deg, ...).
A track is a label on rows, never a nested array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import bearing_deg, haversine_m, project_point
from plotgap.plans.intervals import around_instants
from plotgap.plans.sequence import HOUR_US, chunk_of, running, with_next, with_previous

US = 1_000_000


def first_per_instant(reports: DataFrame, keys: Sequence[str] = ("platform_id",), tie: str = "event_id") -> DataFrame:
    """Drop exact timestamp repeats of a platform, keeping the first to arrive."""
    rest = [c for c in reports.columns if c not in (*keys, "t_us")]
    kept = reports.groupBy(*keys, "t_us").agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_r"))
    return kept.select(*keys, "t_us", *[F.col("_r")[c].alias(c) for c in rest])


def sessionise_tracks(reports: DataFrame, split_gap_s: float = C.SPLIT_GAP_S,
                      keys: Sequence[str] = ("platform_id",), min_reports: int = 1) -> DataFrame:
    """Add ``track_seq`` (1, 2, ... per platform): a new track after a silence over the gap.

    Rows are summarised to one (first, last) pair per time bucket as wide as the gap.
    Inside a bucket no silence can exceed the gap, so tracks break only between
    buckets, and the ordered pass sees buckets rather than reports.
    """
    gap_us = int(split_gap_s * US)
    bucketed = reports.withColumn("_bucket", chunk_of("t_us", gap_us))
    spans = bucketed.groupBy(*keys, "_bucket").agg(F.min("t_us").alias("_lo"), F.max("t_us").alias("_hi"),
                                                  F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    silence = F.col("_lo") - F.lag("_hi").over(order)
    starts = spans.withColumn("_new", F.when(silence.isNull() | (silence > gap_us), 1).otherwise(0))
    labelled = starts.withColumn("track_seq", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if min_reports > 1:
        size = F.sum("_n").over(Window.partitionBy(*keys, "track_seq"))
        labelled = labelled.withColumn("_size", size).where(F.col("_size") >= min_reports)
    return bucketed.join(labelled.select(*keys, "_bucket", "track_seq"), [*keys, "_bucket"]).drop("_bucket")


def report_intervals(reports: DataFrame) -> DataFrame:
    """Consecutive (start, end, seconds) per platform."""
    nxt = with_next(reports.select("platform_id", "t_us", "event_id"), ["platform_id"], ["t_us", "event_id"],
                    ["t_us"], chunk_of("t_us", 6 * HOUR_US))
    return nxt.where(F.col("next_t_us").isNotNull()).select(
        "platform_id", "event_id", F.col("t_us").alias("start_us"), F.col("next_t_us").alias("end_us"),
        ((F.col("next_t_us") - F.col("t_us")) / US).alias("seconds"))


def track_summary(tracks: DataFrame, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """Start, end, duration, net displacement, path length and size of each track."""
    keys = ["platform_id", "track_seq"]
    steps = with_previous(tracks, keys, ["t_us", "event_id"], ["lat", "lon"], chunk_of("t_us", chunk_us))
    step = haversine_m("prev_lat", "prev_lon", "lat", "lon")
    at, here = F.struct("t_us", "event_id"), F.struct("lat", "lon")
    got = steps.groupBy(*keys).agg(
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n_reports"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("path_m"),
        F.min_by(here, at).alias("_a"), F.max_by(here, at).alias("_b"))
    return got.select(*keys, "start_us", "end_us", "n_reports",
                      ((F.col("end_us") - F.col("start_us")) / US).alias("duration_s"), "path_m",
                      haversine_m(F.col("_a")["lat"], F.col("_a")["lon"], F.col("_b")["lat"],
                                  F.col("_b")["lon"]).alias("net_m"))


def interpolate(a: str, b: str, t: str) -> dict:
    """Columns of the position at ``t`` from bracketing structs ``a`` (before) and ``b`` (at or after).

    Between reports: along the great circle, with uncertainty growing to half the
    distance midway. Past the last report: dead reckoning from speed and heading
    with ten per cent drift. Before the first report: null.
    """
    A, B, T = F.col(a), F.col(b), F.col(t)
    inside = A.isNotNull() & B.isNotNull()
    span = (B["t_us"] - A["t_us"]) / US
    frac = ((T - A["t_us"]) / US) / F.nullif(span, F.lit(0.0))
    dist = haversine_m(A["lat"], A["lon"], B["lat"], B["lon"])
    heading = bearing_deg(A["lat"], A["lon"], B["lat"], B["lon"])
    along = project_point(A["lat"], A["lon"], heading, dist * frac)
    mid_sigma = (F.greatest(A["uncertainty_m"], B["uncertainty_m"])
                 + dist * 0.5 * (1 - F.abs(2 * frac - 1)))
    exact = A.isNull() & B.isNotNull() & (B["t_us"] == T)
    past = B.isNull() & A["speed_mps"].isNotNull() & A["heading_deg"].isNotNull()
    run = A["speed_mps"] * ((T - A["t_us"]) / US)
    ahead = project_point(A["lat"], A["lon"], A["heading_deg"], run)

    def pick(mid, out, same):
        return F.when(inside, mid).when(exact, same).when(past, out)
    return {
        "lat": pick(along["lat"], ahead["lat"], B["lat"]),
        "lon": pick(along["lon"], ahead["lon"], B["lon"]),
        "uncertainty_m": pick(mid_sigma, A["uncertainty_m"] + F.abs(run) * 0.10, B["uncertainty_m"]),
        "how": F.when(inside, "interpolated").when(exact, "interpolated").when(past, "dead reckoned"),
    }


FIX = ["t_us", "lat", "lon", "uncertainty_m", "speed_mps", "heading_deg"]


def asof_bracket(tracks: DataFrame, instants: DataFrame, keys: Sequence[str], at: str = "at_us",
                 chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """For each (keys, at): last report strictly before as ``a``, first at or after as ``b``.

    Reports and instants are laid on one time line; running max and min of the report
    struct give both neighbours without a join on time.
    """
    packed = F.struct(*FIX, "event_id")
    rows = tracks.select(*keys, F.col("t_us").alias("_t"), F.lit(1).alias("_kind"), packed.alias("_fix"))
    asks = instants.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).alias("_fix"))
    line = rows.unionByName(asks)
    chunk = chunk_of("_t", chunk_us)
    # an instant sorts before a report of the same time: that report is then 'at or after'
    before = running(line, keys, ["_t", "_kind"], F.col("_fix"), "a", "max", chunk)
    both = running(before, keys, ["_t", "_kind"], F.col("_fix"), "b", "min", chunk, backward=True)
    return both.where("_kind = 0").select(*keys, F.col("_t").alias(at), "a", "b")


def position_at(tracks: DataFrame, instants: DataFrame, keys: Sequence[str], at: str = "at_us") -> DataFrame:
    """Position of each track at each asked instant; null position where none can be given."""
    got = asof_bracket(tracks, instants, keys, at)
    return got.select(*keys, at, *[c.alias(n) for n, c in interpolate("a", "b", at).items()])


def tracks_at(reports: DataFrame, instants: DataFrame, at: str, window_s: float = C.MATCH_WINDOW_S,
              split_gap_s: float = C.SPLIT_GAP_S, equal: Sequence[str] = ("scene",)) -> DataFrame:
    """Reports within the window of each instant, cut into tracks."""
    near = around_instants(reports, instants, "t_us", at, int(window_s * US))
    return sessionise_tracks(near, split_gap_s, keys=[*equal, "platform_id"])


def decimate_track(tracks: DataFrame, limit: int = 250, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """At most ``limit`` vertices per track at an even stride, always keeping the last."""
    keys = ["platform_id", "track_seq"]
    ranked = running(tracks, keys, ["t_us", "event_id"], F.lit(1), "_rank", "sum", chunk_of("t_us", chunk_us))
    sizes = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    i, n = F.col("_rank") - 1, F.col("_n")
    k = F.ceil(i * limit / n).cast("bigint")
    on_stride = (k < limit) & (F.floor(k * n / limit) == i)
    return (ranked.join(sizes, keys).where((n <= limit) | on_stride | (i == n - 1))
            .withColumn("vertex", i).drop("_rank", "_n"))


def top_tracks(summary: DataFrame, min_points: int, limit: int) -> DataFrame:
    """Longest tracks first; ``truncated`` says whether the limit hid any."""
    kept = summary.where(F.col("n_reports") >= min_points)
    total = kept.agg(F.count(F.lit(1)).alias("n_tracks_total"))
    shown = kept.orderBy(F.desc("n_reports"), "platform_id", "track_seq").limit(limit)
    return (shown.join(F.broadcast(total)).withColumn("truncated", F.col("n_tracks_total") > limit))


def track_lines(decimated: DataFrame) -> DataFrame:
    """Ordered coordinate array of each decimated track (bounded by its vertex limit)."""
    points = F.array_sort(F.collect_list(F.struct("vertex", "lon", "lat")))
    return decimated.groupBy("platform_id", "track_seq").agg(
        F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def latest_fix(states: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest row per platform, by partial aggregation."""
    rest = [c for c in states.columns if c != key]
    got = states.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def recent_vehicles(fixes: DataFrame, feeds: DataFrame, now_s: int, window_s: int) -> DataFrame:
    """Newest fix per (feed, vehicle) in the window, its age and which clock the age is from."""
    inside = fixes.where(F.col("fetched_at") >= now_s - window_s)
    when = F.coalesce("vehicle_ts", "fetched_at")
    rest = [c for c in fixes.columns if c not in ("feed_id", "vehicle_key")]
    newest = inside.groupBy("feed_id", "vehicle_key").agg(
        F.max_by(F.struct(*rest), F.struct(when, F.col("fetched_at"), F.col("arrival"))).alias("_r"))
    flat = newest.select("feed_id", "vehicle_key", *[F.col("_r")[c].alias(c) for c in rest])
    lag = inside.agg((F.lit(now_s) - F.max("fetched_at")).alias("archive_lag_s"))
    return (flat.join(feeds, "feed_id", "left").join(F.broadcast(lag))
            .withColumn("age_s", F.greatest(F.lit(0), F.lit(now_s) - when))
            .withColumn("age_from", F.when(F.col("vehicle_ts").isNotNull(), "vehicle").otherwise("poll")))


def derive_motion(fixes: DataFrame, keys: Sequence[str], order: Sequence[str], chunk) -> DataFrame:
    """Fill a missing speed or bearing from the previous fix when 0 < dt <= 120 s."""
    rows = with_previous(fixes, keys, order, ["vehicle_ts", "lat", "lon"], chunk)
    dt = F.col("vehicle_ts") - F.col("prev_vehicle_ts")
    usable = (dt > 0) & (dt <= 120)
    speed = F.when(usable, haversine_m("prev_lat", "prev_lon", "lat", "lon") / dt)
    bearing = F.when(usable, bearing_deg("prev_lat", "prev_lon", "lat", "lon"))
    told = F.col("speed").isNotNull() & F.col("bearing").isNotNull()
    return (rows.withColumn("motion", F.when(told, "feed").when(usable, "derived").otherwise("none"))
            .withColumn("speed", F.coalesce("speed", speed)).withColumn("bearing", F.coalesce("bearing", bearing))
            .drop("prev_vehicle_ts", "prev_lat", "prev_lon"))

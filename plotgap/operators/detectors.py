"""Self-consistency findings: reports of one identifier that cannot all be true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.classes import kinematic_confidence
from plotgap.functions.geo import M_PER_DEG, combined_uncertainty, haversine_m
from plotgap.operators.tracks import US, first_per_instant
from plotgap.plans.sequence import HOUR_US, chunk_of, with_previous

EVENT = ["kind", "reason", "platform_id", "t_start_us", "t_end_us", "lat", "lon", "confidence", "evidence"]


def steps(reports: DataFrame, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """Each report with the preceding one of its platform, their distance and interval."""
    rows = with_previous(reports, ["platform_id"], ["t_us", "event_id"],
                         ["t_us", "lat", "lon", "uncertainty_m", "speed_mps"], chunk_of("t_us", chunk_us))
    return (rows.where(F.col("prev_t_us").isNotNull())
            .withColumn("dt_s", (F.col("t_us") - F.col("prev_t_us")) / US)
            .withColumn("dist_m", haversine_m("prev_lat", "prev_lon", "lat", "lon"))
            .withColumn("sigma_m", combined_uncertainty("prev_uncertainty_m", "uncertainty_m")))


def _events(rows: DataFrame, kind: str, reason: str, confidence: Column, **evidence: Column) -> DataFrame:
    packed = F.to_json(F.struct(*[F.round(v, 2).alias(k) for k, v in evidence.items()]))
    return rows.select(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), "platform_id",
                       F.col("prev_t_us").alias("t_start_us"), F.col("t_us").alias("t_end_us"), "lat", "lon",
                       confidence.alias("confidence"), packed.alias("evidence"))


def _within_track(pairs: DataFrame, split_gap_s: float | None) -> DataFrame:
    inside = pairs.where(F.col("dt_s") > 0)
    return inside if split_gap_s is None else inside.where(F.col("dt_s") <= split_gap_s)


def _speed_ratio(domain: str) -> Column:
    top = C.PLAUSIBILITY[domain][0]
    return F.greatest(F.lit(0.0), F.col("dist_m") - F.col("sigma_m")) / F.col("dt_s") / top


def impossible_speed(pairs: DataFrame, domain: str, split_gap_s: float | None = None) -> DataFrame:
    """Implied speed, after taking off the positional uncertainty, over 1.1 x the maximum."""
    rows = _within_track(pairs, split_gap_s).withColumn("_ratio", _speed_ratio(domain))
    rows = rows.where(F.col("_ratio") > C.TOLERANCE)
    return _events(rows, "kinematic", "implied speed exceeds platform maximum", kinematic_confidence("_ratio"),
                   ratio=F.col("_ratio"), distance_m=F.col("dist_m"), interval_s=F.col("dt_s"))


def impossible_accel(pairs: DataFrame, domain: str, split_gap_s: float | None = None) -> DataFrame:
    """Implied acceleration over 1.1 x the maximum, where the speed test did not fire."""
    rows = _within_track(pairs, split_gap_s).where(_speed_ratio(domain) <= C.TOLERANCE)
    accel = F.abs(F.col("speed_mps") - F.col("prev_speed_mps")) / F.col("dt_s")
    rows = rows.withColumn("_ratio", accel / C.PLAUSIBILITY[domain][1]).where(F.col("_ratio") > C.TOLERANCE)
    return _events(rows, "kinematic", "implied acceleration exceeds platform maximum",
                   kinematic_confidence("_ratio"), ratio=F.col("_ratio"), interval_s=F.col("dt_s"))


def speed_disagreement(pairs: DataFrame, factor: float = 3.0, split_gap_s: float | None = None) -> DataFrame:
    """Claimed speed and distance covered disagree by ``factor`` or more."""
    implied, claimed = F.col("dist_m") / F.col("dt_s"), F.col("prev_speed_mps")
    rows = _within_track(pairs, split_gap_s).where(claimed.isNotNull() & ~((claimed < 1.0) & (implied < 1.0)))
    ratio = F.greatest(implied, claimed) / F.greatest(F.lit(0.5), F.least(implied, claimed))
    rows = rows.withColumn("_ratio", ratio).where(F.col("_ratio") >= factor)
    return _events(rows, "kinematic", "reported speed disagrees with distance covered",
                   F.least(F.lit(0.7), 0.3 + 0.05 * F.col("_ratio")), ratio=F.col("_ratio"),
                   claimed_mps=claimed, implied_mps=implied)


def identity_reuse(pairs: DataFrame, domain: str, min_gap_s: float = 3600.0) -> DataFrame:
    """An identifier resumes after a long silence somewhere it could not have reached."""
    reach = C.PLAUSIBILITY[domain][0] * F.col("dt_s")
    rows = pairs.where((F.col("dt_s") >= min_gap_s) & (F.col("dist_m") > reach))
    return _events(rows, "identity", "identifier resumed beyond reachable range",
                   F.least(F.lit(0.9), 0.6 + (F.col("dist_m") - reach) / 5_000_000), separation_m=F.col("dist_m"),
                   gap_s=F.col("dt_s"))


def identity_duplicate(reports: DataFrame) -> DataFrame:
    """Same identifier and instant, more than a metre from the one before."""
    same = Window.partitionBy("platform_id", "t_us").orderBy("event_id")
    rows = (reports.withColumn("_p", F.lag(F.struct("lat", "lon")).over(same))
            .withColumn("_d", haversine_m(F.col("_p")["lat"], F.col("_p")["lon"], "lat", "lon"))
            .where(F.col("_d") > 1.0).withColumn("prev_t_us", F.col("t_us")))
    return _events(rows, "identity", "two differing reports share one timestamp", F.lit(0.6), separation_m=F.col("_d"))


def _excess(domain: str) -> Column:
    dt = F.greatest((F.col("b_t") - F.col("a_t")) / US, F.lit(1.0))
    dist = haversine_m("a_lat", "a_lon", "b_lat", "b_lon")
    return dist - C.PLAUSIBILITY[domain][0] * dt - combined_uncertainty("a_sigma", "b_sigma")


def _side(rows: DataFrame, side: str, *extra: str) -> DataFrame:
    names = {"t_us": "t", "event_id": "id", "lat": "lat", "lon": "lon", "uncertainty_m": "sigma"}
    return rows.select("platform_id", *extra, *[F.col(k).alias(f"{side}_{v}") for k, v in names.items()])


def suspect_minutes(reports: DataFrame, domain: str, window_us: int) -> DataFrame:
    """Rows whose time bucket, or one beside it, holds an impossible consecutive step.

    If every step between two reports respects the speed limit, the triangle inequality
    says the two reports do as well; only stretches with a bad step need any pairing.
    """
    rows = steps(first_and_all(reports))
    bad = rows.where(F.col("dist_m") > C.PLAUSIBILITY[domain][0] * F.col("dt_s"))
    bucket = chunk_of("t_us", window_us)
    near = (bad.select("platform_id", bucket.alias("_m")).distinct()
            .select("platform_id", F.explode(F.sequence(F.col("_m") - 1, F.col("_m") + 1)).alias("_m")).distinct())
    return reports.withColumn("_m", bucket).join(near, ["platform_id", "_m"], "left_semi")


def first_and_all(reports: DataFrame) -> DataFrame:
    return reports.select("platform_id", "event_id", "t_us", "lat", "lon", "uncertainty_m", "speed_mps")


def identity_collision(reports: DataFrame, domain: str, window_s: float = 60.0, cell_deg: float = 0.25) -> DataFrame:
    """The worst pair per identifier of reports within the window that no journey explains.

    Rows are collapsed to (identifier, minute, cell) summaries. Cell pairs get an upper
    bound of the excess from their extents, and one representative pair gives each
    identifier a lower bound; only cell pairs that can still hold the maximum are opened
    to rows. The result is exact, and an identifier shared by many transmitters costs
    pairs of cells, not pairs of reports.
    """
    window_us = int(window_s * US)
    rows = (suspect_minutes(reports, domain, window_us)
            .withColumn("_cy", F.floor(F.col("lat") / cell_deg)).withColumn("_cx", F.floor(F.col("lon") / cell_deg)))
    rep = F.struct("t_us", "event_id", "lat", "lon", "uncertainty_m")
    cells = rows.groupBy("platform_id", "_m", "_cy", "_cx").agg(
        F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"),
        F.min("uncertainty_m").alias("s"), F.min(rep).alias("r"))
    left = cells.select("platform_id", F.col("_m").alias("_ma"), F.explode(F.array(F.col("_m"), F.col("_m") + 1)).alias("_m"),
                        *[F.col(c).alias("a_" + c.lstrip("_")) for c in ("_cy", "_cx", "y0", "y1", "x0", "x1", "s", "r")])
    right = cells.select("platform_id", "_m",
                         *[F.col(c).alias("b_" + c.lstrip("_")) for c in ("_cy", "_cx", "y0", "y1", "x0", "x1", "s", "r")])
    dlat = F.greatest("a_y1", "b_y1") - F.least("a_y0", "b_y0")
    dlon = F.greatest("a_x1", "b_x1") - F.least("a_x0", "b_x0")
    # sum of the two sides of the joint box bounds any distance inside it (1.002: sphere versus flat)
    upper = ((dlat + dlon) * F.lit(1.002 * M_PER_DEG) - C.PLAUSIBILITY[domain][0] - combined_uncertainty("a_s", "b_s"))
    pairs = left.join(right, ["platform_id", "_m"]).withColumn("upper", upper).where("upper > 0")
    fields = {"t": "t_us", "lat": "lat", "lon": "lon", "sigma": "uncertainty_m"}
    sample = pairs.select("platform_id", *[F.col(f"{s}_r")[v].alias(f"{s}_{k}") for s in "ab" for k, v in fields.items()])
    sample = sample.where((F.col("b_t") >= F.col("a_t")) & (F.col("b_t") - F.col("a_t") <= window_us))
    lower = sample.groupBy("platform_id").agg(F.max(_excess(domain)).alias("lower"))
    open_ = (pairs.join(lower, "platform_id", "left")
             .where(F.col("upper") >= F.greatest(F.coalesce("lower", F.lit(0.0)), F.lit(0.0)))
             .select("platform_id", "_ma", "_m", "a_cy", "a_cx", "b_cy", "b_cx").distinct())
    a = _side(rows, "a", F.col("_m").alias("_ma"), F.col("_cy").alias("a_cy"), F.col("_cx").alias("a_cx"))
    b = _side(rows, "b", "_m", F.col("_cy").alias("b_cy"), F.col("_cx").alias("b_cx"))
    after = ((F.col("b_t") > F.col("a_t")) | ((F.col("b_t") == F.col("a_t")) & (F.col("b_id") > F.col("a_id"))))
    both = (open_.join(a, ["platform_id", "_ma", "a_cy", "a_cx"]).join(b, ["platform_id", "_m", "b_cy", "b_cx"])
            .where(after & (F.col("b_t") - F.col("a_t") <= window_us)).withColumn("excess", _excess(domain))
            .where("excess > 0"))
    # worst excess; ties go to the earliest first report, then the earliest second one
    rank = F.struct("excess", -F.col("a_t"), -F.col("a_id"), -F.col("b_t"), -F.col("b_id"))
    worst = both.groupBy("platform_id").agg(F.max_by(F.struct(
        "excess", F.col("a_t").alias("prev_t_us"), F.col("b_t").alias("t_us"), F.col("b_lat").alias("lat"),
        F.col("b_lon").alias("lon")), rank).alias("w")).select("platform_id", "w.*")
    return _events(worst, "identity", "identifier reported from two places at once",
                   F.least(F.lit(0.98), 0.75 + F.col("excess") / 1_000_000), excess_m=F.col("excess"))


def run_detectors(reports: DataFrame, domain: str, split_gap_s: float = C.SPLIT_GAP_S) -> DataFrame:
    """Every self-consistency detector over one archive window."""
    once = first_per_instant(reports)
    pairs = steps(once)
    found = impossible_speed(pairs, domain, split_gap_s)
    for more in (impossible_accel(pairs, domain, split_gap_s), speed_disagreement(pairs, split_gap_s=split_gap_s),
                 identity_reuse(pairs, domain), identity_collision(reports, domain), identity_duplicate(reports)):
        found = found.unionByName(more)
    return found

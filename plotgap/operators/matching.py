"""Observation against report: where tracks were at the instant of a scene, which pairs are
admissible, the largest one-to-one assignment, and what is left over on either side."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions import classes as K
from plotgap.functions.geo import M_PER_DEG, cell_index, haversine_m
from plotgap.operators.footprint import in_polygons
from plotgap.operators.tracks import FIX, US, interpolate
from plotgap.plans.components import connected_components, ensure_checkpoint_dir
from plotgap.plans.grid import band_join
from plotgap.plans.intervals import around_instants
from plotgap.plans.reuse import pin, spread

MATCH_TIERS_M = (500.0, 2000.0, 8000.0, 32000.0)
IN_TASK_PAIRS = 100_000
NEAR_REPORTS = 4.0


def scene_fixes(scenes: DataFrame, reports: DataFrame, window_s: float = C.MATCH_WINDOW_S,
                split_gap_s: float = C.SPLIT_GAP_S) -> DataFrame:
    """Every track around each scene instant, with its position at that instant.

    Only the last report before and the first at or after the instant matter, so each
    (scene, platform) is reduced by partial aggregation. With a split gap no shorter
    than the half window, a platform has one track across the instant or two beside it.
    """
    if split_gap_s < window_s:
        raise ValueError("the split gap must cover the half window")
    near = around_instants(reports, scenes, "t_us", "t_scene_us", int(window_s * US))
    packed, at = F.struct(*FIX), F.struct("t_us", "event_id")
    before, sized = F.col("t_us") < F.col("t_scene_us"), F.col("length_m") > 0
    got = near.groupBy("scene", "t_scene_us", "platform_id").agg(
        F.max_by(packed, F.when(before, at)).alias("a"), F.min_by(packed, F.when(~before, at)).alias("b"),
        F.min_by("length_m", F.when(before & sized, at)).alias("la"),
        F.min_by("length_m", F.when(~before & sized, at)).alias("lb"),
        F.count_if(before).alias("na"), F.count_if(~before).alias("nb"))
    A, B = F.col("a"), F.col("b")
    none = F.lit(None).cast("struct<t_us:bigint,lat:double,lon:double,uncertainty_m:double,speed_mps:double,heading_deg:double>")

    def part(seq, a, b, length, n):
        return F.struct(F.lit(seq).alias("track_seq"), a.alias("a"), b.alias("b"), length.alias("length_m"), n.alias("n_reports"))
    one = F.array(part(1, A, B, F.coalesce("la", "lb"), F.col("na") + F.col("nb")))
    two = F.array(part(1, A, none, F.col("la"), F.col("na")), part(2, none, B, F.col("lb"), F.col("nb")))
    joined = A.isNotNull() & B.isNotNull() & (B["t_us"] - A["t_us"] <= int(split_gap_s * US))
    tracks = F.when(joined, one).otherwise(F.filter(two, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    flat = (got.select("scene", "t_scene_us", "platform_id", F.explode(tracks).alias("p"))
            .select("scene", "t_scene_us", "platform_id", "p.*"))
    pos = interpolate("a", "b", "t_scene_us")
    fixed = flat.select("scene", "platform_id", "track_seq", "length_m", "n_reports",
                        *[pos[c].alias(c) for c in ("lat", "lon", "uncertainty_m")])
    return fixed.withColumn("has_fix", F.coalesce(F.col("uncertainty_m") <= C.MAX_FIX_UNCERTAINTY_M, F.lit(False)))


def candidate_pairs(observations: DataFrame, fixes: DataFrame, k: float = C.K_SIGMA) -> DataFrame:
    """Admissible (observation, track) pairs of a scene with distance and radius."""
    widest = observations.agg(F.max("uncertainty_m").alias("_worst"))
    usable = (fixes.where("has_fix").join(F.broadcast(widest))
              .select("scene", "platform_id", "track_seq", F.coalesce("length_m", F.lit(C.DEFAULT_LENGTH_M)).alias("length_m"),
                      F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), F.col("uncertainty_m").alias("f_sigma"), "_worst"))
    half = F.col("length_m") / 2
    reach = k * F.sqrt(F.col("_worst") ** 2 + F.col("f_sigma") ** 2 + half ** 2)
    obs = observations.select("scene", "obs_id", "lat", "lon", "uncertainty_m")
    near = band_join(obs, usable, ("lat", "lon"), ("f_lat", "f_lon"), reach, MATCH_TIERS_M, equal=["scene"], spread="platform_id")
    radius = k * F.sqrt(F.col("uncertainty_m") ** 2 + F.col("f_sigma") ** 2 + half ** 2)
    return (near.withColumn("distance_m", haversine_m("lat", "lon", "f_lat", "f_lon")).withColumn("radius_m", radius)
            .where(F.col("distance_m") <= F.col("radius_m"))
            .select("scene", "obs_id", "platform_id", "track_seq", "distance_m", "radius_m"))


def _start(options: Mapping[int, Sequence[tuple[float, str]]]) -> dict[int, str]:
    """Mutual nearest partners, as held track by observation."""
    first: dict[str, tuple[float, int]] = {}
    for o, near in options.items():
        distance, track = min(near)
        first[track] = min(first.get(track, (distance, o)), (distance, o))
    return {o: track for track, (_, o) in first.items()}


def _matched(options: Mapping[int, Sequence[tuple[float, str]]]) -> dict[int, str]:
    """The rule of ``maximum_matching`` on one component's (distance, track) by observation; ``_settled_at_scale`` takes the same
    steps by joins."""
    held, relabel = _start(options), False
    while True:
        owner = {t: o for o, t in held.items()}
        claim: dict[str, tuple[int, float, int]] = {}  # track: (root, distance, observation)
        frontier = {o: o for o in options if o not in held}
        while frontier:
            offers: dict[str, tuple[int, float, int]] = {}
            for o, root in frontier.items():
                for distance, track in options[o]:
                    if track not in claim or (relabel and root < claim[track][0]):
                        offers[track] = min(offers.get(track, (root, distance, o)), (root, distance, o))
            claim.update(offers)
            frontier = {owner[t]: root for t, (root, _, _) in offers.items() if t in owner}
        ends: dict[int, tuple] = {}
        for track, (root, distance, _) in claim.items():
            if track not in owner:
                end = (0, distance, track)
            elif owner[track] > root:
                end = (1, -owner[track], track)
            else:
                continue
            ends[root] = min(ends.get(root, end), end)
        if not ends:
            if relabel or not claim:
                break
            relabel = True
            continue
        relabel = False
        for root, (kind, _, track) in ends.items():
            if kind == 1:
                del held[owner[track]]
            while True:
                o = claim[track][2]
                track, held[o] = held.get(o), track
                if o == root:
                    break
    return held


def _settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """The rows that ``_matched`` keeps of each component; rows of one component lie together."""
    obs, track, distance = (pairs[c].tolist() for c in ("obs_id", "track", "distance_m"))
    starts = np.flatnonzero((pairs["component"] != pairs["component"].shift()).to_numpy()).tolist()
    keep = np.zeros(len(pairs), dtype=bool)
    for lo, hi in zip(starts, [*starts[1:], len(pairs)]):
        options: dict[int, list[tuple[float, str]]] = {}
        for i in range(lo, hi):
            options.setdefault(obs[i], []).append((distance[i], track[i]))
        held = _matched(options)
        keep[lo:hi] = [held.get(obs[i]) == track[i] for i in range(lo, hi)]
    return pairs.loc[keep, PAIR_COLUMNS]


def _settled_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_settled`` over batches sorted by component; the last component of a batch waits for its other rows."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            last = batch["component"] == batch["component"].iloc[-1]
            if waiting and waiting[0]["component"].iloc[0] == batch["component"].iloc[-1]:
                waiting.append(batch)
                continue
            yield _settled(pd.concat([*waiting, batch[~last]], ignore_index=True))
            waiting = [batch[last]]
    if waiting:
        yield _settled(pd.concat(waiting, ignore_index=True))


PAIR_COLUMNS = ["scene", "obs_id", "platform_id", "track_seq", "distance_m", "radius_m"]
PAIR_SCHEMA = "scene bigint, obs_id bigint, platform_id string, track_seq int, distance_m double, radius_m double"


def _settled_at_scale(pairs: DataFrame) -> DataFrame:
    """The rule of ``maximum_matching`` on components of any size, by rounds of joins; nothing is gathered."""
    ensure_checkpoint_dir(pairs.sparkSession)
    edges = pairs.select("obs_id", "track", "distance_m").checkpoint()
    first = edges.groupBy("obs_id").agg(F.min(F.struct("distance_m", "track")).alias("m")).select("obs_id", "m.*")
    held = first.groupBy("track").agg(F.min(F.struct("distance_m", "obs_id")).alias("m")).select(F.col("m.obs_id").alias("obs_id"), "track").checkpoint()
    relabel = False
    while True:  # every phase adds a pair or moves one to an earlier observation
        frontier = edges.select("obs_id").distinct().join(held, "obs_id", "left_anti").select("obs_id", F.col("obs_id").alias("root")).checkpoint()
        claim = None
        while not frontier.isEmpty():
            offers = (edges.join(frontier, "obs_id").groupBy("track")
                      .agg(F.min(F.struct("root", "distance_m", "obs_id")).alias("m")).select("track", "m.*"))
            if claim is not None:
                old = claim.select("track", F.col("root").alias("_root"))
                offers = offers.join(old, "track", "left").where("_root IS NULL OR root < _root" if relabel else "_root IS NULL").drop("_root")
            offers = offers.checkpoint()
            claim = offers if claim is None else claim.join(offers, "track", "left_anti").unionByName(offers).checkpoint()
            frontier = offers.join(held.withColumnRenamed("obs_id", "next"), "track").select(F.col("next").alias("obs_id"), "root").checkpoint()
        if claim is None:
            break
        reached = claim.join(held.withColumnRenamed("obs_id", "owner"), "track", "left").where("owner IS NULL OR owner > root")
        rank = F.struct(F.col("owner").isNotNull().cast("int").alias("kind"), F.when(F.col("owner").isNull(), F.col("distance_m")).alias("near"),
                        (-F.col("owner")).alias("late"), F.col("track"))
        ends = reached.groupBy("root").agg(F.min(rank).alias("m")).select("m.track").checkpoint()
        if ends.isEmpty():
            if relabel:
                break
            relabel = True
            continue
        relabel = False
        at, taken = ends, None
        while not at.isEmpty():
            step = claim.join(at, "track", "left_semi").select("obs_id", "track").checkpoint()
            taken = step if taken is None else taken.unionByName(step).checkpoint()
            at = step.select("obs_id").join(held, "obs_id").select("track").checkpoint()
        held = (held.join(taken, "obs_id", "left_anti").join(taken, "track", "left_anti").select("obs_id", "track").unionByName(taken).checkpoint())
    return pairs.join(held, ["obs_id", "track"], "left_semi")


def with_components(pairs: DataFrame) -> DataFrame:
    """Pairs with the name of their connected component; mutually exclusive pairs are components of their own."""
    pairs = pin(pairs.withColumn("track", F.concat_ws("|", "scene", "platform_id", "track_seq")))
    by_obs = pairs.groupBy("obs_id").agg(F.count(F.lit(1)).alias("_do"))
    by_track = pairs.groupBy("track").agg(F.count(F.lit(1)).alias("_dt"))
    degrees = pairs.join(by_obs, "obs_id").join(by_track, "track")
    node = F.concat(F.lit("o"), F.col("obs_id").cast("string"))
    contested = degrees.where("_do > 1 OR _dt > 1").withColumn("_node", node)
    comp = connected_components(contested.select(F.col("_node").alias("a"), F.concat(F.lit("t"), "track").alias("b")))
    tagged = contested.join(comp.withColumnRenamed("node", "_node"), "_node")
    cols = [*pairs.columns, "component"]
    return degrees.where("_do = 1 AND _dt = 1").withColumn("component", node).select(*cols).unionByName(tagged.select(*cols)).drop("track")


def maximum_matching(pairs: DataFrame, in_task_pairs: int = IN_TASK_PAIRS) -> DataFrame:
    """Largest set of pairs using every observation and every track at most once, by one rule for any size.

    Mutual nearest partners start. In each phase every open observation grows a tree over alternating ways; a track goes to the
    tree that reaches it in the fewest steps, then to the smallest open obs_id, then to the nearer observation. A tree that reaches
    an open track extends the matching to its nearest one; otherwise it takes the place of the largest later observation in it.
    When no tree has either, a track goes to the smallest open obs_id that can reach it at all, and the phases end when that
    gives nothing too. So the matching is as large as can be, and the observations left over are those left when they are
    taken one by one in order of obs_id.
    Mutually exclusive pairs are taken as they are. Contested ones are split into connected components, which do not
    affect each other: ``in_task_pairs`` only decides where a component is worked, in one task or by joins, never its result.
    A task takes its components one after another from sorted batches, so many small ones cost no frame each.
    ``pairs`` may bring a ``component`` that holds whole components, one or several: parts do not affect each other either.
    """
    if "component" not in pairs.columns:
        pairs = with_components(pairs)
    tagged = pin(pairs.withColumn("track", F.concat_ws("|", "scene", "platform_id", "track_seq")))
    cols = PAIR_COLUMNS
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    tagged = pin(tagged.join(sizes, "component"))
    small = (spread(tagged.where((F.col("_size") > 1) & (F.col("_size") <= in_task_pairs)).select("component", "track", *cols), "component")
             .sortWithinPartitions("component").mapInPandas(_settled_runs, PAIR_SCHEMA))
    large = tagged.where((F.col("_size") > 1) & (F.col("_size") > in_task_pairs))
    out = tagged.where("_size = 1").select(*cols).unionByName(small)
    if not large.isEmpty():
        out = out.unionByName(_settled_at_scale(large).select(*cols))
    return out


def associate(observations: DataFrame, fixes: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-scene summary, unmatched observations, unmatched tracks)."""
    keys = ["scene", "platform_id", "track_seq"]
    lost_obs = observations.join(matched.select("scene", "obs_id"), ["scene", "obs_id"], "left_anti")
    lost_tracks = fixes.join(matched.select(*keys), keys, "left_anti")
    n = F.count(F.lit(1))
    o = observations.groupBy("scene").agg(n.alias("n_observations"))
    f = fixes.groupBy("scene").agg(n.alias("n_tracks"), F.count_if(~F.col("has_fix")).alias("n_no_fix"))
    m = matched.groupBy("scene").agg(n.alias("n_matched"))
    s = (o.join(f, "scene", "full_outer").join(m, "scene", "left")
         .fillna(0, ["n_observations", "n_tracks", "n_no_fix", "n_matched"]))
    eligible = F.nullif(F.col("n_tracks") - F.col("n_no_fix"), F.lit(0))
    s = (s.withColumn("n_unmatched_obs", F.col("n_observations") - F.col("n_matched"))
         .withColumn("n_unmatched_tracks", F.col("n_tracks") - F.col("n_matched"))
         .withColumn("detection_rate", F.col("n_matched") / eligible)
         .withColumn("unmatched_fraction", F.col("n_unmatched_obs") / F.nullif("n_observations", F.lit(0))))
    return s, lost_obs, lost_tracks


def unmatched_events(lost_obs: DataFrame, summary: DataFrame) -> DataFrame:
    """Unexplained detections; confidence is the detector's times this pass's detection rate."""
    rate = summary.select("scene", F.coalesce("detection_rate", F.lit(0.0)).alias("rate"))
    score = F.coalesce("confidence", F.lit(0.5)) * F.coalesce("rate", F.lit(0.0))
    return lost_obs.join(rate, "scene", "left").select(
        "scene", "obs_id", "lat", "lon", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))


def in_footprint(fixes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fixes inside the polygon of their scene."""
    return in_polygons(fixes.where("lat IS NOT NULL"), edges, ["scene"])


def split_by_searched(fixes: DataFrame, searched: DataFrame, keys: Sequence[str], cell_deg: float) -> DataFrame:
    """searched (level at the convention or more), marginal (some), or unsearched."""
    cells = fixes.withColumn("col", cell_index("lon", cell_deg)).withColumn("row", cell_index("lat", cell_deg))
    level = searched.select(*keys, "col", "row", (F.col("level") / C.LEVELS).alias("_f"))
    fraction = F.coalesce("_f", F.lit(0.0))
    return (cells.join(level, [*keys, "col", "row"], "left")
            .withColumn("water", F.when(fraction >= C.SEARCHED, "searched").when(fraction > 0, "marginal").otherwise("unsearched"))
            .drop("_f", "col", "row"))


def detection_gate(observations: DataFrame, min_snr: float, min_pixels: int) -> DataFrame:
    return observations.where((F.col("snr") >= min_snr) & (F.col("pixels") >= min_pixels))


def matched_flag(detections: DataFrame, unmatched: DataFrame, scored: DataFrame) -> DataFrame:
    """matched = position (5 decimals) not among the unmatched; null when the pass was never scored."""
    def key(df):
        return df.withColumn("_x", F.round("lon", 5)).withColumn("_y", F.round("lat", 5))
    lost = key(unmatched).select("day", "_x", "_y").distinct().withColumn("_lost", F.lit(True))
    seen = scored.select("day").distinct().withColumn("_scored", F.lit(True))
    rows = key(detections).join(lost, ["day", "_x", "_y"], "left").join(seen, "day", "left")
    return rows.withColumn("matched", F.when(F.col("_scored"), F.col("_lost").isNull())).drop("_x", "_y", "_lost", "_scored")


def misses_by_length(lost_tracks: DataFrame) -> DataFrame:
    return lost_tracks.groupBy(K.miss_bucket("length_m").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _nearest(pairs: DataFrame, key: str, keep: Sequence[str], tie: str) -> DataFrame:
    got = pairs.groupBy(key).agg(F.min_by(F.struct("distance_m", *keep), F.struct("distance_m", tie)).alias("r"))
    return got.select(key, "r.*")


def nearest_report(detections: DataFrame, reports: DataFrame, at: str, window_s: float = 1800.0, max_m: float = 10_000.0) -> DataFrame:
    """Nearest report in space within the time window of each detection.

    The search widens ring by ring: what has a report within a radius is settled, the rest goes on to four times that
    radius, up to ``max_m``. The first radius holds a few reports where reports lie as densely as about the average report,
    so the pairs looked at follow the detections and not the density; results do not depend on it.
    """
    width = int(window_s * US)

    def bucket(t):
        return F.floor(t / F.lit(2 * width)).cast("bigint")
    right = reports.select("platform_id", F.col("event_id").alias("report_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
                           F.col("t_us").alias("r_t"), bucket(F.col("t_us")).alias("_b"))
    crowd = right.groupBy("_b", *[F.floor(F.col(c) / F.lit(max_m / M_PER_DEG)) for c in ("r_lat", "r_lon")]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    mean = crowd.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    radii = [float(max_m)]
    while radii[0] > 1.0 and (radii[0] / max_m) ** 2 * mean > NEAR_REPORTS:
        radii.insert(0, radii[0] / 4)
    rest, settled = pin(detections.select("obs_id", "lat", "lon", at)), []
    for radius in radii:
        left = rest.withColumn("_b", F.explode(F.sequence(bucket(F.col(at) - width), bucket(F.col(at) + width))))
        pairs = band_join(left, right, ("lat", "lon"), ("r_lat", "r_lon"), F.lit(radius), (radius,), equal=["_b"], spread="report_id")
        pairs = (pairs.where(F.abs(F.col("r_t") - F.col(at)) <= width).withColumn("distance_m", haversine_m("lat", "lon", "r_lat", "r_lon"))
                 .where(F.col("distance_m") <= radius).withColumn("dt_s", F.floor(F.abs(F.col("r_t") - F.col(at)) / US)))
        settled.append(pin(_nearest(pairs, "obs_id", ["platform_id", "report_id", "dt_s"], "report_id")))
        if radius < max_m:
            rest = pin(rest.join(settled[-1].select("obs_id"), "obs_id", "left_anti"))
    return reduce(DataFrame.unionByName, settled)


def bright_neighbour(detections: DataFrame, within_m: float = 300.0, ratio: float = 3.0) -> DataFrame:
    """Nearest detection of the same scene that is ``ratio`` times brighter and close by."""
    left = detections.select("scene", "obs_id", "lat", "lon", "snr").where("snr > 0")
    right = detections.select("scene", *[F.col(c).alias("o_" + c) for c in ("obs_id", "lat", "lon", "snr")])
    pairs = band_join(left, right, ("lat", "lon"), ("o_lat", "o_lon"), F.lit(within_m), (within_m,), equal=["scene"], spread="o_obs_id")
    pairs = (pairs.where((F.col("obs_id") != F.col("o_obs_id")) & (F.col("o_snr") / F.col("snr") >= ratio))
             .withColumn("distance_m", haversine_m("lat", "lon", "o_lat", "o_lon")).where(F.col("distance_m") <= within_m)
             .withColumn("ratio", F.col("o_snr") / F.col("snr")))
    return _nearest(pairs, "obs_id", ["o_snr", "ratio"], "o_obs_id")


def nearest_site(points: DataFrame, sites: DataFrame, key: str, near_m: float = 500.0) -> DataFrame:
    """Nearest persistent site within ``near_m``; points without one are absent."""
    right = sites.select("site_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"),
                         *[c for c in sites.columns if c not in ("site_id", "lat", "lon", key)])
    pairs = band_join(points.select(key, "lat", "lon"), right, ("lat", "lon"), ("s_lat", "s_lon"), F.lit(near_m), (near_m,), spread="site_id")
    pairs = pairs.withColumn("distance_m", haversine_m("lat", "lon", "s_lat", "s_lon")).where(F.col("distance_m") <= near_m)
    return _nearest(pairs, key, [c for c in right.columns if c not in ("s_lat", "s_lon")], "site_id")


def frontier_filter(observations: DataFrame, report_frontier_us) -> DataFrame:
    """Scene date from its first detection; matchable only up to the last covered instant."""
    first = observations.groupBy("scene").agg(F.min("t_scene_us").alias("first_us"), F.count(F.lit(1)).alias("n"))
    past = (F.col("first_us") - report_frontier_us) / (86400.0 * US)
    return (first.withColumn("days_past", F.when(past > 0, past)).withColumn("matchable", past <= 0))


def same_fleet(polls: DataFrame, pairs: DataFrame, match_m: float = 200.0, majority: float = 0.5) -> DataFrame:
    """Do two feeds of an agency report the same vehicles? One verdict per pair and round.

    ``polls(feed_id, round, vehicle_id, label, lat, lon)``; ``pairs(a, b)``.
    """
    def one(side, other):
        return (pairs.join(polls, F.col(side) == F.col("feed_id"))
                .select("a", "b", "round", "vehicle_id", "label", "lat", "lon"))
    a, b = one("a", "b"), one("b", "a")
    key = ["a", "b", "round"]

    def shared(field):
        both = (a.where(F.col(field).isNotNull()).select(*key, field).distinct()
                .join(b.where(F.col(field).isNotNull()).select(*key, field).distinct(), [*key, field]))
        return both.groupBy(*key).agg(F.count(F.lit(1)).alias(f"shared_{field}"))
    # places with their number of vehicles, so rows need no number of their own
    places = a.groupBy(*key, "lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    right = b.select(*key, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).distinct()
    near = (band_join(places, right, ("lat", "lon"), ("b_lat", "b_lon"), F.lit(match_m), (match_m,), equal=key, spread="b_lat")
            .where(haversine_m("lat", "lon", "b_lat", "b_lon") <= match_m)
            .select(*key, "lat", "lon", "_n").distinct().groupBy(*key).agg(F.sum("_n").alias("near_within_m")))
    # every pair in every round; both are short lists of what was asked, not of what was seen
    rounds = pairs.join(polls.select("round").distinct()).select(*key)
    n_a = a.groupBy(*key).agg(F.count(F.lit(1)).alias("n_a"))
    n_b = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n_b"))
    out = rounds
    for part in (n_a, n_b, shared("vehicle_id"), shared("label"), near):
        out = out.join(part, key, "left")
    out = out.fillna(0)
    small = F.least("n_a", "n_b")
    verdict = (F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), "UNDECIDED: neither feed reports a vehicle right now")
               .when(small == 0, "UNDECIDED: only one feed reports vehicles right now")
               .when(F.col("shared_vehicle_id") >= majority * small, "SAME VEHICLES by id")
               .when(F.col("shared_label") >= majority * small, "SAME VEHICLES by label")
               .when(F.col("near_within_m") >= majority * small, "SAME VEHICLES by position")
               .otherwise("DIFFERENT vehicles"))
    return out.withColumn("verdict", verdict)


def overall_verdict(rounds: DataFrame) -> DataFrame:
    """Several rounds must agree; undecided ones do not vote."""
    said = F.array_sort(F.collect_set(F.when(~F.col("verdict").startswith("UNDECIDED"), F.col("verdict"))))
    got = rounds.groupBy("a", "b").agg(said.alias("s"))
    return got.select("a", "b", F.when(F.size("s") == 1, F.col("s")[0]).when(F.size("s") == 0, "UNDECIDED in every round")
                      .otherwise(F.concat(F.lit("INCONSISTENT across rounds: "), F.array_join("s", ", "))).alias("overall"))

"""Named behaviours with hand-computed answers."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plotgap.functions import classes as K
from plotgap.operators import boundary as S
from plotgap.operators import calibration as B
from plotgap.operators import coverage as V
from plotgap.operators import detectors as D
from plotgap.operators import land as L
from plotgap.operators import matching as M
from plotgap.operators import persistence as P
from plotgap.operators import tracks as T
from plotgap.operators import uptime as U
from plotgap.sources import positions as src

MIN = 60_000_000
PAIRS = "scene bigint, obs_id bigint, platform_id string, track_seq int, distance_m double, radius_m double"
REPORT = "event_id bigint, platform_id string, t_us bigint, lat double, lon double, uncertainty_m double, speed_mps double, heading_deg double, length_m double"


def reports(spark, rows):
    full = [(i, p, t, la, lo, 10.0, sp, hd, None) for i, (p, t, la, lo, sp, hd) in enumerate(rows)]
    return spark.createDataFrame(full, REPORT)


def brute_matching(edges):
    """Largest matching by augmenting paths on a small graph."""
    owner = {}
    def grow(o, seen):
        for t in sorted(t for x, t in edges if x == o):
            if t not in seen:
                seen.add(t)
                if t not in owner or grow(owner[t], seen):
                    owner[t] = o
                    return True
        return False
    return sum(grow(o, set()) for o in sorted({o for o, _ in edges}))


def test_greedy_would_leave_one_over(spark):
    rows = [(1, 1, "A", 1, 10.0, 99.0), (1, 1, "B", 1, 20.0, 99.0), (1, 2, "A", 1, 15.0, 99.0)]
    got = M.maximum_matching(spark.createDataFrame(rows, PAIRS)).collect()
    assert {(r["obs_id"], r["platform_id"]) for r in got} == {(1, "B"), (2, "A")}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_matching_is_maximum_in_one_task_and_at_scale(spark, limit):
    rng = random.Random(8)
    edges = {(rng.randrange(30), rng.randrange(26)) for _ in range(70)}
    rows = [(1, o, f"T{t:02d}", 1, float(rng.randrange(100)), 99.0) for o, t in sorted(edges)]
    got = M.maximum_matching(spark.createDataFrame(rows, PAIRS), in_task_pairs=limit).collect()
    assert len(got) == brute_matching(edges)
    assert len({r["obs_id"] for r in got}) == len({r["platform_id"] for r in got}) == len(got)


def one_by_one(edges):
    """Observations matched when they are taken in order, each making room by an augmenting path."""
    options, owner = {}, {}
    for o, t in sorted(edges):
        options.setdefault(o, []).append(t)

    def grow(start):
        came, queue = {}, [start]
        for o in queue:
            for t in options[o]:
                if t not in came:
                    came[t] = o
                    if t in owner:
                        queue.append(owner[t])
                        continue
                    while t is not None:
                        o = came[t]
                        lost = next((x for x, w in owner.items() if w == o), None)
                        owner[t] = o
                        if lost is not None:
                            del owner[lost]
                        t = lost if o != start else None
                    return True
        return False
    return {o for o in sorted(options) if grow(o)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_is_the_same_in_one_task_and_by_joins(spark, seed):
    """Equal pairs either way, ties in distance included, and the observations that one-by-one matching keeps."""
    rng = random.Random(seed)
    edges = {(rng.randrange(60), rng.randrange(45)) for _ in range(120)}
    rows = [(1, o, f"T{t:02d}", 1, float(rng.randrange(12)), 99.0) for o, t in sorted(edges)]
    df = spark.createDataFrame(rows, PAIRS)
    task, joins = (sorted(map(tuple, M.maximum_matching(df, in_task_pairs=n).collect())) for n in (100_000, 0))
    assert task == joins and len(task) == brute_matching(edges) and {r[1] for r in task} == one_by_one(edges)


def test_matching_of_a_component_over_the_task_size(spark):
    """One connected component of more pairs than a task takes by default equals the same component worked in one task."""
    n, rng = 2_600, random.Random(4)
    rows = [(1, o, f"T{t:05d}", 1, float(rng.randrange(9973)), 99_999.0) for o in range(n) for t in rng.sample(range(4_000), 40)]
    df = spark.createDataFrame(rows, PAIRS)
    assert len(rows) > M.IN_TASK_PAIRS
    large = sorted(map(tuple, M.maximum_matching(df).collect()))
    task = sorted(map(tuple, M.maximum_matching(df, in_task_pairs=1_000_000).collect()))
    assert large == task and len(large) == n


def brute_sites(rows, radius=300.0):
    sites, out = [], {}
    for i, lat, lon in rows:
        best, best_d = None, radius
        for s in sites:
            d = math.hypot((lon - s[1]) * 111195.0 * math.cos(math.radians((lat + s[0]) / 2)), (lat - s[0]) * 111195.0)
            if d <= best_d:
                best, best_d = s, d
        if best is None:
            best = [lat, lon, 0.0, 0.0, 0, i]
            sites.append(best)
        best[2] += lat
        best[3] += lon
        best[4] += 1
        best[0], best[1] = best[2] / best[4], best[3] / best[4]
        out[i] = best[5]
    return out


def test_sites_follow_the_sequential_rule(spark):
    rng = random.Random(4)
    pts = [(i, 37.0 + rng.gauss(0, 0.004), -75.0 + rng.gauss(0, 0.004)) for i in range(150)]
    pts += [(150 + i, 38.0, -74.0) for i in range(100)] + [(250 + i, 38.5 + 1e-4 * (i % 5), -74.0) for i in range(50)]
    df = spark.createDataFrame(pts, "obs_id bigint, lat double, lon double")
    got = {r["obs_id"]: r["site_id"] for r in P.assign_sites(df, ["obs_id"]).collect()}
    assert got == brute_sites(pts)


def test_seen_on_every_pass_is_fixed(spark):
    row = [(1, [0, 1, 2], [], [0, 1, 2]), (2, [2], [], [0, 1, 2]), (3, [0, 1], [1], [0, 1, 2, 3, 4, 5])]
    s = spark.createDataFrame(row, "site_id bigint, dates array<bigint>, matched_dates array<bigint>, searched_dates array<bigint>")
    got = {r["site_id"]: (r["fixed"], r["verdict"]) for r in P.site_verdict(s).collect()}
    assert got == {1: (True, "fixed structure"), 2: (False, "one pass only"), 3: (False, "traffic (AIS explained it at least once)")}


def brute_collision(rows, top=26.0, window=60):
    best = {}
    for a, b in itertools.permutations(rows, 2):
        dt = (b[2] - a[2]) / 1e6
        if a[1] != b[1] or dt < 0 or dt > window or (dt == 0 and b[0] < a[0]):
            continue
        la1, lo1, la2, lo2 = map(math.radians, (a[3], a[4], b[3], b[4]))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        ex = 2 * 6371008.8 * math.asin(math.sqrt(h)) - top * max(dt, 1.0) - math.hypot(10, 10)
        if ex > 0 and ex > best.get(a[1], (0,))[0] + 1e-9:
            best[a[1]] = (ex, a[2], b[2])
    return {k: round(v[0], 3) for k, v in best.items()}


def test_collision_with_a_shared_hot_identifier(spark):
    rng = random.Random(6)
    rows = [(i, "hot", rng.randrange(600) * 1_000_000, 37 + rng.random() * 3, -75 + rng.random() * 3) for i in range(260)]
    rows += [(1000 + i, "ok", i * 10_000_000, 37.0, -75.0 + i * 0.001) for i in range(60)]
    df = spark.createDataFrame([(i, p, t, la, lo, 10.0, 5.0, 0.0, None) for i, p, t, la, lo in rows], REPORT)
    got = D.identity_collision(df, "sea").select("platform_id", F.get_json_object("evidence", "$.excess_m").cast("double").alias("x")).collect()
    want = brute_collision(rows)
    assert {r["platform_id"] for r in got} == set(want) == {"hot"}
    assert abs(got[0]["x"] - want["hot"]) < 0.01


def test_missing_position_gives_no_distance(spark):
    from plotgap.functions.geo import haversine_m
    assert spark.range(1).select(haversine_m(F.lit(None).cast("double"), 1.0, 2.0, 3.0).alias("d")).first()["d"] is None


def test_tracks_split_on_silence_and_drop_repeats(spark):
    r = reports(spark, [("A", 0, 37.0, -75.0, 1.0, 0.0), ("A", 0, 37.1, -75.0, 1.0, 0.0), ("A", 1800 * 1_000_000, 37.0, -75.0, 1.0, 0.0), ("A", 3601 * 1_000_000, 37.0, -75.0, 1.0, 0.0)])
    got = T.sessionise_tracks(T.first_per_instant(r)).orderBy("t_us").select("track_seq", "lat").collect()
    assert [tuple(x) for x in got] == [(1, 37.0), (1, 37.0), (2, 37.0)]


def test_position_before_between_and_after(spark):
    r = reports(spark, [("A", 0, 37.0, -75.0, 10.0, 0.0), ("A", 10 * MIN, 37.1, -75.0, 10.0, 0.0)]).withColumn("track_seq", F.lit(1))
    ask = spark.createDataFrame([("A", 1, -MIN), ("A", 1, 0), ("A", 1, 5 * MIN), ("A", 1, 11 * MIN)], "platform_id string, track_seq int, at_us bigint")
    got = {x["at_us"]: x for x in T.position_at(r, ask, ["platform_id", "track_seq"]).collect()}
    assert got[-MIN]["lat"] is None and abs(got[0]["lat"] - 37.0) < 1e-9
    assert abs(got[5 * MIN]["lat"] - 37.05) < 1e-6 and abs(got[5 * MIN]["uncertainty_m"] - (10 + 0.5 * 11119.5)) < 5
    assert got[11 * MIN]["how"] == "dead reckoned" and abs(got[11 * MIN]["uncertainty_m"] - (10 + 60.0)) < 1e-6


def test_first_report_contributes_no_gap_and_one_vessel_is_thin(spark):
    r = reports(spark, [("A", 0, 37.01, -75.01, 1.0, 0.0), ("A", MIN, 37.01, -75.01, 1.0, 0.0)])
    g = V.reception_grid(r).first()
    assert (g["n_reports"], g["n_gaps"], g["reception"]) == (2, 1, "thin")


def test_empty_cell_in_heard_water_is_heard(spark):
    g = spark.createDataFrame([(c, r, 5, "heard") for c in (0, 1, 2) for r in (0, 1, 2) if (c, r) != (1, 1)], "col bigint, row bigint, n_vessels bigint, reception string")
    ask = spark.createDataFrame([(1, 1), (9, 9)], "col bigint, row bigint")
    got = {(r["col"], r["row"]): r["reception"] for r in V.classify_cells(ask, g).collect()}
    assert got == {(1, 1): "heard", (9, 9): "unheard"}


def test_restart_seam_is_not_blind_and_silence_is(spark):
    s = spark.createDataFrame([("C", 0, 100 * MIN), ("C", 100 * MIN + 30_000_000, 200 * MIN)], "collector string, started_us bigint, ended_us bigint").withColumn("last_us", F.col("ended_us"))
    who = spark.createDataFrame([("C",), ("D",)], "collector string")
    got = sorted(tuple(r) for r in U.blind_intervals(U.uptime_intervals(s), who, 0, 300 * MIN).select("collector", "lo", "hi").collect())
    assert got == [("C", 200 * MIN, 300 * MIN), ("D", 0, 300 * MIN)]


def test_no_scored_vessels_no_rate(spark):
    c = spark.createDataFrame([("strata", ">=25 m", 0, 0), ("strata", "<25 m", 2, 4)], "kind string, stratum string, found bigint, scored bigint")
    got = {r["stratum"]: r for r in B.pool_calibration(c).collect()}
    assert got[">=25 m"]["rate"] is None and got[">=25 m"]["lo"] is None and got["<25 m"]["rate"] == 0.5


def flat_counts(spark, near, far):
    counts = spark.createDataFrame([("x", False, 0, "0-1 nm", near), ("x", False, 0, "> 25 nm", far)], "limit string, matched boolean, day bigint, band string, n bigint")
    area = spark.createDataFrame([("x", 0, "0-1 nm", 50.0), ("x", 0, "> 25 nm", 50.0)], "limit string, day bigint, band string, km2 double")
    return counts, area


def test_scattered_null_finds_a_real_concentration(spark):
    real = S.scattered_null(*flat_counts(spark, 80, 20), trials=99, seed="t").first()
    flat = S.scattered_null(*flat_counts(spark, 50, 50), trials=99, seed="t").first()
    assert real["p"] == 0.01 and flat["p"] == 1.0 and real["trials"] == 99


def test_empty_near_band_is_not_tested(spark):
    counts, _ = flat_counts(spark, 0, 0)
    far = counts.where("band = '> 25 nm'").withColumn("n", F.lit(7))
    assert S.untestable(far, far.select("limit").distinct()).first()["reason"].startswith("no candidate")


def fixes(spark, rows):
    """One file per row, so the order of rows counts."""
    return spark.createDataFrame([(i, i, i, "F0", *r) for i, r in enumerate(rows)],
                                 "arrival bigint, file bigint, fetched_at bigint, feed_id string, vehicle_key string, vehicle_ts bigint, lat double, lon double, trip_id string")


def test_jitter_inside_a_file_is_no_disorder(spark):
    f = fixes(spark, [("b", 130, 39.001, -77.0, "t"), ("b", 100, 39.0, -77.0, "t"), ("b", 90, 39.0, -77.0, "t")])
    ok, out = L.accepted_fixes(f.withColumn("file", F.col("file") - F.col("file") % 2))
    assert [r.vehicle_ts for r in ok.orderBy("vehicle_ts").collect()] == [100, 130]
    assert [(r.vehicle_ts, r.reason) for r in out.collect()] == [(90, "out_of_order")]


def test_road_exclusions_are_counted(spark):
    f = fixes(spark, [("b", 100, 39.0, -77.0, ""), ("b", 130, 39.0, -77.0, ""), ("b", 130, 39.0, -77.0, ""), ("b", 90, 39.0, -77.0, ""), ("b", 160, 39.003, -77.0, "t"), ("entity:1", 5, 39.0, -77.0, "t"),
                      ("b", None, 39.0, -77.0, "t"), ("b", 165, 39.003, -77.0, "t"), ("b", 400, 39.003, -77.0, "t")])
    ok, out = L.accepted_fixes(f)
    row = L.exclusion_ledger(out, L.speed_pairs(ok)).first().asDict()
    assert {k: row[k] for k in L.REASONS} == {"entity_key": 1, "no_vehicle_ts": 1, "duplicate": 1, "out_of_order": 1, "first_fix": 1, "too_close": 1, "gap": 1, "impossible": 0, "parked": 1, "pairs": 1}
    assert row["fixes"] == 9


def test_local_time_over_both_clock_changes(spark):
    s = [1710053940, 1710054000, 1730613540, 1730613600]  # 2024-03-10 06:59/07:00 UTC, 2024-11-03 05:59/06:00 UTC
    df = spark.createDataFrame([("F0", x) for x in s], "feed_id string, s bigint")
    got = [r[0] for r in L.local_wall_time(df, "s", {"F0": "America/New_York"}).orderBy("s").select(F.date_format("local_time", "HH:mm")).collect()]
    assert got == ["01:59", "03:00", "01:59", "01:00"]


def test_land_null_draws_keep_the_label_count(spark):
    rows = [(i, 37.0 + 0.0001 * (i % 40), -75.0, i % 2 == 0) for i in range(400)] + [(400 + i, 37.05, -75.0, i % 3 == 0) for i in range(200)]
    a = spark.createDataFrame(rows, "a_id bigint, lat double, lon double, declared boolean")
    lines = spark.createDataFrame([("treatment", -76.0, 37.0, -74.0, 37.0), ("control", -76.0, 40.0, -74.0, 40.0)], "line_set string, x0 double, y0 double, x1 double, y1 double")
    assert L.land_did(a, lines, 30).first()["stop_reason"] is not None
    assert L.land_nulls(a, lines, 20, 2, "s").first()["scattered_n"] == 0  # no control group, so no statistic in any trial


def test_overlapping_stores_are_refused(spark):
    df = spark.range(4).withColumn("dataset", F.when(F.col("id") > 1, "wide").otherwise("narrow"))
    with pytest.raises(Exception, match="overlapping stores"):
        src.store_overlap_guard(df).collect()


def test_stable_id_and_versions(spark):
    r = spark.range(1).select(K.stable_id(F.lit("wz-1-1700000000")).alias("a"), K.stable_id(F.lit("wz-1-0000000123")).alias("b"), K.version_verdict(F.lit("4.0"), F.lit("4")).alias("c"),
                              K.version_verdict(F.lit("4.10"), F.lit("4.1")).alias("d")).first()
    assert tuple(r) == ("wz-1", "wz-1-0000000123", "agrees-by-alias", "disagrees")

"""Ties, table ends and texts that only larger tables bring."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotgap.functions.classes import one_decimal
from plotgap.operators import coverage as V
from plotgap.operators import uptime as U


def test_volume_message_has_no_thousands_separator(spark):
    row = spark.createDataFrame([(1, 6089)], "files bigint, polls bigint")
    got = row.select(U.volume_agreement(F.col("files"), F.col("polls")).alias("m")).first()["m"]
    assert got == "archive and heartbeats disagree: 6089.0 polls per file where 10 is expected"


def test_one_decimal_prints_as_c_does(spark):
    rng = random.Random(3)
    values = [0.0, 0.04, 0.05, 0.25, 0.35, 0.75, 0.15, 2.5, 9.95, 99.949999999999989, 1041.65, 1e6 + 0.25] + [rng.random() * 10 ** rng.randrange(7) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal("v").alias("t")).collect()
    assert all(r["t"] == f"{r['v']:.1f}" for r in got)


def test_passes_of_one_name_and_instant_follow_the_smallest_event(spark):
    rows = [("A", f"S{e % 3}", 10, e, 0.0, 1.0, 0.0, 1.0) for e in (5, 3, 7, 4)] + [("B", "S2", 20, 9, 0.0, 1.0, 0.0, 1.0), ("B", "S1", 20, 10, 0.0, 1.0, 0.0, 1.0)]
    names = "name string, satellite string, t_us bigint, event_id bigint, lon0 double, lon1 double, lat0 double, lat1 double"
    for order in (rows, rows[::-1]):
        got = V.pass_revisit(spark.createDataFrame(order, names).coalesce(1), (0.0, 0.0, 1.0, 1.0))
        assert {(r["satellite"], r["n_passes"]) for r in got.collect()} == {("S0", 1), ("S2", 1)}


def test_agencies_beyond_the_decision_table_are_undecided(spark, tmp_path):
    from plotgap.catalog import load
    e = spark.createDataFrame([(i, u, "view", 1.0) for i, u in enumerate((3 * 4999, 3 * 5001, 3 * 5001 + 1, 3 * 4998, 3 * 4998 + 1))],
                              "event_id bigint, user_id bigint, event_type string, value double")
    e.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:01'")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["feed_id"]: r["status"] for r in load()[0]["same_agency_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {14997: "kept", 15003: "UNDECIDED", 15004: "UNDECIDED", 14994: "kept", 14995: "duplicate of the kept feed"}


def _near_case(spark):
    rng = random.Random(5)
    spot = [(rng.uniform(36.9, 37.1), rng.uniform(-75.1, -74.9)) for _ in range(40)]
    seen = [(i, *spot[i % 40], 1_800_000_000 + 3_600_000_000 * (i % 3)) for i in range(60)] + [(900, 36.0, -76.0, 1_800_000_000)]
    told = [(i, f"P{i % 7}", 36.95 + rng.gauss(0, 0.004), -75.0 + rng.gauss(0, 0.004), rng.randrange(10_800_000_001)) for i in range(3000)]
    told += [(5000 + i, "Q", *spot[0], 1_800_000_000 * i) for i in range(7)]
    return (spark.createDataFrame(seen, "obs_id bigint, lat double, lon double, t bigint"),
            spark.createDataFrame(told, "event_id bigint, platform_id string, lat double, lon double, t_us bigint"), seen, told)


def test_nearest_report_widens_its_search_and_stays_exact(spark, monkeypatch):
    import math

    from plotgap.constants import EARTH_RADIUS_M
    from plotgap.operators import matching as M

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))
    detections, reports, seen, told = _near_case(spark)
    want = {}
    for o, la, lo, t in seen:
        near = [(metres(la, lo, x, y), e) for e, _, x, y, s in told if abs(s - t) <= 1_800_000_000]
        if near and min(near)[0] <= 10_000:
            want[o] = min(near)[1]
    looked, join = [], M.band_join

    def counted(*args, **kw):
        looked.append(join(*args, **kw))
        return looked[-1]
    monkeypatch.setattr(M, "band_join", counted)
    got = M.nearest_report(detections, reports, "t").collect()
    assert {r["obs_id"]: r["report_id"] for r in got} == want and len(got) == len(want)
    every = join(detections.withColumn("_b", F.lit(0)), reports.select("event_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.lit(0).alias("_b")),
                 ("lat", "lon"), ("r_lat", "r_lon"), F.lit(10_000.0), (10_000.0,), equal=["_b"]).count()
    assert len(looked) > 1 and looked[0].count() < every / 4  # one wide search looks at about all


def test_meetings_pair_only_pieces_of_one_moment(spark):
    from plotgap.operators import rendezvous as R
    rows = [(i * 2 + k, f"P{k}", 1_000_000 * (3 * i + k), 37.0 + k * 1e-4, -75.0 + i * 1e-6) for i in range(600) for k in range(2)]
    frame = spark.createDataFrame(rows, "event_id bigint, platform_id string, t_us bigint, lat double, lon double")
    got = R.contacts(R.motion_pieces(frame, 600_000_000, 3600.0), 500.0, 0.05, 20_000)
    join = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    assert " div " in join  # the join itself is cut by moments
    met = R.rendezvous(frame, 500.0, 60.0).collect()
    assert [(r["a"], r["b"]) for r in met] == [("P0", "P1")] and met[0]["n_contacts"] == got.count()


def test_each_throw_is_hashed_once(spark):
    from hashlib import md5

    from plotgap.operators import boundary as S
    share = {"a": 1.0, "b": 2.5, "c": 0.0, "d": 4.0}
    n = {(True, 3): 40, (False, 3): 70_000, (False, 4): 9}
    counts = spark.createDataFrame([("L", m, d, b, k // 4 + (k % 4 if b == "a" else 0)) for (m, d), k in n.items() for b in share], "limit string, matched boolean, day bigint, band string, n bigint")
    area = spark.createDataFrame([("L", d, b, w) for d in (3, 4) for b, w in share.items() if (d, b) != (4, "d")], "limit string, day bigint, band string, km2 double")
    got = S.scattered_null(counts, area, 3, "t")
    assert not any("lambdafunction" in line and "md5" in line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    want = {}
    for m in (True, False):
        expected, seen = dict.fromkeys(share, 0.0), dict.fromkeys(share, 0)
        sims = [dict.fromkeys(share, 0) for _ in range(3)]
        for (mm, d), k in n.items():
            if mm != m:
                continue
            here = {b: w for b, w in share.items() if (d, b) != (4, "d")}
            for b in share:
                seen[b] += k // 4 + (k % 4 if b == "a" else 0)
                expected[b] += k * here.get(b, 0.0) / sum(here.values())
            for trial in range(3):
                for i in range(1, k + 1):
                    u, upto = int(md5(f"t|L|{str(m).lower()}|{d}|{trial + 1}|{i}".encode()).hexdigest()[:8], 16) / 2 ** 32 * sum(here.values()), 0.0
                    for b, w in here.items():
                        upto += w
                        if upto > u:
                            sims[trial][b] += 1
                            break

        def chi(o):
            return sum((o[b] - e) ** 2 / e for b, e in expected.items() if e > 0)
        want[m] = (sum(chi(s) >= chi(seen) for s in sims), 3, round(chi(seen), 6))
    assert {r["matched"]: (r["k"], r["trials"], round(r["chi2"], 6)) for r in got.collect()} == want


def test_gates_share_components_and_tasks_take_many(spark, monkeypatch):
    from plotgap.operators import calibration as B
    from plotgap.operators import matching as M
    rng = random.Random(11)
    pairs = {(s, s * 1000 + rng.randrange(60), f"P{rng.randrange(25)}") for s in (1, 2) for _ in range(110)}
    pairs = spark.createDataFrame([(s, o, p, 1, float(rng.randrange(40)), 50.0) for s, o, p in sorted(pairs)],
                                  "scene bigint, obs_id bigint, platform_id string, track_seq int, distance_m double, radius_m double")
    rows = [(s, s * 1000 + i, 6.0 + rng.randrange(40), 2 + rng.randrange(20), 25.0) for s in (1, 2) for i in range(60)]
    observations = spark.createDataFrame(rows, "scene bigint, obs_id bigint, snr double, pixels int, uncertainty_m double")
    fixes = spark.createDataFrame([(s, f"P{i}", 1, 60.0, 20.0, True) for s in (1, 2) for i in range(25)],
                                  "scene bigint, platform_id string, track_seq int, length_m double, uncertainty_m double, has_fix boolean")
    area = spark.createDataFrame([(1, 6e4), (2, 6e4)], "scene bigint, km2 double")
    gates, searched, find = [(6.0, 2), (20.0, 6)], [], M.connected_components
    plain = {g: M.maximum_matching(pairs.join(observations.where((F.col("snr") >= g[0]) & (F.col("pixels") >= g[1])), ["scene", "obs_id"], "left_semi")).count() for g in gates}
    monkeypatch.setattr(M, "connected_components", lambda edges: searched.append(edges.count()) or find(edges))
    got = B.gate_grid_search(observations, fixes, pairs, area)
    found = {(r["min_snr"], r["min_pixels"]): r["n_kept"] - r["unmatched"] for r in got.collect()}
    assert {g: found[g] for g in gates} == plain
    assert searched and max(searched) <= pairs.count()  # not once more for every gate
    assert "FlatMapGroupsInPandas" not in M.maximum_matching(pairs)._jdf.queryExecution().optimizedPlan().toString()
    frames = [pd.DataFrame({"component": list(c), "obs_id": o, "track": list(t), "distance_m": d, "scene": 1, "platform_id": list(t), "track_seq": 1, "radius_m": 9.0})
              for c, o, t, d in (("aab", [1, 1, 3], "xyz", [2.0, 1.0, 1.0]), ("bbb", [4, 5, 4], "zzw", [2.0, 3.0, 5.0]), ("bcc", [5, 6, 7], "vuu", [1.0, 1.0, 2.0]))]
    kept = pd.concat(M._settled_runs(iter(frames)))
    assert sorted(zip(kept["obs_id"], kept["platform_id"])) == [(1, "y"), (3, "z"), (4, "w"), (5, "v"), (6, "u")]


def test_pixels_meet_their_lattice_in_one_join(spark):
    from plotgap.operators import raster as R
    nodes = [(s, 8.0 * i, 8.0 * j, -75.0 + j * 0.02 + i * 0.001 + s, 37.0 - i * 0.015 + s) for s in (1, 2) for i in range(3) for j in range(4) if (s, i, j) != (2, 1, 3)]
    lattice = spark.createDataFrame(nodes, "scene bigint, prow double, pcol double, lon double, lat double")
    pixels = spark.createDataFrame([(s, r, c) for s in (1, 2, 3) for r in range(-1, 20, 3) for c in range(0, 30, 2)], "scene bigint, row bigint, col bigint")
    got = R.pixel_to_lonlat(pixels, lattice)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "broadcast" not in plan  # no table of the lattice in every task but by its size
    have = {n[:3]: n[3:] for n in nodes}

    def ends(v, n):
        lo = 8.0 * min(max(int(v // 8), 0), n - 1)
        inside = 0 <= v < 8 * (n - 1)
        return lo, lo + 8 * inside, (v - lo) / 8 * inside
    want = {}
    for s, r, c in map(tuple, pixels.collect()):
        (r0, r1, fr), (c0, c1, fc) = ends(r, 3), ends(c, 4)
        four = [have.get((s, a, b)) for a in (r0, r1) for b in (c0, c1)]
        if all(four):
            want[s, r, c] = [round((a * (1 - fc) + b * fc) * (1 - fr) + (d * (1 - fc) + e * fc) * fr, 9) for a, b, d, e in zip(*four)]
    assert {(x["scene"], x["row"], x["col"]): [round(x["lon"], 9), round(x["lat"], 9)] for x in got.collect()} == want
    assert len(want) < 210 and any(s == 2 for s, _, _ in want)


@pytest.mark.parametrize("lat,lon", [(37.0, -75.0), (-0.01, 0.01), (80.0, 20.0)])
def test_company_looks_at_few_silences_where_many_are_near(spark, monkeypatch, lat, lon):
    import math

    from plotgap.constants import EARTH_RADIUS_M
    from plotgap.operators import ranking as R
    rng, us, wide = random.Random(7), 1_000_000, 0.05 / math.cos(math.radians(lat))

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))
    told = [(i, rng.randrange(9_000, 20_000, 3 if i % 2 else 600) * us, lat + rng.random() * 0.05, lon + rng.random() * wide) for i in range(1500)]
    asked = [(i, (10_800, 14_400, 18_000, 90_000)[i % 4] * us, lat + rng.uniform(-0.06, 0.11), lon + rng.uniform(-1.2, 2.2) * wide, 1, 0.5) for i in range(240)]
    asked += [(900 + i, 14_400 * us, *told[i][2:], 1, 0.5) for i in range(20)]
    want, pairs = {}, 0
    for o, t, a, b, *_ in asked:
        near = [(s, -metres(a, b, c, d)) for _, s, c, d in told if t - 7_200 * us < s <= t]
        pairs += len(near)
        near = [n for n in near if -n[1] <= 5_000.0]
        if near:
            want[o] = max(near)
    looked, join = [], R.band_join

    def counted(*args, **kw):
        looked.append(join(*args, **kw))
        return looked[-1]
    monkeypatch.setattr(R, "band_join", counted)
    candidates = spark.createDataFrame(asked, "obs_id bigint, t_scene_us bigint, lat double, lon double, pixels int, confidence double")
    silences = spark.createDataFrame(told * 2, "event_id bigint, start_us bigint, lat0 double, lon0 double")
    got = {r["obs_id"]: (r["gone_us"], r["gone_m"]) for r in R.fell_silent(candidates, silences, 5_000.0, 7_200.0).collect()}
    assert {o: g[0] for o, g in got.items()} == {o: w[0] for o, w in want.items()} and 100 < len(want) < 250
    assert all(abs(got[o][1] + w[1]) < 1e-3 for o, w in want.items())
    assert sum(j.count() for j in looked) < pairs / 4  # cells, not pairs of a candidate and a silence
    posts = candidates.select("t_scene_us", *R._lattice("lat", "lon", 5_000.0 / R.CUT, ("_pr", "_pc")))
    assert R.last_near(posts, silences, 5_000.0, 7_200 * us).count() < pairs / 10


def test_a_place_that_falls_silent_again_is_looked_at_once(spark):
    from plotgap.operators import ranking as R
    us, rng = 1_000_000, random.Random(3)
    # all places lie near the reach of the post, so no cell of it is within reach for sure
    places = [(37.0 + rng.uniform(-0.002, 0.002), -75.0 + rng.uniform(0.052, 0.0575)) for _ in range(6)]
    told = [(i, rng.randrange(7_000, 19_000) * us, *places[i % 6]) for i in range(900)]
    asked = [(i, (10_800, 14_400)[i % 2] * us, 37.0 + rng.uniform(0, 0.004), -75.0 + rng.uniform(0, 0.004), 1, 0.5) for i in range(80)]
    candidates = spark.createDataFrame(asked, "obs_id bigint, t_scene_us bigint, lat double, lon double, pixels int, confidence double")
    silences = spark.createDataFrame(told, "event_id bigint, start_us bigint, lat0 double, lon0 double")
    met = candidates.crossJoin(silences).where("start_us <= t_scene_us AND start_us > t_scene_us - 7200000000")
    met = met.withColumn("m", R.haversine_m("lat", "lon", "lat0", "lon0")).where("m <= 5000")
    want = {r["obs_id"]: (r["g"]["start_us"], -r["g"]["n"]) for r in met.groupBy("obs_id").agg(F.max(F.struct("start_us", (-F.col("m")).alias("n"))).alias("g")).collect()}
    got = {r["obs_id"]: (r["gone_us"], r["gone_m"]) for r in R.fell_silent(candidates, silences, 5_000.0, 7_200.0).collect()}
    assert {o: g[0] for o, g in got.items()} == {o: w[0] for o, w in want.items()} and 0 < len(want)
    assert all(abs(got[o][1] - w[1]) < 1e-6 for o, w in want.items())
    posts = candidates.select("t_scene_us", *R._lattice("lat", "lon", 5_000.0 / R.CUT, ("_pr", "_pc"))).distinct()
    few = R.last_near(posts, silences, 5_000.0, 7_200 * us)
    assert few.count() and few.groupBy("t_scene_us", "_pr", "_pc").count().agg(F.max("count")).first()[0] <= 6

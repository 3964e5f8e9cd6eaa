"""Meetings, loitering and circling against brute force and planted tracks."""

import math
import random

import numpy as np
import pytest

from plotgap.operators import loiter, orbits, rendezvous

REPORT = "platform_id string, t_us bigint, event_id bigint, lat double, lon double"
S = 1_000_000


def frame(spark, rows):
    return spark.createDataFrame([(p, int(t * S), k, la, lo) for k, (p, t, la, lo) in enumerate(rows)], REPORT)


def test_meeting_of_moving_tracks(spark):
    """Two pass each other in an hour, one pair drifts together, one only crosses the other's way later."""
    rows = [("a", 0, 37.0, -76.1), ("a", 3600, 37.0, -75.9), ("b", 0, 37.001, -75.9), ("b", 3600, 37.001, -76.1), ("late", 7200, 37.0, -76.1), ("late", 10800, 37.0, -75.9)]
    rows += [(p, k * 900, 10.0 + d, 20.0 + .01 * k) for p, d in (("u", 0), ("v", .002)) for k in range(9)]
    got = {(r.a, r.b): r for r in rendezvous.rendezvous(frame(spark, rows), max_separation_m=500, min_duration_s=30).collect()}
    assert set(got) == {("a", "b"), ("u", "v")}
    metres = math.hypot(.2 * 111195 * math.cos(math.radians(37.0005)), 0) / 3600 * 2  # closing speed
    assert got["a", "b"].min_m == pytest.approx(.001 * 111195, rel=1e-3)
    assert got["a", "b"].duration_s == pytest.approx(2 * math.sqrt(500 ** 2 - 111.195 ** 2) / metres, rel=1e-2)
    assert got["u", "v"].duration_s == pytest.approx(7200) and got["u", "v"].min_m == pytest.approx(222.39, rel=1e-3)


def test_harbour_is_cut_and_pairs_come_once(spark):
    rng = random.Random(1)
    rows = [(f"p{i:02d}", t, 51.0 + rng.gauss(0, .002), 3.0 + rng.gauss(0, .002)) for i in range(30) for t in range(0, 3600, 300)]
    df = frame(spark, rows)
    got = [sorted(map(tuple, rendezvous.rendezvous(df, 300, 120, hot_rows=n).collect())) for n in (15, 1_000_000)]
    assert got[0] == got[1] and len(got[0]) == len({r[:3] for r in got[0]}) > 100


def windows(points, size, least):
    """Maximal windows by trying every start."""
    out = {}
    for i in range(len(points)):
        end = i
        for j in range(i, len(points)):
            la, lo = [p[1] for p in points[i:j + 1]], [p[2] for p in points[i:j + 1]]
            c = 1.0 if min(la) <= 0 <= max(la) else math.cos(math.radians(min(map(abs, la))))
            if (max(la) - min(la)) * 111195 > size or (max(lo) - min(lo)) * 111195 * c > size:
                break
            end = j
        out.setdefault(points[end][0], points[i][0])
    return {(a, b) for b, a in out.items() if b - a >= least * S}


def test_loiter_equals_brute_force_over_seams(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for p, n, step in (("moored", 150, .0001), ("hot", 400, .004), ("walk", 150, .02), ("equator", 100, .01)):
        la, lo, t = (0.0 if p == "equator" else 48.0), 2.0, 0
        mine = []
        for _ in range(n):
            la, lo, t = la + rng.gauss(0, step), lo + rng.gauss(0, step), t + rng.randrange(60, 4000)
            mine.append((t * S, la, lo))
            rows.append((p, t, la, lo))
        want[p] = windows(mine, 2000, 1200)
    for chunk in (3600 * S, 6 * 3600 * S, 10 ** 15):
        got = {}
        for r in loiter.loiter(frame(spark, rows), 2000, 1200, chunk).collect():
            got.setdefault(r.platform_id, set()).add((r.start_us, r.end_us))
        assert got == {p: w for p, w in want.items() if w}
    assert len(want["moored"]) == 1


def test_orbit_and_straight_tracks(spark):
    """Four laps of 36 reports, a straight track, one with a single report and one that stands still."""
    def go(lat, lon, bearing, m):
        b, d = math.radians(bearing), m / 6371008.8
        p = math.radians(lat)
        q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))
        return math.degrees(q), lon + math.degrees(math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q)))
    rows = [("orbit", 4.4 * k, *go(39.0, -76.0, 10 * k, 3000)) for k in range(145)]
    rows += [("line", 10 * k, *go(39.0, -76.0, 90, 2000 * k)) for k in range(60)]
    rows += [("one", 5, 1.0, 1.0), *(("still", 10 * k, 1.0, 1.0) for k in range(5))]
    df = frame(spark, rows).selectExpr("*", "1 AS track_seq")
    got = {r.platform_id: r for r in orbits.orbit_features(df, dwell_m=3500.0).collect()}
    o, line = got["orbit"], got["line"]
    assert o.laps == pytest.approx(4, abs=.05) and o.dwell_share == pytest.approx(1) and o.path_over_net is None or o.path_over_net > 1000
    assert o.turn_hist == [0, 0, 0, 0, 143, 0] and o.unwrapped_range == pytest.approx(1430, abs=2)
    assert line.laps < .01 and line.path_over_net == pytest.approx(1, abs=1e-3) and line.turn_hist[0] == 58 and line.dwell_share < .1
    assert got["one"].n == 1 and got["one"].laps is None and got["still"].path_m == 0 and got["still"].laps is None and got["still"].dwell_share == 1


def test_boxes_move_on_together():
    rng = np.random.default_rng(1)
    pts = np.repeat(rng.normal(0, .01, (200, 2)), 2, axis=1)
    at, box = loiter.advance(pts, np.arange(200), pts, 1500.0)
    for i in range(0, 200, 17):
        inside = pts[i:at[i]]
        assert (box[i] == [inside[:, 0].min(), inside[:, 0].max(), inside[:, 2].min(), inside[:, 2].max()]).all()

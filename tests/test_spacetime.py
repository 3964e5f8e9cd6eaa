"""Silences, cube, rates and hot spots against brute force and planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgap.operators import cube, gaps, hotspots, rates
from plotgap.plans.traversal import crossed_cells

REPORT = "platform_id string, t_us bigint, event_id bigint, lat double, lon double"
GRID = "col bigint, row bigint, median_gap_s double, p_long double, reception string"
HOUR = 3_600_000_000


def cells_of(a, b, c, d, size):
    """Length shares by cell from ten thousand samples."""
    out = {}
    for k in range(10_000):
        t = (k + .5) / 10_000
        key = (math.floor((a + t * (c - a)) / size), math.floor((b + t * (d - b)) / size))
        out[key] = out.get(key, 0) + 1e-4
    return out


def test_lines_are_cut_at_cell_edges(spark):
    rng = random.Random(1)
    lines = [(i, *(rng.uniform(-3, 3) for _ in range(4))) for i in range(40)]
    lines += [(100, 0.11, 0.12, 0.11, 0.12), (101, 0.1, 0.0, 0.1, 0.9), (102, 1.05, 0.35, -1.05, 0.35)]
    df = spark.createDataFrame([*lines, (200, None, 1.0, 2.0, 3.0)], "id int, a double, b double, c double, d double")
    got = {}
    for r in crossed_cells(df, ["id"], "a", "b", "c", "d", 0.1).collect():
        assert r["to"] > r["from"]
        got.setdefault(r.id, {}).setdefault((r.col, r.row), 0.0)
        got[r.id][r.col, r.row] += r["to"] - r["from"]
    assert set(got) == {x[0] for x in lines}
    for i, a, b, c, d in lines:
        assert sum(got[i].values()) == pytest.approx(1)
        if i < 100:
            want = cells_of(a, b, c, d, 0.1)
            assert all(abs(want.get(k, 0) - v) < 2e-3 for k, v in got[i].items())


def test_blind_time_is_taken_off_exactly(spark):
    rng = random.Random(2)
    spans = [(s, s + rng.randrange(1, 3 * HOUR)) for s in (rng.randrange(40 * HOUR) for _ in range(25))]
    asked = [(i, *sorted((rng.randrange(60 * HOUR), rng.randrange(60 * HOUR)))) for i in range(200)]
    calendar = gaps.blind_calendar(spark.createDataFrame(spans, "lo bigint, hi bigint"))
    got = gaps.blind_time(spark.createDataFrame(asked, "id int, a bigint, b bigint"), calendar, "a", "b", "us")
    marks = sorted({x for s in spans for x in s})
    blind = [(p, q) for p, q in zip(marks, marks[1:]) if any(lo <= p and q <= hi for lo, hi in spans)]
    want = {i: sum(max(0, min(b, q) - max(a, p)) for p, q in blind) for i, a, b in asked}
    assert {r.id: r.us for r in got.collect()} == want
    none = gaps.blind_calendar(spark.createDataFrame([], "lo bigint, hi bigint"))
    assert {r.us for r in gaps.blind_time(spark.createDataFrame(asked, "id int, a bigint, b bigint"), none, "a", "b", "us").collect()} == {0}


def test_coverage_gaps_planted(spark):
    """A silence in well-heard water is found, one in our own downtime or where nobody hears is not."""
    rows, n = [], 0
    for p, lon, skip in (("heard", 0.01, (30, 50)), ("down", 0.01, (100, 130)), ("deaf", 5.01, (30, 50)), ("clean", 0.01, (0, 0))):
        for k in range(200):
            if not skip[0] <= k < skip[1]:
                rows.append((p, k * 600_000_000, n, 0.01, lon))
                n += 1
    rows += [("hot", k * 10_000_000, 10_000 + k, 0.01, 0.01) for k in range(5000)]
    reports = spark.createDataFrame(rows, REPORT)
    grid = spark.createDataFrame([(0, 0, 600.0, 0.0, "heard"), (100, 0, None, None, "thin")], GRID)
    blind = spark.createDataFrame([(100 * 600_000_000 - 1, 130 * 600_000_000)], "lo bigint, hi bigint")
    got = gaps.coverage_gaps(reports, grid, blind)
    found = {r.platform_id: r for r in got.collect()}
    assert set(found) == {"heard", "deaf"}
    assert found["heard"].weighted and found["heard"].p_silence == pytest.approx(math.exp(-21)) and found["heard"].heard_share == pytest.approx(1)
    assert not found["deaf"].weighted and found["deaf"].p_silence == 1 and found["deaf"].expected == 0
    one = gaps.gap_comparison(reports, got).first()
    assert (one.n_naive, one.n_blind, one.n_unheard, one.n_weighted) == (3, 1, 1, 1)


def test_cube_keys_and_levels(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-180, 179.9), rng.uniform(-90, 89.9), rng.randrange(500 * HOUR)) for _ in range(500)] + [(10.01, 10.01, 5 * HOUR)] * 200
    df = spark.createDataFrame([*rows, (None, 1.0, 1), (1.0, 1.0, None)], "lon double, lat double, t_us bigint")
    got = {(r.level, r.x, r.y, r.t): r.n for r in cube.event_cube(df, levels=4).collect()}
    want = {}
    for lon, lat, t in rows:
        x, y, h = math.floor(round((lon + 180) / .05, 9)), math.floor(round((lat + 90) / .05, 9)), t // HOUR
        for level in range(4):
            key = (level, x >> level, y >> level, h >> level)
            want[key] = want.get(key, 0) + 1
    assert got == want
    told = {r.level: r for r in cube.cube_sensitivity(cube.event_cube(df, levels=4)).collect()}
    assert all(told[k].kept_share == 1 and told[k].n_events == 700 for k in range(4)) and told[0].max_n == 200


def test_exposure_is_all_track_time(spark):
    rng = random.Random(4)
    rows = [("hot" if k % 3 else f"p{k % 11}", k * 300_000_000, k, 37 + rng.gauss(0, .2), -76 + rng.gauss(0, .2)) for k in range(600)]
    reports = spark.createDataFrame(rows, REPORT)
    grid = spark.createDataFrame([(c, r, 60.0, 0.25, "heard") for c in range(-1560, -1480) for r in range(700, 780)], GRID)
    exposure = rates.traffic_exposure(reports, grid)
    total = rates.track_steps(reports).agg(F.sum("dt_s")).first()[0] / 3600
    got = exposure.agg(F.sum("hours").alias("h"), F.sum("seen_hours").alias("s")).first()
    assert got.h == pytest.approx(total) and got.s == pytest.approx(.75 * total) and total > 10
    events = spark.createDataFrame([(37.0, -76.0)] * 30 + [(0.0, 0.0)], "lat double, lon double")
    rated = {(r.col, r.row): r for r in rates.event_rates(events, exposure).collect()}
    assert rated[0, 0].reason == "no traffic" and rated[0, 0].rate is None and rated[0, 0].shrunken is None
    busy = rated[-1520, 740]
    mean = 30 / got.s
    assert busy.n_events == 30 and mean < busy.shrunken < busy.rate
    assert all(0 <= r.shrunken < mean for k, r in rated.items() if r.rate == 0)


@pytest.mark.parametrize("radius", [1, 3])
def test_gi_star_equals_brute_force(spark, radius):
    rng = random.Random(radius)
    cells = {(rng.randrange(-70, 70), rng.randrange(-40, 40)): float(rng.randrange(9)) for _ in range(1500)}
    cells.update({(31 + i, 31 + j): 60.0 for i in range(3) for j in range(3)})  # a hot place over the corner of four tiles
    got = hotspots.gi_star(spark.createDataFrame([(c, r, v) for (c, r), v in cells.items()], "col bigint, row bigint, x double"), "x", radius)
    n, mean = len(cells), sum(cells.values()) / len(cells)
    sd = math.sqrt(sum(v * v for v in cells.values()) / n - mean * mean)
    want = {}
    for c, r in cells:
        near = [cells[c + i, r + j] for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (c + i, r + j) in cells]
        z = (sum(near) - mean * len(near)) / (sd * math.sqrt((n * len(near) - len(near) ** 2) / (n - 1)))
        want[c, r] = (len(near), z, math.erfc(abs(z) / math.sqrt(2)))
    rows = {(r.col, r.row): r for r in got.collect()}
    assert set(rows) == set(want)
    for k, (w, z, p) in want.items():
        assert rows[k].weight == w and rows[k].z == pytest.approx(z, abs=1e-6) and rows[k].p == pytest.approx(p, abs=1e-6)
    ps = sorted(p for _, _, p in want.values())
    limit = max((p for i, p in enumerate(ps, 1) if p <= .05 * i / n), default=-1)
    assert {k for k, r in rows.items() if r.significant} == {k for k, (_, _, p) in want.items() if p <= limit + 1e-9}
    assert rows[32, 32].significant


def test_trend_counts_pairs():
    rng = random.Random(5)
    for n in (1, 2, 7, 30, 65):
        v = [rng.randrange(6) for _ in range(n)]
        s, var = hotspots.trend(np.array(v))
        assert s == sum((b > a) - (b < a) for i, a in enumerate(v) for b in v[i + 1:])
        ties = [v.count(x) for x in set(v)]
        assert var == pytest.approx((n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18)


def test_emerging_planted_histories(spark):
    rng = random.Random(6)
    shape = {"intensifying": lambda t: 40 + 5 * t, "diminishing": lambda t: 160 - 5 * t, "persistent": lambda t: 90 + (t * 7) % 5, "new": lambda t: 90 if t == 19 else 1,
             "consecutive": lambda t: 90 if t >= 17 else 1, "sporadic": lambda t: 90 if t in (3, 9, 19) else 1, "historical": lambda t: 90 if t < 19 else 0}
    rows = [(10 * i, 10 * i, t, f(t)) for i, f in enumerate(shape.values(), 1) for t in range(20) if f(t)]
    rows += [(200 + c, 200 + r, t, 1) for c in range(0, 60, 2) for r in range(0, 60, 2) for t in range(20) if rng.random() < .5]
    got = {(r.col, r.row): r for r in hotspots.emerging(spark.createDataFrame(rows, "col bigint, row bigint, t bigint, n bigint")).collect()}
    assert {name: got[10 * i, 10 * i].category for i, name in enumerate(shape, 1)} == {name: name for name in shape}
    assert {r.category for k, r in got.items() if k[0] >= 200} == {"none"}

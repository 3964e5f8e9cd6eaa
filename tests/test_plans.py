"""Plan helpers against brute force, including hot keys and chunk seams."""

import random

import numpy as np
from pyspark.sql import functions as F

from plotgap.functions.geo import haversine_m
from plotgap.plans import ranks
from plotgap.plans.components import connected_components
from plotgap.plans.grid import band_join
from plotgap.plans.intervals import containing
from plotgap.plans.nearest import nearest_line
from plotgap.plans.sequence import chunk_of, running, with_next, with_previous


def series(spark, n=400):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(5000), i, float(i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t bigint, id bigint, v double")


def test_neighbours_across_seams(spark):
    rows, df = series(spark)
    want_prev, want_next = {}, {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for a, b in zip(mine, mine[1:]):
            want_prev[b[2]], want_next[a[2]] = a[3], b[3]
    for fn, col, want in ((with_previous, "prev_v", want_prev), (with_next, "next_v", want_next)):
        got = {r["id"]: r[col] for r in fn(df, ["k"], ["t", "id"], ["v"], chunk_of("t", 37)).collect()}
        assert got == {r[2]: want.get(r[2]) for r in rows}


def test_running_across_seams(spark):
    rows, df = series(spark)
    for how, fn in (("sum", sum), ("max", max)):
        got = {r["id"]: r["o"] for r in running(df, ["k"], ["t", "id"], F.col("v"), "o", how, chunk_of("t", 37)).collect()}
        for k in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
            for i, r in enumerate(mine):
                assert got[r[2]] == fn(x[3] for x in mine[:i + 1])
    back = {r["id"]: r["o"] for r in running(df, ["k"], ["t", "id"], F.col("v"), "o", "min", chunk_of("t", 37), inclusive=False, backward=True).collect()}
    mine = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2]))
    assert back[mine[-1][2]] is None and back[mine[0][2]] == min(r[3] for r in mine[1:])


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", float(rng.randrange(-50, 200))) for i in range(301)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ranks.percentiles(df, ["k"], F.col("v"), {"m": 0.5, "p": 0.9}, 7.0).collect()}
    for k in "ab":
        v = [x for g, x in rows if g == k]
        assert abs(got[k]["m"] - np.percentile(v, 50)) < 1e-9 and abs(got[k]["p"] - np.percentile(v, 90)) < 1e-9


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    got = ranks.hash_rank(df, ["g"], ranks.uniform("s", "id"), ["id"], "r", chunks=16).collect()
    for g in (0, 1):
        assert sorted(r["r"] for r in got if r["g"] == g) == list(range(1, 501))


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000)] + [(2000, 2000 + i) for i in range(60)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_band_join_is_complete_with_a_hot_cell(spark):
    rng = random.Random(2)
    left = [(i, 60.0 + rng.random() * 0.3 * (i % 3 > 0), 10.0 + rng.random() * 0.3 * (i % 3 > 0)) for i in range(150)]
    right = [(i, 60.0 + rng.random() * 0.3 * (i % 3 > 0), 10.0 + rng.random() * 0.3 * (i % 3 > 0), rng.choice([200.0, 1500.0, 7000.0])) for i in range(150)]
    a = spark.createDataFrame(left, "i bigint, lat double, lon double")
    b = spark.createDataFrame(right, "j bigint, y double, x double, r double")
    j = band_join(a, b, ("lat", "lon"), ("y", "x"), F.col("r"), (500.0, 2000.0, 8000.0), spread="j", hot_rows=10)
    d = haversine_m("lat", "lon", "y", "x")
    got = j.where(d <= F.col("r")).select("i", "j").collect()
    want = a.crossJoin(b).where(d <= F.col("r")).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 2500


def test_containing_keeps_each_point_once(spark):
    pts = spark.createDataFrame([(1, 5, "a"), (2, 50, "a"), (3, 5, "b")], "id bigint, t bigint, k string")
    spans = spark.createDataFrame([("a", 0, 10), ("a", 4, 30)], "k string, lo bigint, hi bigint")
    assert [r["id"] for r in containing(pts, spans, "t", "lo", "hi", 7, ["k"], "left_semi").collect()] == [1]


def test_nearest_line_looks_one_ring_further(spark):
    # the first cell met holds a far corner; the nearer segment is one ring out
    pts = spark.createDataFrame([(1, 0.05, 0.05)], "id bigint, lon double, lat double")
    segs = spark.createDataFrame([("s", 0.19, 0.19, 0.199, 0.199), ("s", 0.05, 0.201, 0.06, 0.201)], "line_set string, x0 double, y0 double, x1 double, y1 double")
    d = nearest_line(pts, segs, "id").first()["d_m"]
    assert abs(d - 0.151 * 111195.0) < 5
    far = spark.createDataFrame([(1, 30.0, 30.0)], "id bigint, lon double, lat double")
    assert nearest_line(far, segs, "id").first()["d_m"] > 4e6


def test_nearest_line_is_the_plain_minimum(spark):
    """A box that touches the point's cell does not end the search; lines may be far away, long, upright or near a pole."""
    rng = random.Random(8)
    lines = [("s", -77.0, 36.0, -75.0, 38.0), ("s", -75.72, 36.0, -75.72, 36.1), ("far", 179.0, -60.0, 179.0, -59.0), ("long", -170.0, 80.0, 170.0, -70.0), ("dot", 5.0, 5.0, 5.0, 5.0)]
    lines += [("r", x, y, x + rng.gauss(0, 1.5), y + rng.gauss(0, 1.5)) for x, y in ((rng.uniform(-40, 40), rng.uniform(-80, 80)) for _ in range(60))]
    pts = [(0, -75.95, 36.05), (1, 0.0, 89.9), (2, 0.0, -89.99), (3, -179.99, 0.0), (4, 179.99, 12.0)]
    pts += [(10 + k, rng.uniform(-60, 60), rng.uniform(-85, 85)) for k in range(150)]
    segs = spark.createDataFrame(lines, "line_set string, x0 double, y0 double, x1 double, y1 double")
    got = nearest_line(spark.createDataFrame([*pts, (999, None, 1.0)], "id bigint, lon double, lat double"), segs, "id")

    def flat(p, q):
        _, lon, lat = p
        _, ax, ay, bx, by = q
        kx = 111195.0 * max(np.cos(np.radians(lat)), 0.01)
        x0, y0, dx, dy = (ax - lon) * kx, (ay - lat) * 111195.0, (bx - ax) * kx, (by - ay) * 111195.0
        t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, -(x0 * dx + y0 * dy) / (dx * dx + dy * dy)))
        return np.hypot(x0 + t * dx, y0 + t * dy)
    want = {}
    for p in pts:
        for q in lines:
            want[p[0], q[0]] = min(want.get((p[0], q[0]), np.inf), flat(p, q))
    rows = {(r["id"], r["line_set"]): r["d_m"] for r in got.collect()}
    assert set(rows) == set(want) and all(abs(rows[k] - v) < 1e-3 for k, v in want.items())
    assert abs(rows[0, "s"] - 20677) < 2

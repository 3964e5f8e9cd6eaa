"""The review queue, the comparison of domains and the closing of stream dates."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgap.operators import crossdomain as X
from plotgap.operators import land as L
from plotgap.operators import ranking as R
from plotgap.streaming import jobs as J

CAND = "obs_id bigint, t_scene_us bigint, lat double, lon double, pixels int, confidence double"
QUIET = "event_id bigint, start_us bigint, lat0 double, lon0 double"
SCORED = "obs_id bigint, size double, clean double, place double, company double, coverage double"
S = 1_000_000


def test_pooling_is_the_best_rising_fit():
    rng = random.Random(3)
    for _ in range(200):
        n = [rng.randint(1, 9) for _ in range(rng.randint(1, 30))]
        k = [rng.randint(0, m) for m in n]
        mean = lambda a, b: sum(k[a:b + 1]) / sum(n[a:b + 1])
        want = [max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]
        assert R.pool_violators(n, k) == pytest.approx(want)


def test_company_is_the_last_silence_near_and_just_before(spark):
    cands = spark.createDataFrame([(1, 10_000 * S, 37.0, -75.0, 10, .5), (2, 10_000 * S, 38.0, -75.0, 10, .5), (3, 10_000 * S, None, -75.0, 10, .5)], CAND)
    quiet = spark.createDataFrame([(1, 9_000 * S, 37.01, -75.0), (2, 9_500 * S, 37.02, -75.0), (3, 9_500 * S, 37.001, -75.0), (4, 9_900 * S, 37.2, -75.0),
                                   (5, 10_001 * S, 37.0, -75.0), (6, 2_800 * S, 38.0, -75.0), (7, 9_990 * S, None, None)], QUIET)
    got = {r.obs_id: r for r in R.fell_silent(cands, quiet, 5_000.0, 7_200.0).collect()}
    assert set(got) == {1} and got[1].gone_us == 9_500 * S and got[1].gone_m == pytest.approx(111.2, abs=1)


def test_silences_match_brute_force(spark):
    rng = random.Random(5)
    cands = [(i, rng.randrange(0, 30_000) * S, 37 + rng.random() * .3, -75 + rng.random() * .3, 1, .5) for i in range(60)]
    quiet = [(i, rng.randrange(0, 30_000) * S, 37 + rng.random() * .3, -75 + rng.random() * .3) for i in range(300)]

    def m(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))
    want = {}
    for i, t, la, lo, *_ in cands:
        near = [s for _, s, a, b in quiet if t - 3_600 * S < s <= t and m(la, lo, a, b) <= 8_000]
        if near:
            want[i] = max(near)
    got = R.fell_silent(spark.createDataFrame(cands, CAND), spark.createDataFrame(quiet, QUIET), 8_000.0, 3_600.0).collect()
    assert {r.obs_id: r.gone_us for r in got} == want and want


def test_queue_order_ties_unknowns_and_no_reviews(spark):
    rows = spark.createDataFrame([(4, .5, .5, .5, .5, .5), (2, .5, .5, .5, .5, .5), (9, 1., 1., 1., 1., 1.), (7, 0., None, None, 0., None), (5, None, None, None, None, None)], SCORED)
    graded = spark.createDataFrame([(2, True), (4, False), (7, False), (99, True)], "obs_id bigint, y boolean")
    got = sorted(((r.place_no, r.obs_id, r.level, r.p) for r in R.rank_candidates(rows, graded).collect()))
    assert got == [(1, 9, 1000, .5), (2, 2, 500, .5), (3, 4, 500, .5), (4, 7, 0, 0.), (5, 5, None, None)]
    bare = R.rank_candidates(rows, graded.where("false")).collect()
    assert len(bare) == 5 and all(r.p is None for r in bare) and {r.obs_id: r.place_no for r in bare} == {9: 1, 2: 2, 4: 3, 7: 4, 5: 5}
    assert R.rank_candidates(rows.where("false"), graded).count() == 0


def domain(rng, extra, far_only=False):
    out = []
    for c in range(-1500, -1484):
        for r in range(740, 760):
            lat = (r + .5) * .05
            share = .2 + (extra if abs(lat - 37.5) * 111.195 <= 10 else 0)
            out += [((c + .5) * .05, lat, rng.random() < share) for _ in range(40)]
    return out


def test_two_domains_agree_or_one_stands_alone(spark):
    lines = spark.createDataFrame([(-80.0, 37.5, -70.0, 37.5)], "x0 double, y0 double, x1 double, y1 double")
    frame = lambda rows: spark.createDataFrame([*rows, (None, 37.5, True)], "lon double, lat double, hit boolean")
    rng = random.Random(11)
    flat, raised, also = domain(rng, 0), domain(rng, .25), domain(rng, .25)
    both = X.cross_domain(frame(raised), frame(also), lines, 10_000.0, 40_000.0, 60).first()
    one = X.cross_domain(frame(raised), frame(flat), lines, 10_000.0, 40_000.0, 60).first()
    assert both.n_cells == 320 and both.n_trials == 60
    assert both.effect_sea == pytest.approx(.25, abs=.04) and both.effect_air == pytest.approx(.25, abs=.04) and both.trial_r > .8
    assert one.effect_air == pytest.approx(0, abs=.04) and abs(one.trial_r) < .6
    assert both.q < one.q and one.tau2 > 0


def test_effect_equals_direct_sums(spark):
    rng = random.Random(2)
    cells = [(-1500 + i % 8, 745 + i // 8, 5 + i, rng.randint(0, 5), 7, rng.randint(0, 7)) for i in range(64)]
    lines = spark.createDataFrame([(-80.0, 37.5, -70.0, 37.5)], "x0 double, y0 double, x1 double, y1 double")
    df = spark.createDataFrame(cells, "col bigint, row bigint, sea_n bigint, sea_x bigint, air_n bigint, air_x bigint")
    got = {r.trial: r for r in X.displaced_effects(df, lines, 8_000.0, 30_000.0, 3, "x").collect()}
    away = lambda r: abs((r + .5) * .05 - 37.5) * 111_195
    near, far = [c for c in cells if away(c[1]) <= 8_000], [c for c in cells if 8_000 < away(c[1]) <= 30_000]
    share = lambda rows, i: sum(c[i + 1] for c in rows) / sum(c[i] for c in rows)
    assert got[0].effect_sea == pytest.approx(share(near, 2) - share(far, 2)) and got[0].effect_air == pytest.approx(share(near, 4) - share(far, 4))
    assert set(got) <= {0, 1, 2, 3}


PAIR = "feed_id string, vehicle_key string, mid_s bigint, mid_lat double, mid_lon double, speed_mps double, clock_s bigint"


def test_dates_close_once_and_late_pairs_stay_apart(spark, tmp_path):
    """Four batches; the third closes the first date, the fourth brings two pairs for it too late. A repeated batch changes nothing."""
    zones, day, rng = {"A": "UTC", "B": "America/New_York"}, 86_400, np.random.default_rng(1)

    def pairs(lo, hi, n, clock=None):
        at = [int(v) for v in rng.integers(lo, hi, n)]
        return [("AB"[i % 2], f"v{i % 5}", t, 40.0 + .001 * (i % 3), -75.0, float(i % 30), clock or t) for i, t in enumerate(at)]
    batches = [pairs(0, day, 60), pairs(day, 1.5 * day, 60), pairs(1.5 * day, 2.0 * day, 60), [*pairs(2 * day, 2.2 * day, 20), ("A", "v1", 100, 40.0, -75.0, 3.0, int(2.1 * day)),
                ("B", "v1", 100, 40.0, -75.0, 3.0, int(2.1 * day)), ("Z", "v1", 100, 40.0, -75.0, 3.0, int(2.1 * day))]]
    out = str(tmp_path / "out")
    write = J.cell_hour_closer(out, zones)
    frames = [spark.createDataFrame(b, PAIR) for b in batches]
    for i, f in enumerate(frames):
        write(f, i)
        if i == 2:
            write(f, i)
            first = spark.read.parquet(f"{out}/cells")
            assert {r[0] for r in first.select("local_date").distinct().collect()} <= {datetime.date(1969, 12, 31), datetime.date(1970, 1, 1)} and first.count()
    J.close_rest(spark, out, zones)
    J.close_rest(spark, out, zones)
    late = spark.read.parquet(f"{out}/late").collect()
    assert sorted((r.feed_id, r.mid_s) for r in late) == [("A", 100), ("B", 100)]
    on_time = frames[0].union(frames[1]).union(frames[2]).union(frames[3].where("mid_s > 100"))
    cols = ["cell_row", "cell_col", "local_date", "local_hour", "n_pairs", "n_vehicles", "feeds", "median_mps", "p25_mps", "p75_mps"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(spark.read.parquet(f"{out}/cells")) == rows(L.midpoint_cell_hours(on_time, zones))


def test_empty_batches_close_nothing(spark, tmp_path):
    out, zones = str(tmp_path / "out"), {"A": "UTC"}
    write = J.cell_hour_closer(out, zones)
    empty = spark.createDataFrame([], PAIR)
    for i in range(2):
        write(empty, i)
    J.close_rest(spark, out, zones)
    assert spark.read.parquet(f"{out}/cells").count() == 0
    write(spark.createDataFrame([("A", "v", 5, 40.0, -75.0, 2.0, 5)], PAIR), 2)
    J.close_rest(spark, out, zones)
    assert spark.read.parquet(f"{out}/cells").agg(F.sum("n_pairs")).first()[0] == 1

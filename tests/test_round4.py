"""Whole jobs: every trial, every throw."""

from hashlib import md5

from plotgap.operators import boundary as S
from plotgap.plans import hashes


def test_first_words_are_those_of_md5(monkeypatch):
    monkeypatch.setattr(hashes, "CHUNK", 50)
    for length in (0, 5, 41, 50, 53, 54, 55, 62, 63, 64, 130):
        prefix, seen = "é" + "x" * length, {}
        for rows, columns in (((8, 12), (7, 103)), ((9, 9), (98, 101))):
            seen.clear()
            for i, x in hashes.first_words(prefix, rows, columns):
                at = len(seen.get(i, []))
                for a, got in enumerate(x.tolist()):
                    seen.setdefault(i + a, []).extend(got)
                    assert len(seen[i + a]) == at + len(got)
            assert seen == {i: [int(md5(f"{prefix}|{i}|{j}".encode()).hexdigest()[:8], 16) for j in range(columns[0], columns[1] + 1)] for i in range(rows[0], rows[1] + 1)}


def test_scattered_null_has_all_trials_of_the_rule(spark):
    from plotgap import catalog
    queries, oracle = catalog.load()
    got = queries["scattered_null"](spark, "/root/testdata/sf0.001").collect()
    assert got and {r["trials"] for r in got} == {2000}
    assert "range(1, 2001)" in oracle["scattered_null"]


def test_throws_are_dealt_in_ranges_and_all_counted(spark, monkeypatch):
    counts = spark.createDataFrame([("L", False, 1, "a", 30), ("L", False, 1, "b", 25), ("M", False, 1, "a", 12)], "limit string, matched boolean, day bigint, band string, n bigint")
    area = spark.createDataFrame([("L", 1, "a", 1.0), ("L", 1, "b", 2.0), ("L", 1, "c", 4.0), ("M", 1, "a", 3.0)], "limit string, day bigint, band string, km2 double")
    whole = sorted(S.scattered_null(counts, area, 13, "t").collect())
    monkeypatch.setattr(S, "BLOCK", 10)
    monkeypatch.setattr(S, "THROWS", 40)
    assert sorted(S.scattered_null(counts, area, 13, "t").collect()) == whole and len(whole) == 2


def _motion(spark):
    import random
    rng = random.Random(9)
    rows, at = [], {"P0": 1, "P1": 3, "P2": 300, "P3": 0}  # P0 and P1 report often, P2 seldom, P3 far away
    for name, t in at.items():
        for k in range({"P0": 400, "P1": 250, "P2": 6, "P3": 50}[name]):
            rows.append((name, t * 1_000_000, 37.0 + (1.0 if name == "P3" else 0.0) + rng.uniform(-0.004, 0.004), -75.0 + rng.uniform(-0.004, 0.004)))
            t += {"P0": rng.choice((1, 2)), "P1": 2, "P2": 100, "P3": 7}[name]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id bigint, platform_id string, t_us bigint, lat double, lon double")


def test_contacts_are_those_of_all_pairs(spark):
    import math

    from plotgap.operators import rendezvous as R
    pieces = R.motion_pieces(_motion(spark), 60_000_000, 3600.0)
    got = R.contacts(pieces, 400.0, 0.05, 20_000)
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]  # no cells are worked out for each pair of pieces
    rows, want, met = pieces.collect(), {}, 0
    for p in rows:
        for q in rows:
            begin, end = max(p["s"], q["s"]), min(p["e"], q["e"])
            if p["platform_id"] >= q["platform_id"] or p["slot"] != q["slot"] or begin >= end:
                continue
            met += 1

            def at(r, v, t):
                return r[f"{v}_s"] + (r[f"{v}_e"] - r[f"{v}_s"]) * ((t - r["s"]) / (r["e"] - r["s"]))
            scale = 111195.0 * math.cos(math.radians((at(p, "lat", begin) + at(q, "lat", begin)) / 2))
            x, x1 = ((at(q, "lon", t) - at(p, "lon", t)) * scale for t in (begin, end))
            y, y1 = ((at(q, "lat", t) - at(p, "lat", t)) * 111195.0 for t in (begin, end))
            u, v = x1 - x, y1 - y
            least = max(0.0, min(1.0, -(x * u + y * v) / (u * u + v * v)))
            if (m := math.hypot(x + least * u, y + least * v)) <= 400.0:
                key = (p["platform_id"], q["platform_id"])
                want.setdefault(key, []).append(round(m, 6))
    found = {}
    for r in got.collect():
        found.setdefault((r["a"], r["b"]), []).append(round(r["min_m"], 6))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert set(want) == {("P0", "P1"), ("P0", "P2"), ("P1", "P2")} and sum(map(len, want.values())) < met


def test_pieces_are_read_with_the_latest_of_the_other_platform(spark):
    from plotgap.operators import rendezvous as R
    pieces = R.motion_pieces(_motion(spark), 60_000_000, 3600.0)
    plan = R.contacts(pieces, 400.0, 0.05, 20_000)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join Inner")[0]
    assert "Window" in above and "moment" in above  # one pass over the pieces of two platforms, no join of pieces with pieces

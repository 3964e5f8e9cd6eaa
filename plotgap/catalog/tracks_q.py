"""Tracks and self-consistency detectors."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.operators import detectors as D
from plotgap.operators import tracks as T
from plotgap.plans.sequence import chunk_of

TR = """dd AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY platform_id, t_us ORDER BY event_id)=1),
tr AS (SELECT *, CAST(sum(CASE WHEN g IS NULL OR g>1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id ORDER BY t_us) AS BIGINT) AS seq
  FROM (SELECT *, t_us-lag(t_us) OVER (PARTITION BY platform_id ORDER BY t_us) AS g FROM dd))"""


def tracks(t):
    return T.sessionise_tracks(T.first_per_instant(t.reports))


@query("sessionise_tracks", f"""WITH {TR} SELECT platform_id, seq AS track_seq, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n
    FROM tr GROUP BY 1, 2 HAVING count(*) >= 2""")
def sessionise_tracks(t):
    return (T.sessionise_tracks(T.first_per_instant(t.reports), min_reports=2).groupBy("platform_id", "track_seq")
            .agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n")))


@query("report_intervals", """SELECT * FROM (SELECT platform_id, event_id, t_us AS start_us, lead(t_us) OVER w AS end_us, (lead(t_us) OVER w - t_us)/1e6 AS seconds
    FROM reports WINDOW w AS (PARTITION BY platform_id ORDER BY t_us, event_id)) WHERE end_us IS NOT NULL""")
def report_intervals(t):
    return T.report_intervals(t.reports)


SUMMARY = f"""{TR}, st AS (SELECT *, {d.hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM tr
   WINDOW w AS (PARTITION BY platform_id, seq ORDER BY t_us, event_id)),
 su AS (SELECT platform_id, seq AS track_seq, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_reports,
   (max(t_us)-min(t_us))/1e6 AS duration_s, round(coalesce(sum(step), 0), 3) AS path_m,
   round({d.hav('arg_min(lat, t_us)', 'arg_min(lon, t_us)', 'arg_max(lat, t_us)', 'arg_max(lon, t_us)')}, 3) AS net_m
   FROM st GROUP BY 1, 2)"""


def summary(t):
    s = T.track_summary(tracks(t))
    return s.withColumn("path_m", F.round("path_m", 3)).withColumn("net_m", F.round("net_m", 3))


@query("track_summary", f"WITH {SUMMARY} SELECT * FROM su")
def track_summary(t):
    return summary(t)


def _pos(expr_mid, expr_past):
    return f"CASE WHEN at_a IS NOT NULL AND at_b IS NOT NULL THEN {expr_mid} WHEN at_b IS NULL AND sp IS NOT NULL THEN {expr_past} END"


BR = d.bearing("la", "lo", "lb", "ob")
DI = d.hav("la", "lo", "lb", "ob")
FR = "((at_us-at_a)/1e6/((at_b-at_a)/1e6))"


@query("position_at", f"""WITH {SUMMARY}, ins AS (SELECT platform_id, track_seq, unnest(range(((start_us+1799999999)//3600000000)*3600000000+1800000000, end_us+3600000000, 3600000000)) AS at_us FROM su),
  br AS (SELECT i.*, a.t_us AS at_a, a.lat AS la, a.lon AS lo, a.speed_mps AS sp, a.heading_deg AS hd, b.t_us AS at_b, b.lat AS lb, b.lon AS ob
    FROM ins i ASOF LEFT JOIN tr a ON i.platform_id=a.platform_id AND i.track_seq=a.seq AND i.at_us>a.t_us
    ASOF LEFT JOIN tr b ON i.platform_id=b.platform_id AND i.track_seq=b.seq AND i.at_us<=b.t_us)
  SELECT platform_id, track_seq, at_us, round({_pos(d.proj_lat('la', 'lo', BR, f'({DI}*{FR})'), d.proj_lat('la', 'lo', 'hd', '(sp*((at_us-at_a)/1e6))'))}, 6) AS lat,
  round({_pos(d.proj_lon('la', 'lo', BR, f'({DI}*{FR})'), d.proj_lon('la', 'lo', 'hd', '(sp*((at_us-at_a)/1e6))'))}, 6) AS lon,
  round({_pos(f'20e0+{DI}*0.5e0*(1-abs(2*{FR}-1))', '20e0+abs(sp*((at_us-at_a)/1e6))*0.1e0')}, 3) AS uncertainty_m,
  {_pos("'interpolated'", "'dead reckoned'")} AS how FROM br""")
def position_at(t):
    tr = tracks(t)
    spans = tr.groupBy("platform_id", "track_seq").agg(F.min("t_us").alias("s"), F.max("t_us").alias("e"))
    first = F.expr("((s + 1799999999) div 3600000000) * 3600000000 + 1800000000")
    last = F.col("e") + 3_600_000_000 - 1
    grid = F.when(first <= last, F.sequence(first, last, F.lit(3_600_000_000)))
    asked = spans.select("platform_id", "track_seq", F.explode(grid).alias("at_us"))
    p = T.position_at(tr, asked, ["platform_id", "track_seq"])
    return (p.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))
            .withColumn("uncertainty_m", F.round("uncertainty_m", 3)))


@query("tracks_at", """WITH sc AS (SELECT DISTINCT scene, t_scene_us FROM observations),
    w AS (SELECT s.scene, r.platform_id, r.t_us, r.t_us-lag(r.t_us) OVER (PARTITION BY s.scene, r.platform_id ORDER BY r.t_us, event_id) AS g
      FROM sc s JOIN reports r ON abs(r.t_us-s.t_scene_us)<=1800000000)
    SELECT scene, platform_id, count(*) AS n_reports, CAST(sum(CASE WHEN g IS NULL OR g>1800000000 THEN 1 ELSE 0 END) AS BIGINT) AS n_tracks
    FROM w GROUP BY 1, 2""")
def tracks_at(t):
    scenes = t.observations.select("scene", "t_scene_us").distinct()
    got = T.tracks_at(t.reports, scenes, "t_scene_us")
    return got.groupBy("scene", "platform_id").agg(F.count(F.lit(1)).alias("n_reports"), F.max("track_seq").alias("n_tracks"))


@query("decimate_track", f"""WITH {TR}, v AS (SELECT platform_id, seq, event_id, row_number() OVER (PARTITION BY platform_id, seq ORDER BY t_us, event_id)-1 AS i,
    count(*) OVER (PARTITION BY platform_id, seq) AS n FROM tr)
    SELECT platform_id, seq AS track_seq, event_id, CAST(i AS BIGINT) AS vertex FROM v
    WHERE n<=20 OR i=n-1 OR i IN (SELECT (k*v.n)//20 FROM range(20) r(k))""")
def decimate_track(t):
    return T.decimate_track(tracks(t), limit=20).select("platform_id", "track_seq", "event_id", F.col("vertex").cast("bigint").alias("vertex"))


@query("top_tracks", f"""WITH {SUMMARY}, k AS (SELECT * FROM su WHERE n_reports>=10) SELECT *, (SELECT count(*) FROM k) AS n_tracks_total,
    (SELECT count(*) FROM k)>25 AS truncated FROM k ORDER BY n_reports DESC, platform_id, track_seq LIMIT 25""")
def top_tracks(t):
    return T.top_tracks(summary(t), 10, 25)


@query("track_lines", f"""WITH {TR}, v AS (SELECT *, row_number() OVER (PARTITION BY platform_id, seq ORDER BY t_us, event_id)-1 AS i,
    count(*) OVER (PARTITION BY platform_id, seq) AS n FROM tr)
    SELECT platform_id, seq AS track_seq, count(*) AS n_vertices, arg_min(lon, i) AS lon0, arg_min(lat, i) AS lat0, arg_max(lon, i) AS lon1, arg_max(lat, i) AS lat1
    FROM v WHERE n<=20 OR i=n-1 OR i IN (SELECT (k*v.n)//20 FROM range(20) r(k)) GROUP BY 1, 2""")
def track_lines(t):
    lines = T.track_lines(T.decimate_track(tracks(t), limit=20))
    c, n = F.col("coordinates"), F.size("coordinates")
    last = F.element_at(c, -1)
    return lines.select("platform_id", "track_seq", n.cast("bigint").alias("n_vertices"), c[0][0].alias("lon0"),
                        c[0][1].alias("lat0"), last[0].alias("lon1"), last[1].alias("lat1"))


@query("latest_fix", """SELECT hex, event_id, t_us, lat, lon, alt_m FROM aircraft WHERE NOT on_ground
    QUALIFY row_number() OVER (PARTITION BY hex ORDER BY t_us DESC, event_id DESC)=1""")
def latest_fix(t):
    air = t.aircraft.where(~F.col("on_ground")).select("hex", "event_id", "t_us", "lat", "lon", "alt_m")
    return T.latest_fix(air, "hex", ["t_us", "event_id"])


@query("recent_vehicles", """WITH n AS (SELECT max(fetched_at)+10 AS now FROM fixes), i AS (SELECT f.*, n.now FROM fixes f, n WHERE fetched_at>=now-1800)
    SELECT feed_id, vehicle_key, lat, lon, 'agency ' || feed_id AS provider, greatest(0, now-coalesce(vehicle_ts, fetched_at)) AS age_s,
    CASE WHEN vehicle_ts IS NULL THEN 'poll' ELSE 'vehicle' END AS age_from, now-(SELECT max(fetched_at) FROM i) AS archive_lag_s FROM i
    QUALIFY row_number() OVER (PARTITION BY feed_id, vehicle_key ORDER BY coalesce(vehicle_ts, fetched_at) DESC, fetched_at DESC, arrival DESC)=1""")
def recent_vehicles(t):
    now = t.fixes.agg(F.max("fetched_at") + 10).first()[0]
    feeds = t.fixes.select("feed_id").distinct().withColumn("provider", F.concat(F.lit("agency "), F.col("feed_id")))
    return T.recent_vehicles(t.fixes, feeds, now, 1800).select("feed_id", "vehicle_key", "lat", "lon", "provider",
                                                               "age_s", "age_from", "archive_lag_s")


@query("derive_motion", f"""WITH p AS (SELECT *, CASE WHEN arrival%3=0 THEN NULL ELSE 5e0 END AS speed, CASE WHEN arrival%5=0 THEN NULL ELSE 90e0 END AS bearing,
    lag(vehicle_ts) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM fixes WINDOW w AS (PARTITION BY feed_id, vehicle_key ORDER BY arrival)),
    q AS (SELECT *, coalesce(vehicle_ts-pt>0 AND vehicle_ts-pt<=120, false) AS ok FROM p)
    SELECT arrival, CASE WHEN speed IS NOT NULL AND bearing IS NOT NULL THEN 'feed' WHEN ok THEN 'derived' ELSE 'none' END AS motion,
    round(coalesce(speed, CASE WHEN ok THEN {d.hav('pa', 'po', 'lat', 'lon')}/(vehicle_ts-pt) END), 6) AS speed,
    round(coalesce(bearing, CASE WHEN ok THEN {d.bearing('pa', 'po', 'lat', 'lon')} END), 6) AS bearing FROM q""")
def derive_motion(t):
    f = (t.fixes.withColumn("speed", F.when(F.col("arrival") % 3 != 0, 5.0))
         .withColumn("bearing", F.when(F.col("arrival") % 5 != 0, 90.0)))
    m = T.derive_motion(f, ["feed_id", "vehicle_key"], ["arrival"], chunk_of("arrival", 1_000_000))
    return m.select("arrival", "motion", F.round("speed", 6).alias("speed"), F.round("bearing", 6).alias("bearing"))


PAIRS = f"""{TR}, pr AS (SELECT *, (t_us-pt)/1e6 AS dt, {d.hav('pa', 'po', 'lat', 'lon')} AS dist, sqrt(800e0) AS sg FROM
  (SELECT *, lag(t_us) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(speed_mps) OVER w AS ps FROM dd
   WINDOW w AS (PARTITION BY platform_id ORDER BY t_us, event_id)) WHERE pt IS NOT NULL),
 sp AS (SELECT *, greatest(0e0, dist-sg)/dt/26e0 AS ratio FROM pr)"""
CONF = "least(0.95e0, 0.5e0+0.225e0*({r}-1.1e0))"
OUT = "platform_id, pt AS t_start_us, t_us AS t_end_us, lat, lon, round({c}, 9) AS confidence"
EV = {
    "speed": f"SELECT 'kinematic' AS kind, {OUT.format(c=CONF.format(r='ratio'))} FROM sp WHERE dt>0 AND dt<=1800 AND ratio>1.1e0",
    "accel": f"SELECT 'kinematic' AS kind, {OUT.format(c=CONF.format(r='(abs(speed_mps-ps)/dt/1e0)'))} FROM sp WHERE dt>0 AND dt<=1800 AND ratio<=1.1e0 AND abs(speed_mps-ps)/dt/1e0>1.1e0",
    "disagree": f"""SELECT 'kinematic' AS kind, {OUT.format(c="least(0.7e0, 0.3e0+0.05e0*(greatest(dist/dt, ps)/greatest(0.5e0, least(dist/dt, ps))))")} FROM sp
      WHERE dt>0 AND dt<=1800 AND ps IS NOT NULL AND NOT (ps<1 AND dist/dt<1) AND greatest(dist/dt, ps)/greatest(0.5e0, least(dist/dt, ps))>=3""",
    "reuse": f"SELECT 'identity' AS kind, {OUT.format(c='least(0.9e0, 0.6e0+(dist-26e0*dt)/5000000e0)')} FROM sp WHERE dt>=3600 AND dist>26e0*dt",
    "dup": f"SELECT 'identity' AS kind, platform_id, t_us AS t_start_us, t_us AS t_end_us, lat, lon, 0.6e0 AS confidence FROM (SELECT *, {d.hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS dd2 FROM reports WINDOW w AS (PARTITION BY platform_id, t_us ORDER BY event_id)) WHERE dd2>1",
    "collide": f"""SELECT 'identity' AS kind, platform_id, ta AS t_start_us, tb AS t_end_us, lat, lon, round(least(0.98e0, 0.75e0+ex/1000000e0), 9) AS confidence FROM (
      SELECT a.platform_id, a.t_us AS ta, b.t_us AS tb, a.event_id AS ia, b.event_id AS ib, b.lat, b.lon,
        {d.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}-26e0*greatest((b.t_us-a.t_us)/1e6, 1e0)-sqrt(800e0) AS ex
      FROM reports a JOIN reports b ON a.platform_id=b.platform_id AND b.t_us-a.t_us<=60000000 AND (b.t_us>a.t_us OR (b.t_us=a.t_us AND b.event_id>a.event_id)))
      WHERE ex>0 QUALIFY row_number() OVER (PARTITION BY platform_id ORDER BY ex DESC, ta, ia, tb, ib)=1""",
}


def trim(events):
    return events.select("kind", "platform_id", "t_start_us", "t_end_us", "lat", "lon", F.round("confidence", 9).alias("confidence"))


def pairs(t):
    return D.steps(T.first_per_instant(t.reports))


# variants of the reports: slow movers for the acceleration test, shared identifiers for reuse
SLOW = """reports2 AS (SELECT *EXCLUDE(lat, lon), 36.5e0+(event_id*7919%1000)/200000e0 AS lat, -76e0+(event_id*104729%1000)/200000e0 AS lon FROM reports), """
SHARED = """reports2 AS (SELECT r.*EXCLUDE(platform_id), 'S' || (e.user_id % 37) AS platform_id FROM reports r JOIN e USING(event_id)), """


def slow(t):
    r = t.reports
    return r.withColumn("lat", 36.5 + (F.col("event_id") * 7919 % 1000) / 200000.0).withColumn(
        "lon", -76.0 + (F.col("event_id") * 104729 % 1000) / 200000.0)


def shared(t):
    users = t.e.select("event_id", F.concat(F.lit("S"), (F.col("user_id") % 37).cast("string")).alias("platform_id"))
    return t.reports.drop("platform_id").join(users, "event_id")


@query("impossible_speed", f"WITH {PAIRS} {EV['speed']}")
def impossible_speed(t):
    return trim(D.impossible_speed(pairs(t), "sea", 1800.0))


@query("impossible_accel", f"WITH {SLOW}{PAIRS.replace('FROM reports', 'FROM reports2')} {EV['accel']}")
def impossible_accel(t):
    return trim(D.impossible_accel(D.steps(T.first_per_instant(slow(t))), "sea", 1800.0))


@query("speed_disagreement", f"WITH {PAIRS} {EV['disagree']}")
def speed_disagreement(t):
    return trim(D.speed_disagreement(pairs(t), split_gap_s=1800.0))


@query("identity_reuse", f"WITH {SHARED}{PAIRS.replace('FROM reports', 'FROM reports2')} {EV['reuse']}")
def identity_reuse(t):
    return trim(D.identity_reuse(D.steps(T.first_per_instant(shared(t))), "sea"))


@query("identity_duplicate", EV["dup"].replace("FROM reports", "FROM rr") .replace("SELECT 'identity'", "WITH rr AS (SELECT *EXCLUDE(t_us), (t_us//60000000)*60000000 AS t_us FROM reports) SELECT 'identity'", 1))
def identity_duplicate(t):
    minute = t.reports.withColumn("t_us", F.expr("(t_us div 60000000) * 60000000"))
    return trim(D.identity_duplicate(minute))


@query("identity_collision", EV["collide"])
def identity_collision(t):
    return trim(D.identity_collision(t.reports, "sea"))


@query("run_detectors", f"WITH {PAIRS} SELECT kind, platform_id, count(*) AS n, max(confidence) AS top FROM ({' UNION ALL '.join(EV[k] for k in ('speed', 'accel', 'disagree', 'reuse', 'dup'))} UNION ALL SELECT * FROM ({EV['collide']})) GROUP BY 1, 2")
def run_detectors(t):
    return (trim(D.run_detectors(t.reports, "sea")).groupBy("kind", "platform_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top")))

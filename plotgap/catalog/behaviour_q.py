"""Meetings, loitering and circling."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.operators import loiter as L
from plotgap.operators import orbits as O
from plotgap.operators import rendezvous as R
from plotgap.operators.tracks import sessionise_tracks

M = "111195e0"
NEAR_M = 6000.0


def _at(p, v, t):
    return f"({p}.{v}_s+({p}.{v}_e-{p}.{v}_s)*(({t}-{p}.s)/CAST({p}.e-{p}.s AS DOUBLE)))"


def _step(v, t):
    return f"(p{v}+({v}-p{v})*(({t}-pt)/CAST(t_us-pt AS DOUBLE)))"


MEET = f"""st AS (SELECT *, lag(t_us) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM reports WINDOW w AS (PARTITION BY platform_id ORDER BY t_us, event_id)),
  sl AS (SELECT *, greatest(pt, slot*600000000) AS s, least(t_us, (slot+1)*600000000) AS e FROM (SELECT *, unnest(range(pt//600000000, (t_us-1)//600000000+1)) AS slot FROM st WHERE t_us>pt AND t_us-pt<=3600000000)),
  pc AS MATERIALIZED (SELECT platform_id, slot, s, e, {', '.join(f"{_step(v, t)} AS {v}_{t}" for t in 'se' for v in ('lon', 'lat'))} FROM sl),
  pp AS (SELECT a.platform_id AS a, b.platform_id AS b, greatest(a.s, b.s) AS ft, least(a.e, b.e) AS tt, {', '.join(f"{_at('b', v, w)}-{_at('a', v, w)} AS {v}{i}" for i, w in ((0, 'greatest(a.s, b.s)'), (1, 'least(a.e, b.e)')) for v in ('lon', 'lat'))},
     {M}*cos(radians(({_at('a', 'lat', 'greatest(a.s, b.s)')}+{_at('b', 'lat', 'greatest(a.s, b.s)')})/2)) AS sc FROM pc a JOIN pc b ON a.slot=b.slot AND a.platform_id<b.platform_id AND greatest(a.s, b.s)<least(a.e, b.e)),
  mv AS (SELECT a, b, ft, tt, lon0*sc AS x, lat0*{M} AS y, lon1*sc-lon0*sc AS u, lat1*{M}-lat0*{M} AS v FROM pp),
  qq AS (SELECT *, u*u+v*v AS q2, x*u+y*v AS q1, x*x+y*y-{NEAR_M}e0*{NEAR_M}e0 AS q0 FROM mv),
  bb AS (SELECT *, CASE WHEN q2<1e-9 THEN 0e0 ELSE greatest(0e0, (-q1-sqrt(greatest(0, q1*q1-q2*q0)))/q2) END AS bg, CASE WHEN q2<1e-9 THEN 1e0 ELSE least(1e0, (-q1+sqrt(greatest(0, q1*q1-q2*q0)))/q2) END AS en,
     CASE WHEN q2<1e-9 THEN 0e0 ELSE greatest(0e0, least(1e0, -q1/q2)) END AS be FROM qq),
  co AS (SELECT a, b, ft+CAST(round(bg*(tt-ft)) AS BIGINT) AS f, ft+CAST(round(en*(tt-ft)) AS BIGINT) AS t, sqrt(pow(x+be*u, 2)+pow(y+be*v, 2)) AS m FROM bb WHERE sqrt(pow(x+be*u, 2)+pow(y+be*v, 2))<={NEAR_M}e0),
  il AS (SELECT *, sum(nw) OVER (PARTITION BY a, b ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN f<=max(t) OVER (PARTITION BY a, b ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+60000000 THEN 0 ELSE 1 END AS nw FROM co))"""


@query("rendezvous", f"""WITH {MEET} SELECT a, b, round(min(f)/1e6, 2) AS start_s, round((max(t)-min(f))/1e6, 2) AS duration_s, round(min(m), 3) AS min_m, count(*) AS n_contacts FROM il GROUP BY a, b, i HAVING (max(t)-min(f))/1e6>=900""")
def rendezvous(t):
    got = R.rendezvous(t.reports, max_separation_m=NEAR_M, min_duration_s=900.0)
    return got.select("a", "b", F.round(F.col("start_us") / 1e6, 2).alias("start_s"), F.round("duration_s", 2).alias("duration_s"), F.round("min_m", 3).alias("min_m"), "n_contacts")


@query("loiter", f"""WITH r AS MATERIALIZED (SELECT platform_id, t_us, lat, lon, row_number() OVER (PARTITION BY platform_id ORDER BY t_us, event_id) AS k FROM reports),
  w AS (SELECT a.platform_id, a.k AS i, b.k AS j, a.t_us AS ts, b.t_us AS te, max(b.lat) OVER v AS a1, min(b.lat) OVER v AS a0, max(b.lon) OVER v AS o1, min(b.lon) OVER v AS o0
     FROM r a JOIN r b ON a.platform_id=b.platform_id AND b.k>=a.k WINDOW v AS (PARTITION BY a.platform_id, a.k ORDER BY b.k ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT platform_id, i, ts, max(te) AS te FROM w WHERE (a1-a0)*{M}<=2500 AND (o1-o0)*{M}*cos(radians(CASE WHEN a0<=0 AND a1>=0 THEN 0 ELSE least(abs(a0), abs(a1)) END))<=2500 GROUP BY ALL)
  SELECT platform_id, min(ts) AS start_us, te AS end_us, (te-min(ts))/1e6 AS duration_s FROM f GROUP BY platform_id, te HAVING (te-min(ts))/1e6>=1800""")
def loiter(t):
    return L.loiter(t.reports, size_m=2500.0, min_duration_s=1800.0)


TURN = f"""tq AS (SELECT *, sum(nw) OVER (PARTITION BY platform_id ORDER BY t_us, event_id) AS track_seq FROM (SELECT *, CASE WHEN t_us-lag(t_us) OVER (PARTITION BY platform_id ORDER BY t_us, event_id)<=1800000000 THEN 0 ELSE 1 END AS nw FROM reports)),
  sp AS (SELECT *, lag(t_us) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM tq WINDOW w AS (PARTITION BY platform_id, track_seq ORDER BY t_us, event_id)),
  sd AS (SELECT *, {d.hav('pla', 'plo', 'lat', 'lon')} AS dist FROM sp),
  br AS (SELECT *, lag(be) OVER (PARTITION BY platform_id, track_seq ORDER BY t_us, event_id) AS lb FROM (SELECT *, {d.bearing('pla', 'plo', 'lat', 'lon')} AS be FROM sd WHERE dist>0 AND t_us>pt)),
  tn AS (SELECT *, sum(turn) OVER (PARTITION BY platform_id, track_seq ORDER BY t_us, event_id) AS hd, abs(turn)/((t_us-pt)/1e6) AS ra FROM (SELECT *, (be-lb+540e0)-360e0*floor((be-lb+540e0)/360e0)-180e0 AS turn FROM br WHERE lb IS NOT NULL)),
  tu AS (SELECT platform_id, track_seq, sum(turn) AS net_turn, sum(abs(turn)) AS total_turn, greatest(max(hd), 0)-least(min(hd), 0) AS unwrapped_range,
     {', '.join(f"count(*) FILTER (WHERE ra>={lo} AND ra<{hi})" + f" AS h{i}" for i, (lo, hi) in enumerate(zip([0, 0.1, 0.5, 1, 2, 5], [0.1, 0.5, 1, 2, 5, 1e300])))} FROM tn GROUP BY ALL),
  wh AS (SELECT platform_id, track_seq, count(*) AS n, (max(t_us)-min(t_us))/1e6 AS duration_s, coalesce(sum(dist), 0) AS path_m, avg(lat) AS cla, avg(lon) AS clo, arg_min(lat, (t_us, event_id)) AS la0, arg_min(lon, (t_us, event_id)) AS lo0,
     arg_max(lat, (t_us, event_id)) AS la1, arg_max(lon, (t_us, event_id)) AS lo1, (max(lat)-min(lat))*(max(lon)-min(lon))*cos(radians(avg(lat)))*pow(111.195e0, 2) AS box_km2 FROM sd GROUP BY ALL),
  nt AS (SELECT *, {d.hav('la0', 'lo0', 'la1', 'lo1')} AS net_m FROM wh),
  dw AS (SELECT platform_id, track_seq, sum(CASE WHEN {d.hav('lat', 'lon', 'cla', 'clo')}<=2000 THEN t_us-pt ELSE 0 END)/1e6 AS dws FROM sd JOIN wh USING (platform_id, track_seq) WHERE pt IS NOT NULL GROUP BY ALL)"""
FEATURES = ["path_m", "net_m", "path_over_net", "box_km2", "net_turn", "total_turn", "laps", "unwrapped_range", "dwell_share"]


@query("orbit_features", f"""WITH {TURN} SELECT platform_id, CAST(track_seq AS BIGINT) AS track_seq, n, round(duration_s, 3) AS duration_s, round(path_m, 3) AS path_m, round(net_m, 3) AS net_m, round(path_m/nullif(net_m, 0), 3) AS path_over_net,
    round(box_km2, 3) AS box_km2, round(net_turn, 3) AS net_turn, round(total_turn, 3) AS total_turn, round(abs(net_turn)/360, 3) AS laps, round(unwrapped_range, 3) AS unwrapped_range, round(dws/nullif(duration_s, 0), 3) AS dwell_share,
    CASE WHEN h0 IS NOT NULL THEN concat_ws(',', {', '.join(f'h{i}' for i in range(6))}) END AS turn_hist FROM nt LEFT JOIN tu USING (platform_id, track_seq) LEFT JOIN dw USING (platform_id, track_seq)""")
def orbit_features(t):
    got = O.orbit_features(sessionise_tracks(t.reports, 1800.0))
    hist = F.when(F.col("turn_hist").isNotNull(), F.concat_ws(",", F.transform("turn_hist", lambda n: n.cast("string"))))
    return got.select("platform_id", F.col("track_seq").cast("bigint").alias("track_seq"), "n", F.round("duration_s", 3).alias("duration_s"), *[F.round(c, 3).alias(c) for c in FEATURES], hist.alias("turn_hist"))

"""Silences weighed by coverage, the space-time cube, traffic-normalised rates and hot spots."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.catalog.coverage_q import GRID, LISTEN, SES, listen
from plotgap.operators import coverage as V
from plotgap.operators import cube as Q
from plotgap.operators import gaps as G
from plotgap.operators import hotspots as H
from plotgap.operators import rates as R
from plotgap.operators import uptime as U

END_US = 259_200_000_000


def blind(t):
    sessions = U.collector_sessions(t.heartbeats).withColumn("collector", F.lit("all"))
    return U.blind_intervals(U.uptime_intervals(sessions), sessions.select("collector").distinct(), F.lit(0).cast("bigint"), F.lit(END_US))


BLIND = f"""{SES}, al AS (SELECT started_us AS lo, coalesce(ended_us, last_us) AS hi FROM ss UNION ALL SELECT 0, 0 UNION ALL SELECT {END_US}, {END_US}),
 bl AS (SELECT * FROM (SELECT max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, lo AS hi FROM al) WHERE hi-lo>=60000000)"""
SILENT = f"""si AS (SELECT *, (end_us-start_us)/1e6 AS gap_s FROM (SELECT platform_id, event_id, t_us AS end_us, lag(t_us) OVER w AS start_us, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0,
   lon AS lon1, lat AS lat1 FROM {LISTEN} WINDOW w AS (PARTITION BY platform_id ORDER BY t_us, event_id)) WHERE (end_us-start_us)/1e6>=3600)"""
SEEN = f"""{GRID}, {BLIND}, {SILENT}, sb AS (SELECT *, coalesce((SELECT sum(greatest(0, least(bl.hi, end_us)-greatest(bl.lo, start_us))) FROM bl), 0)/1e6 AS blind_s FROM si),
  sn AS (SELECT *, gap_s-blind_s AS seen_s FROM sb WHERE gap_s-blind_s>=3600),
  gp AS (SELECT platform_id, event_id, start_us, end_us, gap_s, blind_s, seen_s, count(*) AS n_cells, sum(CASE WHEN reception='heard' THEN g-f ELSE 0 END) AS heard_share,
    seen_s*sum((g-f)*coalesce(CASE WHEN median_gap_s>0 THEN 1e0/median_gap_s END, 0)) AS expected
    FROM {d.pieces('sn', 'platform_id, event_id, start_us, end_us, gap_s, blind_s, seen_s', '5e-2')} p LEFT JOIN gr USING (col, row) GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def gaps(t):
    reports = listen(t)
    return reports, G.coverage_gaps(reports, V.reception_grid(reports), blind(t))


@query("coverage_gaps", f"""WITH {SEEN} SELECT platform_id, event_id, start_us, end_us, round(gap_s, 3) AS gap_s, round(blind_s, 3) AS blind_s, round(seen_s, 3) AS seen_s, n_cells,
    round(heard_share, 6) AS heard_share, round(expected, 6) AS expected, round(exp(-expected), 9) AS p_silence, exp(-expected)<=0.01e0 AS weighted FROM gp""")
def coverage_gaps(t):
    _, got = gaps(t)
    return got.select("platform_id", "event_id", "start_us", "end_us", *[F.round(c, 3).alias(c) for c in ("gap_s", "blind_s", "seen_s")], "n_cells",
                      F.round("heard_share", 6).alias("heard_share"), F.round("expected", 6).alias("expected"), F.round("p_silence", 9).alias("p_silence"), "weighted")


@query("gap_comparison", f"""WITH {SEEN} SELECT (SELECT count(*) FROM si) AS n_naive, (SELECT count(*) FROM si)-count(*) AS n_blind, count(*) FILTER (WHERE exp(-expected)>0.01e0) AS n_unheard,
    count(*) FILTER (WHERE exp(-expected)<=0.01e0) AS n_weighted, round((SELECT coalesce(sum(gap_s), 0) FROM si), 3) AS naive_s, round(coalesce(sum(seen_s), 0), 3) AS seen_s FROM gp""")
def gap_comparison(t):
    reports, got = gaps(t)
    return G.gap_comparison(reports, got).withColumn("naive_s", F.round("naive_s", 3)).withColumn("seen_s", F.round("seen_s", 3))


CUBE = f"""cu AS (SELECT lv AS level, x>>lv AS x, y>>lv AS y, t>>lv AS t, count(*) AS n FROM (SELECT {d.cell('lon+180e0', '5e-2')} AS x, {d.cell('lat+90e0', '5e-2')} AS y, t_us//3600000000 AS t FROM e),
   range(6) r(lv) GROUP BY ALL)"""
KEY = "+".join(f"((({a}>>{b})&1)<<{3 * b + 2 - i})" for b in range(16) for i, a in enumerate("xyt"))


@query("event_cube", f"WITH {CUBE} SELECT CAST(level AS INTEGER) AS level, {KEY} AS key, x, y, t, n FROM cu")
def event_cube(t):
    return Q.event_cube(t.e)


@query("cube_sensitivity", f"""WITH {CUBE}, st AS (SELECT level, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS max_n, avg(n) AS mean_n,
      greatest(0, sum(n*CAST(n AS DOUBLE))/count(*)-(sum(n)/count(*))*(sum(n)/count(*))) AS va FROM cu GROUP BY 1),
    fl AS (SELECT cu.*, n>mean_n+2*sqrt(va) AS hot FROM cu JOIN st USING (level)), fi AS (SELECT x, y, t, n, hot FROM fl WHERE level=0),
    bo AS (SELECT fl.level, sum(fi.n) FILTER (WHERE fi.hot) AS f, sum(fi.n) FILTER (WHERE fl.hot) AS h, sum(fi.n) FILTER (WHERE fi.hot AND fl.hot) AS b
      FROM fi, range(6) r(lv) JOIN fl ON fl.level=lv AND fl.x=fi.x>>lv AND fl.y=fi.y>>lv AND fl.t=fi.t>>lv GROUP BY 1)
    SELECT CAST(level AS INTEGER) AS level, n_cells, n_events, max_n, round(mean_n, 6) AS mean_n, round(va/mean_n, 6) AS dispersion, (SELECT count(*) FROM fl WHERE hot AND fl.level=st.level) AS n_hot,
      round(coalesce(b, 0)/f, 6) AS kept_share, round((h-coalesce(b, 0))/h, 6) AS diluted_share FROM st JOIN bo USING (level)""")
def cube_sensitivity(t):
    got = Q.cube_sensitivity(Q.event_cube(t.e))
    return got.select("level", "n_cells", "n_events", "max_n", F.round("mean_n", 6).alias("mean_n"), F.round("dispersion", 6).alias("dispersion"), "n_hot",
                      F.round("kept_share", 6).alias("kept_share"), F.round("diluted_share", 6).alias("diluted_share"))


EXPOSED = f"""{GRID}, tk AS (SELECT * FROM (SELECT platform_id, (t_us-lag(t_us) OVER w)/1e6 AS dt_s, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lon AS lon1, lat AS lat1
    FROM {LISTEN} WINDOW w AS (PARTITION BY platform_id ORDER BY t_us, event_id)) WHERE dt_s>0 AND dt_s<=3600),
  ex AS (SELECT col, row, h AS hours, np AS n_platforms, h*coalesce(1e0-p_long, 0) AS seen_hours FROM (
    SELECT col, row, sum((g-f)*dt_s/3600e0) AS h, count(DISTINCT platform_id) AS np FROM {d.pieces('tk', 'platform_id, dt_s', '5e-2')} GROUP BY 1, 2) LEFT JOIN gr USING (col, row))"""


@query("traffic_exposure", f"WITH {EXPOSED} SELECT col, row, round(hours, 6) AS hours, n_platforms, round(seen_hours, 6) AS seen_hours FROM ex")
def traffic_exposure(t):
    return exposed(t).withColumn("hours", F.round("hours", 6)).withColumn("seen_hours", F.round("seen_hours", 6))


def exposed(t):
    reports = listen(t)
    return R.traffic_exposure(reports, V.reception_grid(reports))


RATES = f"""{EXPOSED}, ct AS (SELECT {d.cell('lon', '5e-2')} AS col, {d.cell('lat', '5e-2')} AS row, count(*) AS n FROM observations GROUP BY 1, 2),
  ce AS (SELECT col, row, coalesce(hours, 0) AS hours, coalesce(seen_hours, 0) AS seen_hours, coalesce(n, 0) AS n_events FROM ex FULL JOIN ct USING (col, row)),
  ra AS (SELECT *, CASE WHEN seen_hours>0 THEN n_events/seen_hours END AS rate FROM ce),
  pr AS (SELECT o/e AS m, greatest(0, q/e-(o/e)*(o/e)-(o/e)/(e/k)) AS v FROM (SELECT sum(n_events) AS o, sum(seen_hours) AS e, count(*) AS k, sum(seen_hours*rate*rate) AS q FROM ra WHERE rate IS NOT NULL)),
  rt AS (SELECT *, CASE WHEN rate IS NOT NULL THEN m+CASE WHEN v>0 THEN v/(v+m/seen_hours) ELSE 0 END*(rate-m) END AS shrunken FROM ra, pr)"""


@query("event_rates", f"""WITH {RATES} SELECT col, row, round(hours, 6) AS hours, round(seen_hours, 6) AS seen_hours, n_events, round(rate, 6) AS rate, round(shrunken, 6) AS shrunken,
    round(shrunken/nullif(m, 0), 6) AS relative, CASE WHEN rate IS NULL THEN CASE WHEN hours<=0 THEN 'no traffic' WHEN seen_hours<=0 THEN 'traffic never well heard' END END AS reason FROM rt""")
def event_rates(t):
    got = R.event_rates(t.observations, exposed(t))
    return got.select("col", "row", *[F.round(c, 6).alias(c) for c in ("hours", "seen_hours")], "n_events", *[F.round(c, 6).alias(c) for c in ("rate", "shrunken", "relative")], "reason")


STAR = f"""cs AS (SELECT {d.cell('lon', '5e-2')} AS col, {d.cell('lat', '5e-2')} AS row, CAST(count(*) AS DOUBLE) AS x FROM e GROUP BY 1, 2),
  ms AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, sqrt(greatest(0, avg(x*x)-avg(x)*avg(x))) AS s FROM cs),
  nr AS (SELECT a.col, a.row, a.x, sum(b.x) AS near, count(*) AS weight FROM cs a JOIN cs b ON b.col BETWEEN a.col-2 AND a.col+2 AND b.row BETWEEN a.row-2 AND a.row+2 GROUP BY ALL),
  zz AS (SELECT *, CASE WHEN s*sqrt((n*weight-weight*weight)/(n-1))>1e-12 THEN round((near-m*weight)/(s*sqrt((n*weight-weight*weight)/(n-1))), 9) END AS z FROM nr, ms),
  zp AS (SELECT *, {d.tail('z')} AS p FROM zz),
  li AS (SELECT max(p) AS lim FROM (SELECT p, count(*) OVER (ORDER BY p) AS u, count(*) OVER () AS k FROM zp WHERE p IS NOT NULL) WHERE p<=0.05e0*u/k)"""


@query("gi_star", f"WITH {STAR} SELECT col, row, x, weight, round(z, 6) AS z, round(p, 6) AS p, coalesce(p<=lim, false) AS significant FROM zp, li")
def gi_star(t):
    cells = t.e.groupBy(F.expr("cast(floor(round(lon / 5e-2D, 9)) as bigint)").alias("col"), F.expr("cast(floor(round(lat / 5e-2D, 9)) as bigint)").alias("row")).agg(F.count(F.lit(1)).alias("x"))
    return H.gi_star(cells, "x", radius=2).withColumn("z", F.round("z", 6)).withColumn("p", F.round("p", 6))


EMERGE = f"""oc AS (SELECT {d.cell('lon', '1e-1')} AS col, {d.cell('lat', '1e-1')} AS row, t_us//21600000000 AS t, count(*) AS n FROM e GROUP BY ALL),
  dn AS MATERIALIZED (SELECT c.col, c.row, r.t, CAST(coalesce(n, 0) AS DOUBLE) AS x FROM (SELECT DISTINCT col, row FROM oc) c, (SELECT unnest(range(min(t), max(t)+1)) AS t FROM oc) r
     LEFT JOIN oc ON oc.col=c.col AND oc.row=c.row AND oc.t=r.t),
  mm AS (SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT col, row FROM oc)) AS DOUBLE) AS n, avg(x) AS m, sqrt(greatest(0, avg(x*x)-avg(x)*avg(x))) AS s FROM dn),
  nb AS MATERIALIZED (SELECT a.col, a.row, a.t, sum(b.x) AS near, count(*) AS w FROM dn a JOIN dn b ON a.t=b.t AND b.col BETWEEN a.col-1 AND a.col+1 AND b.row BETWEEN a.row-1 AND a.row+1 GROUP BY ALL),
  zt AS (SELECT *, coalesce(CASE WHEN s*sqrt((n*w-w*w)/(n-1))>1e-12 THEN round((near-m*w)/(s*sqrt((n*w-w*w)/(n-1))), 9) END, 0) AS z FROM nb, mm),
  sm AS (SELECT a.col, a.row, CAST(sum(sign(b.near-a.near)) AS BIGINT) AS s FROM nb a JOIN nb b ON a.col=b.col AND a.row=b.row AND a.t<b.t GROUP BY ALL),
  ti AS (SELECT col, row, sum(k*(k-1)*(2*k+5)) AS tie, sum(k) AS n FROM (SELECT col, row, near, count(*) AS k FROM nb GROUP BY ALL) GROUP BY ALL),
  hs AS (SELECT col, row, count(*) AS n, count(*) FILTER (WHERE z>=1.96e0) AS n_hot, arg_max(z, t) AS last_z, max(t) FILTER (WHERE z<1.96e0) AS cold, max(t) AS t1, min(t) FILTER (WHERE z>=1.96e0) AS h0 FROM zt GROUP BY ALL),
  tr AS (SELECT hs.*, coalesce(s, 0) AS s, CASE WHEN coalesce(s, 0)=0 OR n*(n-1)*(2*n+5)-tie<=0 THEN 0e0 ELSE (s-sign(s))/sqrt((hs.n*(hs.n-1)*(2*hs.n+5)-tie)/18e0) END AS tz
     FROM hs LEFT JOIN sm USING (col, row) JOIN (SELECT col, row, tie FROM ti) USING (col, row))"""


@query("emerging_hotspots", f"""WITH {EMERGE} SELECT col, row, n_hot, round(last_z, 6) AS last_z, s, round(tz, 6) AS trend_z,
    CASE WHEN n_hot=0 THEN 'none' WHEN n_hot>=0.9e0*n THEN CASE WHEN last_z<1.96e0 THEN 'historical' WHEN tz>=1.96e0 THEN 'intensifying' WHEN tz<=-1.96e0 THEN 'diminishing' ELSE 'persistent' END
      WHEN last_z>=1.96e0 AND h0>coalesce(cold, -1) THEN CASE WHEN h0=t1 THEN 'new' ELSE 'consecutive' END WHEN last_z>=1.96e0 THEN 'sporadic' ELSE 'cooled' END AS category FROM tr""")
def emerging_hotspots(t):
    cells = t.e.groupBy(F.expr("cast(floor(round(lon / 1e-1D, 9)) as bigint)").alias("col"), F.expr("cast(floor(round(lat / 1e-1D, 9)) as bigint)").alias("row"),
                        F.expr("t_us div 21600000000").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return H.emerging(cells).withColumn("last_z", F.round("last_z", 6)).withColumn("trend_z", F.round("trend_z", 6))

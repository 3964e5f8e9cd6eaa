"""The review queue and the comparison of domains."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.catalog.coverage_q import GRID, listen
from plotgap.catalog.spacetime_q import SILENT
from plotgap.operators import coverage as V
from plotgap.operators import crossdomain as X
from plotgap.operators import gaps as G
from plotgap.operators import ranking as R

REACH_M, WINDOW_S = 5000.0, 7200.0


def scored(t):
    reports = listen(t)
    return R.signals(t.candidates, t.segments, G.silences(reports), V.reception_grid(reports), REACH_M, WINDOW_S)


SIGNALS = f"""{GRID}, {SILENT}, nd AS (SELECT obs_id, min({d.seg('lon', 'lat', 'x0', 'y0', 'x1', 'y1')}) AS d_m FROM candidates, segments GROUP BY 1),
 go AS (SELECT obs_id, max(start_us) AS gone_us FROM candidates c JOIN si ON start_us<=t_scene_us AND start_us>t_scene_us-7200000000 AND {d.hav('c.lat', 'c.lon', 'si.lat0', 'si.lon0')}<={REACH_M}e0 GROUP BY 1),
 sn AS (SELECT obs_id, least(1e0, pixels/40e0) AS size, confidence AS clean, exp(-d_m/20000e0) AS place, coalesce(1e0-(t_scene_us-gone_us)/7200e6, 0) AS company, 1e0-p_long AS coverage
   FROM candidates c LEFT JOIN nd USING (obs_id) LEFT JOIN go USING (obs_id) LEFT JOIN gr ON gr.col={d.cell('c.lon', '5e-2')} AND gr.row={d.cell('c.lat', '5e-2')})"""
KNOWN = "+".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}e0 END" for c, w in R.WEIGHTS.items())
TOTAL = "+".join(f"coalesce({c}*{w}e0, 0)" for c, w in R.WEIGHTS.items())
QUEUE = f"""{SIGNALS}, lv AS (SELECT *, CAST(floor(round(1000*({TOTAL})/({KNOWN}), 6)) AS INTEGER) AS level FROM sn),
 tb AS (SELECT level, count(*) AS n, count(*) FILTER (WHERE a='vessel') AS k FROM lv JOIN verdicts ON doc_id=obs_id GROUP BY 1),
 ps AS (SELECT *, sum(n) OVER (ORDER BY level) AS cn, sum(k) OVER (ORDER BY level) AS ck FROM tb),
 av AS (SELECT a.level AS la, b.level AS lb, (b.ck-a.ck+a.k)/CAST(b.cn-a.cn+a.n AS DOUBLE) AS m FROM ps a JOIN ps b ON b.level>=a.level),
 fi AS (SELECT lb AS level, max(mn) AS p FROM (SELECT la, lb, min(m) OVER (PARTITION BY la ORDER BY lb DESC) AS mn FROM av) GROUP BY 1)"""


@query("candidate_signals", f"WITH {SIGNALS} SELECT obs_id, {', '.join(f'round({c}, 9) AS {c}' for c in R.WEIGHTS)} FROM sn")
def candidate_signals(t):
    return scored(t).select("obs_id", *[F.round(c, 9).alias(c) for c in R.WEIGHTS])


@query("rank_candidates", f"""WITH {QUEUE} SELECT obs_id, lv.level, round(coalesce(fi.p, (SELECT arg_min(p, level) FROM fi)), 9) AS p, row_number() OVER (ORDER BY lv.level DESC, obs_id) AS place_no
    FROM lv ASOF LEFT JOIN fi ON lv.level>=fi.level""")
def rank_candidates(t):
    reviewed = t.verdicts.select(F.col("doc_id").alias("obs_id"), (F.col("a") == "vessel").alias("y"))
    return R.rank_candidates(scored(t), reviewed).select("obs_id", "level", F.round("p", 9).alias("p"), "place_no")


NEAR_M, FAR_M, TRIALS = 10_000.0, 40_000.0, 400
MOVED = f"""CASE WHEN trial=0 THEN 0e0 ELSE 3000e0+17000e0*{d.u('cross', "'d'", 'trial')} END AS dist, {d.u('cross', "'a'", 'trial')}*6.283185307179586e0 AS ang"""


def _cells(name, rows):
    return f"(SELECT {d.cell('lon', '5e-2')} AS col, {d.cell('lat', '5e-2')} AS row, count(*) AS {name}_n, count(*) FILTER (WHERE hit) AS {name}_x FROM ({rows}) GROUP BY 1, 2)"


def _effect(v):
    return f"sum({v}_x) FILTER (WHERE d_m<={NEAR_M}e0)/sum({v}_n) FILTER (WHERE d_m<={NEAR_M}e0)-sum({v}_x) FILTER (WHERE d_m>{NEAR_M}e0)/sum({v}_n) FILTER (WHERE d_m>{NEAR_M}e0)"


CROSS = f"""pc AS (SELECT * FROM {_cells('sea', 'SELECT lon, lat, false AS hit FROM reports UNION ALL SELECT lon, lat, true FROM observations')} JOIN
   {_cells('air', "SELECT lon, lat, type IN ('mlat', 'mode_s') AS hit FROM aircraft WHERE type IN ('mlat', 'mode_s', 'adsb_icao')")} USING (col, row)),
 mv AS (SELECT *, la-dist*cos(ang)/111195e0 AS lat, lo-dist*sin(ang)/(111195e0*cos(radians(la))) AS lon FROM (SELECT *, (col+0.5e0)*5e-2 AS lo, (row+0.5e0)*5e-2 AS la, {MOVED} FROM pc, range({TRIALS + 1}) r(trial))),
 dm AS (SELECT trial, sea_n, sea_x, air_n, air_x, (SELECT min({d.seg('mv.lon', 'mv.lat', 'x0', 'y0', 'x1', 'y1')}) FROM segments WHERE line_set='L12') AS d_m FROM mv),
 ef AS (SELECT trial, {_effect('sea')} AS es, {_effect('air')} AS ea FROM dm WHERE d_m<={FAR_M}e0 GROUP BY 1),
 nu AS (SELECT count(*) AS n, corr(es, ea) AS r, avg(es) AS ms, stddev_samp(es) AS ss, avg(ea) AS ma, stddev_samp(ea) AS sa FROM ef WHERE trial>0 AND es IS NOT NULL AND ea IS NOT NULL),
 zs AS (SELECT *, round((zs+za)/sqrt(2+2*r), 9) AS zj FROM (SELECT *, round((es-ms)/ss, 9) AS zs, round((ea-ma)/sa, 9) AS za FROM ef, nu)),
 ob AS (SELECT * FROM zs WHERE trial=0), be AS (SELECT {', '.join(f'count(*) FILTER (WHERE abs(z.{k})>=abs(ob.{k})) AS k{k}' for k in ('zs', 'za', 'zj'))} FROM zs z, ob WHERE z.trial>0 AND z.zj IS NOT NULL),
 wt AS (SELECT *, 1/(ss*ss) AS ws, 1/(sa*sa) AS wa, es-ms AS ds, ea-ma AS da FROM ob, be),
 qq AS (SELECT *, ws*pow(ds-(ws*ds+wa*da)/(ws+wa), 2)+wa*pow(da-(ws*ds+wa*da)/(ws+wa), 2) AS q FROM wt),
 tt AS (SELECT *, greatest(0e0, (q-1)/(ws+wa-(ws*ws+wa*wa)/(ws+wa))) AS tau2 FROM qq),
 fw AS (SELECT *, 1/(ss*ss+tau2) AS vs, 1/(sa*sa+tau2) AS va FROM tt)"""
OUT = ["effect_sea", "z_sea", "p_sea", "effect_air", "z_air", "p_air", "trial_r", "z_joint", "p_joint", "q", "tau2", "pooled", "pooled_se"]
SAID = ["es", "zs", "(kzs+1)/(n+1)", "ea", "za", "(kza+1)/(n+1)", "r", "zj", "(kzj+1)/(n+1)", "q", "tau2", "(vs*ds+va*da)/(vs+va)", "1/sqrt(vs+va)"]


@query("cross_domain", f"WITH {CROSS} SELECT (SELECT count(*) FROM pc) AS n_cells, n AS n_trials, {', '.join(f'round({v}, 6) AS {k}' for k, v in zip(OUT, SAID))} FROM fw")
def cross_domain(t):
    sea = t.reports.select("lon", "lat", F.lit(False).alias("hit")).unionByName(t.observations.select("lon", "lat", F.lit(True).alias("hit")))
    independent = F.col("type").isin("mlat", "mode_s")
    air = t.aircraft.where(independent | (F.col("type") == "adsb_icao")).select("lon", "lat", independent.alias("hit"))
    got = X.cross_domain(sea, air, t.segments.where("line_set = 'L12'").drop("line_set", "j"), NEAR_M, FAR_M, TRIALS)
    return got.select("n_cells", "n_trials", *[F.round(c, 6).alias(c) for c in OUT])

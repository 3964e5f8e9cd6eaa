"""Raster detection over a pixel table."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.operators import raster as R
from plotgap.operators.coverage import land_grid_vote

G, B = 7, 21


def _box(h):
    return f"(SELECT a.scene, a.row, a.col, sum(b.dn) AS s, sum(b.dn*b.dn) AS q, count(*) AS n FROM pixels a JOIN pixels b ON a.scene=b.scene AND b.row BETWEEN a.row-{h} AND a.row+{h} AND b.col BETWEEN a.col-{h} AND a.col+{h} GROUP BY 1, 2, 3)"


ST = f"""bx AS {_box(B // 2)}, gx AS {_box(G // 2)}, st AS (SELECT p.*, mu, sqrt(greatest(q/n-mu*mu, 0)) AS sigma FROM (SELECT scene, row, col, greatest(bx.n-gx.n, 1) AS n, bx.q-gx.q AS q, (bx.s-gx.s)/greatest(bx.n-gx.n, 1) AS mu FROM bx JOIN gx USING (scene, row, col)) x JOIN pixels p USING (scene, row, col))"""
HT = f"{ST}, ht AS (SELECT * FROM st WHERE dn>mu+4*sigma AND valid)"


def stats(t):
    return R.clutter_ring_stats(t.pixels, G, B)


def hot(t):
    return R.cfar_threshold(stats(t), k=4.0)


@query("clutter_ring_stats", f"WITH {ST} SELECT scene, row, col, round(mu, 6) AS mu, round(sigma, 4) AS sigma FROM st")
def clutter_ring_stats(t):
    return stats(t).select("scene", "row", "col", F.round("mu", 6).alias("mu"), F.round("sigma", 4).alias("sigma"))


@query("cfar_threshold", f"WITH {HT} SELECT scene, row, col, dn FROM ht WHERE scene IN (SELECT scene FROM st GROUP BY 1 HAVING avg(CASE WHEN dn>mu+4*sigma AND valid THEN 1 ELSE 0 END)<=0.02)")
def cfar_threshold(t):
    return hot(t)[0].select("scene", "row", "col", "dn")


@query("cfar_scene_guard", f"WITH {HT} SELECT scene, round(h, 9) AS hot_share, h>0.02 AS refused FROM (SELECT scene, avg(CASE WHEN dn>mu+4*sigma AND valid THEN 1 ELSE 0 END) AS h FROM st GROUP BY 1)")
def cfar_scene_guard(t):
    return hot(t)[1].withColumn("hot_share", F.round("hot_share", 9))


# the bright targets are 2 x 2 squares on a 16-pixel lattice, so their lattice square names them
CL = f"{HT}, cl AS (SELECT *, min(scene*1099511627776+row*1048576+col) OVER (PARTITION BY scene, row//16, col//16) AS label FROM ht)"


@query("cluster_pixels", f"WITH {CL} SELECT scene, row, col, label FROM cl")
def cluster_pixels(t):
    return R.cluster_pixels(hot(t)[0]).select("scene", "row", "col", "label")


def detections(t):
    return R.cluster_measures(R.cluster_pixels(hot(t)[0]))


CMEAS = f"""{CL}, cm AS (SELECT *, (peak-background)/greatest(sigma, 1e-6) AS snr, sqrt(pixels)*10 AS length_m FROM (SELECT scene, label, count(*) AS pixels, sum(row*dn)/sum(dn) AS row, sum(col*dn)/sum(dn) AS col, max(dn) AS peak, avg(dn) AS mean, avg(mu) AS background, avg(sigma) AS sigma
   FROM cl GROUP BY 1, 2) WHERE pixels BETWEEN 2 AND 5000)"""


@query("cluster_measures", f"WITH {CMEAS} SELECT scene, label, pixels, round(row, 6) AS row, round(col, 6) AS col, peak, round(mean, 6) AS mean, round(background, 4) AS background, round(sigma, 3) AS sigma, round(snr, 3) AS snr, round(length_m, 6) AS length_m FROM cm")
def cluster_measures(t):
    x = detections(t)
    return x.withColumns({"row": F.round("row", 6), "col": F.round("col", 6), "mean": F.round("mean", 6), "background": F.round("background", 4), "sigma": F.round("sigma", 3),
                          "snr": F.round("snr", 3), "length_m": F.round("length_m", 6)})


@query("clutter_verdict", """SELECT scene, n, round(headroom, 6) AS headroom, round(at_floor, 9) AS at_floor, CASE WHEN headroom<2.5 AND at_floor>0.4 THEN 'clutter' WHEN headroom<5 THEN 'marginal' ELSE 'vessels present' END AS verdict FROM (
    SELECT scene, count(*) AS n, max(snr)/6 AS headroom, avg(CASE WHEN pixels=fl THEN 1 ELSE 0 END) AS at_floor FROM (SELECT *, min(pixels) OVER (PARTITION BY scene) AS fl FROM observations) GROUP BY 1)""")
def clutter_verdict(t):
    return R.clutter_verdict(t.observations).withColumns({"headroom": F.round("headroom", 6), "at_floor": F.round("at_floor", 9)})


OT = """oh AS (SELECT scene, lo, hi, coalesce(least(511, CAST(floor((v-lo)/nullif((hi-lo)/512, 0)) AS INTEGER)), 0) AS bin, count(*) AS n FROM (SELECT scene, ln(1+dn) AS v, min(ln(1+dn)) OVER (PARTITION BY scene) AS lo, max(ln(1+dn)) OVER (PARTITION BY scene) AS hi FROM pixels WHERE dn>0) GROUP BY 1, 2, 3, 4),
 oc AS (SELECT *, lo+(bin+0.5e0)*(hi-lo)/512 AS c, sum(n) OVER (PARTITION BY scene) AS tot FROM oh),
 ow AS (SELECT *, sum(n) OVER w/tot AS w, sum(n*c) OVER w/tot AS m, sum(n*c) OVER (PARTITION BY scene)/tot AS ma FROM oc WINDOW w AS (PARTITION BY scene ORDER BY bin)),
 ot AS (SELECT scene, c AS threshold, bt FROM (SELECT *, CASE WHEN w*(1-w)>0 THEN pow(ma*w-m, 2)/(w*(1-w)) ELSE 0 END AS bt FROM ow) QUALIFY row_number() OVER (PARTITION BY scene ORDER BY round(bt, 9) DESC, bin)=1)"""


@query("otsu_threshold", f"WITH {OT} SELECT scene, round(bt, 6) AS between_var FROM ot")
def otsu_threshold(t):
    return R.otsu_threshold(t.pixels.where("dn > 0"), F.log1p("dn")).select("scene", F.round("between", 6).alias("between_var"))


WM = f"""{OT}, lt AS (SELECT p.*, ln(1+dn)<=threshold AS sea FROM pixels p JOIN ot USING (scene) WHERE dn>0), ln AS (SELECT scene, row, col FROM lt WHERE NOT sea),
 sc AS (SELECT scene, avg(dn) FILTER (WHERE NOT sea)/avg(dn) FILTER (WHERE sea) AS contrast FROM lt GROUP BY 1),
 mk AS (SELECT scene, row, col, sea AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.scene=lt.scene AND ln.row BETWEEN lt.row-2 AND lt.row+2 AND ln.col BETWEEN lt.col-2 AND lt.col+2) AS water FROM lt)"""


@query("water_mask", f"WITH {WM} SELECT scene, row, col, water FROM mk WHERE scene IN (SELECT scene FROM sc WHERE contrast>=1.8)")
def water_mask(t):
    return R.water_mask(t.pixels, 2, release=False)[0].select("scene", "row", "col", "water")


@query("release_isolated", "SELECT scene, row, col FROM (SELECT *, count(*) OVER (PARTITION BY scene, row//16, col//16) AS size FROM pixels WHERE dn>=400) WHERE size<=16")
def release_isolated(t):
    return R.release_isolated(t.pixels.where("dn >= 400").select("scene", "row", "col"))


# lattice lines are every eight pixels from 0 to 64
LL = """(SELECT p.*, a.lon*(1-fr)*(1-fc)+b.lon*(1-fr)*fc+c.lon*fr*(1-fc)+x.lon*fr*fc AS lon, a.lat*(1-fr)*(1-fc)+b.lat*(1-fr)*fc+c.lat*fr*(1-fc)+x.lat*fr*fc AS lat FROM (SELECT *, (row%8)/8e0 AS fr, (col%8)/8e0 AS fc FROM pixels) p
  JOIN lattice a ON a.scene=p.scene AND a.i=p.row//8 AND a.j=p.col//8 JOIN lattice b ON b.scene=p.scene AND b.i=p.row//8 AND b.j=p.col//8+1
  JOIN lattice c ON c.scene=p.scene AND c.i=p.row//8+1 AND c.j=p.col//8 JOIN lattice x ON x.scene=p.scene AND x.i=p.row//8+1 AND x.j=p.col//8+1)"""


@query("pixel_to_lonlat", f"SELECT scene, row, col, round(lon, 8) AS lon, round(lat, 8) AS lat FROM {LL}")
def pixel_to_lonlat(t):
    return R.pixel_to_lonlat(t.pixels.select("scene", "row", "col"), t.lattice).select("scene", "row", "col", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


def _hold(step):
    k = f"({{v}}%{step}=0 OR {{v}}=8)"
    lo, hi = f"(n.{{v}}//{step})*{step}", f"least((n.{{v}}//{step})*{step}+{step}, 8)"
    def at(v, which):
        return f"CASE WHEN {k.format(v='n.' + v)} THEN n.{v} ELSE {(lo if which == 0 else hi).format(v=v)} END"
    def fr(v):
        return f"CASE WHEN {k.format(v='n.' + v)} THEN 0e0 ELSE (n.{v}-{lo.format(v=v)})/CAST({hi.format(v=v)}-{lo.format(v=v)} AS DOUBLE) END"
    return f"""(SELECT n.scene, n.i, n.j, n.prow, n.pcol, n.lon AS ox, n.lat AS oy, {fr('i')} AS fr, {fr('j')} AS fc, {at('i', 0)} AS i0, {at('i', 1)} AS i1, {at('j', 0)} AS j0, {at('j', 1)} AS j1 FROM lattice n WHERE NOT ({k.format(v='n.i')} AND {k.format(v='n.j')}))"""


def _err(step, name):
    mix = lambda f: f"(a.{f}*(1-fr)*(1-fc)+b.{f}*(1-fr)*fc+c.{f}*fr*(1-fc)+x.{f}*fr*fc)"
    return f"""{name} AS (SELECT n.scene, n.prow, n.pcol, {d.hav('oy', 'ox', mix('lat'), mix('lon'))} AS e FROM {_hold(step)} n JOIN lattice a ON a.scene=n.scene AND a.i=i0 AND a.j=j0 JOIN lattice b ON b.scene=n.scene AND b.i=i0 AND b.j=j1
      JOIN lattice c ON c.scene=n.scene AND c.i=i1 AND c.j=j0 JOIN lattice x ON x.scene=n.scene AND x.i=i1 AND x.j=j1)"""


def _nr(p):
    return f"quantile_cont(e, {p})"


LH = f"""{_err(2, 'e2')}, {_err(4, 'e4')}, lh AS (SELECT scene, rms_m, worst_m, n, median_m, p90_m, CASE WHEN r4/rms_m BETWEEN 2.5 AND 6 THEN r4/rms_m END AS ratio FROM (SELECT scene, sqrt(avg(e*e)) AS rms_m, max(e) AS worst_m, count(*) AS n, {_nr(0.5)} AS median_m, {_nr(0.9)} AS p90_m FROM e2 GROUP BY 1)
  JOIN (SELECT scene, sqrt(avg(e*e)) AS r4 FROM e4 GROUP BY 1) USING (scene))"""


@query("lattice_holdout", f"WITH {LH} SELECT scene, round(rms_m, 3) AS rms_m, round(worst_m, 3) AS worst_m, n, round(median_m, 3) AS median_m, round(p90_m, 3) AS p90_m, round(ratio, 3) AS ratio, round(rms_m/ratio, 3) AS implied_m FROM lh")
def lattice_holdout(t):
    x = R.lattice_holdout(t.lattice)
    return x.withColumns({c: F.round(c, 3) for c in ("rms_m", "worst_m", "median_m", "p90_m", "ratio", "implied_m")})


@query("lattice_spacing", "SELECT scene, axis, count(*) AS n, min(g) AS lo, max(g) AS hi, max(g)-min(g)<=greatest(1, min(g)*0.02) AS even FROM (SELECT scene, axis, v-lag(v) OVER (PARTITION BY scene, axis ORDER BY v) AS g FROM (SELECT DISTINCT scene, 'row' AS axis, prow AS v FROM lattice UNION SELECT DISTINCT scene, 'col', pcol FROM lattice)) GROUP BY 1, 2")
def lattice_spacing(t):
    return R.lattice_spacing(t.lattice)


@query("holdout_ladder", f"WITH {', '.join(_err(s, f'e{s}') for s in (2, 3, 4))} " + " UNION ALL ".join(f"SELECT scene, {s} AS step, count(*) AS n, round(sqrt(avg(e*e)), 3) AS rms_m, round(max(e), 3) AS worst_m FROM e{s} GROUP BY 1" for s in (2, 3, 4)))
def holdout_ladder(t):
    x = R.holdout_ladder(t.lattice, (2, 3, 4))
    return x.select("scene", "step", "n", F.round("rms_m", 3).alias("rms_m"), F.round("worst_m", 3).alias("worst_m"))


@query("local_error", f"""WITH {LH}, pb AS (SELECT *, CASE WHEN row>=64 THEN 64 ELSE (row//8)*8 END AS r0, (col//8)*8 AS c0 FROM pixels)
    SELECT pb.scene, pb.row, pb.col, round(coalesce(max(e2.e)*any_value(coalesce(1/ratio, 1)), any_value(coalesce(rms_m/ratio, rms_m))), 3) AS error_m FROM pb JOIN lh USING (scene) LEFT JOIN e2 ON e2.scene=pb.scene AND e2.prow BETWEEN r0-8 AND r0+16 AND e2.pcol BETWEEN c0-8 AND c0+16 GROUP BY 1, 2, 3""")
def local_error(t):
    return R.local_error(t.pixels.select("scene", "row", "col"), t.lattice).select("scene", "row", "col", F.round("error_m", 3).alias("error_m"))




@query("searched_samples", f"""WITH ll AS {LL}, ss AS (SELECT scene, {d.cell('lon', '5e-3')} AS c, {d.cell('lat', '5e-3')} AS r, count(*) AS n, count(*) FILTER (WHERE valid) AS hit FROM ll WHERE row%4=0 AND col%4=0 AND scene<>1 GROUP BY 1, 2, 3)
    SELECT scene, c AS col, r AS row, n, hit, CAST(greatest(1, least(10, round_even(10*hit/n, 0))) AS INTEGER) AS level FROM ss WHERE hit>0""")
def searched_samples(t):
    refused = t.pixels.where("scene = 1").select("scene").distinct()
    return R.searched_samples(t.pixels, refused, t.lattice, 4, 0.005)


@query("area_drift", "SELECT scene, n AS pixel_km2, m AS lattice_km2, round(abs(m-n)/n, 9) AS drift, abs(m-n)/n>0.15 AS flagged FROM (SELECT scene, CAST(count(*) AS DOUBLE) AS n, 16e0*count(*) FILTER (WHERE row%4=0 AND col%4=0) AS m FROM pixels GROUP BY 1)")
def area_drift(t):
    n = t.pixels.groupBy("scene").agg(F.count(F.lit(1)).cast("double").alias("pixel_km2"))
    m = t.pixels.groupBy("scene").agg((16.0 * F.count_if((F.col("row") % 4 == 0) & (F.col("col") % 4 == 0))).alias("lattice_km2"))
    return R.area_drift(n, m).withColumn("drift", F.round("drift", 9))


@query("shoreline_mask", f"""WITH ll AS {LL}, vt AS (SELECT {d.cell('lon', '1e-2')} AS c, {d.cell('lat', '1e-2')} AS r, count(*) FILTER (WHERE value>=40)>count(*) FILTER (WHERE value<40) AS w FROM (SELECT value, -75e0+(event_id%50)*2.5e-3+(event_id//2000)*0.2e0 AS lon, 37e0-((event_id%2000)//50)*2e-3+(event_id//2000)*0.1e0 AS lat FROM e) GROUP BY 1, 2),
    s AS (SELECT scene, row, col, coalesce(w, false) AS sea FROM ll LEFT JOIN vt ON c={d.cell('lon', '1e-2')} AND r={d.cell('lat', '1e-2')})
    SELECT scene, row, col, sea AND NOT EXISTS (SELECT 1 FROM s l WHERE NOT l.sea AND l.scene=s.scene AND l.row BETWEEN s.row-1 AND s.row+1 AND l.col BETWEEN s.col-1 AND s.col+1) AS water FROM s""")
def shoreline_mask(t):
    ev = F.col("event_id")
    scene = F.expr("event_id div 2000")
    votes = t.e.select((F.lit(-75.0) + (ev % 50) * 2.5e-3 + scene * 0.2).alias("lon"), (F.lit(37.0) - F.expr("event_id % 2000 div 50") * 2e-3 + scene * 0.1).alias("lat"), (F.col("value") >= 40).alias("is_water"))
    cells = R.pixel_to_lonlat(t.pixels.select("scene", "row", "col"), t.lattice)
    return R.shoreline_mask(cells, land_grid_vote(votes, 0.01), 0.01, 1).select("scene", "row", "col", "water")

"""Matching, sites and calibration."""

from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.catalog.tracks_q import BR, DI, FR, _pos
from plotgap.operators import calibration as B
from plotgap.operators import matching as M
from plotgap.operators import persistence as P
from plotgap.plans.reuse import pin

COL, ROW = d.cell("lon", "5e-2"), d.cell("lat", "5e-2")


def fixes(t):
    return M.scene_fixes(t.observations.select("scene", "t_scene_us").distinct(), t.reports)


SEGS = """sc AS (SELECT DISTINCT scene, t_scene_us AS at_us FROM observations),
 nr AS (SELECT s.scene, s.at_us, r.* FROM sc s JOIN reports r ON abs(r.t_us-s.at_us)<=1800000000),
 g0 AS (SELECT scene, at_us, platform_id, arg_max(struct_pack(t:=t_us, lat:=lat, lon:=lon, sp:=speed_mps, hd:=heading_deg), t_us) FILTER (WHERE t_us<at_us) AS a,
   arg_min(struct_pack(t:=t_us, lat:=lat, lon:=lon, sp:=speed_mps, hd:=heading_deg), t_us) FILTER (WHERE t_us>=at_us) AS b, max(length_m) AS len,
   count(*) FILTER (WHERE t_us<at_us) AS na, count(*) FILTER (WHERE t_us>=at_us) AS nb FROM nr GROUP BY 1, 2, 3),
 g1 AS (SELECT scene, at_us, platform_id, 1 AS track_seq, len, na+nb AS n_reports, a, b FROM g0 WHERE a IS NOT NULL AND b IS NOT NULL AND b.t-a.t<=1800000000
   UNION ALL SELECT scene, at_us, platform_id, 1, len, na, a, NULL FROM g0 WHERE a IS NOT NULL AND (b IS NULL OR b.t-a.t>1800000000)
   UNION ALL SELECT scene, at_us, platform_id, 2, len, nb, NULL, b FROM g0 WHERE b IS NOT NULL AND (a IS NULL OR b.t-a.t>1800000000)),
 g2 AS (SELECT *, a.t AS at_a, a.lat AS la, a.lon AS lo, a.sp AS sp, a.hd AS hd, b.t AS at_b, b.lat AS lb, b.lon AS ob FROM g1)"""
FX = f"""{SEGS}, fx AS (SELECT scene, platform_id, track_seq, len AS length_m, n_reports,
  {_pos(d.proj_lat('la', 'lo', BR, f'({DI}*{FR})'), d.proj_lat('la', 'lo', 'hd', '(sp*((at_us-at_a)/1e6))'))} AS lat,
  {_pos(d.proj_lon('la', 'lo', BR, f'({DI}*{FR})'), d.proj_lon('la', 'lo', 'hd', '(sp*((at_us-at_a)/1e6))'))} AS lon,
  {_pos(f'20e0+{DI}*0.5e0*(1-abs(2*{FR}-1))', '20e0+abs(sp*((at_us-at_a)/1e6))*0.1e0')} AS uncertainty_m FROM g2)"""


@query("scene_fixes", f"""WITH {FX} SELECT scene, platform_id, track_seq, length_m, n_reports, round(lat, 6) AS lat, round(lon, 6) AS lon,
    round(uncertainty_m, 3) AS uncertainty_m, coalesce(uncertainty_m<=2000, false) AS has_fix FROM fx""")
def scene_fixes(t):
    return fixes(t).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6), "uncertainty_m": F.round("uncertainty_m", 3)})


PR = f"""{FX}, pr AS (SELECT * FROM (SELECT o.scene, obs_id, platform_id, track_seq, {d.hav('o.lat', 'o.lon', 'fx.lat', 'fx.lon')} AS distance_m,
  3*sqrt(625e0+fx.uncertainty_m*fx.uncertainty_m+pow(coalesce(length_m, 50)/2, 2)) AS radius_m
  FROM observations o JOIN fx ON o.scene=fx.scene WHERE fx.uncertainty_m<=2000) WHERE distance_m<=radius_m)"""


def pairs(t):
    return M.candidate_pairs(t.observations, fixes(t))


@query("candidate_pairs", f"WITH {PR} SELECT scene, obs_id, platform_id, track_seq, round(distance_m, 3) AS distance_m, round(radius_m, 3) AS radius_m FROM pr")
def candidate_pairs(t):
    return pairs(t).withColumn("distance_m", F.round("distance_m", 3)).withColumn("radius_m", F.round("radius_m", 3))


@query("maximum_matching")
def maximum_matching(t):
    return M.maximum_matching(pairs(t))


def association(t):
    f = fixes(t)
    matched = M.maximum_matching(M.candidate_pairs(t.observations, f))
    return f, matched, M.associate(t.observations, f, matched)


@query("associate")
def associate(t):
    return association(t)[2][0]


@query("unmatched_events")
def unmatched_events(t):
    s, lost, _ = association(t)[2]
    return M.unmatched_events(lost, s)


@query("uncontested_remainder", f"""WITH {PR} SELECT o.scene, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.obs_id=o.obs_id)) AS n_without_pair
    FROM observations o GROUP BY 1""")
def uncontested_remainder(t):
    p = pairs(t).select("obs_id").distinct().withColumn("_p", F.lit(1))
    return t.observations.join(p, "obs_id", "left").groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p").isNull()).alias("n_without_pair"))


EDGE_SQL = """ed AS (SELECT scene, unnest([struct_pack(x0:=cx-w, y0:=cy, x1:=cx, y1:=cy+h), struct_pack(x0:=cx, y0:=cy+h, x1:=cx+w, y1:=cy), struct_pack(x0:=cx+w, y0:=cy, x1:=cx, y1:=cy-h), struct_pack(x0:=cx, y0:=cy-h, x1:=cx-w, y1:=cy)]) AS s
  FROM (SELECT scene, (min(lon)+max(lon))/2 AS cx, (min(lat)+max(lat))/2 AS cy, (max(lon)-min(lon))/2+0.2e0 AS w, (max(lat)-min(lat))/2+0.2e0 AS h FROM observations GROUP BY scene))"""


@query("in_footprint", f"""WITH {FX}, {EDGE_SQL} SELECT scene, platform_id, track_seq FROM fx JOIN ed USING (scene) WHERE lat IS NOT NULL GROUP BY scene, platform_id, track_seq
    HAVING sum(CASE WHEN (s.y0>lat)<>(s.y1>lat) AND lon<(s.x1-s.x0)*(lat-s.y0)/nullif(s.y1-s.y0, 0)+s.x0 THEN 1 ELSE 0 END)%2=1""")
def in_footprint(t):
    b = t.observations.groupBy("scene").agg(((F.min("lon") + F.max("lon")) / 2).alias("cx"), ((F.min("lat") + F.max("lat")) / 2).alias("cy"),
                                            ((F.max("lon") - F.min("lon")) / 2 + 0.2).alias("w"), ((F.max("lat") - F.min("lat")) / 2 + 0.2).alias("h"))
    c = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    def corner(k):
        return F.col("cx") + F.lit(float(k[0])) * F.col("w"), F.col("cy") + F.lit(float(k[1])) * F.col("h")
    edges = F.array(*[F.struct(corner(p)[0].alias("x0"), corner(p)[1].alias("y0"), corner(q)[0].alias("x1"), corner(q)[1].alias("y1"))
                      for p, q in zip(c, c[1:] + c[:1])])
    ed = b.select("scene", F.explode(edges).alias("s")).select("scene", "s.*")
    return M.in_footprint(fixes(t), ed).select("scene", "platform_id", "track_seq")


WATER = "CASE WHEN coalesce(level,0)/10e0>=0.5e0 THEN 'searched' WHEN coalesce(level,0)>0 THEN 'marginal' ELSE 'unsearched' END"


@query("split_by_searched", f"""SELECT event_id, {WATER} AS water FROM (SELECT event_id, t_us//86400000000 AS day, {COL} AS col, {ROW} AS row FROM
    (SELECT event_id, t_us, lat+0.01e0*(event_id%9) AS lat, lon FROM reports)) r LEFT JOIN searched s USING (day, col, row)""")
def split_by_searched(t):
    r = t.reports.withColumn("day", F.expr("t_us div 86400000000")).withColumn("lat", F.col("lat") + 0.01 * (F.col("event_id") % 9))
    return M.split_by_searched(r, t.searched, ["day"], 0.05).select("event_id", "water")


@query("detection_gate", "SELECT scene, count(*) AS n FROM observations WHERE snr>=15 AND pixels>=6 GROUP BY 1")
def detection_gate(t):
    return M.detection_gate(t.observations, 15.0, 6).groupBy("scene").agg(F.count(F.lit(1)).alias("n"))


@query("matched_flag_join", """SELECT o.obs_id, CASE WHEN o.day=2 THEN NULL ELSE NOT EXISTS (SELECT 1 FROM candidates c WHERE NOT c.matched AND c.day=o.day
    AND round(c.lon,5)=round(o.lon,5) AND round(c.lat,5)=round(o.lat,5)) END AS matched FROM observations o""")
def matched_flag_join(t):
    scored = t.observations.where("day < 2").select("day")
    return M.matched_flag(t.observations, t.candidates.where("NOT matched"), scored).select("obs_id", "matched")


BUCKET = """CASE WHEN length_m IS NULL OR length_m=50 THEN 'unknown' WHEN length_m<25 THEN '<25 m' WHEN length_m<50 THEN '25-50 m'
  WHEN length_m<100 THEN '50-100 m' WHEN length_m<200 THEN '100-200 m' ELSE '>200 m' END"""


@query("misses_by_length", f"""WITH {PR} SELECT {BUCKET} AS bucket, count(*) AS n FROM fx WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.scene=fx.scene AND pr.platform_id=fx.platform_id
    AND pr.track_seq=fx.track_seq) GROUP BY 1""")
def misses_by_length(t):
    f = fixes(t)
    keys = ["scene", "platform_id", "track_seq"]
    return M.misses_by_length(f.join(M.candidate_pairs(t.observations, f).select(*keys), keys, "left_anti"))


@query("nearest_report", f"""SELECT obs_id, round(distance_m, 3) AS distance_m, platform_id, report_id, dt_s FROM (SELECT o.obs_id, platform_id, event_id AS report_id,
    CAST(abs(t_us-t_scene_us)//1000000 AS BIGINT) AS dt_s, {d.hav('o.lat', 'o.lon', 'r.lat', 'r.lon')} AS distance_m FROM observations o JOIN reports r ON abs(r.t_us-t_scene_us)<=1800000000)
    WHERE distance_m<=10000 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY distance_m, report_id)=1""")
def nearest_report(t):
    return M.nearest_report(t.observations, t.reports, "t_scene_us").withColumn("distance_m", F.round("distance_m", 3))


@query("bright_neighbour", f"""SELECT obs_id, round(distance_m, 3) AS distance_m, o_snr, round(ratio, 6) AS ratio FROM (SELECT a.obs_id, b.obs_id AS o_id, b.snr AS o_snr, b.snr/a.snr AS ratio,
    {d.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m FROM observations a JOIN observations b ON a.scene=b.scene AND a.obs_id<>b.obs_id WHERE b.snr/a.snr>=3)
    WHERE distance_m<=3000 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY distance_m, o_id)=1""")
def bright_neighbour(t):
    n = M.bright_neighbour(t.observations, within_m=3000.0)
    return n.withColumn("distance_m", F.round("distance_m", 3)).withColumn("ratio", F.round("ratio", 6))


def cell_sites(t):
    """Sites stated directly: mean position per (scene group, cell), for queries an oracle can follow."""
    from plotgap.functions.geo import cell_index
    return (t.candidates.groupBy(cell_index("lon", 0.02).alias("c"), cell_index("lat", 0.02).alias("r"))
            .agg(F.min("obs_id").alias("site_id"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n_detections"),
                 F.array_sort(F.collect_set("day")).alias("dates"),
                 F.array_sort(F.collect_set(F.when(F.col("matched"), F.col("day")))).alias("matched_dates"), F.max("snr").alias("max_snr")).drop("c", "r"))


SITES = f"""st AS (SELECT min(obs_id) AS site_id, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n_detections, list_sort(list_distinct(list(day))) AS dates,
  list_sort(list_distinct(coalesce(list(day) FILTER (WHERE matched), []))) AS matched_dates, max(snr) AS max_snr FROM candidates GROUP BY {d.cell('lon', '2e-2')}, {d.cell('lat', '2e-2')}),
 sd AS (SELECT st.*, coalesce((SELECT list_sort(list(day)) FROM searched s WHERE s.level>=5 AND s.col={d.cell('st.lon', '5e-2')} AND s.row={d.cell('st.lat', '5e-2')}), []) AS searched_dates FROM st),
 sv AS (SELECT *, len(dates) AS n_dates, list_min(dates) AS first_seen, list_sort(list_distinct(list_concat(searched_dates, dates))) AS asked, len(matched_dates)>0 AS ever FROM sd),
 sw AS (SELECT *, len(asked) AS n_searched, len(list_filter(asked, lambda x: x>=first_seen)) AS n_since FROM sv),
 sx AS (SELECT *, n_dates>=2 AND n_dates/n_since>=0.5e0 AS fixed, n_since<n_searched AND n_dates/n_searched<0.5e0 AS app FROM sw)"""


@query("nearest_site", f"""WITH {SITES} SELECT obs_id, round(distance_m, 3) AS distance_m, site_id, n_detections FROM (SELECT o.obs_id, st.site_id, st.n_detections,
    {d.hav('o.lat', 'o.lon', 'st.lat', 'st.lon')} AS distance_m FROM observations o, st) WHERE distance_m<=500 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY distance_m, site_id)=1""")
def nearest_site(t):
    got = M.nearest_site(t.observations, cell_sites(t).select("site_id", "lat", "lon", "n_detections"), "obs_id")
    return got.withColumn("distance_m", F.round("distance_m", 3))


@query("frontier_filter", """SELECT scene, first_us, n, CASE WHEN first_us>200000000000 THEN round((first_us-200000000000)/86400e6, 6) END AS days_past, first_us<=200000000000 AS matchable
    FROM (SELECT scene, min(t_scene_us) AS first_us, count(*) AS n FROM observations GROUP BY 1)""")
def frontier_filter(t):
    return M.frontier_filter(t.observations, F.lit(200_000_000_000)).withColumn("days_past", F.round("days_past", 6))


POLLS = "(SELECT 'F' || (user_id%4) AS feed_id, user_id%3 AS round, CASE WHEN user_id%4<2 THEN 'v' || (event_id%400) ELSE 'v' || event_id END AS vehicle_id, CASE WHEN user_id%5=0 THEN NULL ELSE 'L' || (event_id%700) END AS label, lat, lon FROM e)"
FLEET = f"""po AS {POLLS}, pp AS (SELECT * FROM (VALUES ('F0','F1'),('F2','F3'),('F0','F9')) v(a,b)), pa AS (SELECT a, b, round, vehicle_id, label, lat, lon, row_number() OVER () AS i FROM pp JOIN po ON a=feed_id),
  pb AS (SELECT a, b, round, vehicle_id, label, lat, lon FROM pp JOIN po ON b=feed_id), ks AS (SELECT a, b, round FROM pp, (SELECT DISTINCT round FROM po)),
  cn AS (SELECT ks.*, (SELECT count(*) FROM pa x WHERE x.a=ks.a AND x.b=ks.b AND x.round=ks.round) AS n_a, (SELECT count(*) FROM pb x WHERE x.a=ks.a AND x.b=ks.b AND x.round=ks.round) AS n_b,
   (SELECT count(DISTINCT x.vehicle_id) FROM pa x JOIN pb y ON x.a=y.a AND x.b=y.b AND x.round=y.round AND x.vehicle_id=y.vehicle_id WHERE x.a=ks.a AND x.b=ks.b AND x.round=ks.round) AS shared_vehicle_id,
   (SELECT count(DISTINCT x.label) FROM pa x JOIN pb y ON x.a=y.a AND x.b=y.b AND x.round=y.round AND x.label=y.label WHERE x.a=ks.a AND x.b=ks.b AND x.round=ks.round) AS shared_label,
   (SELECT count(DISTINCT x.i) FROM pa x JOIN pb y ON x.a=y.a AND x.b=y.b AND x.round=y.round AND {d.hav('x.lat', 'x.lon', 'y.lat', 'y.lon')}<=200 WHERE x.a=ks.a AND x.b=ks.b AND x.round=ks.round) AS near_within_m FROM ks)"""


def fleet(t):
    u, ev = F.col("user_id"), F.col("event_id")
    polls = t.e.select(
        F.concat(F.lit("F"), (u % 4).cast("string")).alias("feed_id"), (u % 3).alias("round"),
        F.concat(F.lit("v"), F.when(u % 4 < 2, ev % 400).otherwise(ev).cast("string")).alias("vehicle_id"),
        F.when(u % 5 != 0, F.concat(F.lit("L"), (ev % 700).cast("string"))).alias("label"), "lat", "lon")
    pairs_ = t.spark.createDataFrame([("F0", "F1"), ("F2", "F3"), ("F0", "F9")], "a string, b string")
    return M.same_fleet(polls, pairs_)


@query("same_fleet_verdict", f"""WITH {FLEET} SELECT *, CASE WHEN n_a=0 AND n_b=0 THEN 'UNDECIDED: neither feed reports a vehicle right now' WHEN least(n_a,n_b)=0 THEN 'UNDECIDED: only one feed reports vehicles right now'
    WHEN shared_vehicle_id>=0.5*least(n_a,n_b) THEN 'SAME VEHICLES by id' WHEN shared_label>=0.5*least(n_a,n_b) THEN 'SAME VEHICLES by label' WHEN near_within_m>=0.5*least(n_a,n_b) THEN 'SAME VEHICLES by position'
    ELSE 'DIFFERENT vehicles' END AS verdict FROM cn""")
def same_fleet_verdict(t):
    return fleet(t)


@query("same_fleet_overall", f"""WITH {FLEET}, vr AS (SELECT a, b, CASE WHEN least(n_a,n_b)=0 THEN NULL WHEN shared_vehicle_id>=0.5*least(n_a,n_b) THEN 'SAME VEHICLES by id' WHEN shared_label>=0.5*least(n_a,n_b) THEN 'SAME VEHICLES by label'
    WHEN near_within_m>=0.5*least(n_a,n_b) THEN 'SAME VEHICLES by position' ELSE 'DIFFERENT vehicles' END AS verdict FROM cn),
    sd AS (SELECT a, b, list_sort(list_distinct(list(verdict) FILTER (WHERE verdict IS NOT NULL))) AS s FROM vr GROUP BY 1, 2)
    SELECT a, b, CASE WHEN coalesce(len(s), 0)=0 THEN 'UNDECIDED in every round' WHEN len(s)=1 THEN s[1] ELSE 'INCONSISTENT across rounds: ' || array_to_string(s, ', ') END AS overall FROM sd""")
def same_fleet_overall(t):
    return M.overall_verdict(fleet(t))


# ---- sites -------------------------------------------------------------------------------


def sites(t):
    return P.cluster_sites(t.candidates, ["day", "obs_id"])


@query("cluster_sites")
def cluster_sites(t):
    return sites(t).select("site_id", "lat", "lon", "n_detections", F.array_join("dates", ",").alias("dates"), "max_snr")


@query("site_searched_dates", f"WITH {SITES} SELECT site_id, array_to_string(searched_dates, ',') AS searched_dates FROM sd")
def site_searched_dates(t):
    s = P.site_searched_dates(cell_sites(t), t.searched, 0.05)
    return s.select("site_id", F.array_join("searched_dates", ",").alias("searched_dates"))


VTEXT = """CASE WHEN fixed AND ever AND app THEN 'fixed structure (appeared during the year, AIS explained it at least once)' WHEN fixed AND ever THEN 'fixed structure (AIS explained it at least once)'
  WHEN fixed AND app THEN 'fixed structure (appeared during the year)' WHEN fixed THEN 'fixed structure' WHEN ever THEN 'traffic (AIS explained it at least once)' WHEN n_dates>=2 THEN 'repeat, not yet fixed' ELSE 'one pass only' END"""


def judged(t):
    return P.site_verdict(P.site_searched_dates(cell_sites(t), t.searched, 0.05), min_dates=2)


@query("site_verdict", f"WITH {SITES} SELECT site_id, CAST(n_dates AS INTEGER) AS n_dates, CAST(n_searched AS INTEGER) AS n_searched, CAST(n_since AS INTEGER) AS n_since, round(n_dates/n_since, 6) AS hit_fraction, fixed, {VTEXT} AS verdict FROM sx")
def site_verdict(t):
    return judged(t).select("site_id", "n_dates", "n_searched", "n_since", F.round("hit_fraction", 6).alias("hit_fraction"), "fixed", "verdict")


@query("candidates_without_furniture", f"""WITH {SITES}, nr AS (SELECT c.obs_id, arg_min(fixed, dm) AS fx FROM (SELECT c.obs_id, sx.fixed, {d.hav('c.lat', 'c.lon', 'sx.lat', 'sx.lon')} AS dm FROM candidates c, sx WHERE NOT c.matched) c
    WHERE dm<=300 GROUP BY 1) SELECT obs_id FROM candidates WHERE NOT matched AND obs_id NOT IN (SELECT obs_id FROM nr WHERE fx)""")
def candidates_without_furniture(t):
    return P.candidates_without_furniture(t.candidates.where("NOT matched"), judged(t))[0].select("obs_id")


@query("sites_listing", f"WITH {SITES} SELECT site_id, fixed FROM sx WHERE n_dates>=2")
def sites_listing(t):
    return P.sites_listing(judged(t), fixed_only=False).select("site_id", "fixed")


@query("layer_summary", f"""WITH {SITES} SELECT count(*) AS n_candidates, count(*) FILTER (WHERE reception='heard') AS n_heard, count(*) FILTER (WHERE reception='intermittent') AS n_intermittent,
    count(*) FILTER (WHERE reception='thin') AS n_thin, count(DISTINCT day) AS n_dates, max(day) AS as_of, (SELECT count(*) FROM sx) AS n_sites, (SELECT count(*) FROM sx WHERE fixed) AS n_fixed,
    15e0 AS min_snr, 6 AS min_pixels FROM candidates""")
def layer_summary(t):
    return P.layer_summary(t.candidates, judged(t), 15.0, 6)


@query("candidates_query", """SELECT obs_id, lat, lon, day, reception, (SELECT count(*) FROM candidates) AS n_total, (SELECT max(day) FROM candidates) AS as_of FROM candidates
    WHERE lon BETWEEN -75.5e0 AND -73.5e0 AND lat BETWEEN 36.8e0 AND 38.2e0 AND reception IN ('heard', 'thin') AND day=1 ORDER BY obs_id LIMIT 5000""")
def candidates_query(t):
    q = P.candidates_query(t.candidates, (-75.5, 36.8, -73.5, 38.2), ["heard", "thin"], day=1)
    return q.select("obs_id", "lat", "lon", "day", "reception", "n_total", "as_of")


# ---- calibration -------------------------------------------------------------------------


def area(t):
    return t.observations.select("scene").distinct().withColumn("km2", F.lit(60000.0) + F.col("scene") * 10.0)


def sole_pairs(t, f):
    """Pairs exclusive on both sides: the part of the matching an oracle can follow."""
    p = pin(M.candidate_pairs(t.observations, f))
    o = p.groupBy("obs_id").agg(F.count(F.lit(1)).alias("no"))
    k = p.groupBy("scene", "platform_id", "track_seq").agg(F.count(F.lit(1)).alias("nk"))
    return p.join(o, "obs_id").join(k, ["scene", "platform_id", "track_seq"]).where("no = 1 AND nk = 1")


CAL = f"""{PR}, so AS (SELECT * FROM pr QUALIFY count(*) OVER (PARTITION BY obs_id)=1 AND count(*) OVER (PARTITION BY scene, platform_id, track_seq)=1),
  ch AS (SELECT fx.*, 1-exp(-((SELECT count(*) FROM observations o WHERE o.scene=fx.scene)/(60000e0+fx.scene*10e0))*pi()*pow(3*sqrt(625e0+uncertainty_m*uncertainty_m+pow(coalesce(length_m, 50)/2, 2))/1000, 2)) AS chance,
    CASE WHEN EXISTS (SELECT 1 FROM so WHERE so.scene=fx.scene AND so.platform_id=fx.platform_id AND so.track_seq=fx.track_seq) THEN 1 ELSE 0 END AS hit FROM fx WHERE uncertainty_m<=2000),
  it AS (SELECT scene, hit, chance, unnest(CASE WHEN chance>0.05e0 THEN ['unscorable|unscorable'] ELSE ['strata|all scored', 'strata|' || CASE WHEN length_m IS NULL THEN 'unknown length' WHEN length_m<25 THEN '<25 m' ELSE '>=25 m' END,
    'curve|' || CASE WHEN length_m IS NULL THEN 'unknown' WHEN length_m<15 THEN '0-15 m' WHEN length_m<25 THEN '15-25 m' WHEN length_m<50 THEN '25-50 m' WHEN length_m<100 THEN '50-100 m' ELSE '>100 m' END] END) AS ks FROM ch),
  ca AS (SELECT scene, split_part(ks, '|', 1) AS kind, split_part(ks, '|', 2) AS stratum, CAST(sum(hit) AS BIGINT) AS found, count(*) AS scored, round(sum(chance), 6) AS chance FROM it GROUP BY 1, 2, 3)"""


def calibration(t):
    f = pin(fixes(t))
    return B.calibrate(f, sole_pairs(t, f), t.observations, area(t))


@query("calibrate", f"WITH {CAL} SELECT * FROM ca")
def calibrate(t):
    return calibration(t).withColumn("chance", F.round("chance", 6))


@query("pool_calibration", f"""WITH {CAL}, po AS (SELECT kind, stratum, CAST(sum(found) AS BIGINT) AS found, CAST(sum(scored) AS BIGINT) AS scored FROM ca GROUP BY 1, 2)
    SELECT *, round(found/scored, 9) AS rate, round({d.wilson('found', 'scored', 'lo')}, 9) AS lo, round({d.wilson('found', 'scored', 'hi')}, 9) AS hi FROM po""")
def pool_calibration(t):
    return B.pool_calibration(calibration(t)).withColumns({c: F.round(c, 9) for c in ("rate", "lo", "hi")})


@query("gate_counts", f"""SELECT CAST(s AS DOUBLE) AS min_snr, CAST(p AS INTEGER) AS min_pixels, (SELECT count(*) FROM observations WHERE snr>=s AND pixels>=p) AS n_kept
    FROM (SELECT unnest({C.SNR_GATES}) AS s), (SELECT unnest({C.PIXEL_GATES}) AS p)""")
def gate_counts(t):
    return B.gate_counts(t.observations)


@query("gate_grid_search")
def gate_grid_search(t):
    f = pin(fixes(t))
    return B.gate_grid_search(t.observations, f, M.candidate_pairs(t.observations, f), area(t))


@query("choose_gate")
def choose_gate(t):
    f = pin(fixes(t))
    return B.choose_gate(B.gate_grid_search(t.observations, f, M.candidate_pairs(t.observations, f), area(t)), 0.9)


VERD = "CASE WHEN obs_id%5=4 THEN 'ambiguous' WHEN pixels+(obs_id%13)>=22 THEN 'vessel' WHEN obs_id%2=0 THEN 'fixed' ELSE 'clutter' END"
BINX = "CASE WHEN pixels>=6 AND pixels<8 THEN 0 WHEN pixels>=8 AND pixels<12 THEN 1 WHEN pixels>=12 AND pixels<20 THEN 2 WHEN pixels>=20 AND pixels<35 THEN 3 WHEN pixels>=35 AND pixels<70 THEN 4 ELSE 5 END"
LAB = f"""lb AS (SELECT obs_id AS key, pixels, {BINX} AS bin, {VERD} AS verdict, CASE obs_id%3 WHEN 0 THEN '<=2nm' WHEN 1 THEN '2-10nm' ELSE '>10nm' END AS band FROM candidates),
  rt AS (SELECT bin, count(*) AS labelled, count(*) FILTER (WHERE verdict='vessel') AS vessel FROM lb WHERE verdict<>'ambiguous' GROUP BY 1)"""


def labelled(t):
    k = F.col("obs_id")
    v = (F.when(k % 5 == 4, "ambiguous").when(F.col("pixels") + k % 13 >= 22, "vessel").when(k % 2 == 0, "fixed").otherwise("clutter"))
    return t.candidates.select(k.alias("key"), "pixels", v.alias("verdict"),
                               F.when(k % 3 == 0, "<=2nm").when(k % 3 == 1, "2-10nm").otherwise(">10nm").alias("band"))


@query("size_rates", f"WITH {LAB} SELECT bin, labelled, vessel, round(vessel/labelled, 9) AS rate, round({d.wilson('vessel', 'labelled', 'lo')}, 9) AS lo, round({d.wilson('vessel', 'labelled', 'hi')}, 9) AS hi FROM rt")
def size_rates(t):
    return B.size_rates(labelled(t)).withColumns({c: F.round(c, 9) for c in ("rate", "lo", "hi")})


@query("gate_cost", f"""WITH {LAB}, x AS (SELECT gate, lb.*, vessel/labelled AS r FROM lb JOIN rt USING (bin), (SELECT unnest({[0, *C.SIZE_GATES]}) AS gate)),
    g AS (SELECT gate, CAST(count(*) FILTER (WHERE pixels>=gate) AS BIGINT) AS kept, coalesce(sum(r) FILTER (WHERE pixels>=gate), 0) AS ev, count(*) AS total, sum(r) AS bv FROM x GROUP BY 1),
    b AS (SELECT gate, max(sh)/nullif(min(sh), 0) AS spread FROM (SELECT gate, band, count(*) FILTER (WHERE pixels>=gate)/count(*) AS sh FROM x GROUP BY 1, 2) GROUP BY 1)
    SELECT CAST(gate AS INTEGER) AS gate, kept, total, round(ev, 6) AS est_vessels, round(spread, 6) AS band_spread, round(bv-ev, 6) AS vessels_lost, round((total-bv)-(kept-ev), 6) AS clutter_removed, round(ev/nullif(kept, 0), 6) AS purity
    FROM g JOIN b USING (gate)""")
def gate_cost(t):
    lb = labelled(t)
    g = B.gate_cost(lb, B.size_rates(lb))
    return g.withColumns({c: F.round(c, 6) + 0.0 for c in ("est_vessels", "band_spread", "vessels_lost", "clutter_removed", "purity")})


@query("gate_fit_error", f"""WITH {LAB}, x AS (SELECT split, bin, CASE WHEN verdict='vessel' THEN 1 ELSE 0 END AS y, {d.u('fit', 'split', 'key')}<0.5e0 AS fit FROM lb, range(20) s(split) WHERE verdict<>'ambiguous'),
    f AS (SELECT split, bin, avg(y) AS r FROM x WHERE fit GROUP BY 1, 2), o AS (SELECT split, avg(y) AS r FROM x WHERE fit GROUP BY 1)
    SELECT CAST(split AS INTEGER) AS split, round(p, 6) AS predicted, a AS actual, round(abs(p-a)/a, 6) AS rel_error FROM (SELECT x.split, sum(coalesce(f.r, o.r)) AS p, CAST(sum(y) AS BIGINT) AS a FROM x LEFT JOIN f USING (split, bin) JOIN o ON o.split=x.split WHERE NOT fit GROUP BY 1) WHERE a>0""")
def gate_fit_error(t):
    return B.gate_fit_error(labelled(t), 20, "fit").withColumns({c: F.round(c, 6) for c in ("predicted", "rel_error")})


@query("floor_audit", """SELECT count(*) AS n, count(*) FILTER (WHERE snr>=15 AND pixels>=6) AS kept, count(*) FILTER (WHERE snr<15 AND pixels>=6) AS snr_only, count(*) FILTER (WHERE snr>=15 AND pixels<6) AS pixels_only,
    count(*) FILTER (WHERE snr<15 AND pixels<6) AS both FROM observations""")
def floor_audit(t):
    return B.floor_audit(t.observations, 15.0, 6)


@query("floor_histogram", """SELECT bin, count(*) AS n FROM (SELECT unnest([CASE WHEN pixels<3 THEN '2-3 px' WHEN pixels<4 THEN '3-4 px' WHEN pixels<6 THEN '4-6 px' WHEN pixels<8 THEN '6-8 px' WHEN pixels<12 THEN '8-12 px' ELSE '12+ px' END,
    CASE WHEN snr<8 THEN '6-8 SNR' WHEN snr<10 THEN '8-10 SNR' WHEN snr<12 THEN '10-12 SNR' WHEN snr<15 THEN '12-15 SNR' ELSE '15+ SNR' END]) AS bin FROM observations WHERE snr<15 OR pixels<6) GROUP BY 1""")
def floor_histogram(t):
    return B.floor_histogram(t.observations, 15.0, 6)

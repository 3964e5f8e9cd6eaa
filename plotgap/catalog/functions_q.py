"""Scalar functions and predicates."""

from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.functions import classes as K
from plotgap.functions import geo as G

A, B = ("lat", "lon"), ("37.5e0", "-75.2e0")
REF_LAT, REF_LON = 37.5, -75.2


@query("haversine_m", f"SELECT event_id, round({d.hav(*A, *B)}, 3) AS d_m FROM e")
def haversine_m(t):
    return t.e.select("event_id", F.round(G.haversine_m("lat", "lon", REF_LAT, REF_LON), 3).alias("d_m"))


@query("bearing_deg", f"SELECT event_id, round({d.bearing(*A, *B)}, 6) AS bearing FROM e")
def bearing_deg(t):
    return t.e.select("event_id", F.round(G.bearing_deg("lat", "lon", REF_LAT, REF_LON), 6).alias("bearing"))


@query("project_point", f"""SELECT event_id, round({d.proj_lat('lat', 'lon', '(event_id%360)', '(event_id%5000)')}, 6) AS lat2,
    round({d.proj_lon('lat', 'lon', '(event_id%360)', '(event_id%5000)')}, 6) AS lon2 FROM e""")
def project_point(t):
    p = G.project_point("lat", "lon", F.col("event_id") % 360, F.col("event_id") % 5000)
    return t.e.select("event_id", F.round(p["lat"], 6).alias("lat2"), F.round(p["lon"], 6).alias("lon2"))


@query("equirect_m", f"SELECT event_id, round({d.flat(*A, *B)}, 3) AS d_m FROM e")
def equirect_m(t):
    return t.e.select("event_id", F.round(G.equirect_m("lat", "lon", REF_LAT, REF_LON), 3).alias("d_m"))


@query("segment_distance_m",
       f"SELECT event_id, round({d.seg('lon', 'lat', '-76e0', '37e0', '-74e0', '37.4e0')}, 3) AS d_m FROM e")
def segment_distance_m(t):
    x = G.segment_distance_m("lon", "lat", F.lit(-76.0), F.lit(37.0), F.lit(-74.0), F.lit(37.4))
    return t.e.select("event_id", F.round(x, 3).alias("d_m"))


@query("combined_uncertainty", f"""SELECT event_id, round(sqrt(400e0 + pow(event_id % 50, 2)), 6) AS sigma_m,
    {d.hav(*A, *B)} <= 3 * sqrt(400e0 + pow(event_id % 50, 2)) + 50000 AS agrees FROM e""")
def combined_uncertainty(t):
    s = G.combined_uncertainty(F.lit(20.0), (F.col("event_id") % 50).cast("double"))
    agrees = G.haversine_m("lat", "lon", REF_LAT, REF_LON) <= 3 * s + 50000
    return t.e.select("event_id", F.round(s, 6).alias("sigma_m"), agrees.alias("agrees"))


@query("cell_index", f"""SELECT {d.cell('lon', '5e-2')} AS col, {d.cell('lat', '5e-2')} AS row, count(*) AS n
    FROM e GROUP BY 1, 2""")
def cell_index(t):
    return (t.e.groupBy(G.cell_index("lon", 0.05).alias("col"), G.cell_index("lat", 0.05).alias("row"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("cosine_cell", """SELECT row, CAST(floor(lon*cos(radians((row+0.5e0)*0.00225e0))/0.00225e0) AS BIGINT) AS col,
    count(*) AS n FROM (SELECT *, CAST(floor(lat/0.00225e0) AS BIGINT) AS row FROM e) GROUP BY 1, 2""")
def cosine_cell(t):
    c = G.cosine_cell("lat", "lon", C.ROAD_CELL_DEG)
    return t.e.groupBy(c["row"].alias("row"), c["col"].alias("col")).agg(F.count(F.lit(1)).alias("n"))


@query("cell_area_km2", f"""SELECT day, round(sum({d.area('row', '5e-2')}), 3) AS km2,
    round(sum(0.05e0*111.195e0*0.05e0*111.195e0*cos(radians((row+0.5e0)*0.05e0))*level/10e0), 3) AS searched_km2
    FROM searched GROUP BY day""")
def cell_area_km2(t):
    return t.searched.groupBy("day").agg(
        F.round(F.sum(G.cell_area_km2("row", 0.05)), 3).alias("km2"),
        F.round(F.sum(G.searched_cell_km2("row", "level", 0.05)), 3).alias("searched_km2"))


@query("distance_band", f"SELECT {d.band('dm')} AS band, count(*) AS n FROM (SELECT {d.hav(*A, *B)} AS dm FROM e) GROUP BY 1")
def distance_band(t):
    x = t.e.select(G.haversine_m("lat", "lon", REF_LAT, REF_LON).alias("dm"))
    return x.groupBy(K.distance_band("dm").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("signed_band", f"""SELECT {d.signed('a', 'b', True)} AS outer_band, {d.signed('a', 'b', False)} AS inner_band,
    count(*) AS n FROM (SELECT abs(lat-37.2e0)*111195 AS a, abs(lat-37.4e0)*111195 AS b FROM e) GROUP BY 1, 2""")
def signed_band(t):
    x = t.e.select((F.abs(F.col("lat") - 37.2) * 111195).alias("a"), (F.abs(F.col("lat") - 37.4) * 111195).alias("b"))
    return (x.groupBy(K.signed_band("a", "b", True).alias("outer_band"), K.signed_band("a", "b", False).alias("inner_band"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("altitude_band", """SELECT CASE WHEN on_ground THEN 'on ground' WHEN alt_m IS NULL THEN NULL WHEN alt_m<1000 THEN '0-1 km'
    WHEN alt_m<3000 THEN '1-3 km' WHEN alt_m<6000 THEN '3-6 km' WHEN alt_m<9000 THEN '6-9 km' WHEN alt_m<12000
    THEN '9-12 km' ELSE '12+ km' END AS band, count(*) AS n FROM aircraft GROUP BY 1""")
def altitude_band(t):
    return t.aircraft.groupBy(K.altitude_band("alt_m", "on_ground").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("length_class", """SELECT CASE WHEN length_m IS NULL THEN 'unknown length' WHEN length_m<25 THEN '<25 m' ELSE '>=25 m' END AS length_class,
    CASE WHEN length_m IS NULL THEN 'unknown' WHEN length_m<15 THEN '0-15 m' WHEN length_m<25 THEN '15-25 m'
    WHEN length_m<50 THEN '25-50 m' WHEN length_m<100 THEN '50-100 m' ELSE '>100 m' END AS length_bin,
    CASE WHEN length_m IS NULL OR length_m=50 THEN 'unknown' WHEN length_m<25 THEN '<25 m' WHEN length_m<50 THEN '25-50 m'
    WHEN length_m<100 THEN '50-100 m' WHEN length_m<200 THEN '100-200 m' ELSE '>200 m' END AS miss_bucket,
    count(*) AS n FROM reports GROUP BY 1, 2, 3""")
def length_class(t):
    return (t.reports.groupBy(K.length_class("length_m").alias("length_class"), K.length_bin("length_m").alias("length_bin"),
                              K.miss_bucket("length_m").alias("miss_bucket")).agg(F.count(F.lit(1)).alias("n")))


def _subtype_sql():
    whens = " ".join(f"WHEN code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in C.VESSEL_TYPES)
    return f"CASE WHEN code IS NULL OR code=0 THEN 'unknown' {whens} ELSE 'other' END"


@query("vessel_subtype", f"SELECT {_subtype_sql()} AS subtype, count(*) AS n FROM (SELECT nullif(event_id%100, 99) AS code FROM e) GROUP BY 1")
def vessel_subtype(t):
    x = t.e.select(F.nullif(F.col("event_id") % 100, F.lit(99)).alias("code"))
    return x.groupBy(K.vessel_subtype("code").alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


@query("in_box", """SELECT count(*) FILTER (WHERE lon BETWEEN -75.5e0 AND -74.5e0 AND lat BETWEEN 36.8e0 AND 37.6e0) AS inside,
    count(*) FILTER (WHERE lon-0.1e0<=-74.5e0 AND lon+0.1e0>=-75.5e0 AND lat-0.1e0<=37.6e0 AND lat+0.1e0>=36.8e0) AS overlapping FROM e""")
def in_box(t):
    inside = F.col("lon").between(-75.5, -74.5) & F.col("lat").between(36.8, 37.6)
    near = G.box_overlap(F.col("lon") - 0.1, F.col("lat") - 0.1, F.col("lon") + 0.1, F.col("lat") + 0.1,
                         F.lit(-75.5), F.lit(36.8), F.lit(-74.5), F.lit(37.6))
    return t.e.agg(F.count_if(inside).alias("inside"), F.count_if(near).alias("overlapping"))


BOXES = "(SELECT pid, min(lon) AS lon0, min(lat) AS lat0, max(lon) AS lon1, max(lat) AS lat1 FROM e GROUP BY pid)"


def boxes(t):
    return t.e.groupBy("pid").agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"), F.max("lon").alias("lon1"),
                                  F.max("lat").alias("lat1"))


@query("box_area", f"""SELECT pid, round((lon1-lon0)*111.32e0*cos(radians((lat0+lat1)/2))*(lat1-lat0)*110.57e0, 3) AS km2,
    round(abs(lon1-lon0)*abs(lat1-lat0), 9) AS sqdeg FROM {BOXES}""")
def box_area(t):
    return boxes(t).select("pid", F.round(G.box_area_km2("lon0", "lat0", "lon1", "lat1"), 3).alias("km2"),
                           F.round(F.abs(F.col("lon1") - F.col("lon0")) * F.abs(F.col("lat1") - F.col("lat0")), 9).alias("sqdeg"))


@query("box_circle", f"""SELECT pid, round((lat0+lat1)/2, 9) AS lat, round((lon0+lon1)/2, 9) AS lon,
    round(sqrt(pow((lat1-lat0)/2*110.57e0,2)+pow((lon1-lon0)/2*111.32e0*cos(radians((lat0+lat1)/2)),2))/1.852e0, 6) AS radius_nm
    FROM {BOXES}""")
def box_circle(t):
    c = G.box_circle("lon0", "lat0", "lon1", "lat1")
    return boxes(t).select("pid", F.round(c["lat"], 9).alias("lat"), F.round(c["lon"], 9).alias("lon"),
                           F.round(c["radius_nm"], 6).alias("radius_nm"))


@query("coords_bounds", f"SELECT pid, lon0, lat0, lon1, lat1 FROM (SELECT pid, min(lon) AS lon0, min(lat) AS lat0, max(lon) AS lon1, max(lat) AS lat1 FROM (SELECT event_id//8 AS pid, lon, lat FROM e) GROUP BY pid)")
def coords_bounds(t):
    rings = (t.e.groupBy(F.expr("event_id div 8").alias("pid"))
             .agg(F.collect_list(F.array("lon", "lat")).alias("xy")))  # eight vertices per shape
    xs, ys = F.transform("xy", lambda p: p[0]), F.transform("xy", lambda p: p[1])
    return rings.select("pid", F.array_min(xs).alias("lon0"), F.array_min(ys).alias("lat0"),
                        F.array_max(xs).alias("lon1"), F.array_max(ys).alias("lat1"))


RING = [(-75.9, 36.6), (-74.2, 36.9), (-73.6, 38.0), (-74.8, 37.6), (-75.6, 38.1)]
HOLE = [(-75.2, 37.0), (-74.8, 37.05), (-74.9, 37.3), (-75.2, 37.25)]
EDGES = [(*p, *q) for ring in (RING, HOLE) for p, q in zip(ring, ring[1:] + ring[:1])]
EDGE_SQL = ", ".join(f"({a}e0,{b}e0,{c}e0,{e}e0)" for a, b, c, e in EDGES)


@query("point_in_polygon", f"""SELECT event_id FROM e, (VALUES {EDGE_SQL}) g(x0, y0, x1, y1) GROUP BY event_id, lat, lon
    HAVING sum(CASE WHEN (y0>lat)<>(y1>lat) AND lon<(x1-x0)*(lat-y0)/nullif(y1-y0,0)+x0 THEN 1 ELSE 0 END) % 2 = 1""")
def point_in_polygon(t):
    from plotgap.operators.footprint import inside_rings
    return t.e.where(inside_rings("lon", "lat", [RING, HOLE])).select("event_id")


@query("buffer_box", f"""SELECT pid, round(lon0 - m/greatest(cos(radians(least(greatest(abs(lat0),abs(lat1))+m,89.9e0))),0.01e0), 9) AS lon0,
    round(lat0-m, 9) AS lat0, round(lon1 + m/greatest(cos(radians(least(greatest(abs(lat0),abs(lat1))+m,89.9e0))),0.01e0), 9) AS lon1,
    round(lat1+m, 9) AS lat1 FROM (SELECT *, 5000e0/111195e0 AS m FROM {BOXES})""")
def buffer_box(t):
    b = G.buffer_box("lon0", "lat0", "lon1", "lat1", 5000.0)
    return boxes(t).select("pid", *[F.round(b[c], 9).alias(c) for c in ("lon0", "lat0", "lon1", "lat1")])


def _meet_sql():
    def o(a, b, c):
        return f"sign((({b[0]})-({a[0]}))*(({c[1]})-({a[1]}))-(({b[1]})-({a[1]}))*(({c[0]})-({a[0]})))"
    p, q, r, s = ("x0", "y0"), ("x1", "y1"), ("-75.0e0", "36.9e0"), ("-74.6e0", "37.5e0")
    return f"({o(p, q, r)}<>{o(p, q, s)} AND {o(r, s, p)}<>{o(r, s, q)})"


@query("segments_meet", f"SELECT line_set, CAST(j AS BIGINT) AS j, {_meet_sql()} AS meets, greatest(x0,x1)>=-75.0e0 AND least(x0,x1)<=-74.6e0 AND greatest(y0,y1)>=36.9e0 AND least(y0,y1)<=37.5e0 AS near_box FROM segments")
def segments_meet(t):
    meets = G.segments_meet("x0", "y0", "x1", "y1", F.lit(-75.0), F.lit(36.9), F.lit(-74.6), F.lit(37.5))
    near = G.box_overlap(F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"),
                         F.lit(-75.0), F.lit(36.9), F.lit(-74.6), F.lit(37.5))
    return t.segments.select("line_set", F.col("j").cast("bigint").alias("j"), meets.alias("meets"), near.alias("near_box"))


COUNTS = "(SELECT pid, count(*) AS n, count(*) FILTER (WHERE event_type='view') AS k FROM e GROUP BY pid)"


def counts(t):
    return t.e.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("k"))


@query("wilson_interval", f"SELECT pid, round({d.wilson('k', 'n', 'lo')}, 9) AS lo, round({d.wilson('k', 'n', 'hi')}, 9) AS hi FROM {COUNTS}")
def wilson_interval(t):
    w = K.wilson("k", "n")
    return counts(t).select("pid", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


@query("chance_match", f"""SELECT pid, round(1-exp(-(n/5e4)*pi()*0.09e0), 9) AS p, round(1000*sqrt(-ln(0.95e0)/(pi()*(n/5e4))), 6) AS max_radius_m FROM {COUNTS}""")
def chance_match(t):
    dens = F.col("n") / 5e4
    return counts(t).select("pid", F.round(K.chance_match(F.lit(300.0), dens), 9).alias("p"),
                            F.round(K.max_scorable_radius_m(dens), 6).alias("max_radius_m"))


@query("local_wall_time", """SELECT event_id, CAST(timezone(CASE feed_id WHEN 'F0' THEN 'America/New_York' WHEN 'F1' THEN 'America/Chicago'
    WHEN 'F2' THEN 'America/Denver' WHEN 'F3' THEN 'America/Los_Angeles' WHEN 'F4' THEN 'America/New_York' END, make_timestamptz(1709000000000000 + arrival*100000000)) AS VARCHAR) AS local_time
    FROM (SELECT *, arrival AS event_id FROM fixes) WHERE feed_id<>'F5'""")
def local_wall_time(t):
    from plotgap.catalog.land_q import FEED_ZONES
    from plotgap.operators.land import local_wall_time as lwt
    x = t.fixes.select(F.col("arrival").alias("event_id"), "feed_id", (F.lit(1709000000) + F.col("arrival") * 100).alias("s"))
    return lwt(x, "s", FEED_ZONES).select("event_id", F.date_format("local_time", "yyyy-MM-dd HH:mm:ss").alias("local_time"))


STAMPED = "(SELECT event_id, 'wz-' || pid || CASE WHEN event_id%3=0 THEN '-1700000' || lpad(CAST(event_id%1000 AS VARCHAR),3,'0') WHEN event_id%3=1 THEN '_0000000123' ELSE '' END AS id FROM e)"


@query("stable_id", f"SELECT event_id, CASE WHEN event_id%3=0 THEN 'wz-' || CAST(event_id_pid AS VARCHAR) ELSE id END AS sid FROM (SELECT q.*, e.pid AS event_id_pid FROM {STAMPED} q JOIN e USING(event_id))")
def stable_id(t):
    pid = F.concat(F.lit("wz-"), F.col("pid").cast("string"))
    tail = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("-1700000"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
            .when(F.col("event_id") % 3 == 1, F.lit("_0000000123")).otherwise(F.lit("")))
    return t.e.select("event_id", F.concat(pid, tail).alias("id")).select("event_id", K.stable_id("id").alias("sid"))


@query("rolling_end", """SELECT event_id, event_id%2500 > 1096 AS rolling, CASE WHEN event_id%2500 > 1096 THEN 'open-ended'
    ELSE CAST(DATE '2024-01-01' + CAST(event_id%2500 AS INTEGER) AS VARCHAR) END AS end_date FROM e""")
def rolling_end(t):
    start = F.lit("2024-01-01").cast("date")
    end = F.date_add(start, (F.col("event_id") % 2500).cast("int"))
    roll = K.rolling_end(start, end)
    return t.e.select("event_id", roll.alias("rolling"), F.when(roll, "open-ended").otherwise(end.cast("string")).alias("end_date"))


@query("position_source_class", """SELECT type, CASE type WHEN 'adsb_icao' THEN 'report' WHEN 'mode_s' THEN 'no position' ELSE 'observation' END AS source_class,
    count(*) AS n FROM aircraft GROUP BY 1, 2""")
def position_source_class(t):
    return (t.aircraft.groupBy("type", K.position_source_class("type").alias("source_class")).agg(F.count(F.lit(1)).alias("n")))


@query("altitude_ft", "SELECT TRY_CAST(alt_baro AS INTEGER) AS alt_ft, count(*) AS n FROM aircraft GROUP BY 1")
def altitude_ft(t):
    return t.aircraft.groupBy(K.altitude_ft("alt_baro").alias("alt_ft")).agg(F.count(F.lit(1)).alias("n"))


CANON = "CASE WHEN {v}='4' THEN '4.0' ELSE {v} END"
VERDICT_SQL = f"""CASE WHEN version_declared IS NULL THEN 'absent' WHEN version_registry IS NULL THEN 'registry-silent'
  WHEN version_declared=version_registry THEN 'agrees'
  WHEN {CANON.format(v='version_declared')}={CANON.format(v='version_registry')} THEN 'agrees-by-alias' ELSE 'disagrees' END"""


@query("version_verdict", f"SELECT {VERDICT_SQL} AS verdict, count(*) AS n FROM ledger GROUP BY 1")
def version_verdict(t):
    return (t.ledger.groupBy(K.version_verdict("version_declared", "version_registry").alias("verdict"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("feed_outcome", """SELECT CASE WHEN event_id%13=0 THEN 'truncated' WHEN event_type='error' THEN 'http_error'
    WHEN event_id%5=0 THEN 'not_wzdx' WHEN event_id%5=1 THEN 'not_json' WHEN event_id%5=2 THEN 'not_wzdx'
    WHEN event_id%5=3 THEN 'version_unknown' ELSE 'ok' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def feed_outcome(t):
    k = F.col("event_id") % 5
    body = (F.when(k == 0, "<!DOCTYPE html><p>down</p>").when(k == 1, F.concat(F.lit("{oops"), F.col("props")))
            .when(k == 2, F.col("props")).otherwise(F.lit('{"features": []}')))
    x = t.raw("events").select(
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), body.alias("body"),
        F.when(k == 3, "3.1").otherwise("4").alias("version"), (F.col("event_id") % 13 == 0).alias("cut"))
    return x.groupBy(K.feed_outcome("status", "body", "version", "cut").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("candidate_stratum", """SELECT CASE WHEN nm<=2 THEN '<=2nm' WHEN nm<=10 THEN '2-10nm' ELSE '>10nm' END AS band,
    CASE WHEN snr<20.25e0 THEN 'at-gate' ELSE 'clear' END AS strength, reception, count(*) AS n
    FROM (SELECT *, abs(lat-37.2e0)*60 AS nm FROM candidates) GROUP BY 1, 2, 3""")
def candidate_stratum(t):
    x = t.candidates.withColumn("nm", F.abs(F.col("lat") - 37.2) * 60)
    return (x.groupBy(K.candidate_band("nm").alias("band"), K.candidate_strength("snr", 15.0).alias("strength"), "reception")
            .agg(F.count(F.lit(1)).alias("n")))


@query("kinematic_confidence", """SELECT event_id, round(CASE WHEN r<=1.1e0 THEN 0e0 ELSE least(0.95e0, 0.5e0+0.225e0*(r-1.1e0)) END, 9) AS confidence
    FROM (SELECT event_id, value/50e0 AS r FROM e)""")
def kinematic_confidence(t):
    return t.e.select("event_id", F.round(K.kinematic_confidence(F.col("value") / 50.0), 9).alias("confidence"))


@query("agreement_gloss", """SELECT CASE WHEN k>=0.81e0 THEN 'almost perfect' WHEN k>=0.61e0 THEN 'substantial' WHEN k>=0.41e0 THEN 'moderate'
    WHEN k>=0.21e0 THEN 'fair' WHEN k>=0 THEN 'slight' ELSE 'worse than chance' END ||
    CASE WHEN k>=0 THEN ' agreement, on Landis & Koch''s conventional bands' ELSE '' END AS gloss, count(*) AS n
    FROM (SELECT (event_id%200-50)/150e0 AS k FROM e) GROUP BY 1""")
def agreement_gloss(t):
    k = (F.col("event_id") % 200 - 50) / 150.0
    return t.e.groupBy(K.agreement_gloss(k).alias("gloss")).agg(F.count(F.lit(1)).alias("n"))


@query("shift_verdict", """SELECT CASE WHEN p<=0.05e0 AND c>0.05e0 THEN 'candidates depart, control does not' WHEN p<=0.05e0 THEN 'both depart: shared geography'
    WHEN c<=0.05e0 THEN 'control departs, candidates do not: a measured absence' ELSE 'nothing survives displacement' END AS verdict, count(*) AS n
    FROM (SELECT (event_id%10)/100e0 AS p, (event_id%7)/70e0 AS c FROM e) GROUP BY 1""")
def shift_verdict(t):
    v = K.shift_verdict((F.col("event_id") % 10) / 100.0, (F.col("event_id") % 7) / 70.0)
    return t.e.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("chip_reading", """SELECT CASE WHEN a IS NULL THEN 'no data' WHEN a>=8 THEN 'bright target at the candidate'
    WHEN b>=8 AND c>60 THEN 'bright elsewhere in the chip' ELSE 'nothing bright -- clutter?' END AS reading, count(*) AS n
    FROM (SELECT nullif(event_id%12, 11) AS a, event_id%17 AS b, event_id%130 AS c FROM e) GROUP BY 1""")
def chip_reading(t):
    x = t.e.select(F.nullif(F.col("event_id") % 12, F.lit(11)).cast("double").alias("a"), (F.col("event_id") % 17).alias("b"),
                   (F.col("event_id") % 130).alias("c"))
    return x.groupBy(K.chip_reading("a", "b", "c", 60.0).alias("reading")).agg(F.count(F.lit(1)).alias("n"))


@query("quota_credits", f"""SELECT pid, CAST(CASE WHEN a<=25 THEN 1 WHEN a<=100 THEN 2 WHEN a<=400 THEN 3 ELSE 4 END AS BIGINT) AS credits,
    CAST(2880*CASE WHEN a<=25 THEN 1 WHEN a<=100 THEN 2 WHEN a<=400 THEN 3 ELSE 4 END AS BIGINT) AS daily
    FROM (SELECT pid, abs(lon1-lon0)*abs(lat1-lat0)*pid*pid AS a FROM {BOXES})""")
def quota_credits(t):
    a = F.abs(F.col("lon1") - F.col("lon0")) * F.abs(F.col("lat1") - F.col("lat0")) * F.col("pid") * F.col("pid")
    k = K.quota_credits(a).cast("bigint")
    return boxes(t).select("pid", k.alias("credits"), (F.floor(F.lit(86400 / 30.0)) * k).cast("bigint").alias("daily"))

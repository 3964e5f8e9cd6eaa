"""Reception, searched water and uptime."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.operators import coverage as V
from plotgap.operators import uptime as U

COL, ROW = d.cell("lon", "5e-2"), d.cell("lat", "5e-2")
GRID_BODY = """SELECT {k}col, row, count(*) AS n_reports, count(DISTINCT platform_id) AS n_vessels, count(gap) AS n_gaps, median(gap) AS median_gap_s,
  count(*) FILTER (WHERE gap>180)/nullif(count(gap), 0) AS p_long FROM (SELECT *, CASE WHEN g BETWEEN 0 AND 3600 THEN g END AS gap FROM
  (SELECT {k}{c} AS col, {r} AS row, platform_id, (t_us-lag(t_us) OVER (PARTITION BY {k}platform_id ORDER BY t_us, event_id))/1e6 AS g FROM {src})) GROUP BY {k}col, row"""


def grid_sql(src="reports", key=""):
    body = GRID_BODY.format(c=COL, r=ROW, src=src, k=key)
    return f"(SELECT *, {d.reception('n_vessels', 'n_gaps', 'median_gap_s')} AS reception FROM ({body}))"


# three kinds of listening: one platform per cell, many sparse ones, and three that are always on
LISTEN = """(SELECT r.*EXCLUDE(platform_id), CASE WHEN e.pid%6=0 THEN 'P' || e.pid WHEN e.pid%6=3 THEN 'U' || e.user_id ELSE chr(65+CAST(e.event_id%3 AS INTEGER)) END AS platform_id FROM reports r JOIN e USING(event_id))"""


def listen(t):
    ids = (F.when(F.col("pid") % 6 == 0, F.concat(F.lit("P"), F.col("pid").cast("string")))
           .when(F.col("pid") % 6 == 3, F.concat(F.lit("U"), F.col("user_id").cast("string")))
           .otherwise(F.expr("char(65 + event_id % 3)")))
    return t.e.where("event_type <> 'error'").select("event_id", "t_us", "lat", "lon", ids.alias("platform_id"))


GRID = f"gr AS {grid_sql(LISTEN)}"


@query("reception_grid", f"WITH {GRID} SELECT col, row, n_reports, n_vessels, n_gaps, round(median_gap_s, 3) AS median_gap_s, round(p_long, 9) AS p_long, reception FROM gr")
def reception_grid(t):
    g = V.reception_grid(listen(t))
    return g.withColumn("median_gap_s", F.round("median_gap_s", 3)).withColumn("p_long", F.round("p_long", 9))


@query("reception_class", f"WITH {GRID} SELECT reception, n_vessels, count(*) AS n FROM gr GROUP BY 1, 2")
def reception_class(t):
    return V.reception_grid(listen(t)).groupBy("reception", "n_vessels").agg(F.count(F.lit(1)).alias("n"))


NEAR = f"""{GRID}, nb AS (SELECT g.col+a.x AS col, g.row+b.x AS row, count(*) AS n, count(*) FILTER (WHERE reception='heard') AS h,
  count(*) FILTER (WHERE reception='intermittent') AS i FROM gr g, (VALUES (-1),(0),(1)) a(x), (VALUES (-1),(0),(1)) b(x) GROUP BY 1, 2)"""
NCLASS = "CASE WHEN coalesce(nb.n,0)=0 THEN 'unheard' WHEN nb.h*2>=nb.n THEN 'heard' WHEN nb.h>0 OR nb.i>0 THEN 'intermittent' ELSE 'thin' END"


@query("neighbour_class", f"WITH {NEAR} SELECT nb.col, nb.row, coalesce(gr.reception, {NCLASS}) AS reception FROM nb LEFT JOIN gr USING (col, row)")
def neighbour_class(t):
    grid = V.reception_grid(listen(t))
    near = V.neighbourhood(grid).select("col", "row")
    return V.classify_cells(near, grid).select("col", "row", "reception")


@query("reception_summary", f"WITH {GRID} SELECT reception, count(*) AS n_cells, round(sum({d.area('row', '5e-2')}), 3) AS km2 FROM gr GROUP BY 1")
def reception_summary(t):
    return V.reception_summary(V.reception_grid(listen(t))).withColumn("km2", F.round("km2", 3))


@query("reception_reach", f"WITH {GRID} SELECT {d.cell('row*5e-2', '5e-1')} AS band, max(col) AS east_col, count(*) AS n_heard FROM gr WHERE reception='heard' GROUP BY 1")
def reception_reach(t):
    return V.reception_reach(V.reception_grid(listen(t)))


@query("score_candidates_reception", f"""WITH {NEAR}, c AS (SELECT obs_id, {COL} AS col, {ROW} AS row FROM candidates)
    SELECT obs_id, coalesce(gr.reception, {NCLASS}) AS reception, coalesce(gr.n_vessels, 0) AS n_vessels
    FROM c LEFT JOIN gr USING (col, row) LEFT JOIN nb USING (col, row)""")
def score_candidates_reception(t):
    return V.score_points(t.candidates, V.reception_grid(listen(t))).select("obs_id", "reception", "n_vessels")


@query("reception_around_passes", f"""WITH sc AS (SELECT DISTINCT scene, t_scene_us, day FROM observations),
    w AS (SELECT r.*, s.day FROM {LISTEN} r JOIN sc s ON abs(r.t_us-s.t_scene_us)<=900000000), gr AS {grid_sql('w', 'day, ')}
    SELECT day, col, row, n_reports, n_vessels, n_gaps, reception FROM gr""")
def reception_around_passes(t):
    scenes = t.observations.select("scene", "t_scene_us", "day").distinct()
    near = V.around_passes(listen(t), scenes, "t_scene_us", 900.0)
    return V.reception_grid(near, extra=["day"]).select("day", "col", "row", "n_reports", "n_vessels", "n_gaps", "reception")


HALF = f"(SELECT * FROM {LISTEN} WHERE t_us {{op}} 129600000000)"


@query("compare_reception", f"""WITH a AS {grid_sql(HALF.format(op='<'))}, b AS {grid_sql(HALF.format(op='>='))},
    f AS (SELECT coalesce(a.row, b.row) AS row, a.reception AS ra, b.reception AS rb, a.median_gap_s AS ma, b.median_gap_s AS mb FROM a FULL JOIN b ON a.col=b.col AND a.row=b.row)
    SELECT count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS n_common, count(*) FILTER (WHERE rb IS NULL) AS only_a, count(*) FILTER (WHERE ra IS NULL) AS only_b,
    count(*) FILTER (WHERE ra=rb) AS n_agree, round(coalesce(sum({d.area('row', '5e-2')}) FILTER (WHERE ra='heard'), 0), 3) AS heard_km2_a,
    round(coalesce(sum({d.area('row', '5e-2')}) FILTER (WHERE rb='heard'), 0), 3) AS heard_km2_b,
    round(median(CASE WHEN ra IS NOT NULL AND mb>0 THEN ma/mb END), 6) AS median_gap_ratio FROM f""")
def compare_reception(t):
    a = V.reception_grid(listen(t).where("t_us < 129600000000"))
    b = V.reception_grid(listen(t).where("t_us >= 129600000000"))
    _, totals = V.compare_reception(a, b)
    return (totals.withColumn("heard_km2_a", F.round("heard_km2_a", 3)).withColumn("heard_km2_b", F.round("heard_km2_b", 3))
            .withColumn("median_gap_ratio", F.round("median_gap_ratio", 6)))


@query("reception_confusion", f"""WITH a AS {grid_sql(HALF.format(op='<'))}, b AS {grid_sql(HALF.format(op='>='))}
    SELECT a.reception AS reception_a, b.reception AS reception_b, count(*) AS n FROM a JOIN b ON a.col=b.col AND a.row=b.row GROUP BY 1, 2""")
def reception_confusion(t):
    a = V.reception_grid(listen(t).where("t_us < 129600000000"))
    b = V.reception_grid(listen(t).where("t_us >= 129600000000"))
    return V.compare_reception(a, b)[0]


ABAND = """CASE WHEN on_ground THEN 'on ground' WHEN alt_m IS NULL THEN NULL WHEN alt_m<1000 THEN '0-1 km' WHEN alt_m<3000 THEN '1-3 km'
  WHEN alt_m<6000 THEN '3-6 km' WHEN alt_m<9000 THEN '6-9 km' WHEN alt_m<12000 THEN '9-12 km' ELSE '12+ km' END"""
AIR = f"""ag AS (SELECT *, CASE WHEN n_aircraft<3 THEN 'thin' WHEN n_present/n_polls>=0.05e0 THEN 'heard' ELSE 'intermittent' END AS reception FROM (
  SELECT {d.cell('lon', '1e0')} AS col, {d.cell('lat', '1e0')} AS row, {ABAND} AS band, count(*) AS n_states, count(DISTINCT hex) AS n_aircraft,
  count(DISTINCT poll) AS n_present, (SELECT count(DISTINCT poll) FROM aircraft) AS n_polls,
  (SELECT count(*) FROM aircraft WHERE ({ABAND}) IS NULL) AS n_no_altitude FROM aircraft WHERE ({ABAND}) IS NOT NULL GROUP BY 1, 2, 3))"""
BANDS = "(VALUES ('on ground', 0), ('0-1 km', 1), ('1-3 km', 2), ('3-6 km', 3), ('6-9 km', 4), ('9-12 km', 5), ('12+ km', 6)) bd(band, band_no)"


@query("air_reception_grid", f"WITH {AIR} SELECT * FROM ag")
def air_reception_grid(t):
    return V.air_reception_grid(t.aircraft)


@query("air_reception_class", f"WITH {AIR} SELECT reception, count(*) AS n FROM ag GROUP BY 1")
def air_reception_class(t):
    return V.air_reception_grid(t.aircraft).groupBy("reception").agg(F.count(F.lit(1)).alias("n"))


@query("air_profile", f"""WITH {AIR} SELECT c.col, c.row, band, coalesce(ag.reception, 'unheard') AS reception
    FROM (SELECT DISTINCT col, row FROM ag) c CROSS JOIN {BANDS} LEFT JOIN ag USING (col, row, band)""")
def air_profile(t):
    return V.air_profile(V.air_reception_grid(t.aircraft)).select("col", "row", "band", "reception")


@query("air_floor", f"""WITH {AIR} SELECT ag.col, ag.row, arg_min(band, band_no) FILTER (WHERE reception='heard') AS floor_band FROM ag JOIN {BANDS} USING (band) GROUP BY 1, 2""")
def air_floor(t):
    return V.air_floor(V.air_reception_grid(t.aircraft))


@query("air_summary", f"WITH {AIR} SELECT band, reception, count(*) AS n_cells, round(sum({d.area('row', '1e0')}), 3) AS km2 FROM ag GROUP BY 1, 2")
def air_summary(t):
    return V.air_summary(V.air_reception_grid(t.aircraft)).withColumn("km2", F.round("km2", 3))


@query("freshness", """SELECT count(contact_age_s) AS n, median(contact_age_s) AS median_s, list_sort(list(contact_age_s))[CAST(floor(0.9e0*(count(*)-1)) AS BIGINT)+1] AS p90_s,
    round(count(*) FILTER (WHERE contact_age_s>60)/count(*), 9) AS p_stale FROM aircraft""")
def freshness(t):
    return V.freshness(t.aircraft).withColumn("p_stale", F.round("p_stale", 9))


@query("position_source_audit", "SELECT type, count(*) AS n_rows, count(DISTINCT hex) AS n_craft, min(t_us) AS first_us, max(t_us) AS last_us FROM aircraft GROUP BY 1")
def position_source_audit(t):
    return V.position_source_audit(t.aircraft)


@query("position_source_regions", f"""SELECT {d.cell('lon', '1e0')} AS col, {d.cell('lat', '1e0')} AS row, count(*) AS n_rows FROM aircraft
    WHERE type IN ('mlat', 'mode_s') GROUP BY 1, 2 ORDER BY n_rows DESC, col, row LIMIT 25""")
def position_source_regions(t):
    return V.position_source_regions(t.aircraft, ["mlat", "mode_s"])


@query("searched_from_samples", f"""SELECT day, col, row, n, hit, CAST(greatest(1, least(10, round_even(10*hit/n, 0))) AS INTEGER) AS level FROM (
    SELECT t_us//86400000000 AS day, {d.cell('lon', '2e-2')} AS col, {d.cell('lat', '2e-2')} AS row, count(*) AS n,
    count(*) FILTER (WHERE event_type<>'click') AS hit FROM e GROUP BY 1, 2, 3) WHERE hit>0""")
def searched_from_samples(t):
    s = t.e.select(F.expr("t_us div 86400000000").alias("day"), "lon", "lat", (F.col("event_type") != "click").alias("searched"))
    return V.searched_from_samples(s, ["day"], 0.02)


@query("searched_lookup", f"""SELECT obs_id, round(coalesce(level, 0)/10e0, 6) AS fraction, coalesce(level, 0)/10e0>=0.5e0 AS contains
    FROM (SELECT *, {COL} AS col, {ROW} AS row FROM observations) o LEFT JOIN searched s USING (day, col, row)""")
def searched_lookup(t):
    return (V.searched_lookup(t.observations, t.searched, ["day"], 0.05)
            .select("obs_id", F.round("fraction", 6).alias("fraction"), "contains"))


@query("searched_area_km2", "SELECT day, count(*) AS n_cells, round(sum(0.05e0*111.195e0*0.05e0*111.195e0*cos(radians((row+0.5e0)*0.05e0))*level/10e0), 3) AS km2 FROM searched GROUP BY 1")
def searched_area_km2(t):
    return V.searched_area_km2(t.searched, ["day"], 0.05).withColumn("km2", F.round("km2", 3))


@query("land_grid_vote", f"""SELECT *, water_votes>land_votes AS is_water FROM (SELECT {d.cell('lon', '1e-2')} AS col, {d.cell('lat', '1e-2')} AS row,
    count(*) FILTER (WHERE value>=40) AS water_votes, count(*) FILTER (WHERE value<40) AS land_votes FROM e GROUP BY 1, 2)""")
def land_grid_vote(t):
    return V.land_grid_vote(t.e.withColumn("is_water", F.col("value") >= 40), 0.01)


RLE = """runs AS (SELECT day, row, min(col) AS start, count(*) AS length, any_value(level) AS level FROM (SELECT *, sum(nw) OVER (PARTITION BY day, row ORDER BY col) AS run FROM (
  SELECT *, CASE WHEN col=lag(col) OVER w+1 AND level=lag(level) OVER w THEN 0 ELSE 1 END AS nw FROM searched WINDOW w AS (PARTITION BY day, row ORDER BY col))) GROUP BY day, row, run)"""


@query("searched_rle_encode", f"WITH {RLE} SELECT * FROM runs")
def searched_rle_encode(t):
    return V.rle_encode(t.searched)


@query("searched_rle_decode", "SELECT day, col, row, level FROM searched")
def searched_rle_decode(t):
    return V.rle_decode(V.rle_encode(t.searched)).select("day", "col", "row", "level")


@query("last_look", f"""WITH lk AS (SELECT col, row, day, level, row_number() OVER (PARTITION BY col, row ORDER BY day DESC) AS rank FROM searched WHERE level>=5)
    SELECT obs_id, lk.day, lk.level, CAST(rank AS INTEGER) AS rank FROM (SELECT obs_id, {COL} AS col, {ROW} AS row FROM observations) o JOIN lk USING (col, row) WHERE rank<=2""")
def last_look(t):
    return V.last_look(t.observations.select("obs_id", "lon", "lat"), t.searched, "obs_id", "day", 0.05, 2)


PASSES = """(SELECT 'A' || (event_id//2) AS name, 'S' || (user_id%3) AS satellite, t_us, event_id, lon-0.6e0 AS lon0, lon+0.6e0 AS lon1, lat-0.5e0 AS lat0, lat+0.5e0 AS lat1 FROM e)"""


def passes(t):
    return t.e.select(
        F.concat(F.lit("A"), F.expr("event_id div 2").cast("string")).alias("name"), F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("satellite"),
        "t_us", "event_id", (F.col("lon") - 0.6).alias("lon0"), (F.col("lon") + 0.6).alias("lon1"),
        (F.col("lat") - 0.5).alias("lat0"), (F.col("lat") + 0.5).alias("lat1"))


SHARE = "greatest(0e0, least(lon1, -73.5e0)-greatest(lon0, -75.5e0))*greatest(0e0, least(lat1, 38.2e0)-greatest(lat0, 36.8e0))/(2e0*(38.2e0-36.8e0))"


@query("pass_revisit", f"""WITH o AS (SELECT * FROM {PASSES} QUALIFY row_number() OVER (PARTITION BY name ORDER BY t_us)=1),
    k AS (SELECT *, {SHARE} AS share FROM o), g AS (SELECT satellite, (t_us-lag(t_us) OVER (PARTITION BY satellite ORDER BY t_us, name))/3.6e9 AS gap FROM k WHERE share>=0.15e0)
    SELECT satellite, count(*) AS n_passes, round(min(gap) FILTER (WHERE gap>1), 6) AS best_h, round(max(gap) FILTER (WHERE gap>1), 6) AS worst_h,
    round(median(gap) FILTER (WHERE gap>1), 6) AS median_h FROM g GROUP BY 1""")
def pass_revisit(t):
    r = V.pass_revisit(passes(t), (-75.5, 36.8, -73.5, 38.2))
    return r.select("satellite", "n_passes", *[F.round(c, 6).alias(c) for c in ("best_h", "worst_h", "median_h")])


@query("pass_union_coverage", f"""WITH lt AS (SELECT i, j, -75.5e0+(i+0.5e0)/40e0*2e0 AS x, 36.8e0+(j+0.5e0)/40e0*(38.2e0-36.8e0) AS y FROM range(40) a(i), range(40) b(j)),
    p AS (SELECT *, t_us//10800000000 AS orbit FROM {PASSES}), c AS (SELECT satellite, orbit, count(DISTINCT i*40+j)/1600e0 AS share FROM p JOIN lt ON x BETWEEN lon0 AND lon1 AND y BETWEEN lat0 AND lat1 GROUP BY 1, 2)
    SELECT satellite, orbit, n_slices, west, east, round(share, 6) AS share FROM (SELECT satellite, orbit, count(*) AS n_slices, min(lon0) AS west, max(lon1) AS east FROM p GROUP BY 1, 2) JOIN c USING (satellite, orbit) WHERE share>=0.3e0""")
def pass_union_coverage(t):
    s = passes(t).withColumn("orbit", F.expr("t_us div 10800000000"))
    return V.pass_union_coverage(s, ["satellite", "orbit"], (-75.5, 36.8, -73.5, 38.2), 40, 0.3).withColumn("share", F.round("share", 6))


@query("coverage_summary", "SELECT count(DISTINCT day) AS n_passes, max(day) AS newest, min(day) AS oldest, round(sum(0.05e0*111.195e0*0.05e0*111.195e0*cos(radians((row+0.5e0)*0.05e0))*level/10e0), 3) AS km2 FROM searched")
def coverage_summary(t):
    return V.coverage_summary(t.searched, "day", 0.05).withColumn("km2", F.round("km2", 3))


SES = """ss AS (SELECT collector, session, min(t_us) AS started_us, max(t_us) AS last_us, max(t_us) FILTER (WHERE event='stop') AS ended_us,
  count(*) FILTER (WHERE event='poll') AS polls, count(*) FILTER (WHERE event='poll' AND NOT ok) AS failures FROM heartbeats GROUP BY 1, 2),
 up AS (SELECT collector, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(nw) OVER (PARTITION BY collector ORDER BY lo, hi) AS i FROM (
   SELECT *, CASE WHEN lo<=max(hi) OVER (PARTITION BY collector ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw
   FROM (SELECT collector, started_us AS lo, coalesce(ended_us, last_us) AS hi FROM ss))) GROUP BY collector, i)"""


@query("collector_sessions", f"WITH {SES} SELECT *, ended_us IS NOT NULL AS clean FROM ss")
def collector_sessions(t):
    return U.collector_sessions(t.heartbeats)


def up(t):
    return U.uptime_intervals(U.collector_sessions(t.heartbeats))


@query("uptime_intervals", f"WITH {SES} SELECT * FROM up")
def uptime_intervals(t):
    return up(t)


@query("blind_intervals", f"""WITH {SES}, ed AS (SELECT * FROM up UNION ALL SELECT DISTINCT collector, 0, 0 FROM heartbeats UNION ALL SELECT DISTINCT collector, 259200000000, 259200000000 FROM heartbeats)
    SELECT * FROM (SELECT collector, max(hi) OVER (PARTITION BY collector ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, lo AS hi FROM ed) WHERE hi-lo>=60000000""")
def blind_intervals(t):
    return U.blind_intervals(up(t), t.heartbeats.select("collector").distinct(), F.lit(0).cast("bigint"), F.lit(259_200_000_000))


@query("was_collecting", f"""WITH {SES} SELECT event_id, 'C' || (user_id%4) AS collector FROM e WHERE EXISTS (SELECT 1 FROM up WHERE up.collector='C' || (user_id%4) AND t_us BETWEEN lo AND hi)""")
def was_collecting(t):
    asked = t.e.select("event_id", "t_us", F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("collector"))
    return U.was_collecting(asked, up(t)).select("event_id", "collector")


@query("hour_coverage", """WITH h AS (SELECT unnest(range(0, (SELECT max(t_us)//3600000000+30 FROM e))) AS hour), dh AS (SELECT DISTINCT t_us//3600000000 AS hour FROM heartbeats WHERE event='start'),
    b AS (SELECT t_us//3600000000 AS hour, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_f FROM heartbeats WHERE event='poll' GROUP BY 1)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN dh.hour IS NOT NULL THEN 'with_data' WHEN n_ok>0 THEN 'rows_in_adjacent_partition' WHEN n_f>0 THEN 'looked_all_failed'
      WHEN EXISTS (SELECT 1 FROM heartbeats x WHERE x.t_us//86400000000=h.hour//24) THEN 'not_looking' ELSE 'unknown' END AS outcome
      FROM h LEFT JOIN dh USING (hour) LEFT JOIN b USING (hour)) GROUP BY 1""")
def hour_coverage(t):
    span = t.e.agg(F.expr("max(t_us) div 3600000000 + 29").alias("last"))
    hours = span.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("hour"))
    data = t.heartbeats.where("event = 'start'").select(F.expr("t_us div 3600000000").alias("hour"))
    return U.hour_coverage(hours, data, t.heartbeats).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("volume_agreement", """SELECT collector, CASE WHEN r BETWEEN 5 AND 15 THEN NULL ELSE 'archive and heartbeats disagree: ' || printf('%.1f', r) || ' polls per file where 10 is expected' END AS message
    FROM (SELECT collector, count(*) FILTER (WHERE event='poll' AND ok)/(1+ count(DISTINCT t_us//7200000000)*(1+ (ascii(collector[2])-48))/4e0) AS r FROM heartbeats GROUP BY 1)""")
def volume_agreement(t):
    g = t.heartbeats.groupBy("collector").agg(F.count_if((F.col("event") == "poll") & F.col("ok")).alias("polls"),
                                              F.count_distinct(F.expr("t_us div 7200000000")).alias("n"))
    files = 1 + F.col("n") * (1 + F.ascii(F.substring("collector", 2, 1)) - 48) / 4.0
    return g.select("collector", U.volume_agreement(files, F.col("polls")).alias("message"))


@query("feed_status", """WITH f AS (SELECT DISTINCT feed FROM ledger UNION ALL SELECT 'G99'), l AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY feed ORDER BY cycle DESC, event_id DESC)=1)
    SELECT feed, cycle, n_events, coalesce(outcome, 'no ledger row') AS status FROM f LEFT JOIN l USING (feed)""")
def feed_status(t):
    feeds = t.ledger.select("feed").distinct().union(t.spark.range(1).select(F.lit("G99").alias("feed")))
    return U.feed_status(feeds, t.ledger).select("feed", "cycle", "n_events", "status")

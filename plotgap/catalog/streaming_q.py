"""Streaming operators, run to the end over staged files; the batch rule is the oracle."""

from pyspark.sql import functions as F

from plotgap.catalog import query
from plotgap.catalog.functions_q import _subtype_sql
from plotgap.catalog.land_q import FEED_ZONES, PL, SPD, ZONE, polls
from plotgap.catalog.sources_q import EPOCH, scratch
from plotgap.operators import uptime as U
from plotgap.streaming import jobs as J


def staged(t, rows, order, parts=3):
    """Write rows as consecutive files in arrival order and read them back as a stream."""
    path = scratch(t, "in")
    top = rows.agg(F.max(order)).first()[0]
    edges = [(top + 1) * i // parts for i in range(parts + 1)]
    for lo, hi in zip(edges, edges[1:]):
        rows.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(path)
    return J.read_files(t.spark, path, rows.schema)


def drained(t, stream, mode="append"):
    out = scratch(t, "out")
    J.drain(stream, out, scratch(t, "ck"), mode)
    return t.spark.read.parquet(out)


def messages(t):
    k = F.col("event_id")
    static = F.col("event_type") == "signup"
    return t.e.select(
        F.when(k % 71 == 0, "0").otherwise(F.col("user_id").cast("string")).alias("mmsi"), k.alias("seq"), F.expr("t_us div 1000000").alias("t_s"), F.when(static, "static").otherwise("position").alias("kind"),
        F.when(k % 43 == 0, 91.0).otherwise(F.col("lat")).alias("lat"), F.col("lon").alias("lon"), F.when(k % 9 == 0, 102.3).otherwise((k % 30).cast("double")).alias("sog"), (k % 400).cast("double").alias("cog"),
        (k % 520).cast("double").alias("heading"), F.when(static & (k % 3 == 0), F.concat(F.lit("V"), k.cast("string"))).otherwise("").alias("name"), (k % 100).cast("int").alias("ship_type"),
        (k % 4 * 20).cast("double").alias("dim_a"), (k % 5 * 10).cast("double").alias("dim_b"), F.lit(5.0).alias("dim_c"), F.lit(5.0).alias("dim_d"), (k % 8 != 0).alias("valid"))


MSG = """ms AS (SELECT CAST(user_id AS VARCHAR) AS mmsi, event_id AS seq, t_us//1000000 AS t_s, event_type='signup' AS st, event_id%43<>0 AND event_type<>'signup' AS pos, event_type='signup' AND event_id%8<>0 AS said, lat, lon, CAST(event_id%30 AS DOUBLE) AS sog, CAST(event_id%400 AS DOUBLE) AS cog,
  CASE WHEN event_type='signup' AND event_id%3=0 THEN 'V' || event_id END AS name, CAST(event_id%100 AS INTEGER) AS ty, event_id%4*20e0+event_id%5*10e0 AS len FROM e WHERE event_id%71<>0 AND user_id<>0),
 fo AS (SELECT mmsi, arg_max(lat, seq) FILTER (WHERE pos) AS lat, arg_max(lon, seq) FILTER (WHERE pos) AS lon, arg_max(t_s, seq) FILTER (WHERE pos) AS t_s, arg_max(sog, seq) FILTER (WHERE pos AND seq%9<>0) AS sog_kn, arg_max(cog, seq) FILTER (WHERE pos AND cog<360) AS cog_deg,
  arg_max(name, seq) FILTER (WHERE (said OR pos) AND name IS NOT NULL) AS name, arg_max(ty, seq) FILTER (WHERE said AND ty<>0) AS ship_type, arg_max(len, seq) FILTER (WHERE said AND len>0) AS length_m, count(*) FILTER (WHERE pos) AS n_positions, min(t_s) AS first_s FROM ms GROUP BY 1)"""


def folded(t):
    return J.latest_state(drained(t, J.ais_stream_fold(staged(t, messages(t), "seq")), "update"))


@query("ais_stream_fold", f"WITH {MSG} SELECT * FROM fo")
def ais_stream_fold(t):
    return folded(t).select("mmsi", "lat", "lon", "t_s", "sog_kn", "cog_deg", "name", "ship_type", "length_m", "n_positions", "first_s")


@query("monotonic_dedupe", "SELECT seq, accepted FROM (SELECT seq, coalesce(t>max(t) OVER (PARTITION BY u ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM (SELECT user_id AS u, event_id AS seq, t_us//1000000+(event_id*7919)%4000 AS t FROM e))")
def monotonic_dedupe(t):
    r = t.e.select(F.col("user_id").cast("string").alias("mmsi"), F.col("event_id").alias("seq"), (F.expr("t_us div 1000000") + F.col("event_id") * 7919 % 4000).alias("t_s"))
    return drained(t, J.monotonic_dedupe(staged(t, r, "seq"), forget_s=None)).select("seq", "accepted")


@query("micro_batch_archive", "SELECT CAST(t_us//3600000000 AS BIGINT) AS hour_no, count(*) AS n FROM reports GROUP BY 1")
def micro_batch_archive(t):
    out = scratch(t, "arch")
    rows = t.reports.select("event_id", "platform_id", "t_us", "lat", "lon")
    J.micro_batch_archive(staged(t, rows, "event_id"), out, scratch(t, "ck"), "t_us", EPOCH, every=None).awaitTermination()
    day = F.unix_date(F.to_date(F.substring(F.col("hour").cast("string"), 1, 8), "yyyyMMdd")) - 19723
    return t.spark.read.parquet(out).groupBy((day * 24 + F.substring(F.col("hour").cast("string"), 9, 2).cast("int")).cast("bigint").alias("hour_no")).agg(F.count(F.lit(1)).alias("n"))


NOW_SQL = "(SELECT max(t_s)+60 FROM ms)"
SN = f"{MSG}, sn AS (SELECT *, {NOW_SQL}-t_s AS age_s, {NOW_SQL}-t_s>360 AS stale, {_subtype_sql().replace('code', 'ship_type')} AS subtype, coalesce(name, mmsi) AS label FROM fo WHERE t_s IS NOT NULL AND {NOW_SQL}-t_s<=3600)"


def snapshot(t):
    now = messages(t).where("mmsi <> '0'").agg(F.max("t_s") + 60).first()[0]
    return J.live_snapshot(folded(t), F.lit(now))


@query("live_snapshot", f"WITH {SN} SELECT mmsi, age_s, stale, subtype, label FROM sn")
def live_snapshot(t):
    return snapshot(t).select("mmsi", "age_s", "stale", "subtype", "label")


@query("live_filter", f"WITH {SN} SELECT subtype, count(*) AS n FROM sn WHERE lon BETWEEN -75.5e0 AND -73.5e0 AND lat BETWEEN 36.8e0 AND 38.2e0 GROUP BY 1")
def live_filter(t):
    return J.live_filter(snapshot(t), (-75.5, 36.8, -73.5, 38.2), ["cargo"], 5.0, 60.0, (-77.0, 36.0, -72.0, 39.0))[1]


@query("discovery_rate", f"""WITH {MSG}, sp AS (SELECT min(first_s) AS t0, max(first_s) AS t1 FROM fo), tk AS (SELECT t0, unnest(range(t0, t1+1, 5)) AS t FROM sp), r AS (SELECT t, t0, (SELECT count(*) FROM fo WHERE first_s<=t AND first_s>=t-60) AS n FROM tk),
    p AS (SELECT t, n, t-t0 AS ls, coalesce(max(CASE WHEN t-t0>=60 THEN n END) OVER (ORDER BY t), 0) AS peak FROM r) SELECT t, n AS per_min, peak, peak>0 AND n<=0.3e0*peak AND ls>=180 AS settled FROM p""")
def discovery_rate(t):
    m = staged(t, messages(t).where("mmsi <> '0'"), "seq")
    seen = J.latest_state(drained(t, J.first_seen(m), "update"))
    return J.discovery_rate(seen.select("mmsi", "first_s"), 5)


# a stream takes fixes as they arrive; only files can be put in order first
ARRIVING = SPD.replace("ORDER BY file, vehicle_ts, fetched_at, arrival", "ORDER BY arrival")


@query("speed_pair_stream", f"WITH {ARRIVING} SELECT arrival, reason, CASE WHEN reason='pairs' THEN round(v, 6) END AS speed_mps FROM p1 UNION ALL SELECT arrival, r1, NULL FROM f2 WHERE r1 IS NOT NULL UNION ALL SELECT arrival, r0, NULL FROM f0 WHERE r0 IS NOT NULL")
def speed_pair_stream(t):
    f = t.fixes.select("arrival", "feed_id", "vehicle_key", "vehicle_ts", "lat", "lon", "trip_id")
    return drained(t, J.speed_pair_stream(staged(t, f, "arrival"))).select("arrival", "reason", F.round("speed_mps", 6).alias("speed_mps"))


@query("cell_hour_stream", "SELECT feed_id, count(*) AS n_kept, 0 AS n_late FROM fixes WHERE vehicle_ts IS NOT NULL GROUP BY 1")
def cell_hour_stream(t):
    """All fixes lie within one open date here, so nothing may be late or lost."""
    out = scratch(t, "cells")
    f = staged(t, t.fixes.select("arrival", "feed_id", F.col("vehicle_ts").alias("mid_s")), "arrival")
    f.writeStream.option("checkpointLocation", scratch(t, "ck")).trigger(availableNow=True).foreachBatch(J.cell_hour_batches(out)).start().awaitTermination()
    late = t.spark.read.parquet(f"{out}/late").groupBy("feed_id").agg(F.sum("late").alias("n_late"))
    kept = t.spark.read.parquet(f"{out}/pairs").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return kept.join(late, "feed_id", "left").select("feed_id", "n_kept", F.coalesce("n_late", F.lit(0)).cast("int").alias("n_late"))


CLOSED = f"""{ARRIVING}, g0 AS (SELECT *, 864000+((pt+vehicle_ts)//2)*40 AS ck, (SELECT max(arrival)+1 FROM p1 WHERE reason='pairs') AS top FROM p1 WHERE reason='pairs'),
 g1 AS (SELECT *, ck-CASE WHEN arrival%53=0 THEN 172800 ELSE 0 END AS ms, {'+'.join(f'CAST(arrival>=top*{i}//4 AS INTEGER)' for i in (1, 2, 3))} AS b FROM g0),
 cu AS (SELECT b, max(CAST(make_timestamp((m-50400)*1000000) AS DATE)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM (SELECT b, max(ck) AS m FROM g1 GROUP BY 1)),
 g2 AS (SELECT *, timezone({ZONE}, make_timestamptz(ms*1000000)) AS lt, CAST(floor((pa+lat)/2/0.00225e0) AS BIGINT) AS cell_row FROM g1 JOIN cu USING (b) WHERE feed_id<>'F5'),
 g3 AS (SELECT *, CAST(floor((po+lon)/2*cos(radians((cell_row+0.5e0)*0.00225e0))/0.00225e0) AS BIGINT) AS cell_col, CAST(lt AS DATE) AS local_date, least(120, floor(v/0.5e0)) AS bin, coalesce(CAST(lt AS DATE)<cut, false) AS late FROM g2)"""


@query("cell_hours_closed", f"""WITH {CLOSED} SELECT cell_row, cell_col, CAST(local_date AS VARCHAR) AS local_date, CAST(hour(lt) AS INTEGER) AS local_hour, count(*) AS n_pairs, count(DISTINCT feed_id || '/' || vehicle_key) AS n_vehicles,
    array_to_string(list_sort(list_distinct(list(feed_id))), ',') AS feeds, (list_sort(list(bin))[CAST(floor(0.5e0*(count(*)-1)) AS BIGINT)+1]+0.5e0)*0.5e0 AS median_mps, (SELECT count(*) FROM g3 WHERE late) AS n_late
    FROM g3 WHERE NOT late GROUP BY 1, 2, 3, 4""")
def cell_hours_closed(t):
    """Two streams: fixes to pairs, pairs to closed dates. The clock is stretched to three days and some pairs are held back by two."""
    f = t.fixes.select("arrival", "feed_id", "vehicle_key", "vehicle_ts", "lat", "lon", "trip_id")
    good = drained(t, J.speed_pair_stream(staged(t, f, "arrival"))).where("reason = 'pairs'")
    clock = 864000 + F.col("mid_s") * 40
    good = good.select("arrival", "feed_id", "vehicle_key", "mid_lat", "mid_lon", "speed_mps", clock.alias("clock_s"),
                       (clock - F.when(F.col("arrival") % 53 == 0, 172800).otherwise(0)).alias("mid_s"))
    out = scratch(t, "closed")
    (staged(t, good, "arrival", 4).writeStream.option("checkpointLocation", scratch(t, "ck")).trigger(availableNow=True)
     .foreachBatch(J.cell_hour_closer(out, FEED_ZONES)).start().awaitTermination())
    J.close_rest(t.spark, out, FEED_ZONES)
    late = t.spark.read.parquet(f"{out}/late").agg(F.count(F.lit(1)).alias("n_late"))
    return t.spark.read.parquet(f"{out}/cells").join(F.broadcast(late)).select(
        "cell_row", "cell_col", F.col("local_date").cast("string").alias("local_date"), "local_hour", "n_pairs", "n_vehicles", "feeds", "median_mps", "n_late")


@query("new_fix_stream", f"WITH {PL} SELECT arrival, is_new FROM nf")
def new_fix_stream(t):
    return drained(t, J.new_fix_stream(staged(t, polls(t), "poll_no")))


@query("claim_change_stream", """SELECT event_id, CASE WHEN lag(body) OVER w IS NULL THEN 'first seen' WHEN body=lag(body) OVER w THEN 'unchanged' WHEN content IS NOT DISTINCT FROM lag(content) OVER w THEN 'envelope only' ELSE 'content changed' END AS change
    FROM ledger WHERE body IS NOT NULL WINDOW w AS (PARTITION BY feed ORDER BY event_id)""")
def claim_change_stream(t):
    return drained(t, J.claim_change_stream(staged(t, t.ledger.select("event_id", "feed", "content", "body"), "event_id"), 3)).select("event_id", "change")


LIVE = """ss AS (SELECT collector, session, min(t_us) AS started_us, max(t_us) AS last_us, max(t_us) FILTER (WHERE event='stop') AS ended_us, count(*) FILTER (WHERE event='poll') AS polls, count(*) FILTER (WHERE event='poll' AND NOT ok) AS failures FROM heartbeats GROUP BY 1, 2)"""


@query("liveness_stream", f"WITH {LIVE} SELECT * FROM ss")
def liveness_stream(t):
    beats = staged(t, t.heartbeats.select("event_id", "collector", "session", "event", "ok", "t_us"), "event_id")
    log = drained(t, J.liveness_stream(beats), "update").withColumn("_k", F.concat_ws("|", "collector", "session"))
    return J.latest_state(log, "_k", "last_us").drop("_k")


@query("liveness_uptime", f"WITH {LIVE}, up AS (SELECT collector, count(*) AS n_spans FROM (SELECT *, CASE WHEN lo<=max(hi) OVER (PARTITION BY collector ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM (SELECT collector, started_us AS lo, coalesce(ended_us, last_us) AS hi FROM ss)) WHERE nw=1 GROUP BY 1) SELECT * FROM up")
def liveness_uptime(t):
    return U.uptime_intervals(liveness_stream(t)).groupBy("collector").agg(F.count(F.lit(1)).alias("n_spans"))

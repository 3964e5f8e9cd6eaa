"""Sources and sinks, exercised over files written from the derived tables."""

import struct
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.catalog.land_q import day_cells
from plotgap.operators import detectors as D
from plotgap.plans.components import ensure_checkpoint_dir
from plotgap.sources import documents as S
from plotgap.sources import positions as P
from plotgap.sources import sinks as K

EPOCH = 1_704_067_200_000_000
BOX = (-75.5, 36.8, -73.5, 38.2)
INBOX = "lon BETWEEN -75.5e0 AND -73.5e0 AND lat BETWEEN 36.8e0 AND 38.2e0"


def scratch(t, name):
    """A fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/scratch/{name}-{uuid.uuid4().hex}"


def ais(t):
    """Ship rows as a receiver stores them, with 'not available' values mixed in."""
    k = F.col("event_id")
    when = F.timestamp_micros(F.floor((F.col("t_us") + EPOCH) / 1_000_000) * 1_000_000)
    return t.e.select(
        F.when(k % 97 == 0, " ").otherwise(F.concat(F.lit("36"), F.col("pid").cast("string"))).alias("MMSI"), when.alias("BaseDateTime"),
        F.when(k % 53 == 0, 91.0).otherwise(F.col("lat")).alias("LAT"), F.col("lon").alias("LON"),
        F.when(k % 10 == 0, 102.3).when(k % 10 == 1, 75.0).otherwise(F.col("pid") * 1.0).alias("SOG"), F.when(k % 6 == 0, 360.0).otherwise((k % 360).cast("double")).alias("COG"),
        F.when(k % 12 == 0, 511.0).otherwise((k % 180).cast("double")).alias("Heading"), F.concat(F.lit(" N"), F.col("pid").cast("string")).alias("VesselName"),
        F.lit(None).cast("string").alias("IMO"), F.lit(None).cast("string").alias("CallSign"), (k % 100).cast("int").alias("VesselType"), (k % 9).cast("int").alias("Status"),
        F.when(k % 5 == 0, 0.0).otherwise((k % 300).cast("double")).alias("Length"), F.lit(10.0).alias("Width"), F.lit(-1.0).alias("Draft"), F.lit(None).cast("int").alias("Cargo"),
        F.lit("A").alias("TransceiverClass"), k.alias("event_id"))


def stored_ais(t):
    path = scratch(t, "ais")
    rows = ais(t).drop("event_id").withColumn("_t", F.unix_micros("BaseDateTime"))
    K.write_hour_partitioned(rows, path, "_t", ["MMSI", "_t"])
    return path


T0, T1 = 20_000_000_000, 150_000_000_000
AIS = "ai AS (SELECT CASE WHEN event_id%97=0 THEN ' ' ELSE '36' || pid END AS mmsi, (t_us//1000000)*1000000 AS ts, CASE WHEN event_id%53=0 THEN 91e0 ELSE lat END AS la, lon, lat, event_id, pid FROM e)"


@query("scan_ais", f"WITH {AIS} SELECT mmsi AS \"MMSI\", count(*) AS n, min(ts) AS first_us FROM ai WHERE ts BETWEEN {T0} AND {T1} AND lon BETWEEN -75.5e0 AND -73.5e0 AND la BETWEEN 36.8e0 AND 38.2e0 GROUP BY 1")
def scan_ais(t):
    got = P.scan_ais(t.spark, stored_ais(t), EPOCH + T0, EPOCH + T1, BOX, hour_partitioned=True)
    return got.groupBy("MMSI").agg(F.count(F.lit(1)).alias("n"), (F.min(F.unix_micros("BaseDateTime")) - EPOCH).alias("first_us"))


@query("clean_ais", f"""WITH {AIS} SELECT mmsi AS platform_id, count(*) AS n, count(sp) AS n_speed, round(sum(sp), 6) AS speed, count(hd) AS n_heading, sum(hd) AS heading, count(ln) AS n_length, min(vn) AS name FROM (SELECT mmsi, CASE WHEN event_id%10<2 THEN NULL ELSE CASE WHEN pid<=60 THEN pid*0.514444e0 END END AS sp,
    CASE WHEN event_id%6<>0 THEN CAST(event_id%360 AS DOUBLE) WHEN event_id%12<>0 THEN CAST(event_id%180 AS DOUBLE) END AS hd, CASE WHEN event_id%5<>0 AND event_id%300>0 THEN 1 END AS ln, 'N' || pid AS vn FROM ai WHERE trim(mmsi)<>'' AND la<=90) GROUP BY 1""")
def clean_ais(t):
    c = P.clean_ais(ais(t))
    return c.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n"), F.count("speed_mps").alias("n_speed"), F.round(F.sum("speed_mps"), 6).alias("speed"), F.count("heading_deg").alias("n_heading"),
                                        F.sum("heading_deg").alias("heading"), F.count("length_m").alias("n_length"), F.min("name").alias("name"))


@query("store_overlap_guard", "SELECT count(*) AS n FROM e")
def store_overlap_guard(t):
    return P.store_overlap_guard(ais(t).withColumn("dataset", F.lit("maritime-live"))).agg(F.count(F.lit(1)).alias("n"))


@query("clip_bulk_csv", f"WITH {AIS} SELECT count(*) AS rows_in, count(*) FILTER (WHERE lon BETWEEN -75.5e0 AND -73.5e0 AND la BETWEEN 36.8e0 AND 38.2e0) AS rows_kept FROM ai")
def clip_bulk_csv(t):
    src, out = scratch(t, "csv"), scratch(t, "clip")
    ais(t).drop("event_id").write.option("header", True).csv(src)
    _, counts = P.clip_bulk_csv(t.spark, src, BOX, out)
    back = t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("_kept"))
    return counts.join(F.broadcast(back), F.col("_kept") == F.col("rows_kept")).select("rows_in", "rows_kept")


@F.pandas_udf(BinaryType())
def _wkb(lon: pd.Series, lat: pd.Series, k: pd.Series) -> pd.Series:
    out = []
    for x, y, i in zip(lon, lat, k):
        little, bad = i % 2 == 0, i % 41 == 0
        out.append(b"\x01\x02" if bad else struct.pack("<BIdd" if little else ">BIdd", 1 if little else 0, 1, x, y))
    return pd.Series(out)


@query("clip_bulk_geoparquet", f"SELECT count(*) AS rows_in, count(*) FILTER (WHERE event_id%41<>0 AND {INBOX}) AS rows_kept, count(*) FILTER (WHERE event_id%41=0) AS undecodable FROM e")
def clip_bulk_geoparquet(t):
    return P.clip_geo_points(t.e.select("event_id", _wkb("lon", "lat", "event_id").alias("geometry")), "geometry", BOX)[1]


def states_table(t):
    k = F.col("event_id")
    s = F.expr("t_us div 1000000") + EPOCH // 1_000_000
    return t.aircraft.select(
        F.timestamp_seconds(s).alias("fetched_at"), F.col("hex").alias("icao24"), F.lit("CS").alias("callsign"), F.lit("US").alias("origin_country"), F.when(k % 7 != 0, s - 1).alias("time_position"),
        s.alias("last_contact"), F.when(k % 37 != 0, F.col("lon")).alias("longitude"), F.when(k % 37 != 0, F.col("lat")).alias("latitude"), (F.col("alt_m") + 50).alias("baro_altitude"), "on_ground",
        (k % 250).cast("double").alias("velocity"), (k % 360).cast("double").alias("true_track"), F.lit(0.0).alias("vertical_rate"), F.when(k % 3 == 0, F.col("alt_m")).alias("geo_altitude"),
        F.lit("1200").alias("squawk"), F.lit(False).alias("spi"), F.lit(0).alias("position_source"))


@query("scan_adsb", f"SELECT hex AS icao24, count(*) AS n FROM aircraft WHERE event_id%37<>0 AND NOT on_ground AND {INBOX} AND t_us//1000000 BETWEEN 20000 AND 150000 GROUP BY 1")
def scan_adsb(t):
    path, base = scratch(t, "adsb"), EPOCH // 1_000_000
    states_table(t).write.parquet(path)
    return P.scan_adsb(t.spark, path, base + 20_000, base + 150_000, BOX).groupBy("icao24").agg(F.count(F.lit(1)).alias("n"))


@query("adsb_to_reports", f"SELECT hex AS platform_id, count(*) AS n, CAST(sum(t_us//1000000-CASE WHEN event_id%7<>0 THEN 1 ELSE 0 END) AS BIGINT) AS st, sum(CASE WHEN event_id%3=0 THEN coalesce(alt_m, alt_m+50) ELSE alt_m+50 END) AS alt FROM aircraft WHERE event_id%37<>0 AND NOT on_ground GROUP BY 1")
def adsb_to_reports(t):
    r = P.adsb_to_reports(states_table(t))
    return r.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"(t_us - {EPOCH}) div 1000000")).alias("st"), F.sum("alt_m").alias("alt"))


@query("state_vector_unpack", "SELECT poll AS fetched_s, hex AS icao24, lon AS longitude, lat AS latitude, on_ground, alt_m AS geo_altitude, event_id AS last_contact FROM aircraft")
def state_vector_unpack(t):
    txt = F.to_json(F.array("longitude", "latitude"))  # numbers keep every digit in JSON
    q = F.concat_ws(",", F.concat(F.lit('"'), F.col("hex"), F.lit('"')), F.lit('"CS"'), F.lit('"US"'), F.lit("null"), F.col("event_id").cast("string"), F.regexp_extract(txt, r"\[(.*),", 1),
                    F.regexp_extract(txt, r",(.*)\]", 1), F.lit("null"), F.col("on_ground").cast("string"), F.lit("null,null,null,null"), F.coalesce(F.col("alt_m").cast("string"), F.lit("null")), F.lit("null,false,0,1"))
    rows = t.aircraft.withColumn("longitude", F.col("lon")).withColumn("latitude", F.col("lat")).select("poll", F.expr("event_id div 50").alias("g"), F.concat(F.lit("["), q, F.lit("]")).alias("s"))
    bodies = rows.groupBy("poll", "g").agg(F.array_join(F.collect_list("s"), ",").alias("s")).select(F.concat(F.lit('{"time":'), F.col("poll").cast("string"), F.lit(',"states":['), F.col("s"), F.lit("]}")).alias("body"))
    return P.state_vector_unpack(bodies).select("fetched_s", "icao24", "longitude", "latitude", "on_ground", "geo_altitude", "last_contact")


@query("scan_independent_air", "SELECT hex, type, lat, lon, TRY_CAST(alt_baro AS INTEGER) AS alt_ft, event_id AS messages, CASE WHEN event_id%2=0 THEN '{\"odd\":\"x\"}' END AS extra FROM aircraft")
def scan_independent_air(t):
    k = F.col("event_id")
    a = F.to_json(F.struct(F.concat(F.lit(" "), F.col("hex")).alias("hex"), "type", "lat", "lon", "alt_baro", k.alias("messages"), F.when(k % 2 == 0, "x").alias("odd")))
    bodies = t.aircraft.select("poll", F.expr("event_id div 50").alias("g"), a.alias("a")).groupBy("poll", "g").agg(F.array_join(F.collect_list("a"), ",").alias("a")).select(
        F.concat(F.lit('{"now":'), F.col("poll").cast("string"), F.lit(',"aircraft":['), F.col("a"), F.lit("]}")).alias("body"))
    return P.scan_independent_air(bodies).select("hex", "type", "lat", "lon", "alt_ft", "messages", "extra")


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _part(number, body):
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _encode(batches):
    """Bodies of GTFS-realtime messages from fix rows (fixture only)."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):  # a few bodies at a time become Python objects
            some, out = b.slice(lo, 64), []
            for arr, at in zip(some.column("rows"), some.column("fetched_at").to_pylist()):
                body = _part(1, _varint(3 << 3) + _varint(int(at)))
                for r in arr.as_py():
                    pos = b"" if r["k"] % 9 == 0 else _part(2, struct.pack("<BfBf", 13, r["lat"], 21, r["lon"]))
                    veh = b"" if r["key"].startswith("entity:") else _part(8, _part(1, r["key"].encode()))
                    ts = b"" if r["ts"] is None else _varint(5 << 3) + _varint(int(r["ts"]))
                    body += _part(2, _part(1, str(r["k"]).encode()) + _part(4, pos + ts + veh))
                out.append(body)
            yield pa.RecordBatch.from_arrays([some.column("feed_id"), some.column("fetched_at"), pa.array(out, pa.binary())], ["feed_id", "fetched_at", "body"])


@query("gtfsrt_positions", "SELECT feed_id, vehicle_key, count(*) AS n, CAST(sum(vehicle_ts) AS BIGINT) AS ts, round(sum(lat), 2) AS lat FROM (SELECT feed_id, CASE WHEN vehicle_key LIKE 'entity:%' THEN 'entity:' || arrival ELSE vehicle_key END AS vehicle_key, vehicle_ts, CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat FROM fixes WHERE arrival%9<>0) GROUP BY 1, 2")
def gtfsrt_positions(t):
    one = F.struct(F.col("arrival").alias("k"), F.col("vehicle_key").alias("key"), F.col("vehicle_ts").alias("ts"), "lat", "lon")
    grouped = t.fixes.groupBy("feed_id", F.expr("arrival div 300").alias("fetched_at")).agg(F.collect_list(one).alias("rows"))
    placed, _ = P.gtfsrt_positions(grouped.mapInArrow(_encode, "feed_id string, fetched_at bigint, body binary"))
    return placed.groupBy("feed_id", "vehicle_key").agg(F.count(F.lit(1)).alias("n"), F.sum("vehicle_ts").alias("ts"), F.round(F.sum("lat"), 2).alias("lat"))


@query("institutional_fleet_union", """SELECT fleet, vehicle_id, round(heading_deg, 6) AS heading_deg, round(speed_mps, 6) AS speed_mps, ts FROM (SELECT 'train' AS fleet, CAST(event_id AS VARCHAR) AS vehicle_id, CASE event_id%4 WHEN 0 THEN 0e0 WHEN 1 THEN 90e0 WHEN 2 THEN 225e0 END AS heading_deg, (event_id%80)*0.44704e0 AS speed_mps, event_id AS ts FROM e WHERE event_type IN ('view', 'purchase')
    UNION ALL SELECT 'plow', CAST(event_id AS VARCHAR), CASE WHEN event_id%3>0 THEN CAST(event_id%360 AS DOUBLE) END, (event_id%40)*0.44704e0, 1700000000+event_id FROM e WHERE event_type NOT IN ('view', 'purchase', 'error') UNION ALL SELECT 'rail', 'rn-' || event_id, CAST(event_id%360 AS DOUBLE), NULL, event_id FROM e WHERE event_type='error' AND event_id%6>0)""")
def institutional_fleet_union(t):
    k = F.col("event_id")
    trains = t.e.where("event_type IN ('view', 'purchase')").select(k.alias("id"), "lon", "lat", F.when(k % 4 == 0, "n").when(k % 4 == 1, "E").when(k % 4 == 2, "SW").alias("compass"), (k % 80).cast("double").alias("mph"), k.alias("updated_s"), F.lit("Active").alias("state"))
    stamp = F.lit(1_700_000_000) + k
    plows = t.e.where("event_type NOT IN ('view', 'purchase', 'error')").select(k.alias("id"), "lon", "lat", F.when(k % 3 > 0, (k % 360).cast("string")).otherwise("north").alias("heading"), (k % 40).cast("string").alias("mph"), F.when(k % 2 == 0, stamp * 1000).otherwise(stamp).alias("stamp"))
    rail = t.e.where("event_type = 'error'").select(k.alias("run"), F.when(k % 6 > 0, F.col("lon").cast("string")).otherwise("?").alias("lon"), F.col("lat").cast("string").alias("lat"), (k % 360).cast("string").alias("heading"), k.alias("seen_s"))
    u = P.institutional_fleet_union(trains, plows, rail)
    return u.select("fleet", "vehicle_id", F.round("heading_deg", 6).alias("heading_deg"), F.round("speed_mps", 6).alias("speed_mps"), "ts")


# ---- documents ---------------------------------------------------------------------------


@query("wzdx_events", "SELECT 'G' || (user_id%12) AS feed, 'wz' || event_id AS event_id, 'Road ' || pid AS road, CASE WHEN event_id%2=0 THEN 'northbound' ELSE 'south' END AS direction, event_type AS impact FROM e")
def wzdx_events(t):
    k = F.col("event_id")
    road, new = F.array(F.concat(F.lit("Road "), F.col("pid").cast("string"))), k % 2 == 0
    props = F.struct(F.when(new, F.struct(road.alias("road_names"), F.lit("northbound").alias("direction"))).alias("core_details"), F.when(~new, road[0]).alias("road_name"),
                     F.when(~new, "south").alias("direction"), F.col("event_type").alias("vehicle_impact"))
    feat = F.to_json(F.struct(F.concat(F.lit("wz"), k.cast("string")).alias("id"), props.alias("properties")))
    feed = F.concat(F.lit("G"), (F.col("user_id") % 12).cast("string"))
    bodies = t.e.groupBy(feed.alias("feed"), F.expr("event_id div 200").alias("g")).agg(F.array_join(F.collect_list(feat), ",").alias("f")).select(
        "feed", F.concat(F.lit('{"feed_info":{"version":"4.1"},"features":['), F.col("f"), F.lit("]}")).alias("body"))
    return S.wzdx_events(bodies).select("feed", "event_id", "road", "direction", "impact")


@query("lines_to_segments", """WITH v AS (SELECT event_id//8 AS id, event_id, lon, lat, lead(lon) OVER (PARTITION BY event_id//8 ORDER BY event_id) AS x1, lead(lat) OVER (PARTITION BY event_id//8 ORDER BY event_id) AS y1 FROM e) SELECT id, round(lon, 6) AS x0, round(lat, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM v WHERE x1 IS NOT NULL""")
def lines_to_segments(t):
    pts = t.e.groupBy(F.expr("event_id div 8").alias("id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))).alias("c"))
    k = F.col("id") % 4
    geo = (F.when(k == 0, F.concat(F.lit('{"type":"LineString","coordinates":'), F.col("c"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"type":"MultiLineString","coordinates":['), F.col("c"), F.lit("]}")))
           .when(k == 2, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), F.col("c"), F.lit("]]}")))
           .otherwise(F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[0,0]},{"type":"LineString","coordinates":'), F.col("c"), F.lit("}]}"))))
    return S.lines_to_segments(pts.select("id", geo.alias("geometry"))).select("id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("heartbeats_scan", "SELECT collector, count(*) AS n, count(*) FILTER (WHERE event='poll' AND NOT ok) AS failed, (SELECT count(*) FROM heartbeats WHERE event_id%10=0) AS n_broken FROM heartbeats WHERE event_id%10<>0 GROUP BY 1")
def heartbeats_scan(t):
    path = scratch(t, "beats")
    line = F.to_json(F.struct(F.expr("t_us div 1000000").alias("t"), "event", "collector", "session", "ok", "error"))
    t.heartbeats.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    rows, counts = S.heartbeats_scan(t.spark, path)
    return rows.groupBy("collector").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("event") == "poll") & ~F.col("ok")).alias("failed")).join(F.broadcast(counts.select("n_broken")))


NOW = 1_704_067_200 + 90_000
XE = f"""xe AS (SELECT 'R' || (user_id%5) AS feed, event_id AS seq, CASE WHEN event_id%9=0 THEN NULL ELSE 'E' || (event_id//2) END AS id, CASE event_id%3 WHEN 0 THEN 'roadwork' WHEN 1 THEN 'incident' ELSE 'weather' END AS kind, 1704067200+t_us//1000000 AS s,
  event_id%13=0 AS ended, event_id%11=0 AS noplace, event_id%4=0 AS open, event_id%2=0 AS line FROM e),
 xk AS (SELECT feed, coalesce(id, feed || '-' || seq) AS id, seq, kind, line, s AS start_s, CASE WHEN open THEN NULL ELSE s+7200 END AS end_s, s+60 AS updated_s FROM xe WHERE NOT ended AND NOT noplace AND (open OR s+7200>={NOW}))"""


@query("road_event_feed", f"WITH {XE} SELECT feed, id, kind, line AS is_line, start_s, end_s, updated_s, start_s>{NOW} AS planned FROM xk QUALIFY row_number() OVER (PARTITION BY feed, id ORDER BY seq)=1")
def road_event_feed(t):
    k, s = F.col("event_id"), F.expr("t_us div 1000000") + EPOCH // 1_000_000
    def stamp(tag, sec):
        local = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        when = F.timestamp_add("SECOND", (sec - 5 * 3600).cast("int"), local)
        return F.concat(F.lit(f"<{tag}><date>"), F.date_format(when, "yyyyMMdd"), F.lit("</date><time>"), F.date_format(when, "HHmmss"), F.lit(f"</time><utc-offset>-0500</utc-offset></{tag}>"))
    def place(tag, dx):
        return F.concat(F.lit(f"<{tag}><geo-location><latitude>"), F.round(F.col("lat") * 1e6).cast("bigint").cast("string"), F.lit("</latitude><longitude>"), F.round((F.col("lon") + dx) * 1e6).cast("bigint").cast("string"), F.lit(f"</longitude></geo-location></{tag}>"))
    link = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("<location><location-on-link><route-designator>I-95</route-designator>"), place("primary-location", 0.0), F.when(k % 2 == 0, place("secondary-location", 0.01)).otherwise(F.lit("")), F.lit("</location-on-link></location>")))
    typ = F.when(k % 3 == 0, "roadwork").when(k % 3 == 1, "incident").otherwise("wind")
    xml = F.concat(F.lit('<full-event-update xmlns="urn:x"><event-indicators><event-indicator><status>'), F.when(k % 13 == 0, "Ended").otherwise("new"), F.lit("</status></event-indicator></event-indicators>"),
                   F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("<event-reference><event-id>E"), F.expr("event_id div 2").cast("string"), F.lit("</event-id></event-reference>"))),
                   F.lit("<headline><headline><"), typ, F.lit(">words</"), typ, F.lit("></headline></headline><details><detail><locations>"), link, F.lit("</locations><times>"), stamp("update-time", s + 60), stamp("start-time", s),
                   F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("<valid-period>"), stamp("end-time", s + 7200), F.lit("</valid-period>"))).otherwise(F.concat(F.lit("<valid-period><duration>"), F.lit("119"), F.lit("</duration></valid-period>"))),
                   F.lit("</times></detail></details></full-event-update>"))
    msgs = t.e.select(F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("feed"), k.alias("seq"), xml.alias("xml"))
    return S.road_event_feed(msgs, NOW)[0].select("feed", "id", "kind", "is_line", "start_s", "end_s", "updated_s", "planned")


@query("layer_page_merge", "SELECT count(*) AS n FROM events")
def layer_page_merge(t):
    pages = t.e.select(F.col("event_id").alias("object_id"), F.expr("event_id div 1000").alias("page"))
    return S.layer_page_merge(pages, t.e.count()).agg(F.count(F.lit(1)).alias("n"))


@query("layer_cross_check", "SELECT count(*) FILTER (WHERE l AND r) AS both, count(*) FILTER (WHERE l AND NOT r) AS left_only, count(*) FILTER (WHERE r AND NOT l) AS right_only FROM (SELECT user_id, bool_or(event_type='error') AS l, bool_or(value>98) AS r FROM e GROUP BY 1) WHERE l OR r")
def layer_cross_check(t):
    return S.layer_cross_check(t.e.where("event_type = 'error'").select("user_id"), t.e.where("value > 98").select("user_id"), "user_id")


@query("layer_describe", "SELECT count(*) AS n, count(*) FILTER (WHERE NOT ok) AS without_usable_point, min(lon) FILTER (WHERE ok) AS west, min(lat) FILTER (WHERE ok) AS south, max(lon) FILTER (WHERE ok) AS east, max(lat) FILTER (WHERE ok) AS north, count(*) FILTER (WHERE event_id%4=0) AS null_trip_id FROM (SELECT *, event_id%17<>0 AND event_id%19<>0 AS ok FROM e)")
def layer_describe(t):
    k = F.col("event_id")
    f = t.e.select(F.when(k % 17 == 0, "LineString").otherwise("Point").alias("geometry_type"), F.when(k % 19 != 0, F.col("lon")).alias("lon"), "lat", F.when(k % 4 != 0, "T").alias("trip_id"))
    return S.layer_describe(f, ["trip_id"])


# ---- sinks -------------------------------------------------------------------------------


@query("sink_hour_partitioned", "SELECT CAST(t_us//3600000000 AS BIGINT) AS hour_no, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM reports GROUP BY 1")
def sink_hour_partitioned(t):
    path = scratch(t, "hours")
    K.write_hour_partitioned(t.reports.select("event_id", "platform_id", "t_us", "lat", "lon"), path, "t_us", ["platform_id", "t_us"], EPOCH)
    day = F.unix_date(F.to_date(F.substring(F.col("hour").cast("string"), 1, 8), "yyyyMMdd")) - 19723
    return t.spark.read.parquet(path).groupBy((day * 24 + F.substring(F.col("hour").cast("string"), 9, 2).cast("int")).cast("bigint").alias("hour_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("sink_cell_hours", "SELECT local_date, count(*) AS n FROM (SELECT DISTINCT CAST(floor(round(lat/5e-1, 9)) AS BIGINT) AS a, CAST(floor(round(lon/5e-1, 9)) AS BIGINT) AS b, CAST(raw_us//86400000000 AS INTEGER) AS local_date, event_id%4 AS h FROM e) GROUP BY 1")
def sink_cell_hours(t):
    path = scratch(t, "cells")
    K.write_cell_hours(day_cells(t), path)
    return t.spark.read.parquet(path).groupBy(F.col("local_date").cast("int").alias("local_date")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_events_geojson", f"SELECT platform_id, count(*) AS n FROM (SELECT platform_id, {d.hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS dist, (t_us-lag(t_us) OVER w)/1e6 AS dt FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY platform_id, t_us ORDER BY event_id)=1) WINDOW w AS (PARTITION BY platform_id ORDER BY t_us)) WHERE greatest(0, dist-sqrt(800e0))/dt/26e0>1.1e0 GROUP BY 1")
def sink_events_geojson(t):
    from plotgap.operators.tracks import first_per_instant
    path = scratch(t, "events")
    K.write_events(D.impossible_speed(D.steps(first_per_instant(t.reports)), "sea"), path)
    back = t.spark.read.text(path)
    return back.groupBy(F.get_json_object("value", "$.properties.platform_id").alias("platform_id")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_ledger_append", "SELECT feed, 2*count(*) AS n FROM ledger GROUP BY 1")
def sink_ledger_append(t):
    path = scratch(t, "ledger")
    for _ in range(2):
        K.append_ledger(t.ledger, path)
    return t.spark.read.parquet(path).groupBy("feed").agg(F.count(F.lit(1)).alias("n"))

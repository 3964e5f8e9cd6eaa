"""Document sources: work zones, road events, lines, layers and heartbeat logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WZDX = """feed_info struct<version: string, update_date: string>, features array<struct<id: string, geometry: struct<type: string, coordinates: string>,
  properties: struct<core_details: struct<road_names: array<string>, direction: string, update_date: string>, road_names: array<string>, road_name: string, direction: string,
  vehicle_impact: string, start_date: string, end_date: string, event_status: string>>>"""


def wzdx_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per declared event; 4.x fields from core_details, else the 3.x ones."""
    doc = F.from_json(body, WZDX)
    rows = bodies.select("feed", doc["feed_info"]["version"].alias("version"), F.explode(doc["features"]).alias("f"))
    p, core = F.col("f.properties"), F.col("f.properties.core_details")
    names = F.coalesce(core["road_names"], p["road_names"], F.when(p["road_name"].isNotNull(), F.array(p["road_name"])))
    return rows.select("feed", "version", F.col("f.id").alias("event_id"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("road"),
                       F.coalesce(core["direction"], p["direction"], F.lit("")).alias("direction"), F.coalesce(p["vehicle_impact"], F.lit("")).alias("impact"),
                       p["start_date"].alias("start"), p["end_date"].alias("end"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def lines_to_segments(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Consecutive vertex pairs of every line in GeoJSON geometries; rings count as lines.

    Collections are opened first; each vertex list is paired with itself shifted by one.
    """
    kind = F.get_json_object(geometry, "$.type")
    parts = F.when(kind == "GeometryCollection", F.transform(F.from_json(F.get_json_object(geometry, "$.geometries"), "array<variant>"), lambda g: F.to_json(g))).otherwise(F.array(F.col(geometry)))
    one = features.withColumn("_g", F.explode(parts))
    shape, coords = F.get_json_object("_g", "$.type"), F.get_json_object("_g", "$.coordinates")
    deep1, deep2, deep3 = (F.from_json(coords, f"{'array<' * n}double{'>' * n}") for n in (2, 3, 4))
    runs = (F.when(shape == "LineString", F.array(deep1)).when(shape.isin("MultiLineString", "Polygon"), deep2)
            .when(shape == "MultiPolygon", F.flatten(deep3)))
    lines = one.withColumn("_run", F.explode(runs)).drop("_g")
    pairs = F.arrays_zip(F.slice("_run", 1, F.greatest(F.size("_run") - 1, F.lit(0))).alias("p"), F.slice("_run", 2, F.greatest(F.size("_run") - 1, F.lit(0))).alias("q"))
    return (lines.select(*[c for c in features.columns if c != geometry], F.posexplode(pairs).alias("j", "s"))
            .select(*[c for c in features.columns if c != geometry], "j", F.col("s.p")[0].alias("x0"), F.col("s.p")[1].alias("y0"), F.col("s.q")[0].alias("x1"), F.col("s.q")[1].alias("y1")))


HEARTBEAT = "t bigint, iso string, event string, collector string, session string, ok boolean, n bigint, error string, interval_s double, reason string, polls bigint, failures bigint"


def heartbeats_scan(spark: SparkSession, path: str, collector: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counts of good and broken lines) of a JSON-lines log; a torn line never stops the scan."""
    schema = T.StructType.fromDDL(HEARTBEAT + ", _corrupt string")
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = F.col("r._corrupt").isNull() & F.col("r.t").isNotNull()
    counts = parsed.agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_broken"))
    rows = parsed.where(good).select("r.*").drop("_corrupt")
    return (rows if collector is None else rows.where(F.col("collector") == collector)), counts


# Headline type to kind of road event.
KIND_OF_TYPE = {
    "incident": "incident", "obstruction": "incident", "unusual-driving": "incident", "mobile-situation": "incident", "disaster": "incident", "disturbance": "incident",
    "closure": "closure", "roadwork": "roadwork",
    "restriction": "restriction", "winter-driving-restriction": "restriction", "cdot-osow-restrictions": "restriction",
    "weather-condition": "weather", "precipitation": "weather", "wind": "weather", "visibility-air-quality": "weather", "temperature": "weather",
    "pavement-condition": "weather", "winter-driving-index": "weather", "mdss-conditions": "weather", "mdss-weather-conditions": "weather", "nws-warning": "weather",
    "cdot-road-conditions": "weather", "ma-road-conditions": "weather",
    "traffic-condition": "traffic", "delay": "traffic", "special-event": "event", "sporting-event": "event", "activity": "event", "parking-information": "event",
}
_TEXT = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k.replace("_", "-"), v) for k, v in fields.items()])


_STAMP = _struct(date=_TEXT, time=_TEXT, utc_offset=_TEXT)
_PLACE = _struct(geo_location=_struct(latitude=_TEXT, longitude=_TEXT))
_LINK = _struct(route_designator=_TEXT, link_direction=_TEXT, primary_location=_PLACE, secondary_location=_PLACE)
FEU_SCHEMA = _struct(
    event_indicators=_struct(event_indicator=T.ArrayType(_struct(status=_TEXT))), event_reference=_struct(event_id=_TEXT),
    headline=T.StructType([T.StructField("headline", T.StructType([T.StructField(k, _TEXT) for k in KIND_OF_TYPE]))]),
    details=_struct(detail=T.ArrayType(_struct(
        locations=_struct(location=T.ArrayType(_struct(location_on_link=_LINK))),
        times=_struct(update_time=_STAMP, start_time=_STAMP, valid_period=_struct(end_time=_STAMP, duration=_TEXT))))))


def _when(s: Column) -> Column:
    """Epoch seconds of a local date, time and offset; null when any part is malformed."""
    off = s["utc-offset"]
    sign = F.when(off.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(off, "[^0-9]", "")
    shift = sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)
    ok = s["date"].rlike(r"^\d{8}$") & s["time"].rlike(r"^\d{4}(\d{2})?$") & off.rlike(r"^[+-]\d{2}:?\d{2}$")
    t = F.rpad(s["time"], 6, "0")
    day = F.try_to_timestamp(s["date"], F.lit("yyyyMMdd")).cast("date")
    clock = F.substring(t, 1, 2).cast("int") * 3600 + F.substring(t, 3, 2).cast("int") * 60 + F.substring(t, 5, 2).cast("int")
    return F.when(ok, F.unix_date(day).cast("bigint") * 86400 + clock - shift)


def _micro(p: Column) -> Column:
    g = p["geo-location"]
    lat, lon = g["latitude"].try_cast("bigint") / 1e6, g["longitude"].try_cast("bigint") / 1e6
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(ok, F.struct(lon.alias("lon"), lat.alias("lat")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column as a generated one, so that neither filters nor projections above work it out again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def road_event_feed(messages: DataFrame, now_s: int, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(current road events, counts) from one XML full-event-update per row.

    Ended, expired and place-less events are dropped and counted; start is the earliest
    stated, updated the latest, end the latest or start (or update) plus the duration.
    """
    doc = F.from_xml(xml, FEU_SCHEMA, {"ignoreNamespace": "true"})
    e = _once(messages, "e", doc)
    details = F.coalesce(F.col("e.details.detail"), F.array().cast(FEU_SCHEMA["details"].dataType["detail"].dataType))
    statuses = F.transform(F.col("e")["event-indicators"]["event-indicator"], lambda i: F.lower(i["status"]))
    up, st = F.transform(details, lambda d: _when(d["times"]["update-time"])), F.transform(details, lambda d: _when(d["times"]["start-time"]))

    def end_of(d):
        stated, minutes = _when(d["times"]["valid-period"]["end-time"]), d["times"]["valid-period"]["duration"].try_cast("int") * 60
        s, u = _when(d["times"]["start-time"]), _when(d["times"]["update-time"])
        base = F.when(s.isNotNull() & (u.isNull() | (s > u)), s).otherwise(u)
        return F.coalesce(stated, base + minutes)
    links = F.flatten(F.transform(details, lambda d: F.transform(F.coalesce(d["locations"]["location"], F.array().cast(T.ArrayType(_struct(location_on_link=_LINK)))), lambda l: l["location-on-link"])))
    spots = F.transform(links, lambda l: F.struct(_micro(l["primary-location"]).alias("a"), _micro(l["secondary-location"]).alias("b"), l["route-designator"].alias("road"), l["link-direction"].alias("direction")))
    place = F.try_element_at(F.filter(spots, lambda s: s["a"].isNotNull() | s["b"].isNotNull()), F.lit(1))
    kind, typ = F.lit("other"), F.lit(None).cast("string")
    for k, v in reversed(KIND_OF_TYPE.items()):
        has = F.col("e")["headline"]["headline"][k].isNotNull()
        kind, typ = F.when(has, v).otherwise(kind), F.when(has, k).otherwise(typ)
    rows = _once(e, "r", F.struct("feed", "seq", F.nullif(F.col("e")["event-reference"]["event-id"], F.lit("")).alias("id"), kind.alias("kind"), typ.alias("type"), place.alias("place"),
                    F.array_min(st).alias("start_s"), F.array_max(F.transform(details, end_of)).alias("end_s"), F.array_max(up).alias("updated_s"),
                    F.coalesce(F.array_contains(statuses, "ended"), F.lit(False)).alias("ended"))).select("r.*")
    keep = ~F.col("ended") & F.col("place").isNotNull() & (F.col("end_s").isNull() | (F.col("end_s") >= now_s))
    current = rows.where(keep).withColumn("id", F.coalesce("id", F.concat_ws("-", "feed", "seq")))
    rest = ["seq", "kind", "type", "place", "start_s", "end_s", "updated_s"]
    once = current.groupBy("feed", "id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("feed", "id", "r.*")
    a, b = F.col("place.a"), F.col("place.b")
    out = once.select("feed", "id", "kind", "type", F.coalesce(a["lon"], b["lon"]).alias("lon"), F.coalesce(a["lat"], b["lat"]).alias("lat"),
                      (a.isNotNull() & b.isNotNull() & (a != b)).alias("is_line"), F.col("place.road").alias("road"), "start_s", "end_s", "updated_s",
                      F.coalesce(F.col("start_s") > now_s, F.lit(False)).alias("planned"))
    return out, rows.groupBy("feed").agg(F.count(F.lit(1)).alias("messages"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped"))


def layer_page_merge(pages: DataFrame, expected: int, key: str = "object_id") -> DataFrame:
    """Union of fetched pages, refused unless it is exactly the layer (no duplicates, none missing)."""
    per = pages.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    check = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col(key).isNull()).alias("missing"))
    problem = (F.when(F.col("missing") > 0, "a feature has no id").when(F.col("ids") <= F.col("n") - 1, "an id was fetched twice")
               .when(F.col("n") != expected, "the layer reports another count"))
    ok = check.select(F.when(problem.isNotNull(), F.raise_error(problem).cast("int")).otherwise(F.lit(1)).alias("_ok"))
    return pages.join(F.broadcast(ok)).where("_ok = 1").drop("_ok")


def layer_cross_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on both lists, on the left only and on the right only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("_l") & F.col("_r")).alias("both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def layer_describe(features: DataFrame, fields: list[str]) -> DataFrame:
    """Counts a reader needs before trusting a layer: usable points, extent, nulls per field."""
    usable = (F.col("geometry_type") == "Point") & F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    ok = F.coalesce(usable, F.lit(False))
    return features.agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("without_usable_point"), *[f(F.when(ok, F.col(c))).alias(n) for n, f, c in (
        ("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))], *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in fields])


def geometry_types(features: DataFrame) -> DataFrame:
    return features.groupBy("geometry_type").agg(F.count(F.lit(1)).alias("n"))

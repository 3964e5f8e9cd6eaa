"""Position sources: ship reports, aircraft states, third-party air, transit and fleet feeds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotgap.constants import KNOTS_TO_MPS

_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _declared(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


# Declared schemas of the stored tables.
AIS_SCHEMA = _declared(
    "MMSI string, BaseDateTime timestamp, LAT double, LON double, SOG double, COG double, Heading double, VesselName string, "
    "IMO string, CallSign string, VesselType int, Status int, Length double, Width double, Draft double, Cargo int, TransceiverClass string")
ADSB_SCHEMA = _declared(
    "fetched_at timestamp, icao24 string, callsign string, origin_country string, time_position bigint, last_contact bigint, longitude double, "
    "latitude double, baro_altitude double, on_ground boolean, velocity double, true_track double, vertical_rate double, geo_altitude double, "
    "squawk string, spi boolean, position_source int")
# Order of the bare state vector; the element before geo_altitude lists sensor ids.
STATE_FIELDS = ["icao24", "callsign", "origin_country", "time_position", "last_contact", "longitude", "latitude", "baro_altitude", "on_ground",
                "velocity", "true_track", "vertical_rate", "sensors", "geo_altitude", "squawk", "spi", "position_source", "category"]
CRAFT_TEXT = ["hex", "type", "flight", "r", "t", "squawk", "emergency", "category"]
CRAFT_REAL = ["lat", "lon", "alt_geom", "gs", "track", "baro_rate", "geom_rate", "nav_altitude_mcp", "seen_pos", "seen", "rssi", "dst", "dir"]
CRAFT_INT = ["nic", "rc", "messages", "alert", "spi"]
SENTINELS = {"sog": 102.3, "cog": 360.0, "heading": 511.0, "lat": 91.0, "lon": 181.0}
MAX_SOG_KN = 60.0
SEA_SIGMA_M = 50.0


def _hours(start_us: int, end_us: int) -> tuple[str, str]:
    """Inclusive range of hour=YYYYMMDDHH labels that can hold the window, one hour wider on each side."""
    def label(us):
        return pd.Timestamp(us, unit="us").strftime("%Y%m%d%H")
    return label(start_us - 3_600_000_000), label(end_us + 3_600_000_000)


def scan_ais(spark: SparkSession, paths: str | Sequence[str], start_us: int, end_us: int, box: tuple[float, float, float, float] | None = None,
             hour_partitioned: bool = False) -> DataFrame:
    """Declared columns of a ship store by name, inside a time window and box.

    Absent columns read as null. Time and box reach the Parquet scan as filters; on an
    hour-partitioned store the window also prunes directories.
    """
    reader = spark.read.schema(AIS_SCHEMA if not hour_partitioned else T.StructType([*AIS_SCHEMA.fields, T.StructField("hour", T.StringType())]))
    rows = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    if hour_partitioned:
        lo, hi = _hours(start_us, end_us)
        rows = rows.where(F.col("hour").between(lo, hi)).drop("hour")
    rows = rows.where(F.col("BaseDateTime").between(F.timestamp_micros(F.lit(start_us)), F.timestamp_micros(F.lit(end_us))))
    if box is not None:
        rows = rows.where(F.col("LON").between(box[0], box[2]) & F.col("LAT").between(box[1], box[3]))
    return rows


def _positive(c: str):
    return F.when(F.col(c) > 0, F.col(c))


def clean_ais(rows: DataFrame) -> DataFrame:
    """Raw ship rows to reports: 'not available' values become null, rows without a usable position vanish."""
    sog = F.when((F.col("SOG") >= 0) & (F.col("SOG") < SENTINELS["sog"]) & (F.col("SOG") <= MAX_SOG_KN), F.col("SOG") * KNOTS_TO_MPS)
    def course(c, bad):
        return F.when((F.col(c) >= 0) & (F.col(c) < bad), F.pmod(F.col(c), F.lit(360.0)))
    ident = F.trim("MMSI")
    ok = (F.coalesce(ident, F.lit("")) != "") & (ident != "0") & F.col("BaseDateTime").isNotNull() & F.col("LAT").between(-90, 90) & F.col("LON").between(-180, 180)
    return rows.where(ok).select(
        ident.alias("platform_id"), F.lit("sea").alias("domain"), F.unix_micros("BaseDateTime").alias("t_us"), F.col("LAT").alias("lat"), F.col("LON").alias("lon"),
        F.lit(SEA_SIGMA_M).alias("uncertainty_m"), sog.alias("speed_mps"), F.coalesce(course("COG", SENTINELS["cog"]), course("Heading", SENTINELS["heading"])).alias("heading_deg"),
        _positive("Draft").alias("alt_m"), _positive("Length").alias("length_m"), _positive("Width").alias("width_m"),
        F.nullif(F.trim("VesselName"), F.lit("")).alias("name"), F.col("VesselType").alias("vessel_type"), F.col("Status").alias("nav_status"),
        F.nullif(F.trim("TransceiverClass"), F.lit("")).alias("transceiver"))


def store_overlap_guard(rows: DataFrame, column: str = "dataset") -> DataFrame:
    """Fail a scan that spans two stores of the same water; rows pass through otherwise.

    The check is a distinct count of a partition column, so it reads no data columns.
    """
    stores = rows.agg(F.count_distinct(column).alias("_n"), F.concat_ws(", ", F.array_sort(F.collect_set(column))).alias("_names"))
    checked = stores.select(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("overlapping stores: "), F.col("_names"))).cast("int")).otherwise(F.lit(1)).alias("_ok"))
    return rows.join(F.broadcast(checked)).where("_ok = 1").drop("_ok")


def clip_bulk_csv(spark: SparkSession, path: str, box: tuple[float, float, float, float], out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows inside the box, counts): national CSV with a declared schema, written by date when ``out`` is given."""
    raw = spark.read.schema(AIS_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    inside = F.col("LON").between(box[0], box[2]) & F.col("LAT").between(box[1], box[3])
    kept = raw.where(inside).withColumn("date", F.to_date("BaseDateTime"))
    if out is not None:
        kept.sortWithinPartitions("MMSI", "BaseDateTime").write.partitionBy("date").mode("errorifexists").parquet(out)
    return kept, raw.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(inside).alias("rows_kept"))


@F.pandas_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
def wkb_point(body: pd.Series) -> pd.DataFrame:
    """Positions from 21-byte two-dimensional WKB points; anything else is null."""
    ok = body.map(lambda b: isinstance(b, (bytes, bytearray)) and len(b) == 21).to_numpy(dtype=bool)
    xy = np.full((len(body), 2), np.nan)
    if ok.any():
        raw = np.frombuffer(b"".join(bytes(b) for b in body[ok]), dtype=np.uint8).reshape(-1, 21)
        for order, head, kind in ((1, [1, 0, 0, 0], "<f8"), (0, [0, 0, 0, 1], ">f8")):
            mine = (raw[:, 0] == order) & (raw[:, 1:5] == head).all(axis=1)
            at = np.flatnonzero(ok)[mine]
            xy[at] = np.ascontiguousarray(raw[mine, 5:21]).view(kind).astype(float)
    return pd.DataFrame({"lon": pd.Series(xy[:, 0]).astype(object).where(~np.isnan(xy[:, 0]), None).astype(float), "lat": xy[:, 1]})


def clip_geo_points(rows: DataFrame, geometry: str, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(clipped rows, counts) of a table whose position is a WKB point; undecodable rows are counted."""
    placed = rows.withColumn("_p", wkb_point(geometry)).withColumn("LON", F.nanvl(F.col("_p.lon"), F.lit(None))).withColumn("LAT", F.nanvl(F.col("_p.lat"), F.lit(None))).drop("_p", geometry)
    inside = F.coalesce(F.col("LON").between(box[0], box[2]) & F.col("LAT").between(box[1], box[3]), F.lit(False))
    return placed.where(inside), placed.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(inside).alias("rows_kept"), F.count_if(F.col("LON").isNull()).alias("undecodable"))


def scan_adsb(spark: SparkSession, path: str, start_s: int, end_s: int, box: tuple[float, float, float, float], include_on_ground: bool = False,
              limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(ADSB_SCHEMA).parquet(path)
    rows = rows.where(F.col("last_contact").between(start_s, end_s) & F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3]))
    if not include_on_ground:
        rows = rows.where(~F.col("on_ground"))
    return rows if limit is None else rows.limit(limit)


def adsb_to_reports(rows: DataFrame, include_on_ground: bool = False, sigma_m: float = 10.0) -> DataFrame:
    """State rows to reports: own position time first, geometric altitude first, unpositioned rows dropped."""
    ts = F.coalesce("time_position", "last_contact")
    ok = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ts.isNotNull()
    if not include_on_ground:
        ok = ok & ~F.coalesce("on_ground", F.lit(False))
    return rows.where(ok).select(
        F.col("icao24").alias("platform_id"), F.lit("air").alias("domain"), (ts * 1_000_000).alias("t_us"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.lit(sigma_m).alias("uncertainty_m"), F.col("velocity").alias("speed_mps"), F.col("true_track").alias("heading_deg"), F.coalesce("geo_altitude", "baro_altitude").alias("alt_m"))


def state_vector_unpack(bodies: DataFrame, body: str = "body") -> DataFrame:
    """{"time": .., "states": [[..], ..]} to one named row per aircraft."""
    doc = F.from_json(body, "time bigint, states array<array<string>>")
    rows = bodies.select(F.explode(doc["states"]).alias("s"), doc["time"].alias("fetched_s"))
    cols = [F.try_element_at("s", F.lit(i + 1)).alias(n) for i, n in enumerate(STATE_FIELDS)]
    types = {f.name: f.dataType for f in ADSB_SCHEMA.fields}
    return rows.select("fetched_s", *cols).select("fetched_s", *[F.col(n).try_cast(types[n]).alias(n) for n in STATE_FIELDS if n in types])


def scan_independent_air(bodies: DataFrame, body: str = "body") -> DataFrame:
    """{"now": .., "aircraft": [{..}]} to typed columns plus the untyped remainder as JSON."""
    doc = F.from_json(body, "now double, aircraft array<string>")
    craft = bodies.select(doc["now"].alias("now"), F.explode(doc["aircraft"]).alias("_a"))
    known = {*CRAFT_TEXT, *CRAFT_REAL, *CRAFT_INT, "alt_baro", "mlat", "tisb"}
    asmap = F.from_json("_a", "map<string,string>")
    rest = F.map_filter(asmap, lambda k, v: ~k.isin(sorted(known)))
    def field(n):
        return F.element_at(asmap, n)
    out = craft.select("now", *[F.nullif(F.trim(field(n)), F.lit("")).alias(n) for n in CRAFT_TEXT], field("alt_baro").alias("alt_baro"),
                       *[field(n).try_cast("double").alias(n) for n in CRAFT_REAL], *[field(n).try_cast("double").cast("bigint").alias(n) for n in CRAFT_INT],
                       F.coalesce(field("mlat"), F.lit("[]")).alias("mlat_fields"), F.coalesce(field("tisb"), F.lit("[]")).alias("tisb_fields"),
                       F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"))
    return out.withColumn("alt_ft", F.col("alt_baro").try_cast("int"))


def _fields(buf: memoryview) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of one protobuf message."""
    at, end = 0, len(buf)
    def varint(i):
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 127) << shift
            i += 1
            if b < 128:
                return value, i
            shift += 7
    while at < end:
        tag, at = varint(at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 1:
            value, at = bytes(buf[at:at + 8]), at + 8
        elif wire == 5:
            value, at = bytes(buf[at:at + 4]), at + 4
        elif wire == 2:
            size, at = varint(at)
            value, at = buf[at:at + size], at + size
        else:
            raise ValueError("unknown wire type")
        yield number, wire, value


#: Decoded entities held at once, whatever the number of bodies in an Arrow batch.
DECODED_ROWS = 5_000
VEHICLE_COLUMNS = ("feed_id string, fetched_at bigint, entity_id string, vehicle_id string, label string, trip_id string, route_id string, lat double, lon double, "
                   "bearing double, speed double, vehicle_ts bigint, header_ts bigint")


def _decode_feed(body: bytes) -> tuple[list[dict], int | None]:
    """Vehicle entities of one GTFS-realtime message, by published field numbers."""
    header_ts, out = None, []
    for number, _, value in _fields(memoryview(body)):
        if number == 1:
            header_ts = next((v for n, _, v in _fields(value) if n == 3), None)
        elif number == 2:
            row = {"entity_id": "", "vehicle_id": "", "label": "", "trip_id": "", "route_id": "", "lat": None, "lon": None, "bearing": None, "speed": None, "vehicle_ts": None}
            for n, _, v in _fields(value):
                if n == 1:
                    row["entity_id"] = bytes(v).decode()
                elif n == 4:
                    for m, _, w in _fields(v):
                        if m == 1:
                            row.update({{1: "trip_id", 5: "route_id"}[k]: bytes(x).decode() for k, _, x in _fields(w) if k in (1, 5)})
                        elif m == 2:
                            row.update({{1: "lat", 2: "lon", 3: "bearing", 5: "speed"}[k]: float(np.frombuffer(x, "<f4")[0]) for k, _, x in _fields(w) if k in (1, 2, 3, 5)})
                        elif m == 5:
                            row["vehicle_ts"] = w
                        elif m == 8:
                            row.update({{1: "vehicle_id", 2: "label"}[k]: bytes(x).decode() for k, _, x in _fields(w) if k in (1, 2)})
            out.append(row)
    return out, header_ts


def gtfsrt_positions(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per positioned vehicle, unpositioned counts per feed) from bodies(feed_id, fetched_at, body).

    Spark's protobuf reader is an optional package, so the four published messages needed are
    decoded per body inside the tasks.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in VEHICLE_COLUMNS.split(", ")]
        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"vehicle_ts": "Int64", "header_ts": "Int64"})
        rows = []
        for b in batches:
            for feed, fetched, body in zip(b["feed_id"], b["fetched_at"], b["body"]):
                got, header = _decode_feed(body)
                rows += [{**r, "feed_id": feed, "fetched_at": fetched, "header_ts": header} for r in got]
                if len(rows) >= DECODED_ROWS:
                    yield frame(rows)
                    rows = []
        yield frame(rows)
    rows = bodies.select("feed_id", "fetched_at", "body").mapInPandas(decode, VEHICLE_COLUMNS)
    key = F.when(F.col("vehicle_id") != "", F.col("vehicle_id")).otherwise(F.concat(F.lit("entity:"), F.col("entity_id")))
    placed = rows.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("vehicle_key", key)
    return placed, rows.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("n_unpositioned"))


FLEET = ["fleet", "vehicle_id", "lon", "lat", "heading_deg", "speed_mps", "ts", "label"]
# Compass points in degrees.
COMPASS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}
MPH_TO_MPS = 0.44704


def institutional_fleet_union(trains: DataFrame, plows: DataFrame, rail: DataFrame) -> DataFrame:
    """Three shapes of public fleet rows in one schema: SI units, degrees, epoch seconds.

    trains(id, lon, lat, compass, mph, updated_s, state); plows(id, lon, lat, heading, mph,
    stamp) with stamps in seconds or milliseconds; rail(run, lat, lon, heading, seen_s) as text.
    """
    compass = F.lit(None).cast("double")
    for name, deg in COMPASS.items():
        compass = F.when(F.upper("compass") == name, deg).otherwise(compass)
    a = trains.where(F.col("state") == "Active").select(
        F.lit("train").alias("fleet"), F.col("id").cast("string").alias("vehicle_id"), "lon", "lat", compass.alias("heading_deg"), (F.col("mph") * MPH_TO_MPS).alias("speed_mps"),
        F.col("updated_s").alias("ts"), F.col("id").cast("string").alias("label"))
    stamp = F.when(F.col("stamp") > 1e11, F.floor(F.col("stamp") / 1000)).otherwise(F.col("stamp"))
    b = plows.select(F.lit("plow").alias("fleet"), F.col("id").cast("string").alias("vehicle_id"), "lon", "lat", F.col("heading").try_cast("double").alias("heading_deg"),
                     (F.col("mph").try_cast("double") * MPH_TO_MPS).alias("speed_mps"), stamp.cast("bigint").alias("ts"), F.col("id").cast("string").alias("label"))
    c = rail.select(F.lit("rail").alias("fleet"), F.concat(F.lit("rn-"), F.col("run").cast("string")).alias("vehicle_id"), F.col("lon").try_cast("double").alias("lon"),
                    F.col("lat").try_cast("double").alias("lat"), F.col("heading").try_cast("double").alias("heading_deg"), F.lit(None).cast("double").alias("speed_mps"),
                    F.col("seen_s").alias("ts"), F.col("run").cast("string").alias("label")).where("lat IS NOT NULL AND lon IS NOT NULL")
    out = a.unionByName(b).unionByName(c)
    return out.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))

"""Streaming forms of the operators. Every job takes and returns streaming DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plotgap import constants as C
from plotgap.functions.classes import vessel_subtype
from plotgap.operators.land import KEYS, local_wall_time, midpoint_cell_hours
from plotgap.plans.sequence import chunk_of, running
from plotgap.sources.sinks import hour_label
from plotgap.streaming.stateful import keyed_fold

SETTLED_FRACTION, WARMUP_S, WINDOW_S = 0.3, 180, 60
STALE_S, DROP_S = 360, 3600


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything available into Parquet, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            # a batch directory is written whole or replaced whole, so a retry leaves no duplicates
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")
        q = writer.foreachBatch(keep).outputMode(mode).start()
    q.awaitTermination()
    return q


# ---- ship messages -----------------------------------------------------------------------


def ais_stream_fold(messages: DataFrame) -> DataFrame:
    """Current merged state per vessel from position and static messages.

    messages(mmsi, seq, t_s, kind, lat, lon, sog, cog, heading, name, ship_type, dim_a, dim_b,
    dim_c, dim_d, valid). Each field keeps its last usable value, which is a streaming
    aggregation with partial combine; empty static values and invalid halves never overwrite.
    """
    static = F.col("kind") == "static"
    pos = ~static & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    said = static & F.col("valid")

    def last(value, usable):
        return F.max_by(value, F.when(usable, F.col("seq")))
    text = F.nullif(F.trim("name"), F.lit(""))
    length, width = F.col("dim_a") + F.col("dim_b"), F.col("dim_c") + F.col("dim_d")
    return messages.where((F.coalesce(F.trim("mmsi"), F.lit("")) != "") & (F.trim("mmsi") != "0")).groupBy("mmsi").agg(
        last(F.col("lat"), pos).alias("lat"), last(F.col("lon"), pos).alias("lon"), last(F.col("t_s"), pos).alias("t_s"),
        last(F.col("sog"), pos & (F.col("sog") < 102.0)).alias("sog_kn"), last(F.col("cog"), pos & (F.col("cog") < 360.0)).alias("cog_deg"),
        last(F.col("heading"), pos & (F.col("heading") < 511)).alias("heading_deg"), last(text, (said | pos) & text.isNotNull()).alias("name"),
        last(F.col("ship_type"), said & (F.col("ship_type") != 0)).alias("ship_type"), last(length, said & (length > 0)).alias("length_m"),
        last(width, said & (width > 0)).alias("width_m"), F.count_if(pos).alias("n_positions"), F.min("t_s").alias("first_s"), F.max("seq").alias("seq"))


def monotonic_dedupe(reports: DataFrame, forget_s: float | None = 3600.0) -> DataFrame:
    """Accept a report only when its vessel's clock advanced; the others are marked, not lost.

    ``forget_s`` bounds the state of a stream that runs on. It is measured in processing time,
    which keeps scheduling batches, so pass None to drain a finite backlog.
    """
    def step(state, row):
        seq, mmsi, t = row
        last = None if state is None else state[0]
        ok = last is None or t > last
        return ((t if ok else last),), (seq, mmsi, t, ok)
    return keyed_fold(reports.select("mmsi", "seq", "t_s"), ["mmsi"], ["seq"], "seq bigint, mmsi string, t_s bigint, accepted boolean", "last bigint", step, ["seq", "mmsi", "t_s"], forget_s)


def micro_batch_archive(reports: DataFrame, path: str, checkpoint: str, t_us: str, epoch_us: int = 0, every: str | None = "120 seconds", rows_per_file: int = 20_000) -> StreamingQuery:
    """Hour-partitioned archive of a stream; ``every=None`` drains what is there and stops."""
    labelled = reports.withColumn("hour", hour_label(t_us, epoch_us))
    writer = (labelled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file)
              .partitionBy("hour").outputMode("append"))
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def latest_state(updates: DataFrame, key: str = "mmsi", seq: str = "seq") -> DataFrame:
    """Newest update per key from the update log of a streaming aggregation."""
    rest = [c for c in updates.columns if c not in (key, "batch_id", "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(seq, "batch_id")).alias("r")).select(key, "r.*")


def live_snapshot(state: DataFrame, now_s) -> DataFrame:
    """Positioned vessels heard within the hour; silent for six minutes is stale, not gone."""
    age = now_s - F.col("t_s")
    return (state.where(F.col("t_s").isNotNull() & (age <= DROP_S)).withColumn("age_s", age).withColumn("stale", age > STALE_S)
            .withColumn("subtype", vessel_subtype("ship_type")).withColumn("label", F.coalesce("name", "mmsi")))


def live_filter(snapshot: DataFrame, box: tuple[float, float, float, float], subtypes: list[str] | None, snapshot_age_s: float, max_age_s: float,
                snapshot_box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(features, counts by subtype after clipping); an old snapshot or one of another box is refused."""
    if snapshot_age_s > max_age_s:
        raise ValueError(f"snapshot is {snapshot_age_s:.0f} s old, limit {max_age_s:.0f} s")
    if not (snapshot_box[0] <= box[0] and snapshot_box[1] <= box[1] and snapshot_box[2] >= box[2] and snapshot_box[3] >= box[3]):
        raise ValueError("the snapshot covers another box")
    inside = snapshot.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    counts = inside.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))
    return (inside if subtypes is None else inside.where(F.col("subtype").isin(subtypes))), counts


def first_seen(messages: DataFrame) -> DataFrame:
    return messages.groupBy("mmsi").agg(F.min("t_s").alias("first_s"), F.max("seq").alias("seq"))


def discovery_rate(seen: DataFrame, step_s: int = 1) -> DataFrame:
    """Per sampled second: new platforms in the last minute, the peak so far and whether it settled.

    Work follows the number of platforms: each first sighting touches the seconds of its minute.
    """
    span = seen.agg(F.min("first_s").alias("t0"), F.max("first_s").alias("t1"))
    ticks = span.select("t0", F.explode(F.sequence(F.col("t0"), F.col("t1"), F.lit(step_s).cast("bigint"))).alias("t"))
    t0 = span.select("t0")
    spread = seen.join(F.broadcast(t0)).select(F.explode(F.sequence(
        F.col("t0") + F.ceil((F.col("first_s") - F.col("t0")) / step_s) * step_s, F.col("t0") + F.floor((F.col("first_s") + WINDOW_S - F.col("t0")) / step_s) * step_s, F.lit(step_s).cast("bigint"))).alias("t"))
    new = spread.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rows = ticks.join(new, "t", "left").fillna(0, ["n"]).withColumn("listening_s", F.col("t") - F.col("t0")).withColumn("_all", F.lit(0))
    counted = F.when(F.col("listening_s") >= WINDOW_S, F.col("n"))
    out = running(rows, ["_all"], ["t"], counted, "peak", "max", chunk_of("listening_s", 3600)).withColumn("peak", F.coalesce("peak", F.lit(0)))
    settled = (F.col("peak") > 0) & (F.col("n") <= SETTLED_FRACTION * F.col("peak")) & (F.col("listening_s") >= WARMUP_S)
    return out.select("t", F.col("n").alias("per_min"), "peak", settled.alias("settled"))


# ---- road --------------------------------------------------------------------------------


def _distance(a, b) -> float:
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * C.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def speed_pair_stream(fixes: DataFrame) -> DataFrame:
    """Every fix with its reason or speed; each vehicle's last accepted fix is held across batches."""
    def step(state, row):
        arrival, feed, key, ts, lat, lon, trip = row
        def out(reason, speed=None):
            mid = (None, None, None) if speed is None else ((state[1] + lat) / 2, (state[2] + lon) / 2, (state[0] + ts) // 2)
            return (arrival, feed, key, reason, speed, *mid)
        if key.startswith("entity:"):
            return state, out("entity_key")
        if ts is None:
            return state, out("no_vehicle_ts")
        now = (int(ts), lat, lon, trip or "")
        if state is None:
            return now, out("first_fix")
        if ts <= state[0]:
            return state, out("duplicate" if ts == state[0] else "out_of_order")
        dt = ts - state[0]
        dist = _distance(state[1:3], (lat, lon))
        if dt < C.MIN_DT_S or dt > C.MAX_DT_S:
            return now, out("too_close" if dt < C.MIN_DT_S else "gap")
        if dist / dt > C.MAX_ROAD_MPS:
            return now, out("impossible")
        if not state[3] and not trip and dist < C.PARKED_M:
            return now, out("parked")
        return now, out("pairs", dist / dt)
    cols = ["arrival", "feed_id", "vehicle_key", "vehicle_ts", "lat", "lon", "trip_id"]
    return keyed_fold(fixes.select(*cols), ["feed_id", "vehicle_key"], ["arrival"],
                      "arrival bigint, feed_id string, vehicle_key string, reason string, speed_mps double, mid_lat double, mid_lon double, mid_s bigint",
                      "ts bigint, lat double, lon double, trip string", step, cols)


def cell_hour_batches(out: str, seconds: str = "mid_s", clock: str = "mid_s") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that closes a date 14 hours behind the stream's clock.

    Rows landing on a closed date are counted as late and set aside, never merged or lost.
    The cut-off of every batch is written beside the data, so a restarted stream resumes it.
    """
    lag = C.FLUSH_LAG_H * 3600

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            closed = [r[0] for r in spark.read.parquet(f"{out}/cutoff").where(F.col("batch") < batch_id).agg(F.max("cutoff_day")).collect()]
        except Exception as problem:  # no batch has been written yet
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER" not in str(problem):
                raise
            closed = [None]
        cut = closed[0] if closed and closed[0] is not None else -(1 << 40)
        day = F.floor(F.col(seconds) / 86400)
        rows = batch.where(F.col(seconds).isNotNull()).withColumn("day", day)
        rows.where(F.col("day") >= cut).write.mode("overwrite").parquet(f"{out}/pairs/batch={batch_id}")
        rows.where(F.col("day") < cut).groupBy("feed_id").agg(F.count(F.lit(1)).alias("late")).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        moved = batch.agg(F.greatest(F.lit(cut), F.coalesce(F.floor((F.max(clock) - lag) / 86400), F.lit(cut))).alias("cutoff_day"))
        moved.write.mode("overwrite").parquet(f"{out}/cutoff/batch={batch_id}")
        batch.unpersist()
    return write


OPEN = "feed_id string, vehicle_key string, mid_s bigint, mid_lat double, mid_lon double, speed_mps double, local_date date, batch bigint"
CUTOFF = "cutoff date, batch bigint"


def _last_cutoff(spark: SparkSession, out: str, before: int | None = None):
    """The date up to which everything is closed, or None; batches count from zero."""
    if before == 0:
        return None
    cuts = spark.read.schema(CUTOFF).parquet(f"{out}/cutoff")
    return (cuts if before is None else cuts.where(F.col("batch") < before)).agg(F.max("cutoff")).first()[0]


def _waiting(spark: SparkSession, out: str, since, until=None) -> DataFrame:
    """Pairs of the open dates in [since, until); only those dates' folders are read."""
    rows = spark.read.schema(OPEN).parquet(f"{out}/open")
    rows = rows if since is None else rows.where(F.col("local_date") >= F.lit(since))
    return rows if until is None else rows.where(F.col("local_date") < F.lit(until))


def cell_hour_closer(out: str, zones: dict[str, str], clock: str = "clock_s", lag_s: int = C.FLUSH_LAG_H * 3600) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that turns a local date into cell-hours once the stream's clock is ``lag_s`` past its end.

    Batches hold (feed_id, vehicle_key, mid_s, mid_lat, mid_lon, speed_mps, clock). Pairs of open dates wait in ``out/open``, one
    folder for each batch and date. The cell-hours of the dates that a batch closes go to ``out/cells``; pairs of a date closed
    before their batch go to ``out/late`` as they are, never merged and never lost. A batch writes only folders of its own number,
    its cut-off last, so one that fails half-way is repeated without a trace. The state is these tables: no date, cell or vehicle
    is held in a task.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cut = _last_cutoff(spark, out, batch_id)
        batch = batch.persist()
        rows = (local_wall_time(batch, "mid_s", zones).withColumn("local_date", F.to_date("local_time"))
                .select(*KEYS, "mid_s", "mid_lat", "mid_lon", "speed_mps", "local_date"))
        late = F.lit(False) if cut is None else F.col("local_date") < F.lit(cut)
        rows.where(~late).repartition("local_date", F.pmod(F.xxhash64(*KEYS), F.lit(8))).write.mode("overwrite").partitionBy("local_date").parquet(f"{out}/open/batch={batch_id}")
        rows.where(late).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        reached = batch.agg(F.date_from_unix_date(F.floor((F.max(clock) - lag_s) / 86400).cast("int")).alias("d")).first()[0]
        batch.unpersist()
        now = max((d for d in (cut, reached) if d is not None), default=None)
        if now is not None and now != cut:
            done = _waiting(spark, out, cut, now).where(F.col("batch") <= batch_id)
            midpoint_cell_hours(done, zones).write.mode("overwrite").parquet(f"{out}/cells/batch={batch_id}")
        spark.createDataFrame([(now,)], "cutoff date").write.mode("overwrite").parquet(f"{out}/cutoff/batch={batch_id}")
    return write


def close_rest(spark: SparkSession, out: str, zones: dict[str, str]) -> None:
    """Close the dates still open when a stream has ended; repeating it replaces the same folder."""
    midpoint_cell_hours(_waiting(spark, out, _last_cutoff(spark, out)), zones).write.mode("overwrite").parquet(f"{out}/cells/batch=-1")


def new_fix_stream(polls: DataFrame) -> DataFrame:
    """Mark fixes that differ from the vehicle's fix in the feed's previous poll."""
    def step(state, row):
        arrival, poll, ts, lat, lon = row
        now = (int(poll), -1 if ts is None else int(ts), lat, lon)
        same = state is not None and state[0] == poll - 1 and tuple(state[1:]) == now[1:]
        return now, (arrival, not same)
    return keyed_fold(polls.select("feed_id", "vehicle_key", "arrival", "poll_no", "vehicle_ts", "lat", "lon"), ["feed_id", "vehicle_key"], ["poll_no", "arrival"],
                      "arrival bigint, is_new boolean", "poll bigint, ts bigint, lat double, lon double", step, ["arrival", "poll_no", "vehicle_ts", "lat", "lon"])


def claim_change_stream(ledger: DataFrame, digest_version: int) -> DataFrame:
    """Change class of every answered row; a new digest version re-baselines instead of reporting change."""
    def step(state, row):
        event_id, feed, content, body = row
        now = (content or "", digest_version, body)
        if state is None:
            return now, (event_id, feed, "first seen")
        if state[2] == body:
            return now, (event_id, feed, "unchanged")
        if state[1] != digest_version:
            return now, (event_id, feed, "re-baselined")
        return now, (event_id, feed, "envelope only" if state[0] == (content or "") else "content changed")
    answered = ledger.where("body IS NOT NULL").select("event_id", "feed", "content", "body")
    return keyed_fold(answered, ["feed"], ["event_id"], "event_id bigint, feed string, change string", "content string, version int, body string", step, ["event_id", "feed", "content", "body"])


def liveness_stream(heartbeats: DataFrame) -> DataFrame:
    """Sessions as a streaming aggregation in update mode."""
    poll = F.col("event") == "poll"
    return heartbeats.groupBy("collector", "session").agg(
        F.min("t_us").alias("started_us"), F.max("t_us").alias("last_us"), F.max(F.when(F.col("event") == "stop", F.col("t_us"))).alias("ended_us"),
        F.count_if(poll).alias("polls"), F.count_if(poll & ~F.col("ok")).alias("failures"))

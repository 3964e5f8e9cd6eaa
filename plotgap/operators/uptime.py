"""Was anyone looking: collector sessions, merged uptime and blind intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgap.functions.classes import one_decimal
from plotgap.plans.intervals import containing
from plotgap.plans.sequence import HOUR_US

US = 1_000_000


def collector_sessions(heartbeats: DataFrame) -> DataFrame:
    """One row per session: started, last seen, ended, polls, failures, clean stop."""
    poll = F.col("event") == "poll"
    got = heartbeats.groupBy("collector", "session").agg(
        F.min("t_us").alias("started_us"), F.max("t_us").alias("last_us"),
        F.max(F.when(F.col("event") == "stop", F.col("t_us"))).alias("ended_us"),
        F.count_if(poll).alias("polls"), F.count_if(poll & ~F.col("ok")).alias("failures"))
    return got.withColumn("clean", F.col("ended_us").isNotNull())


def uptime_intervals(sessions: DataFrame) -> DataFrame:
    """Merged spans during which each collector was demonstrably running.

    Sessions, not heartbeats, are ordered here: their number is small per collector.
    """
    spans = sessions.select("collector", F.col("started_us").alias("lo"), F.coalesce("ended_us", "last_us").alias("hi"))
    order = Window.partitionBy("collector").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("lo") <= reached, 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("collector", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")


def blind_intervals(up: DataFrame, collectors: DataFrame, t0_us, t1_us, min_seconds: float = 60.0) -> DataFrame:
    """Complement of the uptime inside [t0, t1]; a collector without evidence is blind throughout."""
    t0, t1 = F.lit(t0_us) if isinstance(t0_us, int) else t0_us, F.lit(t1_us) if isinstance(t1_us, int) else t1_us
    edges = collectors.select("collector", F.array(F.struct(t0.alias("lo"), t0.alias("hi")),
                                                   F.struct(t1.alias("lo"), t1.alias("hi"))).alias("e"))
    marks = edges.select("collector", F.explode("e").alias("e")).select("collector", "e.lo", "e.hi")
    line = up.select("collector", "lo", "hi").unionByName(marks)
    order = Window.partitionBy("collector").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = line.select("collector", reached.alias("lo"), F.col("lo").alias("hi"))
    return gaps.where((F.col("hi") - F.col("lo")) >= int(min_seconds * US))


def was_collecting(instants: DataFrame, up: DataFrame, t: str = "t_us") -> DataFrame:
    """Instants inside any uptime interval of their collector."""
    return containing(instants, up, t, "lo", "hi", HOUR_US, equal=["collector"], how="left_semi")


def hour_coverage(hours: DataFrame, data_hours: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """What a collector was doing in every hour of its span.

    ``hours(hour)`` is the span; five outcomes are kept apart: data, polls that all
    failed, rows landed next door, not looking, and unknown (no heartbeat file that day).
    """
    polls = heartbeats.where("event = 'poll'")
    by_hour = polls.groupBy(F.expr(f"t_us div {HOUR_US}").alias("hour")).agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    days = heartbeats.select(F.expr(f"t_us div {24 * HOUR_US}").alias("day")).distinct().withColumn("_file", F.lit(True))
    present = data_hours.select("hour").distinct().withColumn("_data", F.lit(True))
    rows = (hours.withColumn("day", F.expr("hour div 24")).join(present, "hour", "left").join(by_hour, "hour", "left")
            .join(days, "day", "left"))
    outcome = (F.when(F.col("_data"), "with_data").when(F.col("n_ok") > 0, "rows_in_adjacent_partition")
               .when(F.col("n_failed") > 0, "looked_all_failed").when(F.col("_file"), "not_looking")
               .otherwise("unknown"))
    return rows.select("hour", outcome.alias("outcome"))


def volume_agreement(n_files, polls_returned, expected: float = 10.0, tolerance: float = 0.5):
    """Null when polls per file agree with the expected rate, else a sentence."""
    ratio = polls_returned / F.nullif(n_files.cast("double"), F.lit(0.0))
    ok = ratio.isNull() | (polls_returned == 0) | ratio.between(expected * (1 - tolerance), expected * (1 + tolerance))
    return F.when(~ok, F.concat(F.lit("archive and heartbeats disagree: "), one_decimal(ratio),
                                F.lit(f" polls per file where {expected:.0f} is expected")))


def feed_status(feeds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Last ledger row of every selected feed; a feed without one is kept and said so."""
    rest = ["cycle", "outcome", "n_events", "event_id"]
    last = ledger.groupBy("feed").agg(F.max_by(F.struct(*rest), F.struct("cycle", "event_id")).alias("r")).select("feed", "r.*")
    return feeds.join(last, "feed", "left").withColumn("status", F.coalesce("outcome", F.lit("no ledger row")))

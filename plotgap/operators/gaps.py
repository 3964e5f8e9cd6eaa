"""Reporting silence, weighed by the chance that a report would have been received."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.plans.sequence import HOUR_US, chunk_of, running, with_previous
from plotgap.plans.traversal import crossed_cells

US = 1_000_000


def blind_calendar(blind: DataFrame) -> DataFrame:
    """(hour, before_us, pieces): blind time before each hour, and the blind stretches inside it.

    ``blind(lo, hi)`` may overlap; overlaps count once. Hours run without a break from the first blind one to the one after
    the last. The table follows the time span, not the reports.
    """
    spans = blind.where("hi > lo").select(F.explode(F.sequence(F.expr(f"lo div {HOUR_US}"), F.expr(f"(hi - 1) div {HOUR_US}"))).alias("hour"), "lo", "hi")
    clipped = spans.select("hour", F.greatest("lo", F.col("hour") * HOUR_US).alias("lo"), F.least("hi", (F.col("hour") + 1) * HOUR_US).alias("hi"))
    order = Window.partitionBy("hour").orderBy("lo", "hi")
    reached = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo"))
    fresh = clipped.withColumn("lo", F.greatest("lo", reached)).where("hi > lo")
    hours = fresh.groupBy("hour").agg(F.sum(F.col("hi") - F.col("lo")).alias("us"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("pieces"))
    ends = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", F.col("b") + 1)).alias("hour")).join(hours, "hour", "left")
    dense = every.select("hour", F.coalesce("us", F.lit(0)).alias("us"), "pieces").withColumn("_all", F.lit(0))
    return running(dense, ["_all"], ["hour"], F.col("us"), "before_us", "sum", chunk_of("hour", 720), inclusive=False).select("hour", "before_us", "pieces")


def blind_time(rows: DataFrame, calendar: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Add ``out``: microseconds of [start, end] that are blind, from two look-ups in the calendar."""
    span = calendar.agg(F.min("hour").alias("_first"), F.max("hour").alias("_last"))
    got = rows.crossJoin(F.broadcast(span))  # one row
    for name, at in (("_b0", start), ("_b1", end)):
        hour = F.least(F.greatest(F.expr(f"{at} div {HOUR_US}"), F.col("_first")), F.col("_last"))
        table = calendar.select(F.col("hour").alias("_hour"), F.col("before_us").alias("_before"), F.col("pieces").alias("_pieces"))
        got = got.withColumn("_hour", hour).join(table, "_hour", "left")
        inside = F.aggregate(F.coalesce("_pieces", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), F.lit(0).cast("bigint"),
                             lambda s, p: s + F.greatest(F.lit(0), F.least(p["hi"], F.col(at)) - p["lo"]))
        got = got.withColumn(name, F.coalesce(F.col("_before") + inside, F.lit(0))).drop("_hour", "_before", "_pieces")
    return got.withColumn(out, F.col("_b1") - F.col("_b0")).drop("_b0", "_b1", "_first", "_last")


def silences(reports: DataFrame, min_gap_s: float = C.MAX_GAP_S) -> DataFrame:
    """The naive rule: consecutive reports of a platform at least ``min_gap_s`` apart."""
    rows = with_previous(reports.select("platform_id", "t_us", "event_id", "lat", "lon"), ["platform_id"], ["t_us", "event_id"],
                         ["t_us", "lat", "lon"], chunk_of("t_us", 6 * HOUR_US))
    gap = (F.col("t_us") - F.col("prev_t_us")) / US
    return rows.where(gap >= min_gap_s).select("platform_id", "event_id", F.col("prev_t_us").alias("start_us"), F.col("t_us").alias("end_us"), gap.alias("gap_s"),
                                               F.col("prev_lon").alias("lon0"), F.col("prev_lat").alias("lat0"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))


def report_rate() -> Column:
    """Reports a second that a reception cell yields; zero where it has never shown two in a row."""
    return F.coalesce(F.when(F.col("median_gap_s") > 0, 1.0 / F.col("median_gap_s")), F.lit(0.0))


def coverage_gaps(reports: DataFrame, grid: DataFrame, blind: DataFrame, cell_deg: float = C.RECEPTION_CELL_DEG, min_gap_s: float = C.MAX_GAP_S,
                  alpha: float = 0.01) -> DataFrame:
    """Silences that stay ``min_gap_s`` long without blind time, with the probability of hearing nothing on the way.

    What is known comes first: blind time is taken off exactly, and a silence that does not outlast it is no finding. The
    rest is modelled: reports are taken to arrive at each cell's own rate (one in its median gap), so the number expected is
    the integral of that rate along the straight way between the two reports, and silence has probability exp(-expected).
    ``weighted`` marks the silences that are less likely than ``alpha``. A platform with most of the reports is cut into
    chunks of time; ways are cut at cell edges where they stand.
    """
    found = blind_time(silences(reports, min_gap_s), blind_calendar(blind), "start_us", "end_us", "blind_us")
    found = found.withColumn("blind_s", F.col("blind_us") / US).withColumn("seen_s", F.col("gap_s") - F.col("blind_s")).where(F.col("seen_s") >= min_gap_s)
    keep = ["platform_id", "event_id", "start_us", "end_us", "gap_s", "blind_s", "seen_s"]
    way = crossed_cells(found, keep, "lon0", "lat0", "lon1", "lat1", cell_deg)
    rates = grid.select("col", "row", report_rate().alias("rate"), (F.col("reception") == "heard").alias("heard"))
    part = F.col("to") - F.col("from")
    met = way.join(rates, ["col", "row"], "left").groupBy(*keep).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(F.when(F.col("heard"), part).otherwise(0.0)).alias("heard_share"),
        F.sum(part * F.coalesce("rate", F.lit(0.0))).alias("_rate"))
    expected = F.col("seen_s") * F.col("_rate")
    return met.withColumn("expected", expected).withColumn("p_silence", F.exp(-F.col("expected"))).withColumn("weighted", F.col("p_silence") <= alpha).drop("_rate")


def gap_comparison(reports: DataFrame, gaps: DataFrame, min_gap_s: float = C.MAX_GAP_S) -> DataFrame:
    """One row: what the naive rule finds, what blind time explains, what coverage explains, and what is left."""
    naive = silences(reports, min_gap_s).agg(F.count(F.lit(1)).alias("n_naive"), F.coalesce(F.sum("gap_s"), F.lit(0.0)).alias("naive_s"))
    left = gaps.agg(F.count(F.lit(1)).alias("n_seen"), F.count_if("weighted").alias("n_weighted"), F.coalesce(F.sum("seen_s"), F.lit(0.0)).alias("seen_s"))
    return naive.crossJoin(left).select("n_naive", (F.col("n_naive") - F.col("n_seen")).alias("n_blind"), (F.col("n_seen") - F.col("n_weighted")).alias("n_unheard"),
                                        "n_weighted", "naive_s", "seen_s")

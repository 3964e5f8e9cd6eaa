"""Sinks: hour and date partitions, event lines and append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hour_label(t_us: str, epoch_us: int = 0):
    """YYYYMMDDHH of a UTC instant, whatever the session zone."""
    ntz = F.expr(f"timestampadd(SECOND, cast(({t_us} + {epoch_us}) div 1000000 as int), timestamp_ntz'1970-01-01 00:00:00')")
    return F.date_format(ntz, "yyyyMMddHH")


def write_hour_partitioned(rows: DataFrame, path: str, t_us: str, sort: list[str], epoch_us: int = 0, mode: str = "append") -> None:
    """hour=YYYYMMDDHH Parquet; rows are clustered by hour first, so a task writes few files.

    A random split keeps one busy hour from landing in a single task.
    """
    labelled = rows.withColumn("hour", hour_label(t_us, epoch_us))
    (labelled.repartition("hour", F.pmod(F.xxhash64(*sort), F.lit(8))).sortWithinPartitions("hour", *sort)
     .write.partitionBy("hour").option("compression", "zstd").mode(mode).parquet(path))


def write_cell_hours(cells: DataFrame, path: str) -> None:
    """One directory per local date; an existing output of another run is refused."""
    cells.repartition("local_date", F.pmod(F.col("cell_row"), F.lit(8))).write.partitionBy("local_date").mode("errorifexists").parquet(path)


def event_lines(events: DataFrame) -> DataFrame:
    """One GeoJSON Feature per event as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    rest = [c for c in events.columns if c not in ("lon", "lat")]
    return events.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("errorifexists").text(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)

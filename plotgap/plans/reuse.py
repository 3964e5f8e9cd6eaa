"""Materialise a small table that several branches of one job read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plotgap.plans.components import ensure_checkpoint_dir


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` once; later branches read the files instead of recomputing it.

    Meant for aggregates, not raw rows. The files live in the shared checkpoint folder,
    so losing an executor loses nothing.
    """
    if getattr(df, "_plotgap_pinned", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    out._plotgap_pinned = True
    return out


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal a small table over all shuffle partitions before it is expanded row by row.

    A stated number of partitions is not coalesced at run time, so the expansion that
    follows runs everywhere instead of in the one task that held the small table.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)

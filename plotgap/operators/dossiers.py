"""One evidence record per candidate, its strength, and what the ranking favours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap.plans.reuse import pin


def dossier_strength(candidates: DataFrame, nearest_report: DataFrame, nearest_site: DataFrame, p_vessel: DataFrame | None = None,
                     isolation_radii: float = 20.0) -> DataFrame:
    """p(vessel) x heard x (1 - repeat) x isolation, each with its stated default.

    Reception is a gate: only heard water supports a reading. A repeated place is penalised
    by how often it was seen. Isolation is the distance to the nearest report in match radii;
    with nothing in range the detection is fully isolated.
    """
    rows = candidates.join(nearest_report.select("obs_id", F.col("distance_m").alias("report_m")), "obs_id", "left")
    rows = rows.join(nearest_site.select("obs_id", F.col("distance_m").alias("site_m"), "n_dates"), "obs_id", "left")
    if p_vessel is not None:
        rows = rows.join(p_vessel.select("obs_id", "p_vessel"), "obs_id", "left")
    elif "p_vessel" not in rows.columns:
        rows = rows.withColumn("p_vessel", F.lit(None).cast("double"))
    isolation = (F.when(F.col("search_radius_m").isNull(), F.lit(None).cast("double")).when(F.col("report_m").isNull(), 1.0)
                 .otherwise(F.least(F.lit(1.0), F.col("report_m") / F.col("search_radius_m") / isolation_radii)))
    repeat = F.when(F.col("n_dates").isNotNull(), F.least(F.lit(1.0), (F.col("n_dates") - 1) / 4.0)).otherwise(0.0)
    heard = F.when(F.col("reception") == "heard", 1.0).otherwise(0.0)
    score = F.coalesce("p_vessel", F.lit(0.5)) * heard * (1.0 - repeat) * F.coalesce(isolation, F.lit(0.5))
    return rows.withColumn("isolation", isolation).withColumn("strength", score)


def ranking_bias(dossiers: DataFrame, top: int = 100) -> DataFrame:
    """Band mix of the top of the ranking against the rest, with Pearson's r of strength and distance."""
    dossiers = pin(dossiers.select("obs_id", "strength", "band", "nm"))
    head = dossiers.orderBy(F.desc("strength"), "obs_id").limit(top).select("obs_id").withColumn("_top", F.lit("top"))
    rows = dossiers.join(F.broadcast(head), "obs_id", "left").withColumn("part", F.coalesce("_top", F.lit("rest")))
    mix = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("band") == b).cast("int")).alias(c) for b, c in
                                                                  (("<=2nm", "near"), ("2-10nm", "mid"), (">10nm", "far"))])
    r = dossiers.where("nm IS NOT NULL").agg(F.corr("strength", "nm").alias("pearson"))
    return mix.join(F.broadcast(r))


def dossier_listing(dossiers: DataFrame, min_strength: float, reception: list[str], offset: int, limit: int) -> DataFrame:
    """One page of the filtered list with the number of hits."""
    hit = pin(dossiers.where((F.col("strength") >= min_strength) & F.col("reception").isin(reception)))
    total = hit.agg(F.count(F.lit(1)).alias("n_hits"))
    return hit.orderBy(F.desc("strength"), "obs_id").offset(offset).limit(limit).join(F.broadcast(total))


def facet_counts(dossiers: DataFrame) -> DataFrame:
    items = F.array(F.struct(F.lit("band").alias("facet"), F.col("band").alias("value")), F.struct(F.lit("reception").alias("facet"), F.col("reception").alias("value")))
    return dossiers.select(F.explode(items).alias("i")).groupBy("i.facet", "i.value").agg(F.count(F.lit(1)).alias("n"))

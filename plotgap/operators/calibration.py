"""How good was the sensor: detection rates scored by a rule blind to the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions import classes as K
from plotgap.operators.matching import maximum_matching, with_components
from plotgap.plans.ranks import median, uniform
from plotgap.plans.reuse import pin


def chance_of_tracks(fixes: DataFrame, observations: DataFrame, searched_km2: DataFrame, k: float = C.K_SIGMA) -> DataFrame:
    """Located tracks with the probability that their match radius holds a random detection.

    One detection uncertainty per scene is used, so a track's eligibility cannot depend on
    the detection it happened to be paired with.
    """
    sigma = median(observations, ["scene"], F.col("uncertainty_m"), "obs_sigma", width=10.0).select(
        "scene", F.col("n").alias("n_obs"), "obs_sigma")
    density = searched_km2.join(sigma, "scene", "left").select(
        "scene", F.coalesce("obs_sigma", F.lit(0.0)).alias("obs_sigma"),
        (F.col("n_obs") / F.nullif("km2", F.lit(0.0))).alias("density"))
    rows = fixes.where("has_fix").join(density, "scene", "left")
    length = F.coalesce("length_m", F.lit(C.DEFAULT_LENGTH_M))
    radius = k * F.sqrt(F.coalesce("obs_sigma", F.lit(0.0)) ** 2 + F.col("uncertainty_m") ** 2 + (length / 2) ** 2)
    return rows.withColumn("chance", F.coalesce(K.chance_match(radius, "density"), F.lit(0.0)))


def scorable_tracks(fixes: DataFrame, observations: DataFrame, searched_km2: DataFrame, k: float = C.K_SIGMA) -> DataFrame:
    return chance_of_tracks(fixes, observations, searched_km2, k).where(F.col("chance") <= C.MAX_CHANCE_MATCH)


def calibrate(fixes: DataFrame, matched: DataFrame, observations: DataFrame, searched_km2: DataFrame,
              k: float = C.K_SIGMA) -> DataFrame:
    """Long table (scene, kind, stratum, found, scored, chance) of additive counts.

    A located track whose match radius would hold a random detection more often than the
    limit is 'unscorable'; everything else is scored once, by class and by length bin.
    """
    keys = ["scene", "platform_id", "track_seq"]
    hit = matched.select(*keys).distinct().withColumn("_hit", F.lit(1))
    rows = chance_of_tracks(fixes, observations, searched_km2, k).join(hit, keys, "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(0)))
    scorable = F.col("chance") <= C.MAX_CHANCE_MATCH

    def item(kind, stratum):
        return F.struct(F.lit(kind).alias("kind"), stratum.alias("stratum"))
    items = F.when(scorable, F.array(item("strata", K.length_class("length_m")), item("strata", F.lit("all scored")),
                                     item("curve", K.length_bin("length_m")))).otherwise(
        F.array(item("unscorable", F.lit("unscorable"))))
    long = rows.select("scene", "hit", "chance", F.explode(items).alias("i")).select("scene", "hit", "chance", "i.*")
    return long.groupBy("scene", "kind", "stratum").agg(F.sum("hit").alias("found"), F.count(F.lit(1)).alias("scored"),
                                                        F.sum("chance").alias("chance"))


def pool_calibration(calibration: DataFrame) -> DataFrame:
    """Counts added over passes, with rate and score interval; no scored vessels, no rate."""
    rows = calibration.groupBy("kind", "stratum").agg(F.sum("found").alias("found"), F.sum("scored").alias("scored"))
    w = K.wilson("found", "scored")
    return rows.withColumn("rate", F.col("found") / F.nullif("scored", F.lit(0))).withColumn("lo", w["lo"]).withColumn("hi", w["hi"])


def gates(spark, snr=tuple(C.SNR_GATES), pixels=tuple(C.PIXEL_GATES)) -> DataFrame:
    """The gate grid as a small table (its size is fixed by the two lists)."""
    return spark.createDataFrame([(float(s), int(p)) for s in snr for p in pixels], "min_snr double, min_pixels int")


def gate_counts(observations: DataFrame) -> DataFrame:
    """Detections kept by each gate.

    Gate counts are cumulative, so rows are first collapsed to (snr gates passed, pixel
    gates passed) steps, and the grid is summed from that small table.
    """
    def passed(column, edges):
        return sum((F.when(F.col(column) >= g, 1).otherwise(0) for g in edges), F.lit(0))
    steps = observations.groupBy(passed("snr", C.SNR_GATES).alias("s"), passed("pixels", C.PIXEL_GATES).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = (gates(observations.sparkSession).withColumn("gs", passed("min_snr", C.SNR_GATES))
            .withColumn("gp", passed("min_pixels", C.PIXEL_GATES)))
    got = grid.join(F.broadcast(steps), (F.col("s") >= F.col("gs")) & (F.col("p") >= F.col("gp")), "left")
    return got.groupBy("min_snr", "min_pixels").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept"))


def gate_grid_search(observations: DataFrame, fixes: DataFrame, pairs: DataFrame, searched_km2: DataFrame) -> DataFrame:
    """Headline rate and unmatched density for every gate, all scored on the same vessels.

    Admissible pairs are found once; each gate's matching is a scene of its own in one
    combined matching job. A gate only takes pairs away, so components are found once, without
    a gate, and hold whole components of every gate.
    """
    grid = gates(observations.sparkSession).withColumn("gate", F.row_number().over(Window.orderBy("min_snr", "min_pixels")))
    grid = grid.select("min_snr", "min_pixels", F.col("gate").cast("bigint").alias("gate"))
    strength = with_components(pairs).join(observations.select("scene", "obs_id", "snr", "pixels"), ["scene", "obs_id"])
    open_ = strength.join(F.broadcast(grid), (F.col("snr") >= F.col("min_snr")) & (F.col("pixels") >= F.col("min_pixels")))
    n = F.lit(len(C.SNR_GATES) * len(C.PIXEL_GATES) + 1)
    layered = open_.select((F.col("scene") * n + F.col("gate")).alias("scene"), (F.col("obs_id") * n + F.col("gate")).alias("obs_id"),
                           "platform_id", "track_seq", "distance_m", "radius_m", F.concat_ws("|", "gate", "component").alias("component"))
    won = pin(maximum_matching(layered).select(F.floor(F.col("scene") / n).alias("scene"), (F.col("scene") % n).alias("gate"),
                                               "platform_id", "track_seq"))
    keys = ["scene", "platform_id", "track_seq"]
    scored = scorable_tracks(fixes, observations, searched_km2).where(K.length_class("length_m") == ">=25 m").select(*keys)
    total = scored.agg(F.count(F.lit(1)).alias("scored"))
    area = searched_km2.agg(F.sum("km2").alias("km2"))
    found = won.join(scored, keys, "left_semi").groupBy("gate").agg(F.count(F.lit(1)).alias("found"))
    matched = won.groupBy("gate").agg(F.count(F.lit(1)).alias("n_matched"))
    out = (grid.join(gate_counts(observations), ["min_snr", "min_pixels"]).join(found, "gate", "left").join(matched, "gate", "left")
           .fillna(0, ["found", "n_matched"]).join(F.broadcast(total)).join(F.broadcast(area)))
    return (out.withColumn("rate", F.col("found") / F.nullif("scored", F.lit(0)))
            .withColumn("unmatched", F.col("n_kept") - F.col("n_matched"))
            .withColumn("unmatched_per_1000km2", 1000.0 * (F.col("n_kept") - F.col("n_matched")) / F.nullif("km2", F.lit(0.0)))
            .drop("gate", "n_matched", "km2"))


def choose_gate(outcomes: DataFrame, min_rate_kept: float) -> DataFrame:
    """Fewest unmatched per area among gates keeping enough of the loosest gate's rate; ties to the stricter."""
    base = outcomes.where((F.col("min_snr") == C.SNR_GATES[0]) & (F.col("min_pixels") == C.PIXEL_GATES[0])).select(
        F.col("rate").alias("_base"))
    ok = outcomes.join(F.broadcast(base)).where(F.col("rate") >= min_rate_kept * F.col("_base")).drop("_base")
    return ok.orderBy("unmatched_per_1000km2", F.desc("min_snr"), "min_pixels").limit(1)


def size_bin(pixels):
    out = F.lit(len(C.SIZE_BIN_EDGES) - 1)
    for i, (lo, hi) in reversed(list(enumerate(zip(C.SIZE_BIN_EDGES, C.SIZE_BIN_EDGES[1:])))):
        out = F.when((F.col(pixels) >= lo) & (F.col(pixels) < hi), i).otherwise(out)
    return out


def size_rates(labelled: DataFrame) -> DataFrame:
    """P(vessel) per cluster-size bin from usable labels (vessel against clutter or fixed)."""
    usable = labelled.where(F.col("verdict").isin("vessel", "clutter", "fixed"))
    rows = usable.groupBy(size_bin("pixels").alias("bin")).agg(F.count(F.lit(1)).alias("labelled"),
                                                              F.count_if(F.col("verdict") == "vessel").alias("vessel"))
    w = K.wilson("vessel", "labelled", empty="unit")
    return rows.withColumn("rate", F.col("vessel") / F.col("labelled")).withColumn("lo", w["lo"]).withColumn("hi", w["hi"])


def gate_cost(candidates: DataFrame, rates: DataFrame) -> DataFrame:
    """What each size gate keeps and loses, and how unevenly it thins the bands."""
    # collapse to (pixels, band) first: the gate expansion then works on a small table
    cells = candidates.groupBy("pixels", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", size_bin("pixels"))
    cells = cells.join(F.broadcast(rates.select("bin", "rate")), "bin", "left").withColumn("v", F.col("n") * F.col("rate"))
    gate = cells.withColumn("gate", F.explode(F.array(*[F.lit(g) for g in [0, *C.SIZE_GATES]])))
    keep = F.col("pixels") >= F.col("gate")
    kept = gate.groupBy("gate").agg(F.sum(F.when(keep, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(keep, F.col("v")).otherwise(0.0)).alias("est_vessels"),
                                    F.sum("n").alias("total"), F.sum("v").alias("base_v"))
    shares = gate.groupBy("gate", "band").agg((F.sum(F.when(keep, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    spread = shares.groupBy("gate").agg((F.max("share") / F.nullif(F.min("share"), F.lit(0.0))).alias("band_spread"))
    return (kept.join(spread, "gate").withColumn("vessels_lost", F.col("base_v") - F.col("est_vessels"))
            .withColumn("clutter_removed", (F.col("total") - F.col("base_v")) - (F.col("kept") - F.col("est_vessels")))
            .withColumn("purity", F.col("est_vessels") / F.nullif("kept", F.lit(0))).drop("base_v"))


def gate_fit_error(labelled: DataFrame, splits: int, seed: str) -> DataFrame:
    """Relative error of the bin rates on the held-out half, for repeated hash splits.

    Each label is expanded once per split and immediately summed by (split, half, bin).
    """
    usable = labelled.where(F.col("verdict").isin("vessel", "clutter", "fixed"))
    rows = usable.select("key", size_bin("pixels").alias("bin"), F.when(F.col("verdict") == "vessel", 1).otherwise(0).alias("y"),
                         F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    half = F.when(uniform(seed, "split", "key") < 0.5, "fit").otherwise("test")
    cells = rows.groupBy("split", half.alias("half"), "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    fit = cells.where("half = 'fit'").select("split", "bin", (F.col("k") / F.col("n")).alias("rate"))
    every = cells.where("half = 'fit'").groupBy("split").agg((F.sum("k") / F.sum("n")).alias("overall"))
    test = cells.where("half = 'test'").join(fit, ["split", "bin"], "left").join(every, "split")
    out = test.groupBy("split").agg(F.sum(F.col("n") * F.coalesce("rate", "overall")).alias("predicted"), F.sum("k").alias("actual"))
    return out.where("actual > 0").withColumn("rel_error", F.abs(F.col("predicted") - F.col("actual")) / F.col("actual"))


def floor_audit(observations: DataFrame, min_snr: float, min_pixels: int) -> DataFrame:
    low_snr, low_px = F.col("snr") < min_snr, F.col("pixels") < min_pixels
    return observations.agg(F.count(F.lit(1)).alias("n"), F.count_if(~low_snr & ~low_px).alias("kept"),
                            F.count_if(low_snr & ~low_px).alias("snr_only"), F.count_if(~low_snr & low_px).alias("pixels_only"),
                            F.count_if(low_snr & low_px).alias("both"))


def floor_histogram(observations: DataFrame, min_snr: float, min_pixels: int) -> DataFrame:
    """Discarded detections by size and by strength."""
    cut = observations.where((F.col("snr") < min_snr) | (F.col("pixels") < min_pixels))
    size = K.binned("pixels", [(3.0, "2-3 px"), (4.0, "3-4 px"), (6.0, "4-6 px"), (8.0, "6-8 px"), (12.0, "8-12 px"), (None, "12+ px")])
    snr = K.binned("snr", [(8.0, "6-8 SNR"), (10.0, "8-10 SNR"), (12.0, "10-12 SNR"), (15.0, "12-15 SNR"), (None, "15+ SNR")])
    return cut.select(F.explode(F.array(size, snr)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))

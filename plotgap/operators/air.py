"""Air study: cooperative against independent fixes inside and outside an obligation boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.classes import altitude_ft
from plotgap.functions.geo import equirect_m
from plotgap.plans.ranks import hash_rank, uniform
from plotgap.plans.reuse import pin
from plotgap.plans.sequence import HOUR_US, chunk_of, with_next

US = 1_000_000


def _cell(df: DataFrame) -> DataFrame:
    """Rows with a position, and their cell."""
    return (df.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("col", F.floor(F.col("lon") / C.AIR_CELL_DEG).cast("bigint"))
            .withColumn("row", F.floor(F.col("lat") / C.AIR_CELL_DEG).cast("bigint")))


def air_units(fixes: DataFrame) -> DataFrame:
    """Cooperative, independent and TIS-B counts per (cell, altitude band, day)."""
    rows = _cell(fixes).withColumn("_ft", altitude_ft("alt_baro")).where("_ft IS NOT NULL")
    band = F.when(F.col("_ft") < C.SPLIT_FT, "<10k").otherwise(">=10k")
    kind = F.col("type")
    known = kind.isin(C.INDEPENDENT_TYPES + C.TISB_TYPES + C.COOPERATIVE_TYPES)
    return rows.where(known).groupBy("col", "row", band.alias("band"), "day").agg(
        F.count_if(kind.isin(C.COOPERATIVE_TYPES)).alias("coop"), F.count_if(kind.isin(C.INDEPENDENT_TYPES)).alias("ind"),
        F.count_if(kind.isin(C.TISB_TYPES)).alias("tisb"))


def direct_mask(fixes: DataFrame) -> DataFrame:
    return _cell(fixes.where(F.col("type").isin(C.INDEPENDENT_TYPES))).select("col", "row").distinct()


def continuity_mask(fixes: DataFrame, max_gap_s: float = C.CONTINUITY_GAP_S) -> DataFrame:
    """Cells crossed between consecutive independent fixes of one aircraft."""
    ind = fixes.where(F.col("type").isin(C.INDEPENDENT_TYPES) & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("hex", "t_us", "lon", "lat", "event_id")
    rows = with_next(ind, ["hex"], ["t_us", "lon", "lat", "event_id"], ["t_us", "lon", "lat"], chunk_of("t_us", 6 * HOUR_US))
    gap = (F.col("next_t_us") - F.col("t_us")) / US
    near = rows.where((gap > 0) & (gap <= max_gap_s))
    dx, dy = F.col("next_lon") - F.col("lon"), F.col("next_lat") - F.col("lat")
    steps = F.greatest(F.abs(dx), F.abs(dy)) / (C.AIR_CELL_DEG / 2)
    near = near.withColumn("_n", F.floor(F.greatest(steps, F.lit(1.0))).cast("int"))
    walk = near.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    return walk.select(F.floor((F.col("lon") + dx * F.col("_i") / F.col("_n")) / C.AIR_CELL_DEG).cast("bigint").alias("col"),
                       F.floor((F.col("lat") + dy * F.col("_i") / F.col("_n")) / C.AIR_CELL_DEG).cast("bigint").alias("row")).distinct()


def mask_algebra(units: DataFrame, direct: DataFrame, crossed: DataFrame) -> DataFrame:
    """Every cell with cooperative traffic and how it is covered: direct, inferred or blind."""
    have = units.groupBy("col", "row").agg(F.sum("coop").alias("coop")).where("coop > 0").select("col", "row")
    d = direct.withColumn("_d", F.lit(True))
    i = crossed.withColumn("_i", F.lit(True))
    rows = have.join(d, ["col", "row"], "left").join(i, ["col", "row"], "left")
    return rows.select("col", "row", F.when(F.col("_d"), "direct").when(F.col("_i"), "inferred").otherwise("blind").alias("cover"))


def boundary_side(cells: DataFrame, airports: DataFrame, veil_nm: float = C.VEIL_NM) -> DataFrame:
    """inside or outside the union of circles, at each cell's centre.

    The list of regulated airports is a short published table; it travels as one array,
    and the nearest distance is a minimum over it.
    """
    listed = airports.agg(F.collect_list(F.struct("lat", "lon")).alias("_a"))
    y, x = (F.col("row") + 0.5) * C.AIR_CELL_DEG, (F.col("col") + 0.5) * C.AIR_CELL_DEG
    nearest = F.array_min(F.transform("_a", lambda a: equirect_m(y, x, a["lat"], a["lon"]))) / C.NM_M
    signed = nearest - veil_nm
    return (cells.join(F.broadcast(listed)).withColumn("signed_nm", signed).drop("_a")
            .withColumn("side", F.when(F.col("signed_nm") >= 0, "outside").otherwise("inside")))


def group_means(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and pooled independent share per (band, side)."""
    share = F.when(F.col("ind") + F.col("coop") > 0, F.col("ind") / (F.col("ind") + F.col("coop"))).otherwise(0.0)
    return units.groupBy(*keys, "band", "side").agg(
        F.avg(share).alias("mean_share"), (F.sum("ind") / F.sum(F.col("ind") + F.col("coop"))).alias("pooled_share"),
        F.count(F.lit(1)).alias("n_units"))


def did(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Step outside minus inside per band, and the difference of the two steps."""
    def at(band, side):
        return F.max(F.when((F.col("band") == band) & (F.col("side") == side), F.col("mean_share")))
    low, high = at("<10k", "outside") - at("<10k", "inside"), at(">=10k", "outside") - at(">=10k", "inside")
    agg = [low.alias("treatment_step"), high.alias("control_step")]
    out = groups.groupBy(*keys).agg(*agg) if keys else groups.agg(*agg)
    return out.withColumn("did", F.col("treatment_step") - F.col("control_step"))


def difference_in_differences(units: DataFrame, sides: DataFrame, floor: int = 200) -> DataFrame:
    kept = units.where(F.col("coop") >= floor).join(sides.select("col", "row", "side"), ["col", "row"])
    return did(group_means(kept))


def day_collapsed(units: DataFrame) -> DataFrame:
    return units.groupBy("col", "row", "band").agg(F.sum("coop").alias("coop"), F.sum("ind").alias("ind"))


def cell_sums(units: DataFrame, floor: int) -> DataFrame:
    """Units over the floor, reduced to (cell, band): number and sum of shares.

    A null trial only moves whole cells between sides, so group means follow from these
    sums; trials never touch the units again.
    """
    share = F.when(F.col("ind") + F.col("coop") > 0, F.col("ind") / (F.col("ind") + F.col("coop"))).otherwise(0.0)
    return units.where(F.col("coop") >= floor).groupBy("col", "row", "band").agg(F.sum(share).alias("s"), F.count(F.lit(1)).alias("n"))


def _trial_did(labelled: DataFrame) -> DataFrame:
    g = labelled.groupBy("trial", "band", "side").agg((F.sum("s") / F.sum("n")).alias("mean_share"))
    return did(g, ["trial"])


def _count_beyond(trials: DataFrame, observed: DataFrame, name: str) -> DataFrame:
    both = trials.join(F.broadcast(observed.select(F.col("did").alias("_obs"))))
    beyond = F.abs(F.round("did", 6)) >= F.abs(F.round("_obs", 6))
    return both.agg(F.count_if(beyond).alias(f"{name}_k"), F.count(F.lit(1)).alias(f"{name}_trials"))


def air_nulls(units: DataFrame, sides: DataFrame, floor: int, trials: int, shift_trials: int, seed: str) -> DataFrame:
    """Two nulls of the difference in differences, two-sided.

    Scattered: every trial relabels the cells at random, keeping the outside count, by
    ranking cells on a hash. Shift: the cell-to-side map is displaced by whole cells; a
    cell whose source is off the map keeps its own side.
    """
    sides = pin(sides.select("col", "row", "side"))
    sums = pin(cell_sums(units, floor).join(sides.select("col", "row"), ["col", "row"], "left_semi"))
    observed = pin(difference_in_differences(units, sides, floor))
    extent = sides.agg((F.max("col") - F.min("col")).alias("wc"), (F.max("row") - F.min("row")).alias("wr"),
                       F.count_if(F.col("side") == "outside").alias("n_out"))
    used = sums.select("col", "row").distinct()
    cells = sides.select("col", "row", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    ranked = hash_rank(cells, ["trial"], uniform(seed, "trial", "col", "row"), ["col", "row"], "_rank", chunks=8)
    labels = (ranked.join(used, ["col", "row"], "left_semi").join(F.broadcast(extent.select("n_out")))
              .withColumn("side", F.when(F.col("_rank") <= F.col("n_out"), "outside").otherwise("inside")))
    scattered = _trial_did(labels.join(sums, ["col", "row"]))
    moves = extent.select("wc", "wr", F.explode(F.sequence(F.lit(1), F.lit(shift_trials))).alias("trial"))

    def step(axis, width):
        return F.floor(uniform(seed, F.lit(axis), "trial") * (2 * F.col(width) + 1)).cast("bigint") - F.col(width)
    moves = moves.select("trial", step("c", "wc").alias("dc"), step("r", "wr").alias("dr"))
    # one row per trial on the small side; the map itself is joined by key
    at = used.join(sides, ["col", "row"]).withColumnRenamed("side", "own").join(F.broadcast(moves))
    source = sides.select(F.col("col").alias("sc"), F.col("row").alias("sr"), F.col("side").alias("moved"))
    shifted = (at.withColumn("sc", F.col("col") + F.col("dc")).withColumn("sr", F.col("row") + F.col("dr"))
               .join(source, ["sc", "sr"], "left").withColumn("side", F.coalesce("moved", "own")))
    shift = _trial_did(shifted.join(sums, ["col", "row"]))
    a, b = _count_beyond(scattered, observed, "scattered"), _count_beyond(shift, observed, "shift")
    out = observed.select("did").join(F.broadcast(a)).join(F.broadcast(b))
    return (out.withColumn("scattered_p", (F.col("scattered_k") + 1) / (F.col("scattered_trials") + 1))
            .withColumn("shift_p", (F.col("shift_k") + 1) / (F.col("shift_trials") + 1)))


def air_verdict(nulls: DataFrame) -> DataFrame:
    return nulls.withColumn("verdict", F.when(F.col("did") <= 0, "REFUTED: the difference is not positive")
                            .when(F.col("shift_p") > 0.05, "REFUTED: positive, but a displaced boundary reproduces it")
                            .otherwise("SUPPORTED: positive and survives the shift null"))


def channel_tally(fixes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Fixes and craft per type inside a box, per poll round."""
    lon0, lat0, lon1, lat1 = box
    inside = fixes.where(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))
    per = inside.groupBy("poll", "type", "hex").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("poll", "type").agg(F.sum("n").alias("n_fixes"), F.count(F.lit(1)).alias("n_craft"))

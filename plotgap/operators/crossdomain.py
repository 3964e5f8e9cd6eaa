"""One boundary, two domains: do both change at it, and do they agree?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import cell_index
from plotgap.plans.nearest import nearest_line
from plotgap.plans.ranks import uniform
from plotgap.plans.reuse import pin, spread

DOMAINS = ("sea", "air")


def paired_cells(sea: DataFrame, air: DataFrame, cell_deg: float = C.RECEPTION_CELL_DEG) -> DataFrame:
    """(col, row, sea_n, sea_x, air_n, air_x): observations and hits of the cells that both domains visit.

    Both frames hold (lon, lat, hit). Comparing the same cells only keeps a difference in where ships and aircraft go from passing
    for a difference in what they do.
    """
    def counted(rows, name):
        return rows.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy(cell_index("lon", cell_deg).alias("col"), cell_index("lat", cell_deg).alias("row")).agg(
            F.count(F.lit(1)).alias(f"{name}_n"), F.count_if("hit").alias(f"{name}_x"))
    return counted(sea, "sea").join(counted(air, "air"), ["col", "row"])


def displaced_effects(cells: DataFrame, lines: DataFrame, near_m: float, far_m: float, trials: int, seed: str, cell_deg: float = C.RECEPTION_CELL_DEG,
                      least_m: float = 3_000.0, most_m: float = 20_000.0) -> DataFrame:
    """(trial, effect_sea, effect_air): share of hits within ``near_m`` of a line less the share from there to ``far_m``.

    Trial 0 is where the lines are. In every other one they move by one draw of distance and bearing that both domains share, so
    whatever the domains have in common by place alone shows up as correlation of the trials. Lines move by moving the cells the
    other way. An effect with an empty zone is unknown, not zero.
    """
    dist = F.when(F.col("trial") == 0, 0.0).otherwise(least_m + (most_m - least_m) * uniform(seed, F.lit("d"), "trial"))
    angle = uniform(seed, F.lit("a"), "trial") * 6.283185307179586
    lon, lat = (F.col("col") + 0.5) * cell_deg, (F.col("row") + 0.5) * cell_deg
    names = [f"{d}_{v}" for d in DOMAINS for v in "nx"]
    moved = (spread(cells, "col", "row").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
             .withColumn("lat", lat - dist * F.cos(angle) / C.M_PER_DEG)
             .withColumn("lon", lon - dist * F.sin(angle) / (C.M_PER_DEG * F.cos(F.radians(lat))))
             .select(F.struct("trial", "col", "row", *names).alias("at"), "lon", "lat"))
    far = nearest_line(moved, lines.withColumn("line_set", F.lit("all")), "at").select("at.*", "d_m").where(F.col("d_m") <= far_m)
    near = F.col("d_m") <= near_m

    def effect(d):
        def share(zone):
            n = F.sum(F.when(zone, F.col(f"{d}_n")))
            return F.sum(F.when(zone, F.col(f"{d}_x"))) / F.nullif(n, F.lit(0))
        return (share(near) - share(~near)).alias(f"effect_{d}")
    return far.groupBy("trial").agg(*[effect(d) for d in DOMAINS])


def cross_domain(sea: DataFrame, air: DataFrame, lines: DataFrame, near_m: float, far_m: float, trials: int = 400, seed: str = "cross",
                 cell_deg: float = C.RECEPTION_CELL_DEG) -> DataFrame:
    """One row: the effect of each domain against displaced lines, how far the domains go together, and both pooled.

    z is the effect in standard deviations of its trials; p counts trials at least as far out on either side, as (k + 1) / (n + 1).
    The joint z adds both and divides by what their correlation over the trials leaves. Pooling is by random effects: ``q`` is the
    disagreement, ``tau2`` the variance between domains that it implies. All statistics come from one row for each trial.
    """
    cells = pin(paired_cells(sea, air, cell_deg))
    effects = pin(displaced_effects(cells, lines, near_m, far_m, trials, seed, cell_deg))
    whole = effects.where("trial > 0 AND effect_sea IS NOT NULL AND effect_air IS NOT NULL")
    null = whole.agg(F.count(F.lit(1)).alias("n_trials"), F.corr("effect_sea", "effect_air").alias("trial_r"),
                     *[f(f"effect_{d}").alias(f"{k}_{d}") for d in DOMAINS for k, f in (("m", F.avg), ("s", F.stddev_samp))])

    def with_z(rows):
        for d in DOMAINS:
            rows = rows.withColumn(f"z_{d}", F.round((F.col(f"effect_{d}") - F.col(f"m_{d}")) / F.nullif(f"s_{d}", F.lit(0.0)), 9))
        r = F.coalesce("trial_r", F.lit(0.0))
        return rows.withColumn("z_joint", F.round((F.col("z_sea") + F.col("z_air")) / F.sqrt(F.nullif(2.0 + 2.0 * r, F.lit(0.0))), 9))
    found = effects.where("trial = 0").select("effect_sea", "effect_air")
    one = with_z(F.broadcast(cells.agg(F.count(F.lit(1)).alias("n_cells"))).join(null).join(found, how="left"))  # one row each
    tries = with_z(whole.join(F.broadcast(null))).select(*[F.abs(f"z_{d}").alias(f"t_{d}") for d in (*DOMAINS, "joint")])
    beyond = tries.join(F.broadcast(one.select(*[f"z_{d}" for d in (*DOMAINS, "joint")]))).agg(
        *[F.count_if(F.col(f"t_{d}") >= F.abs(f"z_{d}")).alias(f"k_{d}") for d in (*DOMAINS, "joint")])
    out = one.join(F.broadcast(beyond))
    for d in (*DOMAINS, "joint"):
        out = out.withColumn(f"p_{d}", F.when(F.col(f"z_{d}").isNotNull(), (F.col(f"k_{d}") + 1) / (F.col("n_trials") + 1)))

    def pooled(extra):
        weight = {d: 1.0 / F.nullif(F.pow(F.col(f"s_{d}"), 2) + extra, F.lit(0.0)) for d in DOMAINS}
        total = weight["sea"] + weight["air"]
        shift = {d: F.col(f"effect_{d}") - F.col(f"m_{d}") for d in DOMAINS}
        return weight, shift, total, (weight["sea"] * shift["sea"] + weight["air"] * shift["air"]) / total
    weight, shift, total, mean = pooled(F.lit(0.0))
    out = out.withColumn("q", sum((weight[d] * F.pow(shift[d] - mean, 2) for d in DOMAINS), F.lit(0.0)))
    out = out.withColumn("tau2", F.greatest(F.lit(0.0), (F.col("q") - 1) / (total - sum((F.pow(weight[d], 2) for d in DOMAINS), F.lit(0.0)) / total)))
    _, _, total, mean = pooled(F.col("tau2"))
    return out.withColumn("pooled", mean).withColumn("pooled_se", 1.0 / F.sqrt(total)).select(
        "n_cells", "n_trials", *[f"{k}_{d}" for d in DOMAINS for k in ("effect", "z", "p")], "trial_r", "z_joint", "p_joint", "q", "tau2", "pooled", "pooled_se")

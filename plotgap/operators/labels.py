"""Reader labels: sampling, agreement, contamination rates and what they do to the ratios."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgap.functions.classes import agreement_gloss
from plotgap.functions.geo import haversine_m
from plotgap.plans.grid import band_join
from plotgap.plans.ranks import hash_rank, index_rank, quantiles, uniform
from plotgap.plans.sequence import running


def labels_last_wins(labels: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Last verdict per key by line sequence."""
    rest = [c for c in labels.columns if c != key]
    return labels.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def stratified_sample(pool: DataFrame, per: int, seed: str, stratum: str = "stratum", date: str = "day", key: str = "obs_id") -> DataFrame:
    """Round-robin over dates inside each stratum, dates shuffled by hash, ``per`` rows each.

    Only the first ``per`` of any (stratum, date) can be chosen, so the second ranking
    works on at most per x dates rows of a stratum.
    """
    within = hash_rank(pool, [stratum, date], uniform(seed, key), [key], "_round").where(F.col("_round") <= per)
    turn = Window.partitionBy(stratum).orderBy("_round", date, key)
    return within.withColumn("_pick", F.row_number().over(turn)).where(F.col("_pick") <= per).withColumnRenamed("_pick", "pick").drop("_round")


def review_draw(pool: DataFrame, read: DataFrame, n_near: int, n_rest: int, seed: str, near: str = "<=2nm", key: str = "key") -> DataFrame:
    """Random unread rows: a fixed number near the line and a fixed number elsewhere."""
    unread = pool.join(read.select(key).distinct(), key, "left_anti")
    group = F.when(F.col("band") == near, "near").otherwise("rest")
    ranked = hash_rank(unread.withColumn("grp", group), ["grp"], uniform(seed, key), [key], "_rank")
    return ranked.where(F.col("_rank") <= F.when(F.col("grp") == "near", n_near).otherwise(n_rest)).drop("_rank")


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, merge: dict[str, str] | None = None) -> DataFrame:
    """Observed and chance agreement, kappa, standard error and gloss; null when chance is certain."""
    def merged(c):
        out = F.col(c)
        for old, new in (merge or {}).items():
            out = F.when(F.col(c) == old, new).otherwise(out)
        return out
    m = confusion_matrix(pairs.select(merged("a").alias("a"), merged("b").alias("b")))
    rows, cols = m.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("na")), m.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    pe = rows.join(cols, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("_x"))
    got = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("_agree")).join(F.broadcast(pe))
    n = F.col("n").cast("double")
    po, pe_ = F.col("_agree") / n, F.coalesce("_x", F.lit(0)) / (n * n)
    room = F.nullif(F.lit(1.0) - pe_, F.lit(0.0))
    out = got.withColumn("observed", po).withColumn("expected", pe_).withColumn("kappa", (po - pe_) / room)
    out = out.withColumn("se", F.sqrt(po * (1 - po) / (n * room * room)))
    return out.withColumn("gloss", F.when(F.col("kappa").isNotNull(), agreement_gloss("kappa"))).drop("_agree", "_x")


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.col("a").eqNullSafe(F.col("b")))


def reader_stability(pairs: DataFrame) -> DataFrame:
    """Agreement per round, near and far from the line."""
    grp = F.when(F.col("band") == "<=2nm", "<=2nm").otherwise(">2nm")
    return pairs.groupBy("round", grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agree"))


def reader_drift(stability: DataFrame, points: float = 10.0) -> DataFrame:
    """First to last round far from the line, flagged when it moved by ``points`` or more."""
    far = stability.where("grp = '>2nm'").agg(F.min_by("agree", "round").alias("first"), F.max_by("agree", "round").alias("last"), F.count(F.lit(1)).alias("rounds"))
    change = (F.col("last") - F.col("first")) * 100
    return far.where("rounds >= 2").withColumn("change_points", change).withColumn("unstable", F.abs(change) >= points)


def stratum_rates(candidates: DataFrame, verdicts: DataFrame, ambiguous_as_clutter: bool = False) -> DataFrame:
    """Vessel share per stratum; unlabelled strata are kept with a null rate, odd verdicts counted apart."""
    rows = candidates.join(verdicts, "key", "left")
    v = F.col("verdict")
    base = ["vessel", "clutter", "fixed"] + (["ambiguous"] if ambiguous_as_clutter else [])
    out = rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("population"), F.count_if(v == "vessel").alias("vessel"), F.count_if(v.isin(base)).alias("labelled"),
        F.count_if(v.isNotNull() & ~v.isin(base)).alias("excluded"))
    return out.withColumn("rate", F.col("vessel") / F.nullif("labelled", F.lit(0)))


def point_correction(candidates: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """Keep round(rate x n) rows of each stratum at random; an unlabelled stratum stays whole."""
    ranked = hash_rank(candidates, ["stratum"], uniform(seed, "key"), ["key"], "_rank")
    keep = F.bround(F.coalesce("rate", F.lit(1.0)) * F.col("population"), 0)
    return ranked.join(F.broadcast(rates.select("stratum", "rate", "population")), "stratum").where(F.col("_rank") <= keep).drop("_rank", "rate", "population")


def _beta(batches: Iterator[pd.DataFrame], seed: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        draws = []
        for rep, stratum, k, n in b.itertuples(index=False):
            rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{rep}|{stratum}".encode()).digest()[:8], "big"))
            draws.append(rng.beta(k + 0.5, n - k + 0.5) if n else 1.0)
        yield b[["replicate", "stratum"]].assign(draw=draws)


def beta_draws(rates: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(replicate, stratum, draw): rates from Beta(k + 1/2, n - k + 1/2); 1 where nothing is labelled."""
    grid = rates.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), "stratum", F.col("vessel").alias("k"), F.col("labelled").alias("n"))
    return grid.mapInPandas(lambda it: _beta(it, seed), "replicate int, stratum string, draw double")


def beta_replicates(candidates: DataFrame, draws: DataFrame, seed: str) -> DataFrame:
    """Kept counts per (replicate, band): each candidate is kept when its hash falls under the draw.

    Draws are a small table, so the expansion is a map-side join followed at once by a
    partial count.
    """
    rows = candidates.select("key", "stratum", "band").join(F.broadcast(draws), "stratum")
    return rows.where(uniform(seed, "replicate", "key") < F.col("draw")).groupBy("replicate", "band").agg(F.count(F.lit(1)).alias("n"))


def corrected_ratios(kept: DataFrame, published: DataFrame) -> DataFrame:
    """obs / exp per (replicate, band) after rescaling the expectation to the kept total."""
    totals = kept.groupBy("replicate").agg(F.sum("n").alias("n_rep"))
    n0 = published.agg(F.sum("observed").alias("n0"))
    frame = totals.join(F.broadcast(published.select("band", "expected"))).join(F.broadcast(n0)).join(kept, ["replicate", "band"], "left").fillna(0, ["n"])
    scale = F.col("n_rep") / F.col("n0")
    return frame.select("replicate", "band", (F.col("n") / F.nullif(F.col("expected") * scale, F.lit(0.0))).alias("ratio"))


def ratio_interval(ratios: DataFrame) -> DataFrame:
    """5 to 95 per cent of the replicates by index."""
    return quantiles(ratios, ["band"], F.col("ratio"), {"lo": F.floor(F.lit(0.05) * F.col("total")), "hi": index_rank(0.95)}, 0.05)


def extreme_near_ratio(candidates: DataFrame, published: DataFrame, near: Sequence[str]) -> DataFrame:
    """Near-band ratio if every near row is kept and every at-gate row elsewhere is thrown away."""
    kept = candidates.where((F.col("coarse") == "<=2nm") | (F.col("strength") == "clear"))
    k = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band").isin(list(near))).alias("n_near"))
    p = published.agg(F.sum("observed").alias("n0"), F.sum(F.when(F.col("band").isin(list(near)), F.col("expected"))).alias("e_near"))
    return k.join(F.broadcast(p)).select("n", "n_near", (F.col("n_near") / F.nullif(F.col("e_near") * F.col("n") / F.col("n0"), F.lit(0.0))).alias("ratio"))


def even_sample(rows: DataFrame, k: int, order: Sequence[str], chunk) -> DataFrame:
    """Every (n / k)-th row of the order, by rounded position."""
    whole = rows.withColumn("_all", F.lit(0))
    ranked = running(whole, ["_all"], order, F.lit(1), "_i", "sum", chunk)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    i, size = F.col("_i") - 1, F.col("_n")
    step = size / float(k)
    slot = F.floor((i + 0.5) / step)
    hit = F.bround(slot * step, 0).cast("bigint") == i
    hit = hit | (F.bround((slot + 1) * step, 0).cast("bigint") == i) & (slot + 1 < k)
    return ranked.join(F.broadcast(n)).where((size <= k) | hit).drop("_all", "_i", "_n")


def label_queue(sample: DataFrame, chips: DataFrame, read: DataFrame, session: DataFrame, seed: str, key: str = "key", within_m: float = 1.0) -> DataFrame:
    """Sampled rows and the nearest chip within ``within_m``, of this session, not yet read, in a fixed shuffle."""
    places = chips.select("chip", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    near = band_join(sample.select(key, "lat", "lon"), places, ("lat", "lon"), ("_lat", "_lon"), F.lit(within_m), (within_m,), spread="chip")
    away = haversine_m("lat", "lon", "_lat", "_lon")
    nearest = near.withColumn("_m", away).where(F.col("_m") <= within_m).groupBy(key).agg(F.min_by("chip", F.struct("_m", "chip")).alias("chip"))
    ready = sample.join(nearest, key)
    open_ = ready.join(session.select(key).distinct(), key, "left_semi").join(read.select(key).distinct(), key, "left_anti")
    return open_.withColumn("shuffle", uniform(seed, key)).orderBy("shuffle", key)


def label_progress(candidates: DataFrame, verdicts: DataFrame, need_note: Sequence[str] = ("ambiguous", "fixed")) -> DataFrame:
    """Counts by stratum and verdict ('unread' included) and how many lack a required note."""
    rows = candidates.join(verdicts, "key", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unread")))
    missing = F.col("verdict").isin(list(need_note)) & (F.coalesce(F.trim("note"), F.lit("")) == "")
    return rows.groupBy("stratum", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("n_without_note"))

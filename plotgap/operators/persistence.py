"""Places that detections keep coming back to: sites, their denominators and verdicts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import cell_index
from plotgap.operators.matching import nearest_site
from plotgap.plans.components import connected_components, ensure_checkpoint_dir

ASSIGN_SCHEMA = "obs_id bigint, site_id bigint"


def _walk(batches: Iterator[pd.DataFrame], radius_m: float) -> Iterator[pd.DataFrame]:
    """Assign detections, in order, to the nearest running centroid of their component.

    Rows arrive sorted by component and order; only the open sites of the current
    component are held, never its rows.
    """
    current, sites = None, []
    for batch in batches:
        out = []
        for comp, obs, lat, lon in zip(batch["component"], batch["obs_id"], batch["lat"], batch["lon"]):
            if comp != current:
                current, sites = comp, []
            best, best_d = None, radius_m
            for s in sites:
                dx = (lon - s[0]) * C.M_PER_DEG * math.cos(math.radians((lat + s[1]) / 2))
                gap = math.hypot(dx, (lat - s[1]) * C.M_PER_DEG)
                if gap <= best_d:
                    best, best_d = s, gap
            if best is None:
                best = [lon, lat, 0.0, 0.0, 0, obs]
                sites.append(best)
            best[2] += lon
            best[3] += lat
            best[4] += 1
            best[0], best[1] = best[2] / best[4], best[3] / best[4]
            out.append((obs, best[5]))
        yield pd.DataFrame(out, columns=["obs_id", "site_id"])


def assign_sites(detections: DataFrame, order: Sequence[str], radius_m: float = C.SITE_RADIUS_M) -> DataFrame:
    """(obs_id, site_id): sequential nearest-centroid clustering, site = its first detection.

    Detections are linked into components through occupied lattice cells two radii wide.
    A component no wider than the radius is one site whatever the order, since every
    running mean stays inside it: those (a structure seen on every pass, copies of one
    place) are plain aggregation, however many rows they hold. Only wider components
    need the ordered walk.
    """
    ensure_checkpoint_dir(detections.sparkSession)
    size = 2 * radius_m / C.M_PER_DEG
    narrow = detections.agg(F.max(F.abs("lat")).alias("m"))
    width = F.lit(size) / F.greatest(F.cos(F.radians(F.least(F.col("m") + size, F.lit(89.0)))), F.lit(0.01))
    placed = (detections.select("obs_id", "lat", "lon", *[c for c in order if c != "obs_id"]).join(F.broadcast(narrow))
              .withColumn("_r", F.floor(F.col("lat") / size)).withColumn("_c", F.floor(F.col("lon") / width)).drop("m")
              .withColumn("_cell", F.concat_ws(":", "_r", "_c")))
    cells = placed.select("_r", "_c", "_cell").distinct().checkpoint()
    beside = cells.select(F.col("_cell").alias("a"), F.explode(F.sequence(F.col("_r") - 1, F.col("_r") + 1)).alias("_r"), "_c")
    beside = beside.select("a", "_r", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1)).alias("_c"))
    comp = connected_components(beside.join(cells, ["_r", "_c"]).select("a", F.col("_cell").alias("b")))
    tagged = placed.join(comp.select(F.col("node").alias("_cell"), "component"), "_cell")
    spread = tagged.groupBy("component").agg(
        F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"),
        F.min_by("obs_id", F.struct(*order)).alias("first_id"))
    dx = (F.col("x1") - F.col("x0")) * C.M_PER_DEG * F.cos(F.radians(F.least(F.abs("y0"), F.abs("y1"))))
    compact = F.hypot(dx, (F.col("y1") - F.col("y0")) * C.M_PER_DEG) <= radius_m
    tagged = tagged.join(spread.select("component", compact.alias("compact"), "first_id"), "component")
    single = tagged.where("compact").select("obs_id", F.col("first_id").alias("site_id"))
    wide = (tagged.where("NOT compact").repartition("component").sortWithinPartitions("component", *order)
            .select("component", "obs_id", "lat", "lon"))
    return single.unionByName(wide.mapInPandas(lambda it: _walk(it, radius_m), ASSIGN_SCHEMA))


def cluster_sites(detections: DataFrame, order: Sequence[str], radius_m: float = C.SITE_RADIUS_M) -> DataFrame:
    """One row per site: centroid, count, dates seen, dates matched, brightest."""
    rows = detections.join(assign_sites(detections, order, radius_m), "obs_id")
    dates = F.array_sort(F.collect_set("day"))
    return rows.groupBy("site_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n_detections"), dates.alias("dates"),
        F.array_sort(F.collect_set(F.when(F.col("matched"), F.col("day")))).alias("matched_dates"), F.max("snr").alias("max_snr"))


def site_searched_dates(sites: DataFrame, searched: DataFrame, cell_deg: float) -> DataFrame:
    """Add the dates whose searched water covered the site."""
    cells = sites.withColumn("col", cell_index("lon", cell_deg)).withColumn("row", cell_index("lat", cell_deg))
    looked = (searched.where(F.col("level") / C.LEVELS >= C.SEARCHED).groupBy("col", "row")
              .agg(F.array_sort(F.collect_set("day")).alias("_looked")))
    return (cells.join(looked, ["col", "row"], "left").drop("col", "row")
            .withColumn("searched_dates", F.coalesce("_looked", F.array().cast("array<bigint>"))).drop("_looked"))


def site_verdict(sites: DataFrame, min_dates: int = C.SITE_MIN_DATES, min_fraction: float = C.SITE_MIN_FRACTION,
                 require_never_matched: bool = False) -> DataFrame:
    """Hit fraction since first seen, fixed or not, and the verdict text."""
    asked = F.array_union("searched_dates", "dates")
    rows = (sites.withColumn("n_dates", F.size("dates")).withColumn("first_seen", F.array_min("dates"))
            .withColumn("n_searched", F.size(asked))
            .withColumn("n_since", F.size(F.filter(asked, lambda x: x >= F.array_min("dates"))))
            .withColumn("ever_matched", F.size("matched_dates") > 0)
            .withColumn("hit_fraction", F.col("n_dates") / F.nullif("n_since", F.lit(0)))
            .withColumn("hit_fraction_all", F.col("n_dates") / F.nullif("n_searched", F.lit(0))))
    fixed = (F.col("n_dates") >= min_dates) & (F.col("hit_fraction") >= min_fraction)
    if require_never_matched:
        fixed = fixed & ~F.col("ever_matched")
    appeared = (F.col("n_since") < F.col("n_searched")) & (F.col("hit_fraction_all") < 0.5)
    told = F.col("ever_matched")
    text = (F.when(F.col("fixed") & told & appeared, "fixed structure (appeared during the year, AIS explained it at least once)")
            .when(F.col("fixed") & told, "fixed structure (AIS explained it at least once)")
            .when(F.col("fixed") & appeared, "fixed structure (appeared during the year)")
            .when(F.col("fixed"), "fixed structure").when(told, "traffic (AIS explained it at least once)")
            .when(F.col("n_dates") >= 2, "repeat, not yet fixed").otherwise("one pass only"))
    return rows.withColumn("fixed", F.coalesce(fixed, F.lit(False))).withColumn("verdict", text)


def candidates_without_furniture(unmatched: DataFrame, sites: DataFrame, radius_m: float = C.SITE_RADIUS_M) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): detections whose nearest site within the radius is fixed are furniture."""
    near = nearest_site(unmatched, sites.select("site_id", "lat", "lon", "fixed"), "obs_id", radius_m).where("fixed").select("obs_id")
    return unmatched.join(near, "obs_id", "left_anti"), unmatched.join(near, "obs_id", "left_semi")


def sites_listing(sites: DataFrame, fixed_only: bool) -> DataFrame:
    return sites.where("fixed") if fixed_only else sites.where("n_dates >= 2")


def layer_summary(candidates: DataFrame, sites: DataFrame, min_snr: float, min_pixels: int) -> DataFrame:
    """One row describing a published layer."""
    c = candidates.agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("reception") == "heard").alias("n_heard"),
                       F.count_if(F.col("reception") == "intermittent").alias("n_intermittent"),
                       F.count_if(F.col("reception") == "thin").alias("n_thin"), F.count_distinct("day").alias("n_dates"),
                       F.max("day").alias("as_of"))
    s = sites.agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("fixed").alias("n_fixed"))
    return c.join(F.broadcast(s)).withColumn("min_snr", F.lit(min_snr)).withColumn("min_pixels", F.lit(min_pixels))


def candidates_query(candidates: DataFrame, box: tuple[float, float, float, float], reception: Sequence[str], day: int | None = None,
                     limit: int = 5000) -> DataFrame:
    """Candidates in a box, by reception and date, with the layer total beside each row."""
    lon0, lat0, lon1, lat1 = box
    rows = candidates.where(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1) & F.col("reception").isin(list(reception)))
    if day is not None:
        rows = rows.where(F.col("day") == day)
    total = candidates.agg(F.count(F.lit(1)).alias("n_total"), F.max("day").alias("as_of"))
    return rows.orderBy("obs_id").limit(limit).join(F.broadcast(total))

"""Radar detection as Spark jobs over a pixel table (scene, row, col, dn, valid).

Window sums are separable: one window along rows, one along columns, each partition being
one line of one scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap.functions.geo import cell_index, haversine_m
from plotgap.operators.coverage import searched_from_samples
from plotgap.plans.components import connected_components
from plotgap.plans.ranks import percentiles

GUARD, BACKGROUND, K_SIGMA = 41, 121, 6.0
MAX_HOT = 0.02


def box_sums(pixels: DataFrame, values: dict[str, Column], half: int, prefix: str) -> DataFrame:
    """Sum of each value over the edge-clipped (2 half + 1) square around every pixel."""
    across = Window.partitionBy("scene", "row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy("scene", "col").orderBy("row").rangeBetween(-half, half)
    rows = pixels.withColumns({f"_{prefix}{n}": F.sum(v).over(across) for n, v in values.items()})
    out = rows.withColumns({f"{prefix}{n}": F.sum(f"_{prefix}{n}").over(down) for n in values})
    return out.drop(*[f"_{prefix}{n}" for n in values])


def clutter_ring_stats(pixels: DataFrame, guard: int = GUARD, background: int = BACKGROUND) -> DataFrame:
    """Mean and deviation of the background square minus the guard square."""
    parts = {"s": F.col("dn"), "q": F.col("dn") * F.col("dn"), "n": F.lit(1)}
    both = box_sums(box_sums(pixels, parts, background // 2, "b_"), parts, guard // 2, "g_")
    n = F.greatest(F.col("b_n") - F.col("g_n"), F.lit(1))
    mu = (F.col("b_s") - F.col("g_s")) / n
    var = F.greatest((F.col("b_q") - F.col("g_q")) / n - mu * mu, F.lit(0.0))
    return both.withColumn("mu", mu).withColumn("sigma", F.sqrt(var)).drop(*[f"{p}{k}" for p in ("b_", "g_") for k in parts])


def cfar_threshold(stats: DataFrame, k: float = K_SIGMA, max_hot: float = MAX_HOT) -> tuple[DataFrame, DataFrame]:
    """(hot pixels, scenes): pixels above mu + k sigma in valid water; scenes too bright are refused."""
    hot = (F.col("dn") > F.col("mu") + k * F.col("sigma")) & F.col("valid")
    scenes = stats.groupBy("scene").agg(F.avg(hot.cast("int")).alias("hot_share")).withColumn("refused", F.col("hot_share") > max_hot)
    kept = scenes.where("NOT refused").select("scene")
    return stats.where(hot).join(F.broadcast(kept), "scene", "left_semi"), scenes


def cluster_pixels(hot: DataFrame) -> DataFrame:
    """Label 8-connected components; the label is the smallest pixel key of the component."""
    node = (F.col("scene") * F.lit(1 << 40) + F.col("row") * F.lit(1 << 20) + F.col("col")).cast("bigint")
    keyed = hot.withColumn("node", node)
    # half of the neighbourhood is enough: every pair is seen from one side
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    reach = keyed.select("scene", "node", F.explode(steps).alias("s"), "row", "col").select(
        "scene", "node", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    edges = reach.join(keyed.select("scene", "row", "col", F.col("node").alias("b")), ["scene", "row", "col"]).select(F.col("node").alias("a"), "b")
    comp = connected_components(edges)
    return keyed.join(comp.withColumnRenamed("component", "label"), "node").drop("node")


def cluster_measures(labelled: DataFrame, min_pixels: int = 2, max_pixels: int = 5000) -> DataFrame:
    """Intensity-weighted centroid, peak, clutter and signal-to-noise of each cluster."""
    w = F.sum("dn")
    got = labelled.groupBy("scene", "label").agg(
        F.count(F.lit(1)).alias("pixels"), (F.sum(F.col("row") * F.col("dn")) / w).alias("row"), (F.sum(F.col("col") * F.col("dn")) / w).alias("col"),
        F.max("dn").alias("peak"), F.avg("dn").alias("mean"), F.avg("mu").alias("background"), F.avg("sigma").alias("sigma"))
    got = got.where(F.col("pixels").between(min_pixels, max_pixels))
    return (got.withColumn("snr", (F.col("peak") - F.col("background")) / F.greatest(F.col("sigma"), F.lit(1e-6)))
            .withColumn("length_m", F.sqrt("pixels") * 10.0))


def clutter_verdict(detections: DataFrame, k: float = K_SIGMA) -> DataFrame:
    """Is the list a vessel population or the tail of the clutter?"""
    floor = detections.groupBy("scene").agg(F.min("pixels").alias("_floor"))
    got = detections.join(F.broadcast(floor), "scene").groupBy("scene").agg(
        F.count(F.lit(1)).alias("n"), (F.max("snr") / k).alias("headroom"), F.avg((F.col("pixels") == F.col("_floor")).cast("int")).alias("at_floor"))
    return got.withColumn("verdict", F.when((F.col("headroom") < 2.5) & (F.col("at_floor") > 0.4), "clutter")
                          .when(F.col("headroom") < 5.0, "marginal").otherwise("vessels present"))


def otsu_threshold(pixels: DataFrame, value: Column, bins: int = 512) -> DataFrame:
    """Per scene: bin centre with the largest between-class variance, from a histogram."""
    rows = pixels.select("scene", value.alias("v"))
    span = rows.groupBy("scene").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int")
    hist = rows.join(F.broadcast(span), "scene").groupBy("scene", "lo", "hi", F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    upto = Window.partitionBy("scene").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    whole = Window.partitionBy("scene")
    total = F.sum("n").over(whole)
    rows = (hist.withColumn("centre", centre).withColumn("w", F.sum("n").over(upto) / total)
            .withColumn("m", F.sum(F.col("n") * F.col("centre")).over(upto) / total)
            .withColumn("m_all", F.sum(F.col("n") * F.col("centre")).over(whole) / total))
    spread = F.col("w") * (1 - F.col("w"))
    between = F.when(spread > 0, (F.col("m_all") * F.col("w") - F.col("m")) ** 2 / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    best = F.max_by(F.struct("centre", "between"), F.struct("between", -F.col("bin")))
    return rows.withColumn("between", between).groupBy("scene").agg(best.alias("b")).select(
        "scene", F.col("b.centre").alias("threshold"), F.col("b.between").alias("between"))


def release_isolated(land: DataFrame, max_cells: int = 16, isolation: int = 6) -> DataFrame:
    """Land cells (scene, row, col) whose component is small and has no other land nearby."""
    sums = box_sums(land.withColumn("_one", F.lit(1)), {"near": F.col("_one")}, isolation, "w_")
    rows = cluster_pixels(sums)
    per = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.max("w_near").alias("worst")).where(
        (F.col("size") <= max_cells) & (F.col("worst") <= F.col("size")))
    return rows.join(per.select("label"), "label", "left_semi").select("scene", "row", "col")


def water_mask(pixels: DataFrame, buffer_cells: int, min_contrast: float = 1.8, min_water: float = 0.02,
               release: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mask, scenes): searchable cells of a decimated raster, or the reason a scene is refused.

    Land and sea are split at Otsu's threshold of log1p; small isolated bright targets go back
    to sea; land is dilated seaward by ``buffer_cells``.
    """
    lit = pixels.where("dn > 0")
    thr = otsu_threshold(lit, F.log1p("dn")).select("scene", "threshold")
    rows = lit.join(F.broadcast(thr), "scene").withColumn("sea", F.log1p("dn") <= F.col("threshold"))
    mean = rows.groupBy("scene").agg(F.avg(F.when(F.col("sea"), F.col("dn"))).alias("sea_mean"), F.avg(F.when(~F.col("sea"), F.col("dn"))).alias("land_mean"))
    scenes = mean.withColumn("contrast", F.col("land_mean") / F.nullif("sea_mean", F.lit(0.0)))
    if release:
        freed = release_isolated(rows.where("NOT sea").select("scene", "row", "col")).withColumn("_free", F.lit(True))
        rows = rows.join(freed, ["scene", "row", "col"], "left").withColumn("sea", F.col("sea") | F.coalesce("_free", F.lit(False))).drop("_free")
    near = box_sums(rows, {"land": (~F.col("sea")).cast("int")}, buffer_cells, "w_")
    mask = near.withColumn("water", F.col("sea") & (F.col("w_land") == 0)).drop("w_land", "threshold")
    share = mask.groupBy("scene").agg(F.avg(F.col("water").cast("int")).alias("water_share"))
    reason = (F.when(~F.coalesce(F.col("contrast") >= min_contrast, F.lit(False)), "cannot tell land from sea")
              .when(F.col("water_share") < min_water, "too little open water"))
    scenes = scenes.join(share, "scene").withColumn("refused", reason)
    return mask.join(F.broadcast(scenes.where("refused IS NULL").select("scene")), "scene", "left_semi"), scenes


# ---- geolocation -------------------------------------------------------------------------


def _lines(lattice: DataFrame) -> DataFrame:
    """Sorted node rows and columns of each scene (a lattice has tens of lines)."""
    return lattice.groupBy("scene").agg(F.array_sort(F.collect_set("prow")).alias("rows"), F.array_sort(F.collect_set("pcol")).alias("cols"))


def _bracket(lines: str, v: Column) -> tuple[Column, Column, Column]:
    """One-based indices either side of ``v`` and the fraction between them, clamped."""
    n = F.size(lines)
    below = F.size(F.filter(lines, lambda x: x <= v))
    lo = F.greatest(F.lit(1), F.least(below, n))
    inside = (below >= 1) & (below < n)
    hi = F.when(inside, lo + 1).otherwise(lo)
    a, b = F.element_at(lines, lo), F.element_at(lines, hi)
    frac = F.when(inside, (v - a) / F.nullif(b - a, F.lit(0.0))).otherwise(0.0)
    return lo, hi, frac


def _scenes(lattice: DataFrame) -> DataFrame:
    """One row for each scene: its node lines and its nodes row by row, null where one is missing (a lattice has tens of lines)."""
    got = lattice.groupBy("scene").agg(F.array_sort(F.collect_set("prow")).alias("rows"), F.array_sort(F.collect_set("pcol")).alias("cols"),
                                       F.array_sort(F.collect_list(F.struct("prow", "pcol", "lon", "lat"))).alias("_nodes"))
    filled = F.flatten(F.transform("rows", lambda r: F.transform("cols", lambda c: F.get(
        F.filter("_nodes", lambda n: (n["prow"] == r) & (n["pcol"] == c)), F.lit(0)))))
    return got.withColumn("_nodes", F.when(F.size("_nodes") == F.size("rows") * F.size("cols"), F.col("_nodes")).otherwise(filled))


def pixel_to_lonlat(points: DataFrame, lattice: DataFrame, row: str = "row", column: str = "col") -> DataFrame:
    """Bilinear position of each pixel on a complete control lattice, clamped at its edges.

    A pixel meets its scene's lattice in one join and takes its four corners from it by place. Few scenes are small enough to be
    broadcast by size, many are joined by scene.
    """
    rows = points.join(_scenes(lattice), "scene")
    i0, i1, fr = _bracket("rows", F.col(row))
    j0, j1, fc = _bracket("cols", F.col(column))
    rows = rows.withColumns({"_i0": i0, "_i1": i1, "_j0": j0, "_j1": j1, "_fr": fr, "_fc": fc, "_w": F.size("cols")})
    rows = rows.withColumns({f"_{a}{b}": F.element_at("_nodes", ((F.col(f"_i{i}") - 1) * F.col("_w") + F.col(f"_j{j}")).cast("int"))
                             for a, i in (("a", 0), ("b", 1)) for b, j in (("a", 0), ("b", 1))})

    rows = rows.where(" AND ".join(f"_{c} IS NOT NULL" for c in ("aa", "ab", "ba", "bb")))

    def mix(f):
        top = F.col("_aa")[f] * (1 - F.col("_fc")) + F.col("_ab")[f] * F.col("_fc")
        bottom = F.col("_ba")[f] * (1 - F.col("_fc")) + F.col("_bb")[f] * F.col("_fc")
        return top * (1 - F.col("_fr")) + bottom * F.col("_fr")
    return rows.withColumn("lon", mix("lon")).withColumn("lat", mix("lat")).drop(
        "rows", "cols", "_nodes", "_i0", "_i1", "_j0", "_j1", "_fr", "_fc", "_w", "_aa", "_ab", "_ba", "_bb")


def holdout_errors(lattice: DataFrame, step: int) -> DataFrame:
    """Error at nodes left out when only every ``step``-th line (and the last) is kept."""
    at = lattice.withColumn("_ir", F.dense_rank().over(Window.partitionBy("scene").orderBy("prow")) - 1).withColumn(
        "_ic", F.dense_rank().over(Window.partitionBy("scene").orderBy("pcol")) - 1)
    whole = Window.partitionBy("scene")
    at = at.withColumn("_lr", F.max("_ir").over(whole)).withColumn("_lc", F.max("_ic").over(whole))
    kept = ((F.col("_ir") % step == 0) | (F.col("_ir") == F.col("_lr"))) & ((F.col("_ic") % step == 0) | (F.col("_ic") == F.col("_lc")))
    at = at.withColumn("_kept", kept)
    coarse = at.where("_kept").select("scene", "prow", "pcol", "lon", "lat")
    out = at.where("NOT _kept").select("scene", "prow", "pcol", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    got = pixel_to_lonlat(out, coarse, "prow", "pcol")
    return got.select("scene", "prow", "pcol", haversine_m("_y", "_x", "lat", "lon").alias("error_m"))


def lattice_holdout(lattice: DataFrame) -> DataFrame:
    """Holdout accuracy at twice the spacing, and the implied one where the h2 law holds."""
    two, four = holdout_errors(lattice, 2), holdout_errors(lattice, 4)

    def rms(df, name):
        return df.groupBy("scene").agg(F.sqrt(F.avg(F.col("error_m") ** 2)).alias(name), F.max("error_m").alias("worst_m"))
    mid = percentiles(two, ["scene"], F.col("error_m"), {"median_m": 0.5, "p90_m": 0.9}, 10.0)
    ratio = F.col("rms4_m") / F.nullif("rms_m", F.lit(0.0))
    out = rms(two, "rms_m").join(rms(four, "rms4_m").drop("worst_m"), "scene", "left").join(mid, "scene").withColumn("ratio", ratio)
    ok = F.col("ratio").between(2.5, 6.0)
    return (out.withColumn("implied_m", F.when(ok, F.col("rms_m") / F.col("ratio"))).withColumn("ratio", F.when(ok, F.col("ratio"))).drop("rms4_m"))


def lattice_spacing(lattice: DataFrame) -> DataFrame:
    """Line count, spacing range and evenness per scene and axis."""
    axis = lattice.select("scene", F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("prow").alias("v")), F.struct(F.lit("col").alias("axis"), F.col("pcol").alias("v")))).alias("a"))
    lines = axis.select("scene", "a.axis", "a.v").distinct()
    gap = F.col("v") - F.lag("v").over(Window.partitionBy("scene", "axis").orderBy("v"))
    got = lines.withColumn("g", gap).groupBy("scene", "axis").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    return got.withColumn("even", F.col("hi") - F.col("lo") <= F.greatest(F.lit(1.0), F.col("lo") * 0.02))


def holdout_ladder(lattice: DataFrame, steps=(2, 3, 4, 5, 6)) -> DataFrame:
    """rms and worst node of the holdout at several spacings (a handful of fixed steps)."""
    out = None
    for s in steps:
        e = holdout_errors(lattice, s).groupBy("scene").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("error_m") ** 2)).alias("rms_m"), F.max("error_m").alias("worst_m"),
            F.max_by(F.struct("prow", "pcol"), F.struct(F.round("error_m", 6), -F.col("prow"), -F.col("pcol"))).alias("w")).withColumn("step", F.lit(s))
        out = e if out is None else out.unionByName(e)
    return out.select("scene", "step", "n", "rms_m", "worst_m", F.col("w.prow").alias("worst_row"), F.col("w.pcol").alias("worst_col"))


def local_error(points: DataFrame, lattice: DataFrame) -> DataFrame:
    """Worst measured node around each pixel, scaled by the implied accuracy; scene value where none is near."""
    lines = _lines(lattice)
    at = points.join(F.broadcast(lines), "scene")
    i0, i1, _ = _bracket("rows", F.col("row"))
    j0, j1, _ = _bracket("cols", F.col("col"))
    at = at.withColumns({"_i0": F.greatest(F.lit(1), i0 - 1), "_i1": F.least(F.size("rows"), i1 + 1), "_j0": F.greatest(F.lit(1), j0 - 1), "_j1": F.least(F.size("cols"), j1 + 1)})
    # pixels of one lattice cell share their neighbourhood: resolve it once per cell
    box = ["scene", "_i0", "_i1", "_j0", "_j1"]
    cells = at.select(*box, "rows", "cols").distinct()
    nodes = (cells.withColumn("prow", F.explode(F.slice("rows", F.col("_i0"), F.col("_i1") - F.col("_i0") + 1)))
             .withColumn("pcol", F.explode(F.slice("cols", F.col("_j0"), F.col("_j1") - F.col("_j0") + 1))).drop("rows", "cols"))
    near = nodes.join(holdout_errors(lattice, 2), ["scene", "prow", "pcol"]).groupBy(*box).agg(F.max("error_m").alias("_worst"))
    acc = lattice_holdout(lattice).select("scene", "rms_m", "implied_m")
    scale = F.coalesce(F.col("implied_m") / F.nullif("rms_m", F.lit(0.0)), F.lit(1.0))
    out = at.drop("rows", "cols").join(near, box, "left").join(F.broadcast(acc), "scene")
    best = F.coalesce("implied_m", "rms_m")
    return out.withColumn("error_m", F.coalesce(F.col("_worst") * scale, best)).drop("_i0", "_i1", "_j0", "_j1", "_worst", "rms_m", "implied_m")


# ---- searched water ----------------------------------------------------------------------


def searched_samples(pixels: DataFrame, refused: DataFrame, lattice: DataFrame, stride: int, cell_deg: float) -> DataFrame:
    """Searched levels of each scene from a lattice of its pixels; refused scenes are left out."""
    grid = pixels.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).join(F.broadcast(refused.select("scene")), "scene", "left_anti")
    placed = pixel_to_lonlat(grid.select("scene", "row", "col", F.col("valid").alias("searched")), lattice)
    return searched_from_samples(placed, ["scene"], cell_deg)


def area_drift(pixel_km2: DataFrame, lattice_km2: DataFrame, limit: float = 0.15) -> DataFrame:
    """Two routes to a searched area; a difference over the limit is flagged."""
    both = pixel_km2.join(lattice_km2, "scene")
    drift = F.abs(F.col("lattice_km2") - F.col("pixel_km2")) / F.nullif("pixel_km2", F.lit(0.0))
    return both.withColumn("drift", drift).withColumn("flagged", F.coalesce(drift > limit, F.lit(False)))


def shoreline_mask(scene_cells: DataFrame, land_grid: DataFrame, cell_deg: float, buffer_cells: int) -> DataFrame:
    """Searchable mask of a scene from the pooled shoreline; unknown ground is land."""
    at = scene_cells.withColumn("_c", cell_index("lon", cell_deg)).withColumn("_r", cell_index("lat", cell_deg))
    vote = land_grid.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col("is_water").alias("_w"))
    rows = at.join(vote, ["_c", "_r"], "left").withColumn("_sea", F.coalesce("_w", F.lit(False)))
    near = box_sums(rows, {"land": (~F.col("_sea")).cast("int")}, buffer_cells, "w_")
    return near.withColumn("water", F.col("_sea") & (F.col("w_land") == 0)).drop("_c", "_r", "_w", "_sea", "w_land")

"""The order of the review queue: signals of a candidate, calibrated on reviewed ones."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import cell_index, haversine_m
from plotgap.plans.grid import band_join, cells_around, home_cell
from plotgap.plans.nearest import nearest_line
from plotgap.plans.reuse import pin
from plotgap.plans.sequence import chunk_of, running
from plotgap.plans.skew import split_hot

US = 1_000_000
#: Raw scores are whole thousandths, so every table by level has at most LEVELS + 1 rows.
LEVELS = 1000
#: Cells in a reach when candidates and silences are summed up by cells.
CUT = 8
WEIGHTS = {"size": 1.0, "clean": 1.0, "place": 1.0, "company": 2.0, "coverage": 1.0}


def _lattice(lat: str, lon: str, side_m: float, names: tuple[str, str]) -> list[Column]:
    """Row and column of a cell whose points all lie within ``_radius`` of its centre; columns are cut where a row is widest."""
    side = side_m / C.M_PER_DEG
    row = F.floor(F.col(lat) / side).cast("bigint")
    return [row.alias(names[0]), F.floor(F.col(lon) / _column_deg(row, side)).cast("bigint").alias(names[1])]


def _column_deg(row: Column, side: float) -> Column:
    least = F.least(F.abs(row * side), F.abs((row + 1) * side))
    return side / F.greatest(F.cos(F.radians(F.least(least, F.lit(90.0)))), F.lit(0.01))


def _centre(row: str, column: str, side_m: float, names: tuple[str, str]) -> list[Column]:
    side = side_m / C.M_PER_DEG
    lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (F.col(row) + 0.5) * side))
    return [lat.alias(names[0]), ((F.col(column) + 0.5) * _column_deg(F.col(row), side)).alias(names[1])]


def _radius(side_m: float) -> float:
    return side_m * math.sqrt(0.5) * 1.01  # one per cent covers the difference between flat and spherical metres


def last_near(asked: DataFrame, quiet: DataFrame, reach_m: float, width: int) -> DataFrame:
    """(t_scene_us, _pr, _pc, start_us, lat0, lon0): for each post the silences that can be the last one near a candidate in it.

    asked(t_scene_us, _pr, _pc) are posts: an instant and a cell 1/CUT as wide as the reach. Silences are summed up by instant and
    place to the latest start, since an earlier one at the same place is never the last, and these by cell. The latest one in a cell
    that is within reach from all of the post bounds the answer, so only cells on the rim or later than that bound are opened, and of
    those only the silences not before it. Where there is no bound, as on the rim of a quiet area, every place of the rim is left.
    All of equal start at different places are kept.
    """
    side, radius = reach_m / CUT, _radius(reach_m / CUT)
    post = ["t_scene_us", "_pr", "_pc"]
    posts = asked.distinct().select(*post, *_centre("_pr", "_pc", side, ("p_lat", "p_lon")))
    slot = F.expr(f"t_scene_us div {width}")
    wide = reach_m + 2 * radius
    # instants meet the silences about them once for all posts of a cell
    hours = posts.withColumn("_slot", F.explode(F.array(slot - 1, slot)))
    hours = cells_around(hours, "p_lat", "p_lon", wide, ("_wr", "_wc")).select("t_scene_us", "_slot", "_wr", "_wc").distinct()
    quiet = quiet.select("start_us", "lat0", "lon0", F.expr(f"start_us div {width}").alias("_slot")).distinct()
    seen = hours.join(quiet.select("*", *home_cell("lat0", "lon0", wide, ("_wr", "_wc"))), ["_slot", "_wr", "_wc"])
    seen = seen.where((F.col("start_us") <= F.col("t_scene_us")) & (F.col("start_us") > F.col("t_scene_us") - width))
    cell = ["t_scene_us", "_sr", "_sc"]
    seen = seen.groupBy("t_scene_us", "lat0", "lon0").agg(F.max("start_us").alias("start_us"))
    seen = pin(seen.select("t_scene_us", "start_us", "lat0", "lon0", *_lattice("lat0", "lon0", side, ("_sr", "_sc"))))
    last = seen.groupBy(*cell).agg(F.max("start_us").alias("_last")).select(*cell, "_last", *_centre("_sr", "_sc", side, ("s_lat", "s_lon")))
    met = band_join(posts, last, ("p_lat", "p_lon"), ("s_lat", "s_lon"), F.lit(wide), [wide], ["t_scene_us"])
    met = met.withColumn("_m", haversine_m("p_lat", "p_lon", "s_lat", "s_lon")).where(F.col("_m") <= wide)
    bound = met.groupBy(*post).agg(F.max(F.when(F.col("_m") <= reach_m - 2 * radius, F.col("_last"))).alias("_sure"),
                                   F.collect_list(F.struct("_last", "_sr", "_sc")).alias("_cells"))
    late = F.filter("_cells", lambda x: F.col("_sure").isNull() | (x["_last"] >= F.col("_sure")))
    doors = bound.select(*post, "_sure", F.explode(late).alias("_c")).select(*post, "_sure", "_c._sr", "_c._sc")
    doors, seen = split_hot(doors, seen, cell, "start_us")
    open_ = doors.join(seen, [*cell, "_salt"]).where(F.col("_sure").isNull() | (F.col("start_us") >= F.col("_sure")))
    open_ = open_.select(*post, "start_us", "lat0", "lon0", *_centre("_pr", "_pc", side, ("p_lat", "p_lon")))
    return open_.where(haversine_m("p_lat", "p_lon", "lat0", "lon0") <= reach_m + radius).drop("p_lat", "p_lon")


def fell_silent(candidates: DataFrame, silences: DataFrame, reach_m: float, window_s: float) -> DataFrame:
    """(obs_id, gone_us, gone_m): the last track that fell silent near a candidate, at most ``window_s`` before its scene.

    candidates(obs_id, t_scene_us, lat, lon); silences(event_id, start_us, lat0, lon0). Candidates of one scene and cell share
    a post; each is measured exactly against the few silences that can be the last one for some place of its post. Of silences
    that began at the same instant the nearest counts.
    """
    width, post = int(window_s * US), ["t_scene_us", "_pr", "_pc"]
    asked = candidates.where("lat IS NOT NULL AND lon IS NOT NULL AND t_scene_us IS NOT NULL").select("obs_id", "t_scene_us", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    asked = asked.select("*", *_lattice("c_lat", "c_lon", reach_m / CUT, ("_pr", "_pc")))
    few = last_near(asked.select(*post), silences.where("lat0 IS NOT NULL AND lon0 IS NOT NULL"), reach_m, width)
    near = asked.join(few, post).withColumn("_m", haversine_m("c_lat", "c_lon", "lat0", "lon0")).where(F.col("_m") <= reach_m)
    return near.groupBy("obs_id").agg(F.max(F.struct("start_us", -F.col("_m"))).alias("_g")).select(
        "obs_id", F.col("_g.start_us").alias("gone_us"), (-F.col("_g")["col2"]).alias("gone_m"))


def signals(candidates: DataFrame, lines: DataFrame, silences: DataFrame, grid: DataFrame, reach_m: float = 5_000.0, window_s: float = 7_200.0,
            fade_m: float = 20_000.0, full_px: float = 40.0) -> DataFrame:
    """Each candidate's signals, all from 0 to 1; one that cannot be known is null, which is not zero.

    ``size`` grows with its pixels, ``clean`` is the detector's confidence, ``place`` fades with the distance to the nearest line,
    ``company`` is 1 where a near track fell silent at the scene's instant, 0 where none did in the window, and ``coverage`` is the
    share of its cell's reporting intervals that were not long ones.
    """
    near = nearest_line(candidates, lines.withColumn("line_set", F.lit("all")), "obs_id").select("obs_id", "d_m")
    gone = fell_silent(candidates, silences, reach_m, window_s)
    cells = grid.select("col", "row", (1.0 - F.col("p_long")).alias("coverage"))
    rows = candidates.withColumn("col", cell_index("lon", C.RECEPTION_CELL_DEG)).withColumn("row", cell_index("lat", C.RECEPTION_CELL_DEG))
    rows = rows.join(cells, ["col", "row"], "left").join(near, "obs_id", "left").join(gone, "obs_id", "left")
    ago = (F.col("t_scene_us") - F.col("gone_us")) / (window_s * US)
    company = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("t_scene_us").isNotNull(), F.coalesce(1.0 - ago, F.lit(0.0)))
    return rows.select("obs_id", F.least(F.lit(1.0), F.col("pixels") / full_px).alias("size"), F.col("confidence").alias("clean"),
                       F.exp(-F.col("d_m") / fade_m).alias("place"), company.alias("company"), "coverage")


def score_level(weights: Mapping[str, float] = WEIGHTS):
    """Weighted mean of the known signals in thousandths; null where none is known."""
    known = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    mean = total / F.nullif(known, F.lit(0.0))
    return F.when(mean.isNotNull(), F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(F.round(mean * LEVELS, 6))))).cast("int")


def pool_violators(n: Sequence[float], k: Sequence[float]) -> np.ndarray:
    """The rising sequence nearest to the shares k / n, weighted by n."""
    blocks: list[list[float]] = []  # cases, hits, levels covered
    for cases, hits in zip(n, k):
        blocks.append([cases, hits, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.repeat([b[1] / b[0] for b in blocks], [b[2] for b in blocks])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for table in batch["t"]:
            if len(table):
                level, n, k = (np.array([r[c] for r in table]) for c in ("level", "n", "k"))
                every = np.arange(LEVELS + 1)
                at = np.maximum(np.searchsorted(level, every, side="right") - 1, 0)
                yield pd.DataFrame({"level": every.astype("int32"), "p": pool_violators(n, k)[at]})


def calibration(graded: DataFrame) -> DataFrame:
    """(level, p) for every level: rising share of hits among graded(level, y), constant between graded levels; empty without any.

    Shares are counted on Spark; only the counts by level, at most LEVELS + 1, meet in one row.
    """
    counts = graded.where("level IS NOT NULL AND y IS NOT NULL").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("int")).alias("k"))
    return counts.agg(F.array_sort(F.collect_list(F.struct("level", "n", "k"))).alias("t")).mapInPandas(_fit, "level int, p double")


def rank_candidates(scored: DataFrame, reviewed: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """The queue: ``scored`` with level, calibrated p and place, best first; ties go to the smaller obs_id.

    scored(obs_id, signals...); reviewed(obs_id, y). p never falls as the level rises, so one order serves both. Places are the
    count of better levels, a table of at most LEVELS + 2 rows, plus a running count inside the level, by chunks of obs_id.
    A candidate without any known signal comes last, with p unknown.
    """
    rows = pin(scored.withColumn("level", score_level(weights)))
    fit = calibration(rows.join(reviewed.select("obs_id", "y"), "obs_id"))
    keyed = rows.withColumn("_level", F.coalesce("level", F.lit(-1)))
    better = Window.partitionBy(F.lit(0)).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each level
    offsets = keyed.groupBy("_level").agg(F.count(F.lit(1)).alias("_n")).select("_level", F.coalesce(F.sum("_n").over(better), F.lit(0)).alias("_before"))
    placed = running(keyed, ["_level"], ["obs_id"], F.lit(1), "_no", "sum", chunk_of("obs_id", 1 << 20))
    return (placed.join(F.broadcast(offsets), "_level").join(F.broadcast(fit), "level", "left")
            .withColumn("place_no", F.col("_before") + F.col("_no")).drop("_level", "_before", "_no"))

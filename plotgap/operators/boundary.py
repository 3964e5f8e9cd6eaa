"""Do unexplained detections bunch near a limit? Counts per distance band against searched
water, with a scattered null and a displaced-pattern null."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions import classes as K
from plotgap.functions.geo import cell_index, searched_cell_km2
from plotgap.plans.hashes import first_words
from plotgap.plans.nearest import nearest_line
from plotgap.plans.ranks import uniform
from plotgap.plans.reuse import pin, spread
from plotgap.plans.sequence import running

POOLED = "any"
KEY_DEG = 0.01
#: Points of a pass that one row stands for at most, and throws that it stands for at least, if its pass has them.
BLOCK, THROWS = 1 << 18, 1 << 20


def limit_sets(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments labelled by limit, rejected features) from flagged line features.

    ``features(name, kind, flag_3, flag_12, flag_24, flag_200, land, x0, y0, x1, y1)``.
    Polygons and land boundaries are refused with a reason.
    """
    def on(c):
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) != 0
    name = F.lower("name")
    label = (F.when(on("flag_12"), "L12").when(on("flag_24"), "L24").when(on("flag_200"), "L200").when(on("flag_3"), "L3")
             .when(name.contains("territorial"), "L12").when(name.contains("contiguous"), "L24")
             .when(name.contains("eez"), "L200").when(name.contains("state seaward"), "L3"))
    reason = (F.when(F.col("kind").contains("Polygon"), "polygon, not a line").when(on("land"), "land boundary")
              .when(label.isNull(), "not a known limit"))
    rows = features.withColumn("line_set", label).withColumn("reason", reason)
    return (rows.where("reason IS NULL").select("line_set", "x0", "y0", "x1", "y1"),
            rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def with_pool(segments: DataFrame, members: Sequence[str]) -> DataFrame:
    """Add the frozen pool of limits as one more line set."""
    s = segments.select("line_set", "x0", "y0", "x1", "y1")
    return s.unionByName(s.where(F.col("line_set").isin(list(members))).withColumn("line_set", F.lit(POOLED)))


def banded(points: DataFrame, key: str, segments: DataFrame, sets: Sequence[str],
           companions: Mapping[str, tuple[str, bool]] = {}) -> DataFrame:
    """(key, limit, band) for every point and limit; limits with a companion also get signed bands."""
    near = nearest_line(points, segments, key).groupBy(key).agg(
        *[F.max(F.when(F.col("line_set") == s, F.col("d_m"))).alias(f"d_{s}") for s in sets])
    wide = points.select(key).join(near, key, "left")

    def entry(limit, band):
        return F.struct(F.lit(limit).alias("limit"), band.alias("band"))
    items = [entry(s, K.distance_band(f"d_{s}")) for s in sets]
    items += [entry(f"{s} (signed)", K.signed_band(f"d_{s}", f"d_{c}", outer)) for s, (c, outer) in companions.items()]
    return wide.select(key, F.explode(F.array(*items)).alias("i")).select(key, "i.*")


def band_counts(points: DataFrame, key: str, bands: DataFrame) -> DataFrame:
    """(limit, matched, day, band, n): candidates (matched false) and control (true) per pass."""
    return (points.select(key, "day", "matched").join(bands, key)
            .groupBy("limit", "matched", "day", "band").agg(F.count(F.lit(1)).alias("n")))


def searched_centres(searched: DataFrame, cell_deg: float) -> DataFrame:
    """Searched cells at the convention, with centre, area and a key."""
    return searched.where(F.col("level") / C.LEVELS >= C.SEARCHED).select(
        "day", "col", "row", F.concat_ws(":", "col", "row").alias("cell"), ((F.col("col") + 0.5) * cell_deg).alias("lon"),
        ((F.col("row") + 0.5) * cell_deg).alias("lat"), searched_cell_km2("row", "level", cell_deg).alias("km2"))


def band_area(searched: DataFrame, segments: DataFrame, sets: Sequence[str], companions=None, cell_deg: float = 0.05) -> DataFrame:
    """Searched km2 per (limit, day, band); each distinct cell is banded once for all passes."""
    cells = searched_centres(searched, cell_deg)
    bands = banded(cells.select("cell", "lon", "lat").distinct(), "cell", segments, sets, companions or {})
    return cells.join(bands, "cell").groupBy("limit", "day", "band").agg(F.sum("km2").alias("km2"))


def expectation(counts: DataFrame, area: DataFrame) -> DataFrame:
    """Expected counts per (limit, matched, band): each pass's total spread by its searched area."""
    n = counts.groupBy("limit", "matched", "day").agg(F.sum("n").alias("n_pass"))
    total = area.groupBy("limit", "day").agg(F.sum("km2").alias("km2_pass")).where("km2_pass > 0")
    share = area.join(total, ["limit", "day"]).join(n, ["limit", "day"])
    return share.groupBy("limit", "matched", "band").agg(
        F.sum(F.col("n_pass") * F.col("km2") / F.col("km2_pass")).alias("expected"), F.sum("km2").alias("km2"))


def observed_expected(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed beside expected; the observed count covers every pass."""
    o = counts.groupBy("limit", "matched", "band").agg(F.sum("n").alias("observed"))
    return expected.join(o, ["limit", "matched", "band"], "left").fillna(0, ["observed"])


def chi_square(table: DataFrame, keys: Sequence[str], observed: str = "observed") -> DataFrame:
    term = F.when(F.col("expected") > 0, (F.col(observed) - F.col("expected")) ** 2 / F.col("expected"))
    return table.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("chi2"))


def band_ratios(table: DataFrame) -> DataFrame:
    return table.withColumn("ratio", F.col("observed") / F.nullif("expected", F.lit(0.0)))


def _p_value(sims: DataFrame, stat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """k simulated statistics at or above the observed one; p = (k + 1) / (trials + 1)."""
    both = sims.join(stat.withColumnRenamed("chi2", "stat"), list(keys))
    return both.groupBy(*keys).agg(F.count_if(F.col("chi2") >= F.col("stat")).alias("k"), F.count(F.lit(1)).alias("trials"),
                                   F.first("stat").alias("chi2")).withColumn("p", (F.col("k") + 1) / (F.col("trials") + 1))


def _mark(edge: float, top: float) -> int:
    """The least eight hex digits x with edge <= x / 2^32 * top; 2^32 if there are none."""
    low, high = 0, 1 << 32
    while low < high:
        x = (low + high) // 2
        low, high = (low, x) if edge <= x / 4294967296.0 * top else (x + 1, high)
    return low


def _landed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pass, trial, place, n): how many points of each range of throws land at or after as many edges as ``place``."""
    for batch in batches:
        for r in batch.to_pylist():
            marks = [_mark(e, r["top"]) for e in r["upto"]]
            trials, points = range(r["trial"], r["trial_to"] + 1), r["i_to"] - r["i"] + 1
            beyond = np.array([[points if m == 0 else 0 for m in [0, *marks, 1 << 32]]] * len(trials))
            open_ = [k for k, m in enumerate(marks, 1) if 0 < m < 1 << 32]
            if open_:  # else all throws land in one place, whatever their hashes
                for i, x in first_words(r["name"], (r["trial"], r["trial_to"]), (r["i"], r["i_to"])):
                    at = slice(i - r["trial"], i - r["trial"] + len(x))
                    for k in open_:
                        beyond[at, k] += np.count_nonzero(x >= np.uint32(marks[k - 1]), axis=1)
            n = beyond[:, :-1] - beyond[:, 1:]
            t, place = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), r["pass"])), pa.array(t + r["trial"]), pa.array(place, pa.int32()), pa.array(n[t, place])],
                                             names=["pass", "trial", "place", "n"])


def scattered_null(counts: DataFrame, area: DataFrame, trials: int, seed: str) -> DataFrame:
    """p of the band chi-square when each pass's points are re-thrown into its own searched water.

    Every point is thrown by a hash uniform through the cumulative area shares, whatever
    the size of its pass. Throws are dealt as ranges of trials and points; a task hashes a
    range in arrays and hands on counts, so throws never become rows.
    """
    counts, area = pin(counts), pin(area)
    exp = pin(expectation(counts, area))
    stat = chi_square(observed_expected(counts, exp), ["limit", "matched"])
    n = counts.groupBy("limit", "matched", "day").agg(F.sum("n").alias("n_pass"))
    total = area.groupBy("limit", "day").agg(F.sum("km2").alias("km2_pass")).where("km2_pass > 0")
    upto = running(area, ["limit", "day"], ["band"], F.col("km2"), "upto", "sum", F.lit(0).cast("bigint"))
    cdf = upto.join(total, ["limit", "day"]).groupBy("limit", "day").agg(
        F.array_sort(F.collect_list(F.struct("upto", "band"))).alias("cdf"), F.max("upto").alias("top"))
    passes = pin(n.join(cdf, ["limit", "day"]).withColumn("pass", F.monotonically_increasing_id()))
    at_once = F.greatest(F.lit(1), F.expr(f"{THROWS} div least(n_pass, {BLOCK})"))
    throws = passes.select("pass", F.concat_ws("|", F.lit(seed), "limit", "matched", "day").alias("name"), F.col("cdf.upto").alias("upto"), "top", "n_pass",
                           at_once.alias("at_once"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_pass - 1) div {BLOCK}"))).alias("block"))
    throws = throws.withColumn("trial", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(trials).cast("bigint"), F.col("at_once"))))
    throws = spread(throws).select(
        "pass", "name", "upto", "top", "trial", F.least(F.lit(trials).cast("bigint"), F.expr("trial + at_once - 1")).alias("trial_to"),
        F.expr(f"block * {BLOCK} + 1").alias("i"), F.expr(f"least(n_pass, (block + 1) * {BLOCK})").alias("i_to"))
    landed = throws.mapInArrow(_landed, "pass bigint, trial bigint, place int, n bigint").groupBy("pass", "trial", "place").agg(F.sum("n").alias("n"))
    thrown = landed.join(passes, "pass").select("limit", "matched", "trial", F.get("cdf", F.col("place"))["band"].alias("band"), "n")
    sim = thrown.groupBy("limit", "matched", "trial", "band").agg(F.sum("n").alias("sim"))
    frame = exp.select("limit", "matched", "band", "expected", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    filled = frame.join(sim, ["limit", "matched", "trial", "band"], "left").fillna(0, ["sim"])
    return _p_value(chi_square(filled, ["limit", "matched", "trial"], "sim"), stat, ["limit", "matched"])


def water_keys(searched: DataFrame, segments: DataFrame, sets: Sequence[str], companions, cell_deg: float) -> DataFrame:
    """(day, kx, ky, limit, band): every fine key inside searched water with its band, by its centre."""
    per = int(round(cell_deg / KEY_DEG))
    cells = searched.where(F.col("level") / C.LEVELS >= C.SEARCHED).select("day", "col", "row")
    keys = (cells.withColumn("kx", F.explode(F.sequence(F.col("col") * per, F.col("col") * per + per - 1)))
            .withColumn("ky", F.explode(F.sequence(F.col("row") * per, F.col("row") * per + per - 1)))
            .select("day", "kx", "ky", F.concat_ws(":", "kx", "ky").alias("cell")))
    places = keys.select("cell", ((F.col("kx") + 0.5) * KEY_DEG).alias("lon"), ((F.col("ky") + 0.5) * KEY_DEG).alias("lat")).distinct()
    return keys.join(banded(places, "cell", segments, sets, companions or {}), "cell").drop("cell")


def shift_null(points: DataFrame, counts: DataFrame, area: DataFrame, water: DataFrame, trials: int, seed: str,
               attempts: int = 25, max_shift_deg: float = 0.6, keep_share: float = 0.67) -> DataFrame:
    """p of the band chi-square when each pass's whole pattern is slid, clumps intact.

    Points are collapsed to fine keys with counts and slides are whole keys, so one slide of
    one pass is a join of keys, and equal slides drawn by different trials are computed once.
    A slide is kept when enough of the pattern stays in that pass's searched water; each pass
    takes its first kept attempt. Counts are rescaled to the observed total.
    """
    counts, area, water = pin(counts), pin(area), pin(water)
    exp = pin(expectation(counts, area))
    stat = chi_square(observed_expected(counts, exp), ["limit", "matched"])
    pts = pin(points.groupBy("matched", "day", cell_index("lon", KEY_DEG).alias("kx"), cell_index("lat", KEY_DEG).alias("ky"))
              .agg(F.count(F.lit(1)).alias("n")))
    size = pts.groupBy("matched", "day").agg(F.sum("n").alias("n_pass"))
    span = int(round(2 * max_shift_deg / KEY_DEG)) + 1
    draws = (size.select("matched", "day", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
             .select("matched", "day", "trial", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt")))

    def slide(axis):
        return F.floor(uniform(seed, F.lit(axis), "matched", "day", "trial", "attempt") * span).cast("bigint") - (span // 2)
    draws = draws.withColumn("dx", slide("x")).withColumn("dy", slide("y"))
    slides = draws.select("matched", "day", "dx", "dy").distinct()
    moved = slides.join(pts, ["matched", "day"]).select(
        "matched", "day", "dx", "dy", (F.col("kx") + F.col("dx")).alias("kx"), (F.col("ky") + F.col("dy")).alias("ky"), "n")
    wet = water.select("day", "kx", "ky").distinct()
    inside = moved.join(wet, ["day", "kx", "ky"])
    kept = inside.groupBy("matched", "day", "dx", "dy").agg(F.sum("n").alias("n_in")).join(size, ["matched", "day"]).where(
        F.col("n_in") >= keep_share * F.col("n_pass"))
    chosen = pin(draws.join(kept.select("matched", "day", "dx", "dy"), ["matched", "day", "dx", "dy"]).groupBy("matched", "day", "trial").agg(
        F.min_by(F.struct("dx", "dy"), "attempt").alias("s")).select("matched", "day", "trial", "s.*"))
    used = chosen.select("matched", "day", "dx", "dy").distinct()
    hist = (moved.join(used, ["matched", "day", "dx", "dy"], "left_semi").join(water, ["day", "kx", "ky"])
            .groupBy("matched", "day", "dx", "dy", "limit", "band").agg(F.sum("n").alias("n")))
    sim = pin(chosen.join(hist, ["matched", "day", "dx", "dy"]).groupBy("limit", "matched", "trial", "band").agg(F.sum("n").alias("sim")))
    n_sim = sim.groupBy("limit", "matched", "trial").agg(F.sum("sim").alias("n_sim"))
    frame = exp.join(n_sim, ["limit", "matched"]).join(sim, ["limit", "matched", "trial", "band"], "left").fillna(0, ["sim"])
    n_obs = exp.groupBy("limit", "matched").agg(F.sum("expected").alias("n_obs"))
    scaled = frame.join(n_obs, ["limit", "matched"]).withColumn("sim", F.col("sim") * F.col("n_obs") / F.col("n_sim"))
    return _p_value(chi_square(scaled, ["limit", "matched", "trial"], "sim"), stat, ["limit", "matched"])


def untestable(counts: DataFrame, limits: DataFrame, signed_suffix: str = "(signed)") -> DataFrame:
    """Why a limit cannot be tested: no candidate in any near band. Null where it can be."""
    plain = limits.where(~F.col("limit").endswith(signed_suffix))
    near = counts.where(~F.col("matched") & ~F.col("band").startswith(">")).groupBy("limit").agg(F.sum("n").alias("n_near"))
    rows = plain.join(near, "limit", "left").fillna(0, ["n_near"])
    return rows.withColumn("reason", F.when(F.col("n_near") == 0, "no candidate lies within 25 nm of this line"))


def local_step(rows: DataFrame, near_nm: float) -> DataFrame:
    """Signed rows restricted to bands wholly within +/- near_nm of the line."""
    return rows.where(F.col("limit").endswith("(signed)") & F.col("band").isin(K.near_signed_bands(near_nm)))


def limit_report(points: DataFrame, searched: DataFrame, segments: DataFrame, sets: Sequence[str], companions, trials: int,
                 shift_trials: int, seed: str, cell_deg: float = 0.05, attempts: int = 25, near_nm: float | None = None) -> DataFrame:
    """One row per (limit, candidates or control): chi-square, both p-values and testability."""
    bands = banded(points, "obs_id", segments, sets, companions)
    counts = band_counts(points, "obs_id", bands)
    area = band_area(searched, segments, sets, companions, cell_deg)
    water = water_keys(searched, segments, sets, companions, cell_deg)
    if near_nm is not None:
        counts, area, water = (local_step(x, near_nm) for x in (counts, area, water))
    counts, area, water = pin(counts), pin(area), pin(water)
    scattered = scattered_null(counts, area, trials, seed).select(
        "limit", "matched", "chi2", F.col("k").alias("k_scattered"), F.col("p").alias("p_scattered"))
    shifted = shift_null(points, counts, area, water, shift_trials, seed, attempts).select(
        "limit", "matched", F.col("k").alias("k_shift"), F.col("trials").alias("shift_used"), F.col("p").alias("p_shift"))
    tested = untestable(counts, counts.select("limit").distinct()).select("limit", "reason")
    return (scattered.join(shifted, ["limit", "matched"], "left").join(tested, "limit", "left")
            .withColumn("testable", F.col("reason").isNull()))

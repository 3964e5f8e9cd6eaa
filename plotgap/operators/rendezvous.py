"""Two tracks close together for a while, from the motion between their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import M_PER_DEG, cell_index
from plotgap.plans.reuse import pin
from plotgap.plans.sequence import HOUR_US, chunk_of, with_previous

US = 1_000_000
#: Average pieces that a moment lasts.
MOMENT = 16


def motion_pieces(reports: DataFrame, slot_us: int, max_gap_s: float) -> DataFrame:
    """(platform_id, slot, s, e, lon_s, lat_s, lon_e, lat_e): straight motion between reports, cut at fixed time slots."""
    rows = with_previous(reports.select("platform_id", "t_us", "event_id", "lat", "lon"), ["platform_id"], ["t_us", "event_id"],
                         ["t_us", "lat", "lon"], chunk_of("t_us", 6 * HOUR_US))
    step = rows.where((F.col("t_us") > F.col("prev_t_us")) & (F.col("t_us") - F.col("prev_t_us") <= int(max_gap_s * US)))
    slots = F.sequence(F.expr(f"prev_t_us div {slot_us}"), F.expr(f"(t_us - 1) div {slot_us}"))
    cut = (step.withColumn("slot", F.explode(slots)).withColumn("s", F.greatest("prev_t_us", F.col("slot") * slot_us))
           .withColumn("e", F.least("t_us", (F.col("slot") + 1) * slot_us)))

    def at(t: str, v: str) -> Column:
        return F.col(f"prev_{v}") + (F.col(v) - F.col(f"prev_{v}")) * ((F.col(t) - F.col("prev_t_us")) / (F.col("t_us") - F.col("prev_t_us")))
    return cut.select("platform_id", "slot", "s", "e", *[at(t, v).alias(f"{v}_{t}") for t in "se" for v in ("lon", "lat")])


def _settled(rows: DataFrame, *columns: Column) -> DataFrame:
    """Rows of ``columns``; later steps read their values and do not repeat their expressions."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def near_pairs(around: DataFrame, cell_deg: float, hot_rows: int) -> DataFrame:
    """(moment, a, b): platforms whose boxes of one moment meet; ``around(platform_id, moment, x0, x1, y0, y1)``.

    A box goes to the cells that it touches, which are as wide as the average box at least; a pair is found only in the cell
    that holds the lower corner of the two boxes' common part. Cells with more than ``hot_rows`` boxes, such as a harbour, are
    cut by a hash: one side is dealt over the parts, the other goes to each.
    """
    around = pin(around)
    wide = around.agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")))).first()[0] or 0.0
    size = max(cell_deg, wide)
    box = around.withColumn("c0", cell_index("x0", size)).withColumn("r0", cell_index("y0", size))
    cells = (box.withColumn("c", F.explode(F.sequence("c0", cell_index("x1", size)))).withColumn("r", F.explode(F.sequence("r0", cell_index("y1", size)))))
    keys = ["moment", "c", "r"]
    hot = (cells.groupBy(*keys).count().where(F.col("count") > hot_rows)
           .select(*keys, F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("_parts")))  # rows / hot_rows entries at most
    parts = F.coalesce("_parts", F.lit(1))
    held = cells.join(hot, keys, "left")
    left = held.withColumn("_salt", F.pmod(F.xxhash64("platform_id"), parts).cast("int")).drop("_parts")
    right = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    right = right.select(*keys, "_salt", *[F.col(n).alias(f"o_{n}") for n in ("platform_id", "x0", "x1", "y0", "y1", "c0", "r0")])
    return left.join(right, [*keys, "_salt"]).where(
        (F.col("platform_id") < F.col("o_platform_id")) & (F.col("c") == F.greatest("c0", "o_c0")) & (F.col("r") == F.greatest("r0", "o_r0"))
        & (F.greatest("x0", "o_x0") <= F.least("x1", "o_x1")) & (F.greatest("y0", "o_y0") <= F.least("y1", "o_y1"))
    ).select("moment", F.col("platform_id").alias("a"), F.col("o_platform_id").alias("b"))


def contacts(pieces: DataFrame, max_separation_m: float, cell_deg: float, hot_rows: int) -> DataFrame:
    """(a, b, from_us, to_us, min_m): the times within which two pieces of one slot are close enough.

    Time is cut into moments, ``MOMENT`` times as long as the average piece. Two platforms are looked at only in the moments in
    which their boxes, widened by half the separation, meet. There the pieces of both are read in the order in which they
    begin: as those of one platform do not overlap, a piece that begins meets at most the latest one of the other platform. So
    pairs follow the pieces, however many one moment holds. The least distance and the times of coming within reach are those
    of two points in straight motion, in closed form.
    """
    pieces = pin(pieces)
    moment = max(1, int(MOMENT * (pieces.agg(F.avg(F.col("e") - F.col("s"))).first()[0] or 1)))
    half = max_separation_m / 2 / M_PER_DEG
    lat = F.greatest(F.abs(F.col("lat_s")), F.abs(F.col("lat_e")))
    wide = half / F.greatest(F.cos(F.radians(lat)), F.lit(0.01)) * 1.01  # the separation is judged at the pair's own latitude
    begins = F.expr(f"s div {moment}")
    held = (pieces.withColumn("_k", F.explode(F.sequence(begins, F.expr(f"(e - 1) div {moment}"))))
            .withColumn("here", F.greatest("s", F.col("_k") * moment)).drop("_k"))
    around = held.groupBy("platform_id", F.expr(f"here div {moment}").alias("moment")).agg(
        F.min(F.least("lon_s", "lon_e") - wide).alias("x0"), F.max(F.greatest("lon_s", "lon_e") + wide).alias("x1"),
        F.min(F.least("lat_s", "lat_e") - half * 1.01).alias("y0"), F.max(F.greatest("lat_s", "lat_e") + half * 1.01).alias("y1"))
    sides = near_pairs(around, cell_deg, hot_rows).select("*", F.explode(F.array("a", "b")).alias("_p"))
    both = held.join(sides, (F.col("platform_id") == F.col("_p")) & (F.expr(f"here div {moment}") == F.col("moment")))
    first = F.col("platform_id") == F.col("a")
    order = Window.partitionBy("moment", "a", "b").orderBy("s", F.when(first, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.struct("platform_id", "s", "e", "lon_s", "lat_s", "lon_e", "lat_e")
    met = both.select("moment", "s", F.last(F.when(first, piece), True).over(order).alias("_a"), F.last(F.when(~first, piece), True).over(order).alias("_b"))
    pair = met.where((begins == F.col("moment")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        "_a.*", *[F.col(f"_b.{n}").alias(f"o_{n}") for n in ("platform_id", "s", "e", "lon_s", "lat_s", "lon_e", "lat_e")])
    pair = pair.withColumn("from_t", F.greatest("s", "o_s")).withColumn("to_t", F.least("e", "o_e")).where("from_t < to_t")

    def where(p: str, v: str, t: str) -> Column:
        return F.col(f"{p}{v}_s") + (F.col(f"{p}{v}_e") - F.col(f"{p}{v}_s")) * ((F.col(t) - F.col(f"{p}s")) / (F.col(f"{p}e") - F.col(f"{p}s")))
    apart = [(where("o_", v, t) - where("", v, t)).alias(f"{v}{name}") for name, t in (("0", "from_t"), ("1", "to_t")) for v in ("lon", "lat")]
    scale = M_PER_DEG * F.cos(F.radians((where("", "lat", "from_t") + where("o_", "lat", "from_t")) / 2))
    pair = _settled(pair, F.col("platform_id").alias("a"), F.col("o_platform_id").alias("b"), F.col("from_t"), F.col("to_t"), scale.alias("scale"), *apart)
    x0, x1, y0, y1 = F.col("lon0") * F.col("scale"), F.col("lon1") * F.col("scale"), F.col("lat0") * M_PER_DEG, F.col("lat1") * M_PER_DEG
    moved = _settled(pair, F.col("a"), F.col("b"), F.col("from_t"), F.col("to_t"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("u"), (y1 - y0).alias("v"))
    q2, q1 = F.col("u") * F.col("u") + F.col("v") * F.col("v"), F.col("x") * F.col("u") + F.col("y") * F.col("v")
    q0 = F.col("x") * F.col("x") + F.col("y") * F.col("y") - max_separation_m * max_separation_m
    root = F.sqrt(F.greatest(F.lit(0.0), q1 * q1 - q2 * q0))
    still = q2 < 1e-9
    begin = F.when(still, 0.0).otherwise(F.greatest(F.lit(0.0), (-q1 - root) / q2))
    end = F.when(still, 1.0).otherwise(F.least(F.lit(1.0), (-q1 + root) / q2))
    best = F.when(still, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -q1 / q2)))
    least = F.hypot(F.col("x") + best * F.col("u"), F.col("y") + best * F.col("v"))
    span = F.col("to_t") - F.col("from_t")
    close = _settled(moved, F.col("a"), F.col("b"), F.col("from_t"), span.alias("span"), begin.alias("begin"), end.alias("end"), least.alias("min_m"))
    begin, end, span = F.col("begin"), F.col("end"), F.col("span")
    return (close.where(F.col("min_m") <= max_separation_m)
            .select("a", "b", (F.col("from_t") + F.round(begin * span).cast("bigint")).alias("from_us"), (F.col("from_t") + F.round(end * span).cast("bigint")).alias("to_us"), "min_m"))


def rendezvous(reports: DataFrame, max_separation_m: float = 500.0, min_duration_s: float = 1800.0, slack_s: float = 60.0, slot_us: int = 600 * US,
               cell_deg: float = 0.05, max_gap_s: float = C.MAX_GAP_S, hot_rows: int = 20_000) -> DataFrame:
    """(a, b, start_us, end_us, duration_s, min_m, n_contacts): two platforms within reach of each other for a while.

    Contacts of a pair that follow within ``slack_s`` are one meeting; a pair has one contact at most for each slot and step.
    """
    found = contacts(motion_pieces(reports, slot_us, max_gap_s), max_separation_m, cell_deg, hot_rows)
    order = Window.partitionBy("a", "b").orderBy("from_us", "to_us")
    reached = F.max("to_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.when(F.col("from_us") <= reached + int(slack_s * US), 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = island.groupBy("a", "b", "_i").agg(F.min("from_us").alias("start_us"), F.max("to_us").alias("end_us"), F.min("min_m").alias("min_m"), F.count(F.lit(1)).alias("n_contacts"))
    duration = (F.col("end_us") - F.col("start_us")) / US
    return met.withColumn("duration_s", duration).where(F.col("duration_s") >= min_duration_s).select("a", "b", "start_us", "end_us", "duration_s", "min_m", "n_contacts")

"""Agency declarations over time: digests, changes, ledgers and feed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgap.functions.classes import rolling_end, stable_id, version_verdict
from plotgap.functions.geo import buffer_box, crosses_ray, segments_meet
from plotgap.plans.sequence import chunk_of, with_previous

CHUNK = 1_000_000


def claim_text(event_id: Column, start: Column, end: Column, rest: Sequence[Column], open_ended: Column) -> Column:
    """Canonical text of one declared event: stable id, rolling ends folded, churn fields left out."""
    closes = F.when(open_ended & rolling_end(start, end), F.lit("open-ended")).otherwise(end.cast("string"))
    return F.concat_ws("|", stable_id(event_id), start.cast("string"), closes, *rest)


def claim_digest(claims: DataFrame, keys: Sequence[str], text: str = "claim") -> DataFrame:
    """Order-insensitive SHA-256 of the claims of one body.

    Each claim is hashed where it lies, so a body travels as one short hash per event.
    """
    hashed = claims.select(*keys, F.sha2(text, 256).alias("h"))
    return hashed.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("content"),
                                     F.count(F.lit(1)).alias("n_events"))


def claim_changes(ledger: DataFrame) -> DataFrame:
    """Each answered row against the feed's previous answer."""
    answered = ledger.where(F.col("body").isNotNull())
    rows = with_previous(answered, ["feed"], ["event_id"], ["content", "body"], chunk_of("event_id", CHUNK))
    change = (F.when(F.col("prev_body").isNull(), "first seen").when(F.col("body") == F.col("prev_body"), "unchanged")
              .when(F.col("content").eqNullSafe(F.col("prev_content")), "envelope only").otherwise("content changed"))
    return rows.withColumn("change", change).drop("prev_content", "prev_body")


def cycle_summary(ledger: DataFrame) -> DataFrame:
    """Counts of one cycle and the flags a reader must act on."""
    marked = ledger.join(claim_changes(ledger).select("event_id", "change"), "event_id", "left").withColumn(
        "_v", version_verdict("version_declared", "version_registry"))
    n = F.col("n_events")
    out = marked.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("n_attempted"), F.count_if("returned").alias("n_returned"), F.count("n_events").alias("n_counted"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n_events_total"), F.max(n).alias("events_max"),
        F.count_if(F.col("change") == "content changed").alias("n_changed"), F.count_if(F.col("change") == "envelope only").alias("n_envelope_only"),
        F.count_if(F.col("change") == "first seen").alias("n_first_seen"), F.count_if(F.col("_v") == "disagrees").alias("n_disagree"),
        F.count_if(F.col("outcome") == "truncated").alias("n_truncated"))
    flags = F.when(F.col("n_attempted") == 0, F.array(F.lit("NO FEEDS ATTEMPTED"))).when(
        F.col("n_returned") == 0, F.array(F.lit("NOTHING RETURNED"))).otherwise(F.array_compact(F.array(
            F.when(F.col("n_counted") == 0, "NOTHING COUNTABLE"),
            F.when((F.col("n_changed") > 0) & (F.col("n_changed") / F.col("n_returned") >= 0.95), "NEARLY EVERY FEED REFRESHED"),
            F.when(F.col("n_disagree") > 0, "VERSION DISAGREEMENT"), F.when(F.col("n_truncated") > 0, "TRUNCATED BY OUR OWN CAP"))))
    return out.withColumn("flags", F.array_join(flags, ","))


def blind_feeds(ledger: DataFrame) -> DataFrame:
    """Feeds attempted but never once answering."""
    return ledger.groupBy("feed").agg(F.count(F.lit(1)).alias("n_attempted"), F.count_if("returned").alias("_r")).where("_r = 0").drop("_r")


def _compared(ledger: DataFrame) -> DataFrame:
    """Answered rows after each feed's first one, which is only its baseline."""
    return claim_changes(ledger).where("change <> 'first seen'")


def decorative_feeds(ledger: DataFrame, min_cycles: int = 3) -> DataFrame:
    """Feeds whose bytes keep moving while their events never do."""
    got = _compared(ledger).groupBy("feed").agg(F.count_if(F.col("change") == "envelope only").alias("n_envelope"),
                                               F.count_if(F.col("change") == "content changed").alias("n_real"))
    return got.where((F.col("n_envelope") >= min_cycles) & (F.col("n_real") == 0)).select("feed", "n_envelope")


def envelope_rate(ledger: DataFrame) -> DataFrame:
    got = _compared(ledger).groupBy("feed").agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (
        ("envelope only", "envelope_only"), ("content changed", "real"), ("unchanged", "unchanged"))])
    answered = F.col("envelope_only") + F.col("real") + F.col("unchanged")
    return got.withColumn("answered", answered).withColumn("rate", F.col("envelope_only") / F.nullif(answered, F.lit(0)))


# ---- feed selection ----------------------------------------------------------------------


def states_touched(boxes: DataFrame, edges: DataFrame, key: str = "feed_id") -> DataFrame:
    """(feed, state) where a box overlaps a state polygon; edges(state, x0, y0, x1, y1).

    The polygon bounds prefilter through coarse one-degree tiles (an equi-join); the exact
    test is edge against box, box corner inside polygon, or polygon inside box.
    """
    def tiles(a, b, c, d):
        return (F.explode(F.sequence(F.floor(a), F.floor(b))), F.explode(F.sequence(F.floor(c), F.floor(d))))
    bounds = edges.groupBy("state").agg(F.min(F.least("x0", "x1")).alias("bx0"), F.max(F.greatest("x0", "x1")).alias("bx1"),
                                        F.min(F.least("y0", "y1")).alias("by0"), F.max(F.greatest("y0", "y1")).alias("by1"),
                                        F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    bt = bounds.withColumn("_tx", tiles("bx0", "bx1", "by0", "by1")[0]).withColumn("_ty", tiles("bx0", "bx1", "by0", "by1")[1])
    ft = boxes.withColumn("_tx", tiles("lon0", "lon1", "lat0", "lat1")[0]).withColumn("_ty", tiles("lon0", "lon1", "lat0", "lat1")[1])
    near = (ft.join(bt.select("state", "_tx", "_ty"), ["_tx", "_ty"]).select(key, "state").distinct()
            .join(boxes, key).join(bounds.select("state", "edges"), "state"))
    b = [F.col(c) for c in ("lon0", "lat0", "lon1", "lat1")]
    sides = [(b[0], b[1], b[2], b[1]), (b[2], b[1], b[2], b[3]), (b[2], b[3], b[0], b[3]), (b[0], b[3], b[0], b[1])]

    def touches(s):
        within = s["x0"].between(b[0], b[2]) & s["y0"].between(b[1], b[3])
        out = within
        for side in sides:
            out = out | segments_meet(s["x0"], s["y0"], s["x1"], s["y1"], *side)
        return out
    corner_in = F.size(F.filter("edges", lambda s: crosses_ray(b[0], b[1], s["x0"], s["y0"], s["x1"], s["y1"]))) % 2 == 1
    return near.where(F.exists("edges", touches) | corner_in).select(key, "state")


def box_touches_state(feeds: DataFrame, edges: DataFrame, buffer_m: float, max_box_km: float, skipped: Sequence[str],
                      by_hand: DataFrame | None = None) -> DataFrame:
    """Selection of feeds whose buffered box crosses a state line, with the reason for every other."""
    w = (F.col("lon1") - F.col("lon0")) * 111.195 * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2))
    h = (F.col("lat1") - F.col("lat0")) * 111.195
    usable = F.coalesce(F.greatest(w, h) <= max_box_km, F.lit(False))
    grown = buffer_box("lon0", "lat0", "lon1", "lat1", buffer_m)
    boxed = feeds.where(usable).select("feed_id", *[grown[c].alias(c) for c in ("lon0", "lat0", "lon1", "lat1")])
    hits = states_touched(boxed, edges).groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("n_states"), F.count_if(F.col("state").isin(list(skipped))).alias("n_skipped"))
    rows = feeds.withColumn("_usable", usable).join(hits, "feed_id", "left").fillna(0, ["n_states", "n_skipped"])
    if by_hand is not None:
        rows = rows.join(F.broadcast(by_hand.select("feed_id", F.col("decision").alias("_hand"))), "feed_id", "left")
    else:
        rows = rows.withColumn("_hand", F.lit(None).cast("string"))
    verdict = (F.when(~F.col("_usable") & F.col("_hand").isNotNull(), F.col("_hand")).when(~F.col("_usable"), "undecided: no usable box")
               .when(F.col("n_skipped") > 0, "excluded: touches a skipped state").when(F.col("n_states") >= 2, "selected")
               .when(F.col("n_states") == 1, "excluded: one state only").otherwise("excluded: touches no state"))
    return rows.select("feed_id", "n_states", verdict.alias("verdict"))


def same_agency_dedupe(selected: DataFrame, decisions: DataFrame) -> DataFrame:
    """Agencies with several selected feeds keep what a decision table says; undecided ones are named."""
    agency = F.lower(F.trim(F.coalesce("provider", F.lit(""))))
    rows = selected.withColumn("agency", agency)
    many = rows.groupBy("agency").agg(F.count(F.lit(1)).alias("n_feeds"))
    got = rows.join(many, "agency").join(F.broadcast(decisions.select("agency", "keep_feed", "keep_all")), "agency", "left")
    status = (F.when(F.col("n_feeds") < 2, "kept").when(F.col("keep_all"), "kept")
              .when(F.col("keep_feed").isNull(), "UNDECIDED").when(F.col("keep_feed") == F.col("feed_id"), "kept")
              .otherwise("duplicate of the kept feed"))
    return got.select("feed_id", "agency", "n_feeds", status.alias("status"))


def feed_registry_select(registry: DataFrame) -> DataFrame:
    """First failing rule per catalogue row; 'selected' and 'credentialed' are outcomes of the same chain."""
    def truth(c):
        v = F.lower(F.trim(F.col(c)))
        return F.when(v.isin("true", "t", "yes", "y", "1"), True).when(v.isin("false", "f", "no", "n", "0"), False)
    lo_x, lo_y, hi_x, hi_y = [F.col(c).try_cast("double") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    box = (F.when(lo_x.isNull() | lo_y.isNull() | hi_x.isNull() | hi_y.isNull(), "box missing")
           .when((lo_x < -180) | (hi_x > 180) | (lo_y < -90) | (hi_y > 90), "box out of range")
           .when((lo_x >= hi_x) | (lo_y >= hi_y), "box inverted"))
    rule = (F.when(truth("active").isNull(), "active flag not in the vocabulary").when(~truth("active"), "inactive")
            .when(~F.coalesce(F.lower(F.col("format")), F.lit("")).isin("geojson", "json"), "format")
            .when(~F.coalesce(F.col("version"), F.lit("")).isin("4", "4.1", "4.2"), "version")
            .when(F.coalesce("url", F.lit("")) == "", "no url").when(F.coalesce(truth("need_key"), F.lit(False)), "credentialed")
            .otherwise("selected"))
    return registry.withColumn("rule", rule).withColumn("box_problem", box)


def workzones_in_view(zones: DataFrame, view: tuple[float, float, float, float], limit: int = 4000) -> DataFrame:
    """Zones whose bounds meet the view, most recently updated first."""
    lon0, lat0, lon1, lat1 = view
    hit = zones.where((F.col("lon0") <= lon1) & (F.col("lon1") >= lon0) & (F.col("lat0") <= lat1) & (F.col("lat1") >= lat0))
    return hit.orderBy(F.desc("updated"), "zone_id").limit(limit)



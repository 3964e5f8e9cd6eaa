"""Classification rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotgap import constants as C
from plotgap.functions.geo import col


def binned(value, edges: list[tuple[float | None, str]], missing: str | None = None) -> Column:
    """First (upper edge, name) whose edge lies above the value; null keeps ``missing``."""
    v = col(value)
    out = F.when(v.isNull(), F.lit(missing))
    for hi, name in edges:
        out = out.when(v < hi, F.lit(name)) if hi is not None else out.otherwise(F.lit(name))
    return out


def one_decimal(value) -> Column:
    """Text of a non-negative number with one decimal, as C's %.1f: no grouping, the exact binary value rounded half to even."""
    v = col(value)
    whole, scale = F.floor(v).cast("bigint"), 1 << 58
    tenfold = ((v - F.floor(v)) * F.lit(float(scale))).cast("bigint") * F.lit(10)  # exact from 1/64 on, and less prints as 0.0
    down, left = F.shiftright(tenfold, 58), tenfold.bitwiseAND(F.lit(scale - 1))
    up = (left > scale // 2) | ((left == scale // 2) & (down % 2 == 1))
    tenths = down + up.cast("int")
    full = tenths == 10
    return F.concat((whole + full.cast("int")).cast("string"), F.lit("."), F.when(full, 0).otherwise(tenths).cast("string"))


def distance_band(d_m) -> Column:
    """Band of distance to a limit; null distance means beyond the search range."""
    nm = col(d_m) / C.NM_M
    out = F.when(nm.isNull(), F.lit(C.BAND_NAMES[-1]))
    for hi, name in zip(C.BAND_EDGES_NM[1:], C.BAND_NAMES):
        out = out.when(nm < hi, F.lit(name))
    return out.otherwise(F.lit(C.BAND_NAMES[-1]))


def signed_band(d_self, d_companion, outer_companion: bool) -> Column:
    """Side-aware band; the companion limit lying outside (or inside) decides the side.

    A null distance stands for 'beyond the search range' and is treated as infinite.
    """
    inf = F.lit(float("inf"))
    me, other = F.coalesce(col(d_self), inf), F.coalesce(col(d_companion), inf)
    sep = C.COMPANION_SEPARATION_NM * C.NM_M
    seaward = ((other <= sep) | (other < me)) if outer_companion else ((other >= sep) & (other > me))
    nm = F.when(seaward, me).otherwise(-me) / C.NM_M
    out = F.when(nm <= C.SIGNED_EDGES_NM[0], F.lit(C.SIGNED_NAMES[0])).when(
        nm >= C.SIGNED_EDGES_NM[-1], F.lit(C.SIGNED_NAMES[-1]))
    for hi, name in zip(C.SIGNED_EDGES_NM[1:], C.SIGNED_NAMES[1:]):
        out = out.when(nm < hi, F.lit(name))
    return out.otherwise(F.lit(C.SIGNED_NAMES[-1]))


def near_signed_bands(near_nm: float) -> list[str]:
    """Signed bands lying wholly inside +/- near_nm."""
    edges = list(zip(C.SIGNED_EDGES_NM, C.SIGNED_EDGES_NM[1:], C.SIGNED_NAMES[1:-1]))
    return [name for lo, hi, name in edges if abs(lo) <= near_nm and abs(hi) <= near_nm]


def altitude_band(alt_m, on_ground) -> Column:
    return F.when(col(on_ground), F.lit(C.GROUND)).otherwise(binned(alt_m, C.ALTITUDE_BANDS))


def length_class(length) -> Column:
    v = F.when(col(length) > 0, col(length))
    return binned(v, [(C.DETECTABLE_LENGTH_M, "<25 m"), (None, ">=25 m")], "unknown length")


def length_bin(length) -> Column:
    return binned(F.when(col(length) > 0, col(length)), C.LENGTH_CURVE, "unknown")


def miss_bucket(length) -> Column:
    """Length bucket of a missed vessel; a length equal to the default counts as unknown."""
    v = F.when((col(length) > 0) & (col(length) != C.DEFAULT_LENGTH_M), col(length))
    return binned(v, C.MISS_BUCKETS, "unknown")


def vessel_subtype(code) -> Column:
    c = col(code)
    out = F.when(c.isNull() | (c == 0), F.lit("unknown"))
    for lo, hi, name in C.VESSEL_TYPES:
        out = out.when(c.between(lo, hi), F.lit(name))
    return out.otherwise(F.lit("other"))


def reception_class(n_vessels, n_gaps, median_gap) -> Column:
    n = F.coalesce(col(n_vessels), F.lit(0))
    return (F.when(n == 0, "unheard")
            .when((n < C.MIN_VESSELS) | (F.coalesce(col(n_gaps), F.lit(0)) == 0), "thin")
            .when(col(median_gap) <= C.LONG_GAP_S, "heard").otherwise("intermittent"))


def air_reception_class(n_aircraft, n_present, n_polls) -> Column:
    n = F.coalesce(col(n_aircraft), F.lit(0))
    return (F.when(n == 0, "unheard").when(n < C.MIN_VESSELS, "thin")
            .when(col(n_polls).isNull() | (col(n_polls) == 0), "intermittent")
            .when(col(n_present) / col(n_polls) >= C.MIN_PRESENCE, "heard").otherwise("intermittent"))


def neighbour_class(n, n_heard, n_intermittent) -> Column:
    return (F.when(F.coalesce(col(n), F.lit(0)) == 0, "unheard")
            .when(col(n_heard) * 2 >= col(n), "heard")
            .when((col(n_heard) > 0) | (col(n_intermittent) > 0), "intermittent")
            .otherwise("thin"))


def wilson(found, n, z: float = 1.96, empty: str = "null") -> Column:
    """struct(lo, hi) of the 95% score interval; with no trials (null, null) or (0, 1)."""
    k, m = col(found).cast("double"), F.nullif(col(n).cast("double"), F.lit(0.0))
    p = k / m
    denom = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / denom
    lo, hi = F.when(m.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(
        m.isNotNull(), F.least(F.lit(1.0), centre + half))
    if empty == "unit":
        lo, hi = F.coalesce(lo, F.lit(0.0)), F.coalesce(hi, F.lit(1.0))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def chance_match(radius_m, density_per_km2) -> Column:
    r = col(radius_m) / 1000.0
    return 1.0 - F.exp(-(col(density_per_km2)) * F.lit(3.141592653589793) * r * r)


def max_scorable_radius_m(density_per_km2) -> Column:
    d = F.nullif(col(density_per_km2), F.lit(0.0))
    return 1000.0 * F.sqrt(-F.log(F.lit(1.0 - C.MAX_CHANCE_MATCH)) / (F.lit(3.141592653589793) * d))


def altitude_ft(text) -> Column:
    """Integer feet from a text altitude; 'ground' and junk become null."""
    return F.expr(f"try_cast({text} as int)") if isinstance(text, str) else text.try_cast("int")


def kinematic_confidence(ratio) -> Column:
    r = col(ratio)
    return F.when(r <= C.TOLERANCE, F.lit(0.0)).otherwise(
        F.least(F.lit(0.95), 0.5 + 0.225 * (r - C.TOLERANCE)))


def stable_id(value) -> Column:
    """Strip a trailing ten-digit generation stamp when it is a plausible epoch."""
    v = col(value)
    pattern = r"^(.+?)[-_:.](\d{10})$"
    stamp = F.regexp_extract(v, pattern, 2)
    ok = (stamp != "") & stamp.try_cast("bigint").between(1_500_000_000, 2_500_000_000)
    return F.when(ok, F.regexp_extract(v, pattern, 1)).otherwise(v)


def rolling_end(start_ts, end_ts) -> Column:
    """More than three years (plus a day) between start and end."""
    return F.coalesce(F.datediff(col(end_ts), col(start_ts)) > 3 * 365 + 1, F.lit(False))


# The registry's shorthand for a published version.
SPEC_FROM_REGISTRY = {"4": "4.0"}


def canonical_version(v) -> Column:
    """Version text in the specification's own notation; never a number."""
    out = col(v)
    for short, full in SPEC_FROM_REGISTRY.items():
        out = F.when(out == short, F.lit(full)).otherwise(out)
    return out


def version_verdict(declared, registry) -> Column:
    d, r = col(declared), col(registry)
    return (F.when(d.isNull(), "absent").when(r.isNull(), "registry-silent")
            .when(d == r, "agrees")
            .when(canonical_version(d) == canonical_version(r), "agrees-by-alias")
            .otherwise("disagrees"))


# Specification versions whose events may be counted.
KNOWN_SPEC_VERSIONS = ["4.0", "4.1", "4.2"]


def feed_outcome(status, body, version, truncated) -> Column:
    """First matching outcome of one feed attempt."""
    s, b = col(status), col(body)
    head = F.lower(F.ltrim(F.substring(b, 1, 512)))
    parsed = F.expr(f"try_parse_json({body})") if isinstance(body, str) else F.try_parse_json(b)
    feats = F.try_variant_get(parsed, "$.features", "array<variant>")
    return (F.when(col(truncated), "truncated")
            .when(s.isNull() | b.isNull() | ~s.between(200, 299), "http_error")
            .when(head.startswith("<!doctype html") | head.startswith("<html"), "not_wzdx")
            .when(parsed.isNull(), "not_json")
            .when(feats.isNull(), "not_wzdx")
            .when(col(version).isNotNull() & ~canonical_version(version).isin(KNOWN_SPEC_VERSIONS),
                  "version_unknown")
            .otherwise("ok"))


def candidate_band(nm) -> Column:
    return (F.when(col(nm).isNull(), "unknown").when(col(nm) <= 2.0, "<=2nm")
            .when(col(nm) <= 10.0, "2-10nm").otherwise(">10nm"))


def candidate_strength(snr, min_snr: float) -> Column:
    return F.when(F.coalesce(col(snr), F.lit(0.0)) < min_snr * 1.35, "at-gate").otherwise("clear")


def agreement_gloss(k) -> Column:
    v = col(k)
    tail = " agreement, on Landis & Koch's conventional bands"
    return (F.when(v >= 0.81, "almost perfect" + tail).when(v >= 0.61, "substantial" + tail)
            .when(v >= 0.41, "moderate" + tail).when(v >= 0.21, "fair" + tail)
            .when(v >= 0.0, "slight" + tail).otherwise("worse than chance"))


def shift_verdict(p, p_control) -> Column:
    """Reading of the shift test for candidates against the control group."""
    return (F.when(col(p).isNull(), "not tested")
            .when((col(p) <= 0.05) & (col(p_control) > 0.05), "candidates depart, control does not")
            .when((col(p) <= 0.05) & (col(p_control) <= 0.05), "both depart: shared geography")
            .when(col(p_control) <= 0.05, "control departs, candidates do not: a measured absence")
            .otherwise("nothing survives displacement"))


def chip_reading(near_x, chip_x, peak_off_m, near_m: float) -> Column:
    """First reading of a chip from its brightness near the point and anywhere."""
    return (F.when(col(near_x).isNull() | F.isnan(col(near_x)), "no data")
            .when(col(near_x) >= 8, "bright target at the candidate")
            .when((col(chip_x) >= 8) & (col(peak_off_m) > near_m), "bright elsewhere in the chip")
            .otherwise("nothing bright -- clutter?"))


# Position feed types by what they are.
REPORT_TYPES = ["adsb_icao", "adsb_icao_nt", "adsb_other", "adsr_icao", "adsr_other", "adsc"]
OBSERVATION_TYPES = ["mlat", "tisb_icao", "tisb_trackfile", "tisb_other"]
NO_POSITION_TYPES = ["mode_s", "other"]


def position_source_class(kind) -> Column:
    """Self report, third-party observation, no position at all, or unknown."""
    k = col(kind)
    return (F.when(k.isin(OBSERVATION_TYPES), "observation").when(k.isin(REPORT_TYPES), "report")
            .when(k.isin(NO_POSITION_TYPES), "no position").otherwise("unknown"))


def quota_credits(area_sqdeg) -> Column:
    """Tier price of one request by box area in square degrees."""
    a = col(area_sqdeg)
    return F.when(a <= 25, 1).when(a <= 100, 2).when(a <= 400, 3).otherwise(4)

"""Air study."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.operators import air as A
from plotgap.plans.reuse import pin

C, R = "CAST(floor(lon/0.05e0) AS BIGINT)", "CAST(floor(lat/0.05e0) AS BIGINT)"
UN = f"""un AS (SELECT {C} AS col, {R} AS row, CASE WHEN TRY_CAST(alt_baro AS INTEGER)<10000 THEN '<10k' ELSE '>=10k' END AS band, day, count(*) FILTER (WHERE type='adsb_icao') AS coop,
  count(*) FILTER (WHERE type IN ('mlat', 'mode_s')) AS ind, count(*) FILTER (WHERE type LIKE 'tisb%') AS tisb FROM aircraft WHERE TRY_CAST(alt_baro AS INTEGER) IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("air_units", f"WITH {UN} SELECT * FROM un")
def air_units(t):
    return A.air_units(t.aircraft)


DM = f"dm AS (SELECT DISTINCT {C} AS col, {R} AS row FROM aircraft WHERE type IN ('mlat', 'mode_s'))"


@query("direct_mask", f"WITH {DM} SELECT * FROM dm")
def direct_mask(t):
    return A.direct_mask(t.aircraft)


CM = """cm AS (SELECT DISTINCT CAST(floor((lon+(nx-lon)*i/n)/0.05e0) AS BIGINT) AS col, CAST(floor((lat+(ny-lat)*i/n)/0.05e0) AS BIGINT) AS row FROM (SELECT *, unnest(range(0, n+1)) AS i FROM (
  SELECT *, CAST(floor(least(greatest(greatest(abs(nx-lon), abs(ny-lat))/0.025e0, 1), 400)) AS BIGINT) AS n FROM (SELECT lon, lat, t_us, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny, lead(t_us) OVER w AS nt
   FROM aircraft WHERE type IN ('mlat', 'mode_s') WINDOW w AS (PARTITION BY hex ORDER BY t_us, lon, lat, event_id)) WHERE nt-t_us>0 AND nt-t_us<={gap})))"""
GAP = 3600


@query("continuity_mask", f"WITH {CM.format(gap=GAP * 1000000)} SELECT * FROM cm")
def continuity_mask(t):
    # the derived aircraft are seen rarely, so a wider gap than the default is bridged
    return A.continuity_mask(t.aircraft, GAP)


MK = f"""{UN}, {DM}, {CM.format(gap=GAP * 1000000)}, mk AS (SELECT col, row, CASE WHEN EXISTS (SELECT 1 FROM dm WHERE dm.col=h.col AND dm.row=h.row) THEN 'direct' WHEN EXISTS (SELECT 1 FROM cm WHERE cm.col=h.col AND cm.row=h.row) THEN 'inferred'
  ELSE 'blind' END AS cover FROM (SELECT col, row FROM un GROUP BY 1, 2 HAVING sum(coop)>0) h)"""


def mask(t):
    return A.mask_algebra(A.air_units(t.aircraft), A.direct_mask(t.aircraft), A.continuity_mask(t.aircraft, GAP))


@query("mask_algebra", f"WITH {MK} SELECT * FROM mk")
def mask_algebra(t):
    return mask(t)


VEIL = 15.0
SD = f"""{MK}, sd AS (SELECT col, row, sn, CASE WHEN sn>=0 THEN 'outside' ELSE 'inside' END AS side FROM (SELECT col, row, (SELECT min({d.flat('(mk.row+0.5e0)*0.05e0', '(mk.col+0.5e0)*0.05e0', 'a.lat', 'a.lon')}) FROM airports a)/1852-{VEIL}e0 AS sn FROM mk WHERE cover<>'blind'))"""


def sides(t):
    return A.boundary_side(mask(t).where("cover <> 'blind'"), t.airports, VEIL)


@query("boundary_side", f"WITH {SD} SELECT col, row, round(sn, 6) AS signed_nm, side FROM sd")
def boundary_side(t):
    return sides(t).select("col", "row", F.round("signed_nm", 6).alias("signed_nm"), "side")


FLOOR = 20
GM = f"""{SD}, gm AS (SELECT band, side, avg(ind/(ind+coop)) AS mean_share, sum(ind)/sum(ind+coop) AS pooled_share, count(*) AS n_units FROM {{u}} JOIN sd USING (col, row) WHERE coop>={FLOOR} GROUP BY 1, 2),
  dd AS (SELECT lo-li AS treatment_step, ho-hi AS control_step, lo-li-(ho-hi) AS did FROM (SELECT max(mean_share) FILTER (WHERE band='<10k' AND side='outside') AS lo, max(mean_share) FILTER (WHERE band='<10k' AND side='inside') AS li,
   max(mean_share) FILTER (WHERE band='>=10k' AND side='outside') AS ho, max(mean_share) FILTER (WHERE band='>=10k' AND side='inside') AS hi FROM gm))"""
FLAT = "(SELECT col, row, band, CAST(sum(coop) AS BIGINT) AS coop, CAST(sum(ind) AS BIGINT) AS ind FROM un GROUP BY 1, 2, 3)"


@query("difference_in_differences", f"WITH {GM.format(u='un')} SELECT round(treatment_step, 9) AS treatment_step, round(control_step, 9) AS control_step, round(did, 9) AS did FROM dd")
def difference_in_differences(t):
    x = A.difference_in_differences(A.air_units(t.aircraft), sides(t), FLOOR)
    return x.select(*[F.round(c, 9).alias(c) for c in ("treatment_step", "control_step", "did")])


@query("air_group_means", f"WITH {GM.format(u='un')} SELECT band, side, round(mean_share, 9) AS mean_share, round(pooled_share, 9) AS pooled_share, n_units FROM gm")
def air_group_means(t):
    kept = A.air_units(t.aircraft).where(F.col("coop") >= FLOOR).join(sides(t).select("col", "row", "side"), ["col", "row"])
    return A.group_means(kept).withColumn("mean_share", F.round("mean_share", 9)).withColumn("pooled_share", F.round("pooled_share", 9))


@query("day_collapsed", f"WITH {GM.format(u=FLAT)} SELECT round(treatment_step, 9) AS treatment_step, round(control_step, 9) AS control_step, round(did, 9) AS did FROM dd")
def day_collapsed(t):
    x = A.difference_in_differences(A.day_collapsed(A.air_units(t.aircraft)), sides(t), FLOOR)
    return x.select(*[F.round(c, 9).alias(c) for c in ("treatment_step", "control_step", "did")])


T1, T2 = 60, 40
NL = f"""{GM.format(u='un')}, cs AS (SELECT col, row, band, sum(ind/(ind+coop)) AS s, count(*) AS n FROM un JOIN sd USING (col, row) WHERE coop>={FLOOR} GROUP BY 1, 2, 3),
  ex AS (SELECT max(col)-min(col) AS wc, max(row)-min(row) AS wr, count(*) FILTER (WHERE side='outside') AS n_out FROM sd),
  sl AS (SELECT trial, col, row, CASE WHEN row_number() OVER (PARTITION BY trial ORDER BY {d.u('an', 'trial', 'col', 'row')}, col, row)<=(SELECT n_out FROM ex) THEN 'outside' ELSE 'inside' END AS side FROM sd, range(1, {T1 + 1}) a(trial)),
  mo AS (SELECT trial, CAST(floor({d.u('an', "'c'", 'trial')}*(2*wc+1)) AS BIGINT)-wc AS dc, CAST(floor({d.u('an', "'r'", 'trial')}*(2*wr+1)) AS BIGINT)-wr AS dr FROM ex, range(1, {T2 + 1}) a(trial)),
  hl AS (SELECT trial, sd.col, sd.row, coalesce(z.side, sd.side) AS side FROM sd, mo LEFT JOIN sd z ON z.col=sd.col+dc AND z.row=sd.row+dr),
  tr AS (SELECT 'a' AS w, * FROM sl UNION ALL SELECT 'b', * FROM hl), tg AS (SELECT w, trial, band, side, sum(s)/sum(n) AS m FROM tr JOIN cs USING (col, row) GROUP BY 1, 2, 3, 4),
  td AS (SELECT w, trial, round((max(m) FILTER (WHERE band='<10k' AND side='outside')-max(m) FILTER (WHERE band='<10k' AND side='inside'))-(max(m) FILTER (WHERE band='>=10k' AND side='outside')-max(m) FILTER (WHERE band='>=10k' AND side='inside')), 6) AS v FROM tg GROUP BY 1, 2),
  nl AS (SELECT (SELECT did FROM dd) AS did, count(*) FILTER (WHERE w='a' AND abs(v)>=abs((SELECT round(did, 6) FROM dd))) AS scattered_k, count(*) FILTER (WHERE w='a') AS scattered_trials,
   count(*) FILTER (WHERE w='b' AND abs(v)>=abs((SELECT round(did, 6) FROM dd))) AS shift_k, count(*) FILTER (WHERE w='b') AS shift_trials FROM td)"""


def nulls(t):
    return A.air_nulls(pin(A.air_units(t.aircraft)), sides(t), FLOOR, T1, T2, "an")


@query("air_nulls", f"WITH {NL} SELECT round(did, 9) AS did, scattered_k, scattered_trials, shift_k, shift_trials, (scattered_k+1)/(scattered_trials+1) AS scattered_p, (shift_k+1)/(shift_trials+1) AS shift_p FROM nl")
def air_nulls(t):
    return nulls(t).withColumn("did", F.round("did", 9))


@query("air_verdict", f"WITH {NL} SELECT CASE WHEN did<=0 THEN 'REFUTED: the difference is not positive' WHEN (shift_k+1)/(shift_trials+1)>0.05 THEN 'REFUTED: positive, but a displaced boundary reproduces it' ELSE 'SUPPORTED: positive and survives the shift null' END AS verdict FROM nl")
def air_verdict(t):
    return A.air_verdict(nulls(t)).select("verdict")


@query("channel_tally", "SELECT poll, type, count(*) AS n_fixes, count(DISTINCT hex) AS n_craft FROM aircraft WHERE lon BETWEEN -75.5e0 AND -73.5e0 AND lat BETWEEN 36.8e0 AND 38.2e0 GROUP BY 1, 2")
def channel_tally(t):
    return A.channel_tally(t.aircraft, (-75.5, 36.8, -73.5, 38.2))

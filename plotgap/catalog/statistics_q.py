"""Boundary statistics."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.operators import boundary as S
from plotgap.plans.reuse import pin
from plotgap.plans.nearest import nearest_line as near_line

SETS = ["L3", "L12", "L24", "L200", "any"]
COMP = {"L12": ("L24", True), "L24": ("L12", False)}


def segs(t):
    return S.with_pool(t.segments, ["L12", "L24", "L200"])


SG = """sg AS (SELECT line_set, x0, y0, x1, y1 FROM segments UNION ALL SELECT 'any', x0, y0, x1, y1 FROM segments WHERE line_set IN ('L12','L24','L200'))"""


def near_sql(name, pts, key, pre=""):
    """The plain minimum over all segments."""
    return f"""{name} AS (SELECT p.{key}, line_set, min({d.seg('p.lon', 'p.lat', 'x0', 'y0', 'x1', 'y1')}) AS d_m FROM {pts} p, sg GROUP BY 1, 2)"""


def band_sql(name, pts, key):
    """<name>(key, limit, band) for all sets and signed pairs."""
    wide = f"{name}_w AS (SELECT p.{key}, " + ", ".join(f"max(d_m) FILTER (WHERE line_set='{s}') AS d_{s}" for s in SETS) + f" FROM {pts} p LEFT JOIN {name}_n n ON p.{key}=n.{key} GROUP BY 1)"
    items = " UNION ALL ".join(
        [f"SELECT {key}, '{s}' AS lim, {d.band('d_' + s)} AS band FROM {name}_w" for s in SETS]
        + [f"SELECT {key}, '{s} (signed)', {d.signed('d_' + s, 'd_' + c, o)} FROM {name}_w" for s, (c, o) in COMP.items()])
    return f"{near_sql(name + '_n', pts, key)}, {wide}, {name} AS ({items})"


@query("nearest_line", f"WITH {SG}, {near_sql('nn', 'observations', 'obs_id')} SELECT obs_id, line_set, round(d_m, 3) AS d_m FROM nn")
def nearest_line(t):
    return near_line(t.observations, segs(t), "obs_id").withColumn("d_m", F.round("d_m", 3))


@query("limit_set_assembly", """SELECT line_set, count(*) AS n, round(sum(x0), 6) AS sx FROM (SELECT CASE WHEN line_set='L3' AND j%2=0 THEN NULL ELSE line_set END AS line_set, x0, j FROM segments) WHERE line_set IS NOT NULL AND j%6<>5 AND j%6<>4 GROUP BY 1
    UNION ALL SELECT 'any', count(*), round(sum(x0), 6) FROM segments WHERE line_set<>'L3' AND j%6<>5 AND j%6<>4""")
def limit_set_assembly(t):
    ls, j = F.col("line_set"), F.col("j")
    def flag(s):
        return F.when(ls == s, "1.00000000").otherwise("0.00000000")
    f = t.segments.select(
        F.when(ls == "L3", F.when(j % 2 == 0, "unnamed").otherwise("State Seaward line")).when(ls == "L200", "EEZ outer").otherwise("limit").alias("name"),
        F.when(j % 6 == 5, "Polygon").otherwise("LineString").alias("kind"), F.lit("").alias("flag_3"), flag("L12").alias("flag_12"), flag("L24").alias("flag_24"),
        F.lit(None).cast("string").alias("flag_200"), F.when(j % 6 == 4, "1.0").alias("land"), "x0", "y0", "x1", "y1")
    kept, _ = S.limit_sets(f)
    return S.with_pool(kept, ["L12", "L24", "L200"]).groupBy("line_set").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x0"), 6).alias("sx"))


BC = f"{SG}, {band_sql('cb', 'candidates', 'obs_id')}, bc AS (SELECT lim, matched, day, band, count(*) AS n FROM cb JOIN candidates USING (obs_id) GROUP BY 1, 2, 3, 4)"
BA = f"""sc AS (SELECT day, col || ':' || row AS cell, (col+0.5e0)*5e-2 AS lon, (row+0.5e0)*5e-2 AS lat, 0.05e0*111.195e0*0.05e0*111.195e0*cos(radians((row+0.5e0)*0.05e0))*level/10e0 AS km2 FROM searched WHERE level>=5),
  sd2 AS (SELECT DISTINCT cell, lon, lat FROM sc), {band_sql('ab', 'sd2', 'cell')}, ba AS (SELECT lim, day, band, sum(km2) AS km2 FROM sc JOIN ab USING (cell) GROUP BY 1, 2, 3)"""
EX = f"""{BC}, {BA}, ex AS (SELECT lim, matched, band, sum(np*km2/kp) AS expected, sum(km2) AS km2 FROM ba JOIN (SELECT lim, day, sum(km2) AS kp FROM ba GROUP BY 1, 2) USING (lim, day)
  JOIN (SELECT lim, matched, day, sum(n) AS np FROM bc GROUP BY 1, 2, 3) USING (lim, day) GROUP BY 1, 2, 3),
 oe AS (SELECT ex.*, CAST(coalesce(observed, 0) AS BIGINT) AS observed FROM ex LEFT JOIN (SELECT lim, matched, band, sum(n) AS observed FROM bc GROUP BY 1, 2, 3) USING (lim, matched, band)),
 ch AS (SELECT lim, matched, sum(pow(observed-expected, 2)/expected) AS chi2 FROM oe WHERE expected>0 GROUP BY 1, 2)"""


def counts(t):
    c = t.candidates
    return S.band_counts(c, "obs_id", S.banded(c, "obs_id", segs(t), SETS, COMP))


def area(t):
    return S.band_area(t.searched, segs(t), SETS, COMP)


def table(t):
    c = pin(counts(t))
    return S.observed_expected(c, S.expectation(c, pin(area(t))))


@query("band_counts", f"WITH {BC} SELECT lim AS \"limit\", matched, day, band, n FROM bc")
def band_counts(t):
    return counts(t)


@query("band_area", f"WITH {SG}, {BA} SELECT lim AS \"limit\", day, band, round(km2, 6) AS km2 FROM ba")
def band_area(t):
    return area(t).withColumn("km2", F.round("km2", 6))


@query("stratified_expectation", f"WITH {EX} SELECT lim AS \"limit\", matched, band, observed, round(expected, 6) AS expected, round(km2, 3) AS km2 FROM oe")
def stratified_expectation(t):
    return table(t).withColumn("expected", F.round("expected", 6)).withColumn("km2", F.round("km2", 3))


@query("chi_square", f"WITH {EX} SELECT lim AS \"limit\", matched, round(chi2, 6) AS chi2 FROM ch")
def chi_square(t):
    return S.chi_square(table(t), ["limit", "matched"]).withColumn("chi2", F.round("chi2", 6))


@query("band_ratios", f"WITH {EX} SELECT lim AS \"limit\", matched, band, round(observed/nullif(expected, 0), 6) AS ratio FROM oe")
def band_ratios(t):
    return S.band_ratios(table(t)).select("limit", "matched", "band", F.round("ratio", 6).alias("ratio"))


TR = 2000
SC = f"""{EX}, cdf AS (SELECT lim, day, band, sum(km2) OVER (PARTITION BY lim, day ORDER BY band) AS upto, sum(km2) OVER (PARTITION BY lim, day) AS top FROM ba),
  th AS (SELECT lim, matched, day, trial, i, {d.u('sc', 'lim', 'matched', 'day', 'trial', 'i')} AS u FROM (SELECT lim, matched, day, CAST(sum(n) AS BIGINT) AS np FROM bc GROUP BY 1, 2, 3) JOIN (SELECT DISTINCT lim, day FROM ba) USING (lim, day), range(1, {TR + 1}) a(trial), LATERAL (SELECT unnest(range(1, np+1)) AS i)),
  la AS (SELECT lim, matched, trial, th.day, i, min(band) AS band FROM th JOIN cdf USING (lim, day) WHERE upto>u*top GROUP BY 1, 2, 3, 4, 5),
  si AS (SELECT lim, matched, trial, band, count(*) AS sim FROM la GROUP BY 1, 2, 3, 4),
  sx AS (SELECT lim, matched, trial, sum(pow(coalesce(sim, 0)-expected, 2)/expected) AS chi2 FROM ex CROSS JOIN range(1, {TR + 1}) a(trial) LEFT JOIN si USING (lim, matched, trial, band) WHERE expected>0 GROUP BY 1, 2, 3)"""


@query("scattered_null", f"WITH {SC} SELECT lim AS \"limit\", matched, count(*) FILTER (WHERE sx.chi2>=ch.chi2) AS k, count(*) AS trials, round(any_value(ch.chi2), 6) AS chi2, (count(*) FILTER (WHERE sx.chi2>=ch.chi2)+1)/(count(*)+1) AS p FROM sx JOIN ch USING (lim, matched) GROUP BY 1, 2")
def scattered_null(t):
    return S.scattered_null(counts(t), area(t), TR, "sc").withColumn("chi2", F.round("chi2", 6))


ST, AT = 10, 4
SH = f"""{EX}, wk AS (SELECT day, col*5+a.x AS kx, row*5+b.x AS ky FROM searched, range(5) a(x), range(5) b(x) WHERE level>=5), wd AS (SELECT DISTINCT kx || ':' || ky AS cell, (kx+0.5e0)*1e-2 AS lon, (ky+0.5e0)*1e-2 AS lat FROM wk),
  {band_sql('wb', 'wd', 'cell')}, pt AS (SELECT matched, day, {d.cell('lon', '1e-2')} AS kx, {d.cell('lat', '1e-2')} AS ky, count(*) AS n FROM candidates GROUP BY 1, 2, 3, 4),
  sz AS (SELECT matched, day, sum(n) AS np FROM pt GROUP BY 1, 2),
  dr AS (SELECT matched, day, trial, attempt, CAST(floor({d.u('sh', "'x'", 'matched', 'day', 'trial', 'attempt')}*121) AS BIGINT)-60 AS dx, CAST(floor({d.u('sh', "'y'", 'matched', 'day', 'trial', 'attempt')}*121) AS BIGINT)-60 AS dy FROM sz, range(1, {ST + 1}) a(trial), range(1, {AT + 1}) b(attempt)),
  mv AS (SELECT dr.*, pt.kx+dx AS kx, pt.ky+dy AS ky, n FROM dr JOIN pt USING (matched, day)),
  ok AS (SELECT mv.matched, mv.day, trial, attempt FROM mv JOIN wk ON mv.day=wk.day AND mv.kx=wk.kx AND mv.ky=wk.ky JOIN sz ON sz.matched=mv.matched AND sz.day=mv.day GROUP BY 1, 2, 3, 4, np HAVING sum(n)>=0.3e0*np),
  fs AS (SELECT matched, day, trial, min(attempt) AS attempt FROM ok GROUP BY 1, 2, 3),
  sm AS (SELECT lim, mv.matched, mv.trial, band, sum(n) AS sim FROM mv JOIN fs USING (matched, day, trial, attempt) JOIN wk ON mv.day=wk.day AND mv.kx=wk.kx AND mv.ky=wk.ky JOIN wb ON wb.cell=mv.kx || ':' || mv.ky GROUP BY 1, 2, 3, 4),
  ns AS (SELECT lim, matched, trial, sum(sim) AS ns FROM sm GROUP BY 1, 2, 3), no AS (SELECT lim, matched, sum(expected) AS no FROM ex GROUP BY 1, 2),
  sy AS (SELECT lim, matched, trial, sum(pow(coalesce(sim, 0)*no/ns-expected, 2)/expected) AS chi2 FROM ex JOIN ns USING (lim, matched) JOIN no USING (lim, matched) LEFT JOIN sm USING (lim, matched, trial, band) WHERE expected>0 GROUP BY 1, 2, 3)"""


@query("shift_null", f"WITH {SH} SELECT lim AS \"limit\", matched, count(*) FILTER (WHERE sy.chi2>=ch.chi2) AS k, count(*) AS trials, round(any_value(ch.chi2), 6) AS chi2, (count(*) FILTER (WHERE sy.chi2>=ch.chi2)+1)/(count(*)+1) AS p FROM sy JOIN ch USING (lim, matched) GROUP BY 1, 2")
def shift_null(t):
    water = S.water_keys(t.searched, segs(t), SETS, COMP, 0.05)
    # the derived water is patchy, so a lower share than the default is asked to stay in it
    return S.shift_null(t.candidates, counts(t), area(t), water, ST, "sh", attempts=AT, keep_share=0.3).withColumn("chi2", F.round("chi2", 6))


@query("untestable", f"WITH {BC} SELECT lim AS \"limit\", CAST(coalesce(sum(n) FILTER (WHERE NOT matched AND band NOT LIKE '>%'), 0) AS BIGINT) AS n_near, CASE WHEN coalesce(sum(n) FILTER (WHERE NOT matched AND band NOT LIKE '>%'), 0)=0 THEN 'no candidate lies within 25 nm of this line' END AS reason FROM bc WHERE lim NOT LIKE '%(signed)' GROUP BY 1")
def untestable(t):
    c = counts(t)
    return S.untestable(c, c.select("limit").distinct())


@query("local_step", f"WITH {BC} SELECT lim AS \"limit\", matched, day, band, n FROM bc WHERE lim LIKE '%(signed)' AND band IN ('-5 to -2 nm', '-2 to -1 nm', '-1 to 0 nm', '0 to 1 nm', '1 to 2 nm', '2 to 5 nm')")
def local_step(t):
    return S.local_step(counts(t), 5.0)


@query("limit_report")
def limit_report(t):
    return S.limit_report(t.candidates, t.searched, segs(t), SETS, COMP, trials=20, shift_trials=10, seed="lr", attempts=4)

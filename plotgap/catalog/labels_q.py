"""Labels, sampling, models and dossiers."""

from pyspark.sql import functions as F

from plotgap.catalog import duck as d
from plotgap.catalog import query
from plotgap.catalog.matching_q import VERD
from plotgap.operators import dossiers as Z
from plotgap.operators import labels as L
from plotgap.operators import models as ML
from plotgap.plans.reuse import pin
from plotgap.plans.sequence import chunk_of

BAND3 = "CASE obs_id%3 WHEN 0 THEN '<=2nm' WHEN 1 THEN '2-10nm' ELSE '>10nm' END"
CD = f"""cd AS (SELECT *, obs_id AS key, {BAND3} AS band, CASE WHEN snr<20.25e0 THEN 'at-gate' ELSE 'clear' END AS strength, ({BAND3}) || '/' || CASE WHEN snr<20.25e0 THEN 'at-gate' ELSE 'clear' END AS stratum FROM candidates),
 vd AS (SELECT obs_id AS key, {VERD} AS verdict, CASE WHEN obs_id%4=0 THEN 'seen' END AS note FROM candidates WHERE obs_id%2=0 OR pixels>20)"""


def cand(t):
    k = F.col("obs_id")
    band = F.when(k % 3 == 0, "<=2nm").when(k % 3 == 1, "2-10nm").otherwise(">10nm")
    strength = F.when(F.col("snr") < 20.25, "at-gate").otherwise("clear")
    return t.candidates.withColumn("key", k).withColumn("band", band).withColumn("strength", strength).withColumn("stratum", F.concat_ws("/", band, strength))


def verd(t):
    k = F.col("obs_id")
    v = F.when(k % 5 == 4, "ambiguous").when(F.col("pixels") + k % 13 >= 22, "vessel").when(k % 2 == 0, "fixed").otherwise("clutter")
    return t.candidates.where("obs_id % 2 = 0 OR pixels > 20").select(k.alias("key"), v.alias("verdict"), F.when(k % 4 == 0, "seen").alias("note"))


@query("labels_last_wins", "SELECT key, verdict FROM (SELECT user_id AS key, event_type AS verdict, event_id FROM e) QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC)=1")
def labels_last_wins(t):
    lines = t.e.select(F.col("user_id").alias("key"), F.col("event_type").alias("verdict"), F.col("event_id").alias("seq"))
    return L.labels_last_wins(lines).select("key", "verdict")


@query("stratified_sample", f"""WITH {CD}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum, day ORDER BY {d.u('ss', 'obs_id')}, obs_id) AS rd FROM cd)
    SELECT stratum, day, obs_id, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rd, day, obs_id) AS pick FROM r) WHERE pick<=25""")
def stratified_sample(t):
    return L.stratified_sample(cand(t), 25, "ss").select("stratum", "day", "obs_id", "pick")


@query("review_draw", f"""WITH {CD}, r AS (SELECT key, CASE WHEN band='<=2nm' THEN 'near' ELSE 'rest' END AS grp FROM cd WHERE key NOT IN (SELECT key FROM vd))
    SELECT key, grp FROM r QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {d.u('rd', 'key')}, key)<=CASE WHEN grp='near' THEN 30 ELSE 60 END""")
def review_draw(t):
    return L.review_draw(cand(t), verd(t), 30, 60, "rd").select("key", "grp")


KP = """kp AS (SELECT n, po AS observed, pe AS expected, CASE WHEN pe<1 THEN (po-pe)/(1-pe) END AS kappa, CASE WHEN pe<1 THEN sqrt(po*(1-po)/(n*(1-pe)*(1-pe))) END AS se FROM (SELECT (SELECT count(*) FROM pp) AS n, (SELECT count(*) FILTER (WHERE a=b)/count(*) FROM pp) AS po,
  (SELECT sum(x.n*y.n) FROM (SELECT a, count(*) AS n FROM pp GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM pp GROUP BY 1) y ON a=b)/pow((SELECT count(*) FROM pp), 2) AS pe))"""
GLOSS = "CASE WHEN kappa IS NULL THEN NULL WHEN kappa>=0.81e0 THEN 'almost perfect' WHEN kappa>=0.61e0 THEN 'substantial' WHEN kappa>=0.41e0 THEN 'moderate' WHEN kappa>=0.21e0 THEN 'fair' WHEN kappa>=0 THEN 'slight' END"
KOUT = f"SELECT n, round(observed, 9) AS observed, round(expected, 9) AS expected, round(kappa, 9) AS kappa, round(se, 9) AS se, CASE WHEN kappa<0 THEN 'worse than chance' ELSE {GLOSS} || ' agreement, on Landis & Koch''s conventional bands' END AS gloss FROM kp"


def rounded(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("kappa", f"WITH pp AS (SELECT a, b FROM verdicts), {KP} {KOUT}")
def kappa(t):
    return rounded(L.kappa(t.verdicts), "observed", "expected", "kappa", "se")


@query("kappa_merged", f"WITH pp AS (SELECT CASE WHEN a='fixed' THEN 'vessel' ELSE a END AS a, CASE WHEN b='fixed' THEN 'vessel' ELSE b END AS b FROM verdicts), {KP} {KOUT}")
def kappa_merged(t):
    return rounded(L.kappa(t.verdicts, {"fixed": "vessel"}), "observed", "expected", "kappa", "se")


@query("confusion_matrix", "SELECT a, b, count(*) AS n FROM verdicts GROUP BY 1, 2")
def confusion_matrix(t):
    return L.confusion_matrix(t.verdicts)


@query("disagreements", "SELECT doc_id, a, b FROM verdicts WHERE a<>b")
def disagreements(t):
    return L.disagreements(t.verdicts).select("doc_id", "a", "b")


STB = "sb AS (SELECT round, CASE WHEN band='<=2nm' THEN '<=2nm' ELSE '>2nm' END AS grp, count(*) AS n, avg(CASE WHEN a=b THEN 1 ELSE 0 END) AS agree FROM verdicts GROUP BY 1, 2)"


@query("reader_stability", f"WITH {STB} SELECT round, grp, n, round(agree, 9) AS agree FROM sb")
def reader_stability(t):
    return rounded(L.reader_stability(t.verdicts), "agree")


@query("reader_drift", f"WITH {STB} SELECT round(f, 9) AS first, round(l, 9) AS last, rounds, round((l-f)*100, 6) AS change_points, abs(l-f)*100>=10 AS unstable FROM (SELECT arg_min(agree, round) AS f, arg_max(agree, round) AS l, count(*) AS rounds FROM sb WHERE grp='>2nm')")
def reader_drift(t):
    return rounded(rounded(L.reader_drift(L.reader_stability(t.verdicts)), "first", "last"), "change_points", n=6)


SR = f"""{CD}, sr AS (SELECT stratum, count(*) AS population, count(*) FILTER (WHERE verdict='vessel') AS vessel, count(*) FILTER (WHERE verdict IN ('vessel', 'clutter', 'fixed')) AS labelled,
  count(*) FILTER (WHERE verdict='ambiguous') AS excluded FROM cd LEFT JOIN vd USING (key) GROUP BY 1)"""


def rates(t):
    return L.stratum_rates(cand(t), verd(t))


@query("stratum_rates", f"WITH {SR} SELECT *, round(vessel/nullif(labelled, 0), 9) AS rate FROM sr")
def stratum_rates(t):
    return rounded(rates(t), "rate")


PC = f"{SR}, pc AS (SELECT cd.* FROM cd JOIN sr USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {d.u('pc', 'key')}, key)<=round_even(coalesce(vessel/nullif(labelled, 0), 1)*population, 0))"


@query("point_correction", f"WITH {PC} SELECT key, stratum FROM pc")
def point_correction(t):
    return L.point_correction(cand(t), rates(t), "pc").select("key", "stratum")


@query("beta_replicates")
def beta_replicates(t):
    return L.beta_replicates(cand(t), L.beta_draws(rates(t), 50, "br"), "br")


def published(t):
    return cand(t).groupBy("band").agg(F.count(F.lit(1)).alias("observed"), (F.sum("pixels") / 20.0).alias("expected"))


PUB = "pb AS (SELECT band, count(*) AS observed, sum(pixels)/20e0 AS expected FROM cd GROUP BY 1)"


@query("corrected_point_ratios", f"WITH {PC}, {PUB} SELECT 0 AS replicate, pb.band, round((SELECT count(*) FROM pc WHERE pc.band=pb.band)/(expected*(SELECT count(*) FROM pc)/(SELECT sum(observed) FROM pb)), 9) AS ratio FROM pb")
def corrected_point_ratios(t):
    kept = L.point_correction(cand(t), rates(t), "pc").groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("replicate", F.lit(0))
    return rounded(L.corrected_ratios(kept, published(t)), "ratio")


@query("corrected_ratios")
def corrected_ratios(t):
    kept = L.beta_replicates(cand(t), L.beta_draws(rates(t), 50, "br"), "br")
    return L.ratio_interval(L.corrected_ratios(kept, published(t)))


@query("extreme_near_ratio", f"WITH {CD}, {PUB}, k AS (SELECT * FROM cd WHERE band='<=2nm' OR strength='clear') SELECT count(*) AS n, count(*) FILTER (WHERE band='<=2nm') AS n_near, round(count(*) FILTER (WHERE band='<=2nm')/((SELECT expected FROM pb WHERE band='<=2nm')*count(*)/(SELECT sum(observed) FROM pb)), 9) AS ratio FROM k")
def extreme_near_ratio(t):
    return rounded(L.extreme_near_ratio(cand(t).withColumn("coarse", F.col("band")), published(t), ["<=2nm"]), "ratio")


@query("even_sample", """WITH r AS (SELECT obs_id, row_number() OVER (ORDER BY obs_id)-1 AS i, count(*) OVER () AS n FROM candidates)
    SELECT obs_id FROM r WHERE i IN (SELECT CAST(round_even(s*((SELECT count(*) FROM candidates)/40e0), 0) AS BIGINT) FROM range(40) x(s))""")
def even_sample(t):
    return L.even_sample(t.candidates, 40, ["obs_id"], chunk_of("obs_id", 100_000)).select("obs_id")


@query("label_queue", f"""WITH {CD} SELECT key, round({d.u('lq', 'key')}, 9) AS shuffle FROM cd WHERE key NOT IN (SELECT key FROM vd)
    AND EXISTS (SELECT 1 FROM cd h WHERE abs(h.lat-cd.lat)<1e-4 AND {d.hav('cd.lat', 'cd.lon', '(h.lat+(h.key%4)*5e-6)', 'h.lon')}<=1) ORDER BY shuffle, key""")
def label_queue(t):
    c = cand(t)
    chips = c.select(F.col("key").alias("chip"), "lon", (F.col("lat") + (F.col("key") % 4) * 5e-6).alias("lat"))  # half of them too far away
    return rounded(L.label_queue(c, chips, verd(t), c.select("key"), "lq").select("key", "shuffle"), "shuffle")


@query("label_progress", f"""WITH {CD} SELECT stratum, coalesce(verdict, 'unread') AS verdict, count(*) AS n, count(*) FILTER (WHERE verdict IN ('ambiguous', 'fixed') AND coalesce(trim(note), '')='') AS n_without_note FROM cd LEFT JOIN vd USING (key) GROUP BY 1, 2""")
def label_progress(t):
    return L.label_progress(cand(t), verd(t))


FEATURES = ["snr_x", "pixels_x", "confidence"]


def featured(t):
    c = cand(t).withColumn("snr_x", F.when(F.col("key") % 11 != 0, F.col("snr"))).withColumn("pixels_x", F.col("pixels").cast("double"))
    return c


def labelled(t):
    v = verd(t).where("verdict IN ('vessel', 'clutter', 'fixed')").select("key", (F.col("verdict") == "vessel").cast("double").alias("y"))
    return featured(t).join(v, "key")


@query("vessel_classifier")
def vessel_classifier(t):
    rows = pin(labelled(t))
    scores = ML.cross_validate(rows, "logistic", FEATURES, folds=3, repeats=1).unionByName(ML.cross_validate(rows, "forest", FEATURES, folds=3, repeats=1, trees=10))
    return ML.pick_best(scores)


@query("threshold_table", f"""WITH {CD}, s AS (SELECT CASE WHEN verdict='vessel' THEN 1 ELSE 0 END AS y, least(1e0, pixels/40e0) AS p FROM cd JOIN vd USING (key) WHERE verdict<>'ambiguous'),
    g AS (SELECT threshold, count(*) FILTER (WHERE p>=threshold AND y=1) AS tp, count(*) FILTER (WHERE p>=threshold AND y=0) AS fp, count(*) FILTER (WHERE p<threshold AND y=1) AS fn, count(*) FILTER (WHERE p<threshold AND y=0) AS tn FROM s, (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) AS threshold) GROUP BY 1)
    SELECT *, round(tp/nullif(tp+fp, 0), 9) AS precision, round({d.wilson('tp', '(tp+fp)', 'lo')}, 9) AS precision_lo, round({d.wilson('tp', '(tp+fp)', 'hi')}, 9) AS precision_hi, round(tp/nullif(tp+fn, 0), 9) AS recall, round({d.wilson('tp', '(tp+fn)', 'lo')}, 9) AS recall_lo, round({d.wilson('tp', '(tp+fn)', 'hi')}, 9) AS recall_hi FROM g""")
def threshold_table(t):
    s = labelled(t).select("y", F.least(F.lit(1.0), F.col("pixels") / 40.0).alias("p"))
    return rounded(ML.threshold_table(s), "precision", "precision_lo", "precision_hi", "recall", "recall_lo", "recall_hi")


@query("leakage_test")
def leakage_test(t):
    return ML.leakage_test(featured(t), FEATURES, folds=3, trees=10, kind="logistic")


@query("score_candidates")
def score_candidates(t):
    return ML.score_candidates(featured(t), labelled(t), "logistic", FEATURES).select("obs_id", "p_vessel")


DOS = f"""{CD}, nr AS (SELECT obs_id, min(dm) AS report_m FROM (SELECT c.obs_id, {d.hav('c.lat', 'c.lon', 'r.lat', 'r.lon')} AS dm FROM candidates c JOIN reports r ON abs(r.t_us-t_scene_us)<=1800000000) WHERE dm<=10000 GROUP BY 1),
 ds AS (SELECT cd.obs_id, cd.reception, cd.band, abs(cd.lat-37.2e0)*60 AS nm, least(1e0, cd.pixels/40e0)*CASE WHEN cd.reception='heard' THEN 1 ELSE 0 END*(1-CASE WHEN obs_id%4=0 THEN least(1e0, (obs_id%6+1-1)/4e0) ELSE 0 END)
   *CASE WHEN report_m IS NULL THEN 1e0 ELSE least(1e0, report_m/200e0/20e0) END AS strength FROM cd LEFT JOIN nr USING (obs_id))"""


def dossiers(t):
    from plotgap.operators.matching import nearest_report
    c = (cand(t).withColumn("search_radius_m", F.lit(200.0)).withColumn("p_vessel", F.least(F.lit(1.0), F.col("pixels") / 40.0))
         .withColumn("nm", F.abs(F.col("lat") - 37.2) * 60))
    site = c.where("obs_id % 4 = 0").select("obs_id", F.lit(10.0).alias("distance_m"), (F.col("obs_id") % 6 + 1).alias("n_dates"))
    return Z.dossier_strength(c.drop("strength"), nearest_report(t.candidates, t.reports, "t_scene_us"), site)


@query("dossier_strength", f"WITH {DOS} SELECT obs_id, round(strength, 9) AS strength FROM ds")
def dossier_strength(t):
    return rounded(dossiers(t).select("obs_id", "strength"), "strength")


@query("ranking_bias", f"""WITH {DOS}, r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY round(strength, 9) DESC, obs_id)<=100 THEN 'top' ELSE 'rest' END AS part FROM ds)
    SELECT part, count(*) AS n, round(avg(CASE WHEN band='<=2nm' THEN 1 ELSE 0 END), 9) AS near, round(avg(CASE WHEN band='2-10nm' THEN 1 ELSE 0 END), 9) AS mid, round(avg(CASE WHEN band='>10nm' THEN 1 ELSE 0 END), 9) AS far,
    round((SELECT corr(round(strength, 9), nm) FROM ds), 6) AS pearson FROM r GROUP BY 1""")
def ranking_bias(t):
    x = Z.ranking_bias(rounded(dossiers(t), "strength"))
    return rounded(rounded(x, "near", "mid", "far"), "pearson", n=6)


@query("dossier_listing", f"""WITH {DOS} SELECT obs_id, round(strength, 9) AS strength, (SELECT count(*) FROM ds WHERE round(strength, 9)>=0.1e0 AND reception IN ('heard')) AS n_hits FROM ds WHERE round(strength, 9)>=0.1e0 AND reception IN ('heard') ORDER BY round(ds.strength, 9) DESC, obs_id LIMIT 50 OFFSET 50""")
def dossier_listing(t):
    x = Z.dossier_listing(rounded(dossiers(t), "strength"), 0.1, ["heard"], 50, 50)
    return x.select("obs_id", "strength", "n_hits")


@query("dossier_facets", f"WITH {CD} SELECT 'band' AS facet, band AS value, count(*) AS n FROM cd GROUP BY 2 UNION ALL SELECT 'reception', reception, count(*) FROM cd GROUP BY 2")
def dossier_facets(t):
    return Z.facet_counts(cand(t))

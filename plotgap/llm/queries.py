"""The operators bound to their whole tables, with production parameters; and their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotgap.llm import clustering, jaccard, mixing, packing, phrases, pii, ppm, quality, secret_scan, simhash, substring, topk, toxicity
from plotgap.llm.base import crc_remainder, table


QUALITY = {"alpha": 0.05, "delta": 0.1, "price": 5.0}
PII_KEY = "pseudonyms of the registered query"
MIX = {"target_entropy": 0.9, "max_repeats": 2.0}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.kept_words(table(spark, sf_dir, "documents"), min_words=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.col("longest").alias("longest_removed"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **QUALITY)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), threshold=0.75)


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Model:
    learn = crc_remainder("doc_id", 5) != 0
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("spans").alias("n_spans"),
                         F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("offsets"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def told(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    counts = [_count("spans", k) for k in secret_scan.KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)
    return done.select("doc_id", *[_count("pii", k) for k in pii.KINDS], "text")


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 7) != 2)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), most=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), top=2000, least=30, longest=4, scale=2_000_000, share=80)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, width=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_secret_scan": op8_secret_scan,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_ppm_scoring": op10_ppm_scoring,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLE: dict[str, str] = {}

ORACLE["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_KEYED = "CAST('0x' || substr(md5(concat_ws('|', 'mix', {})), 1, 15) AS BIGINT)"

ORACLE["op7_temperature_mixing"] = f"""
WITH RECURSIVE c AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k,
         CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS BIGINT) AS n
  FROM documents GROUP BY ALL),
s AS (SELECT k, CAST(sum(n) AS BIGINT) AS t FROM c GROUP BY k),
l AS (SELECT list(CAST(t AS DOUBLE) / total ORDER BY k) AS shares, list(CAST(t AS DOUBLE) ORDER BY k) AS ts
      FROM s, (SELECT sum(t) AS total FROM s) WHERE t > 0),
h AS (  -- entropy and repeats as functions of the exponent are written out at each use
  SELECT 0 AS i, 0e0 AS lo, 1e0 AS hi, 0e0 AS rlo, 1e0 AS rhi
  UNION ALL
  SELECT i + 1,
    CASE WHEN eg THEN (lo + hi) / 2 ELSE lo END, CASE WHEN eg THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN rg THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN rg THEN rhi ELSE (rlo + rhi) / 2 END
  FROM (SELECT h.*,
      list_sum(list_transform(shares, lambda x: -(pow(x, (lo + hi) / 2) / list_sum(list_transform(shares, lambda y: pow(y, (lo + hi) / 2))))
        * ln(pow(x, (lo + hi) / 2) / list_sum(list_transform(shares, lambda y: pow(y, (lo + hi) / 2)))))) >= {MIX['target_entropy']} * ln(len(shares)) - 1e-12 AS eg,
      pow(list_max(ts) / list_min(ts), 1 - (rlo + rhi) / 2) > {MIX['max_repeats']} AS rg
    FROM h, l) WHERE i < 60),
a AS (SELECT CASE WHEN list_sum(list_transform(shares, lambda x: -x * ln(x))) >= {MIX['target_entropy']} * ln(len(shares)) - 1e-12 THEN 1e0
             WHEN pow(list_max(ts) / list_min(ts), 1 - lo) <= {MIX['max_repeats']} THEN lo ELSE rlo END AS a, shares
      FROM h, l WHERE i = 60),
w AS (SELECT k, t, pow(CAST(t AS DOUBLE) / (SELECT sum(t) FROM s), a) / list_sum(list_transform(shares, lambda y: pow(y, a))) AS w
      FROM s, a WHERE t > 0),
p AS (SELECT k, t, greatest(t, CAST(floor(w * (SELECT max(t / w) FROM w) + 0.5) AS BIGINT)) AS b FROM w
      UNION ALL SELECT k, 0, 0 FROM s WHERE t = 0),
f AS (SELECT k, t, b, CASE WHEN t > 0 THEN b // t ELSE 1 END AS whole FROM p),
u AS (SELECT c.*, t, b, whole, epoch, {_KEYED.format("'deal', doc_id")} % greatest(CAST(ceil(t / 1048576e0) AS BIGINT), 1) AS block
      FROM c JOIN f USING (k), range(100) r(epoch) WHERE epoch < whole + CASE WHEN b > whole * t THEN 1 ELSE 0 END),
o AS (SELECT *, {_KEYED.format("'block', k, epoch, block")} AS kb, {_KEYED.format("'document', epoch, doc_id")} AS kd FROM u),
z AS (SELECT *, epoch * t + coalesce(sum(n) OVER (PARTITION BY k, epoch ORDER BY kb, block, kd, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM o)
SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block, CAST(st AS BIGINT) AS start,
       CASE WHEN b > 0 THEN st / CAST(b AS DOUBLE) ELSE 0e0 END AS position
FROM z WHERE st + n <= b
"""

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))"
_GRID = ", ".join(f"('{rule}', {k}, {c}e0)" for rule, grid in quality.GRIDS.items() for k, c in enumerate(grid))

ORACLE["op2_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, text, {_WORDS} AS w, {_LINES} AS l FROM documents),
g AS (SELECT id, i, list_aggregate(w[i:i + 4], 'string_agg', chr(10)) AS gram FROM d, unnest(range(1, len(w) - 3)) r(i) WHERE len(w) >= 5),
c AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM g) WHERE n >= 2),
r AS (SELECT id, count(DISTINCT i + k) AS n FROM c, range(5) r(k) GROUP BY id),
b AS (SELECT d.id, doc_id, lang, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, len(l) AS lines, length(regexp_replace(coalesce(text, ''), '[^A-Z!]', '', 'g')) AS loud
      FROM d LEFT JOIN r USING (id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
v AS (SELECT id, lang, base_failed, doc_id, rule, value FROM (SELECT *, unnest([
        {{'rule': 'symbols', 'value': n_symbols / greatest(n_words, 1)}}, {{'rule': 'dup_lines', 'value': n_dup_lines / greatest(lines, 1)}},
        {{'rule': 'repeats', 'value': n_repeat_words / greatest(n_words, 1)}}, {{'rule': 'shouting', 'value': loud / greatest(word_chars, 1)}},
        {{'rule': 'word_length', 'value': word_chars / greatest(n_words, 1)}}], recursive := true) FROM f)),
q AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
grid(rule, k, cutoff) AS (VALUES {_GRID}),
t AS (SELECT v.lang, v.rule, k, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND value > cutoff) AS x, count(*) FILTER (NOT good AND value > cutoff) AS bad
      FROM v JOIN q USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed GROUP BY ALL),
e AS (SELECT *, n > 0 AND (x < n AND list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({QUALITY['alpha'] / len(quality.GRIDS)!r}) + (n - i) * ln(1 - {QUALITY['alpha'] / len(quality.GRIDS)!r}))))
        <= {QUALITY['delta']!r} / ((SELECT count(DISTINCT coalesce(lang, '')) FROM t) * {len(quality.GRIDS)})) AS ok FROM t),
s AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY k) AS passed, bad - {QUALITY['price']} * x AS gain FROM e),
u AS (SELECT lang, rule, arg_max(cutoff, (gain, -k)) AS cutoff FROM s WHERE passed AND gain > 0 GROUP BY ALL),
z AS (SELECT v.id, string_agg(v.rule, ',' ORDER BY list_position({list(quality.GRIDS)!r}, v.rule)) AS failed_rules
      FROM v JOIN u ON v.rule = u.rule AND v.lang IS NOT DISTINCT FROM u.lang WHERE value > cutoff GROUP BY v.id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM f LEFT JOIN z USING (id)
"""

ORACLE["op12_phrase_collocations"] = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) a(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS n FROM g GROUP BY ALL HAVING count(*) >= 30 OR k = 1),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
h AS MATERIALIZED (SELECT lang, k, phrase, a, i, array_to_string(w[:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM c, range(1, 4) q(i) WHERE i < k),
s AS (SELECT h.lang, h.k, h.phrase, a, i, x.n AS l, y.n AS r, 2000000 * a // (x.n + y.n) AS score
      FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.x JOIN f y ON y.lang = h.lang AND y.phrase = h.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS o FROM c, range(2, 4) u(m), range(1, 4) q(i)
      WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o IS NULL OR 100 * o < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM r JOIN t USING (lang) WHERE rank <= 2000
"""


def _rounds(k: int, rounds: int) -> str:
    """Assignment and integer means, written out round by round."""
    out = ""
    for i in range(rounds + 1):
        out += f"""
a{i} AS MATERIALIZED (SELECT id, c, d FROM (SELECT v.id, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} c)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1),"""
        if i < rounds:
            out += f"""
m{i} AS MATERIALIZED (SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY j) AS e FROM (
         SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (id)) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c)),"""
    return out


ORACLE["op13_centroid_clustering"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS c, e FROM v QUALIFY c < 16),{_rounds(16, 3)}
s AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a3) AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN v USING (id) JOIN s USING (c) JOIN c3 USING (c)
"""

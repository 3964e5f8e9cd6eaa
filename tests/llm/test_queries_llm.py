"""Registered queries against their oracle SQL, and the pipeline against brute force, on the smallest data."""

import collections
import decimal
import math
import tempfile

import duckdb
import pytest

import corpus_pipeline
from plotgap.llm import mixing, toxicity
from plotgap.llm.queries import MIX, ORACLE, QUERIES, toxicity_model
from test_operators_llm import brute_classes, packed_right

FOLDER = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, first = docs.columns, docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = tempfile.mkdtemp(prefix="spark-") + "/out"
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == columns
        kept[name] = docs.collect()
    scores, _ = toxicity.Scorer(toxicity_model(spark, FOLDER))([r.text for r in first])
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r, s in zip(first, scores) if s < 0.5}
    classes = brute_classes([(r.doc_id, r.text) for r in kept["toxicity"]])
    assert sorted(r.doc_id for r in kept["ngram_jaccard_join"]) == sorted({c for _, c in classes.values()})
    left = {r.doc_id: r.text for r in kept["secret_scans"]}
    assert set(left) == {r.doc_id for r in kept["ngram_jaccard_join"]}
    assert all(r.text == left[r.doc_id] or "[SECRET]" in left[r.doc_id] for r in kept["ngram_jaccard_join"])
    uses = collections.Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(kept["secret_scans"], docs.schema), **MIX).collect())
    assert collections.Counter(r.doc_id for r in kept["source_mixing"]) == uses and set(uses) == set(left)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == uses
    assert packed_right(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 1
    assert all(r.length <= 4096 for r in rows)

"""Vessel probability from detection features, with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgap.functions.classes import wilson
from plotgap.plans.ranks import hash_rank, uniform


def pipeline(kind: str, features: list[str], trees: int = 400, leaf: int = 3, seed: int = 7) -> Pipeline:
    """Median imputation, then scaled logistic regression or a forest."""
    filled = [f"{c}_f" for c in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw")]
    if kind == "logistic":
        return Pipeline(stages=[*stages, StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                                LogisticRegression(labelCol="y", regParam=0.01, maxIter=50)])
    return Pipeline(stages=[*stages, RandomForestClassifier(featuresCol="raw", labelCol="y", numTrees=trees, minInstancesPerNode=leaf, maxDepth=8, seed=seed)])


def with_folds(rows: DataFrame, folds: int, repeat: int, key: str = "key") -> DataFrame:
    """Stratified folds: rows of a class are dealt in hash order."""
    ranked = hash_rank(rows, ["y"], uniform(f"fold{repeat}", key), [key], "_rank", chunks=16)
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def cross_validate(rows: DataFrame, kind: str, features: list[str], folds: int = 5, repeats: int = 20, trees: int = 400) -> DataFrame:
    """AUC per (repeat, fold). The loop is over folds, each of which is a distributed fit."""
    auc = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction")
    out = []
    for r in range(repeats):
        dealt = with_folds(rows, folds, r).cache()
        for f in range(folds):
            model = pipeline(kind, features, trees).fit(dealt.where(F.col("fold") != f))
            out.append((kind, r, f, float(auc.evaluate(model.transform(dealt.where(F.col("fold") == f))))))
        dealt.unpersist()
    return rows.sparkSession.createDataFrame(out, "model string, repeat int, fold int, auc double")


def pick_best(scores: DataFrame) -> DataFrame:
    mean = scores.groupBy("model").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd"))
    return mean.orderBy(F.desc("auc"), "model").limit(1)


def out_of_fold(rows: DataFrame, kind: str, features: list[str], folds: int = 5, trees: int = 400) -> DataFrame:
    """Held-out probability of every labelled row."""
    dealt = with_folds(rows, folds, 0)
    parts = []
    for f in range(folds):
        model = pipeline(kind, features, trees).fit(dealt.where(F.col("fold") != f))
        parts.append(model.transform(dealt.where(F.col("fold") == f)).select("key", "y", vector_to_array("probability")[1].alias("p")))
    return reduce(DataFrame.unionByName, parts)


def threshold_table(scored: DataFrame, thresholds=(0.3, 0.5, 0.7)) -> DataFrame:
    """TP, FP, FN, TN with precision and recall and their intervals per threshold."""
    rows = scored.select("y", "p", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    yes, true = F.col("p") >= F.col("threshold"), F.col("y") == 1
    got = rows.groupBy("threshold").agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    pr, rc = wilson("tp", F.col("tp") + F.col("fp"), empty="unit"), wilson("tp", F.col("tp") + F.col("fn"), empty="unit")
    return (got.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("precision_lo", pr["lo"]).withColumn("precision_hi", pr["hi"])
            .withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).withColumn("recall_lo", rc["lo"]).withColumn("recall_hi", rc["hi"]))


def leakage_test(candidates: DataFrame, features: list[str], folds: int = 5, trees: int = 400, kind: str = "forest") -> DataFrame:
    """Can the features alone tell a near-line candidate? Mean AUC over the folds."""
    rows = candidates.withColumn("y", (F.col("band") == "<=2nm").cast("double"))
    return cross_validate(rows, kind, features, folds, 1, trees).agg(F.avg("auc").alias("auc"))


def score_candidates(candidates: DataFrame, labelled: DataFrame, kind: str, features: list[str], trees: int = 400) -> DataFrame:
    """p(vessel) for every candidate from a model fitted on all labels."""
    model = pipeline(kind, features, trees).fit(labelled)
    return model.transform(candidates).withColumn("p_vessel", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction", *[f"{c}_f" for c in features])

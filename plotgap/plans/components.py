"""Connected components by alternating star contraction, cut at checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Only a local master, whose tasks are all here, may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        alone = context.master == "local" or context.master.startswith("local[")
        if named is None and not alone:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's neighbours are re-hung on its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b <= a")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node named by ``edges(a, b)``; component = smallest node.

    Each round is two star contractions and a checkpoint. Neighbour lists are never
    gathered: a node of any degree is handled by a partial ``min`` and a join.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    base = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    nodes = base.select(F.col("a").alias("node")).union(base.select("b")).distinct()
    now, mark = base.where("a <> b"), None
    while True:  # every round shortens the longest chain; the loop ends when nothing moves
        now = _star(_star(now, large=True), large=False).checkpoint()
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    low = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

"""Streams that need their own staging: late rows, re-baselining and refusals."""

import pytest
from pyspark.sql import functions as F

from plotgap.streaming import jobs as J


def run_batches(spark, tmp_path, frames, build, mode="append"):
    src = str(tmp_path / "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    J.drain(build(J.read_files(spark, src, frames[0].schema)), out, str(tmp_path / "ck"), mode)
    return spark.read.parquet(out)


def test_late_rows_are_set_aside_and_counted(spark, tmp_path):
    day = 86400
    frames = [spark.createDataFrame([("F", t) for t in ts], "feed_id string, mid_s bigint") for ts in ([10, 20], [2 * day], [30, 2 * day + 5])]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    q = (J.read_files(spark, src, frames[0].schema).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
         .foreachBatch(J.cell_hour_batches(out)).start())
    q.awaitTermination()
    assert spark.read.parquet(f"{out}/pairs").count() == 4
    assert spark.read.parquet(f"{out}/late").agg(F.sum("late")).first()[0] == 1


def test_new_digest_version_re_baselines(spark, tmp_path):
    cols = "event_id bigint, feed string, content string, body string"
    first = spark.createDataFrame([(1, "G", "c1", "b1"), (2, "G", "c1", "b2"), (3, "G", "c2", "b3"), (4, "G", "c2", "b3")], cols)
    got = {r["event_id"]: r["change"] for r in run_batches(spark, tmp_path, [first], lambda s: J.claim_change_stream(s, 3)).collect()}
    assert got == {1: "first seen", 2: "envelope only", 3: "content changed", 4: "unchanged"}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(5, "G", "c9", "b9"), (6, "G", "c9", "b10")], cols).coalesce(1).write.mode("append").parquet(src)
    J.drain(J.claim_change_stream(J.read_files(spark, src, first.schema), 4), out, str(tmp_path / "ck"))
    got = {r["event_id"]: r["change"] for r in spark.read.parquet(out).where("event_id > 4").collect()}
    assert got == {5: "re-baselined", 6: "envelope only"}


def test_snapshot_of_another_box_is_refused(spark):
    with pytest.raises(ValueError):
        J.live_filter(spark.range(1), (0, 0, 1, 1), None, 1.0, 60.0, (0.5, 0, 2, 2))
    with pytest.raises(ValueError):
        J.live_filter(spark.range(1), (0, 0, 1, 1), None, 99.0, 60.0, (0, 0, 2, 2))

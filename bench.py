"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = ["sessionise_tracks", "track_summary", "impossible_speed", "identity_collision", "reception_grid", "scene_fixes", "candidate_pairs", "nearest_report",
            "exclusion_ledger", "cell_hours", "slow_anomalies", "band_counts", "air_units", "difference_in_differences", "clutter_ring_stats", "cluster_pixels",
            "maximum_matching", "cluster_sites", "cycle_summary", "gate_cost", "shift_null", "scattered_null",
            "vessel_classifier", "corrected_ratios", "dossier_strength", "limit_report",
            "nearest_line", "coverage_gaps", "traffic_exposure", "event_cube", "gi_star", "emerging_hotspots", "loiter", "rendezvous", "orbit_features",
            "rank_candidates", "cross_domain"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from plotgap import catalog
    queries, _ = catalog.load()
    queries["cell_index"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM paths once
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

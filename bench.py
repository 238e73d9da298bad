"""Headline queries timed on one machine; prints one JSON line.

Every query builds its own intermediate tables (nothing is shared between queries). Only
the demo rasters, which stand in for scene files, are written before the clock starts.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sheenwake.plans.catalog import QUERIES  # noqa: E402
from sheenwake.plans.context import RASTERS, Context  # noqa: E402
from sheenwake.session import build_session  # noqa: E402

HEADLINE = [
    "src1_read_ais", "jn1_ais_near_origin", "win2_drop_teleports", "jn2_position_at",
    "agg1_origin_summary", "job1_attribute", "tr3_backtrack", "agg11_heatmap",
    "job3_hindcast_origin", "job5_preprocess_scene", "win10_label_regions", "job4_characterize",
    "job6_score_tiles", "agg16_iou_report", "job8_curate_incidents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    base = Context(spark, sf_dir)
    for name in RASTERS:
        base.t(name)
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        c = Context(spark, sf_dir)
        c._memo.update({k: base.t(k) for k in RASTERS})
        start = time.time()
        QUERIES[name](c).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall-clock of the headline queries",
                      "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()

"""Times the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from kinesift.session import get_spark  # noqa: E402

HEADLINE = [
    "run_segments",
    "sliding_windows",
    "evidence_counts",
    "axis_energy",
    "nearest_centroid",
    "hard_texts_v3",
    "structured_summary",
    "rule_system_m1",
    "control_shuffled",
    "hashed_words",
    "majority_votes",
    "gate_sweep",
    "calibrated_gate",
    "paired_comparison",
    "bootstrap_interval",
    "risk_coverage",
    "probability_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    chosen = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

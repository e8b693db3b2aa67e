"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "file_inventory", "rule_scan_findings", "code_scan_findings", "document_audit", "file_triage", "duplicate_blocks", "validate_reject_reasons",
    "dedup_same_line", "assign_ids", "severity_counts", "category_breakdown", "layer_density", "hotspots", "rule_layer_matrix", "compliance_cube",
    "service_heatmap", "cross_cutting_groups", "families", "gate_tiers", "gate_overall", "readiness_trend", "phase_tasks", "phase_progress",
    "line_relocation", "import_edges", "components", "blast_radius", "reconcile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lintlake.queries import catalogue
    from lintlake.session import session

    spark = session("bench", f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
                                                  "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's machinery on a query that is not timed.
    catalogue.QUERIES["scanner_breakdown"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

One cheap query warms the session up. Then every query runs ``BENCH_RUNS`` times (default 1) into a sink that drops
the rows; the median counts. ``BENCH_QUERIES`` names other queries than the headline ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flipline.plans import registry  # noqa: E402
from flipline.session import local_session  # noqa: E402

HEADLINE = [
    "error_ranking_per_source",
    "ag3_confusion",
    "ag9_threshold_sweep",
    "ag14_category_report",
    "jn1_join_truth",
    "jn3_overlay_patch",
    "an1_propagate_default",
    "an2_propagate_full",
    "an4_infer_boundaries",
    "pr36_parse_version",
    "jn4_resolve_version",
    "jn5_resolve_artifact",
    "jn6_artifact_hints",
    "jn7_match_tag",
    "an6_grid_pairs",
    "an7_main_line",
    "an8_lineage",
    "an9_place_untested",
    "jn9_artifact_summary",
    "jn10_member_stats",
    "jn11_diff_traces",
    "so4_line_changes",
    "pr32_failure_subtype",
    "pr33_normalize_runner_error",
    "ag13_best_test",
    "pr28_search_terms",
    "pr43_signals",
    "tk2_keyword_search",
    "tk3_rank_diff_paths",
    "tk5_best_anchor",
    "pr39_parse_sections",
    "jn21_evidence_for_judgment",
    "ag15_rule_judgment",
    "pr49_predict_label",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    registry.load_all()
    spark = local_session(cpus)
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times: dict[str, float] = {}
    registry.QUERIES["ag3_confusion"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in wanted:
        laps = []
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per headline query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

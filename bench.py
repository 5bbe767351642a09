"""Headline queries, timed once each into a no-op sink: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from diagtab.plans import catalog  # noqa: E402
from diagtab.session import builder  # noqa: E402

HEADLINE = (
    "text_features", "dataset_overview", "split_sentences", "diagram_counts", "extract_relationships", "jaccard",
    "validate", "match_levels", "sentence_stats", "class_attr_bindings", "token_features", "mean_root_distance",
    "extract_association", "summarise", "run_stability", "resume_status", "spearman_matrix", "flatten_chat",
    "coverage_summary", "relationship_bindings", "extract_generalization", "per_element_table", "match_relationships",
    "score_pairs", "wide_record_table", "case_study_rows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = builder("bench", cores, int(cores)).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    available = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    available["run_totals"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up the session
    times = {}
    for name in names:
        started = time.time()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

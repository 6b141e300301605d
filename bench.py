"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quizlake.plans.catalog import QUERIES
from quizlake.session import local_session

HEADLINE = (
    "top_stems", "normalize_ocr", "frequency_keys", "best_frames", "question_flags", "classify_lines",
    "extract_questions", "route_questions", "merge_wrapped_lines", "smart_filter", "log_retention", "upsert_latest",
    "sample_interval", "throttle_latest", "illegal_transitions", "job_with_children", "polished_bank",
    "collapse_jaccard", "validate_replies", "answer_key", "question_bank", "dup_groups_edit", "dedupe_token_sort",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=16)
    QUERIES["recent_jobs"](spark, sf_dir).collect()  # start the JVM and the Python workers
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

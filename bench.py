"""Headline queries, timed one by one from a cold start of their inputs.

Prints one JSON line.  $BENCH_SF_DIR names the tables, $BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "row_date_selection", "claim_attribution", "chronology", "bullet_union", "run_delta",
    "corrections_overlay", "markdown_export", "manifest_score", "product_metrics", "block_types",
    "page_groups", "classification", "section_selection", "cue_fields", "duplicate_report",
    "words_to_lines", "date_find", "role_resolution", "table_rows", "casefile_units",
)


def main() -> None:
    from chronoloom.plans.queries import QUERIES
    from chronoloom.plans.queries.registry import forget
    from chronoloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times = {}
    for name in HEADLINES:
        if only and name not in only:
            continue
        # Nothing is carried over: a query pays for every table it needs.
        forget()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

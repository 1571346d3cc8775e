"""Time the headline queries on whole tables and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and the cores.
Every query runs once to warm up the JVM on the smallest tables, then once measured, to a sink that
keeps nothing; the time includes building the plan and any staged table.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docreview.plans.queries import QUERIES  # noqa: E402
from docreview.session import local_session  # noqa: E402

HEADLINE = [
    "heading_paths", "sections", "doc_freq", "section_scores", "packed_evidence", "packages",
    "reviews", "score_matrix", "expert_totals", "audit_uniform", "live_counters", "pipeline_ranking",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=cores, memory="16g")
    warm = str(Path(folder).parent / "sf0.001")

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    times = {}
    for name in HEADLINE:
        if Path(warm).exists():
            run(name, warm)
        times[name] = run(name, folder)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

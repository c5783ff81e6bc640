"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

#: Each is run once to compile and warm up and then timed once; results go to a sink that keeps nothing.
HEADLINES = [
    "q0", "q1", "q2", "q3", "q4", "q5", "q6", "q7", "q8", "q9", "q10", "q11", "q12", "q13", "q14", "q15", "q16", "q17", "q18", "q19", "q20", "q21", "q22", "q23", "global_aggregate", "group_aggregate", "aggregate_modifiers",
    "grouping_sets", "over_event_time", "over_bounded_range", "temporal_join", "interval_join", "temporal_sort", "bounded_sort", "top_n", "bounded_rank", "match_recognize", "join_multiway", "cumulate_aggregate",
    "session_aggregate", "changelog_normalize",
]


def main() -> None:
    from tidemill.plans import registry
    from tidemill.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus, **{"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='bench-')}"})
    queries, seconds = registry.queries(), {}
    for name in HEADLINES:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()

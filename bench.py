"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs over its whole tables into the no-op sink: once untimed, which
starts and warms the JVM, and once timed. Nothing is cached in between; a time
covers building the plan, planning and running it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from joblattice.plans import bindings  # noqa: E402
from joblattice.plans.queries import QUERIES  # noqa: E402
from joblattice.session import build_session  # noqa: E402

HEADLINE = (
    "dashboard_stats",
    "dashboard_filter",
    "salary_parsed",
    "intake_status",
    "request_normalized",
    "match_candidates",
    "matches_scored",
    "matches_topk",
    "plan_topk",
    "user_dashboard_stats",
    "alerts_new",
    "saved_search_hits",
    "bookmark_state",
    "profile_fold",
    "rate_limited",
    "time_to_first",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    first = {name: run(name) for name in HEADLINE}
    times = {name: run(name) for name in HEADLINE}
    titles = bindings.listings(spark, sf_dir).select("title").distinct().count()
    skill_lists = bindings.profiles(spark, sf_dir).select("skills").distinct().count()
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "first_run": first,
        "distinct_titles": titles,
        "distinct_skill_lists": skill_lists,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

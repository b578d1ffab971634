"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is built, planned and executed completely (written to the no-op sink) once after a warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from matchlake.plans import registry
from matchlake.session import build_session

HEADLINE = [
    "tier_list",
    "champion_stats",
    "matchups",
    "player_summary",
    "player_champion_stats",
    "player_roles",
    "player_activity",
    "activity_insights",
    "player_matches",
    "gold_insights",
    "match_performance",
    "compare_players",
    "compare_timelines",
    "request_window",
    "work_list",
    "participant_rows",
    "timeline_series",
    "match_events",
    "batch_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", partitions=cpus, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["processed_matches"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()

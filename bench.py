"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the cores, BENCH_QUERIES an optional comma-separated choice.
Every query runs once cold and once warm; the warm run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "knn_cosine",
    "knn_sharded",
    "semantic_search",
    "bm25",
    "hash_embed",
    "corpus_parse",
    "analyze_general",
    "ivf_search",
    "recall_at_10",
    "lsh_search",
    "knn_graph",
    "avg_path",
    "shard_by_distance",
    "dpp",
    "feature_log",
    "fbin_roundtrip",
    "upsert_last_wins",
    "requests_per_minute",
    "deltas",
    "rates",
)


def main() -> None:
    from nearfield.plans import catalogue
    from nearfield.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session("bench", cpus, shuffle=int(cpus) if cpus.isdigit() else 8)
    cold, warm = {}, {}
    for name in catalogue.QUERIES if chosen == "all" else names:
        for times in (cold, warm):
            started = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm wall time",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

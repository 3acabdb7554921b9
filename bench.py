"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "gate_input", "segment_long_lines", "rule_hits_en", "topic_counts_en", "merge_intervals", "ip_usage", "global_usage",
    "record_list", "rule_hits_ko", "status_counts_ko", "item_relations_ko",
]


def main() -> None:
    from checks.queries import QUERIES
    from factsieve.session import local_session

    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["gate_input"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
    count = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count()
    rates = {"documents_per_sec": round(count("documents") / seconds["topic_counts_en"], 1),
             "notices_per_sec": round(count("orders") / seconds["status_counts_ko"], 1)}
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "rates": rates, "cpus": CPUS, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

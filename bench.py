"""Times all queries of the library and prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Each query is run in full to a sink that
throws rows away; the time is the better of two runs, after one small query has started the session.
"""

import json
import os
import time

from tidegauge import build_session
from tidegauge.plans.queries import QUERIES
from tidegauge.plans.streams import STREAM_QUERIES

HEADLINE = list(QUERIES)
RUNS = 2
REPEAT_BELOW_SEC = 10
SLOW = {q.__name__ for q in STREAM_QUERIES}  # run once


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run("batch_counts")
    seconds = {}
    for name in HEADLINE:
        first = run(name)
        again = [run(name) for _ in range(RUNS - 1)] if name not in SLOW and first < REPEAT_BELOW_SEC else []
        seconds[name] = round(min(first, *again) if again else first, 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
